"""The source tree: names first, content only where it is kept."""

import os

from pyspark.sql import functions as F

from linewise.config import ScanConfig
from linewise.sources import corpus as C

FILES = {
    "a.c": "int a;", "b.txt": "no", "src/x.py": "x=1\n", "src/deep/y.py": "y=2", "src/deep/node_modules/z.js": "bad", "src/deep/ok/w.js": "w",
    "vendor/big.c": "bad " * 1000, "lib/one/p.go": "p", "lib/two/q.GO": "q", "lib/two/vendor": "a file of that name", "lib/two/vendor.c": "v",
    "odd [1]/k*{v}.c": "odd", "vendor/src/m.c": "bad", "only/vendor/n.c": "bad", "deep/a/b/c/d/e.c": "e",
}


def tree(path, files=FILES):
    for name, text in files.items():
        p = path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(path)


def test_only_kept_subtrees_are_read(spark, tmp_path):
    root = tree(tmp_path)
    got = C.scan_source_tree(spark, root, "p", ScanConfig())
    want = {n: t for n, t in FILES.items() if t != "bad" and not t.startswith("bad ") and "." in os.path.basename(n) and not n.endswith(".txt")}
    assert {r.path: r.content for r in got.collect()} == want
    # the content scan's own list of files holds no excluded one and no unknown extension
    read = [f for f in got.inputFiles()]
    assert len(read) == len(want) and not any("vendor/" in f or "node_modules" in f or f.endswith(".txt") for f in read)


def test_whole_clean_subtrees_are_taken_by_their_top(spark, tmp_path):
    root = tree(tmp_path)
    roots = sorted(r.rel for r in C.kept_roots(C.tree_listing(spark, root), ScanConfig().excludes).collect())
    # the root, src, src/deep and only are mixed (an excluded name is below); deep and lib are not
    assert roots == ["a.c", "deep", "lib", "odd [1]", "src/deep/ok", "src/deep/y.py", "src/x.py"]
    assert [r.rel for r in C.kept_roots(C.tree_listing(spark, root + "/deep"), ScanConfig().excludes).collect()] == [""]
    assert [r.rel for r in C.kept_roots(C.tree_listing(spark, root), []).collect()] == [""]


def test_empty_trees_and_projects(spark, tmp_path):
    a, b = tree(tmp_path / "a", {"x.c": "int x;"}), tree(tmp_path / "b", {"vendor/y.c": "bad", "z.txt": ""})
    assert C.scan_source_tree(spark, b).collect() == []
    both = C.multi_project_sources(spark, [("one", a), ("two", b)])
    assert [(r.project, r.path, r.language) for r in both.collect()] == [("one", "x.c", "C")]
    alone = C.multi_project_sources(spark, [], root=a)
    assert [(r.project, r.path) for r in alone.collect()] == [("default", "x.c")]
    assert C.scan_source_tree(spark, a, cfg=ScanConfig(max_file_bytes=3)).select("content", "truncated").collect() == [("int", True)]
    assert both.select(F.count("*")).first()[0] == 1
