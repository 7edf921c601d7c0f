"""Listed groups of duplicated blocks, with and without limits."""

from collections import defaultdict

from linewise.operators.duplicates import duplicate_groups


def test_groups_and_locations_with_and_without_limits(spark):
    rows = [("p", f"f{i % 7}", i, h, h * 2) for h, n in ((1, 30), (2, 5), (3, 5), (4, 1), (5, 2)) for i in range(n)] + [("q", "a", 1, 1, 2), (None, "a", 1, 9, 9), (None, "b", 1, 9, 9)]
    blk = spark.createDataFrame(rows, "project string, path string, line int, h1 long, h2 long")

    def plain(max_groups, max_locations):
        where = defaultdict(list)
        for p, path, line, h1, h2 in rows:
            if p is not None:
                where[p, h1, h2].append((path, line))
        out = []
        for project in ("p", "q"):
            found = sorted((-len(w), min(w), k) for k, w in where.items() if k[0] == project and len(w) > 1)
            for rank, (n, _, k) in enumerate(found[:max_groups], 1):
                shown = sorted(where[k])[:max_locations]
                out.append((project, rank, -n, len(shown), ",".join(f"{a}:{b}" for a, b in shown)))
        return out
    for limits in ((None, None), (2, 3), (None, 3), (3, None)):
        got = sorted(map(tuple, duplicate_groups(blk.filter("project is not null"), *limits).collect()))
        assert got == plain(*limits), limits
    assert duplicate_groups(blk.limit(0)).collect() == []
