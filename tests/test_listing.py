"""The listing's state: a bucket of files costs one read and one write, however many files it has."""

import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from linewise.streaming import stateful


class Held:
    """A list state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(list(self.rows))

    def put(self, rows):
        assert rows
        self.calls += 1
        self.rows = list(rows)

    def clear(self):
        self.rows = []


def listing():
    held = Held()
    it = stateful.Listing()
    it.init(SimpleNamespace(getListState=lambda name, schema: held))
    return it, held


def frame(sights):
    return pd.DataFrame([(p, f, ".c", "C", None if h is None else f"text {h}", 1, pd.Timestamp("2024-01-01"), seen, str(at), None if h is None else str(h))
                         for p, f, seen, at, h in sights],
                        columns=["project", "path", "ext", "language", "content", "size", "mtime", "seen", "at", "hash"])


def changes(it, *frames):
    got = [f for f in it.handleInputRows((0,), iter(frames), None) if len(f)]
    return sorted((r.project or "", r.path, r.change, r.content) for f in got for r in f.itertuples())


def test_a_bucket_is_read_and_written_once():
    it, held = listing()
    many = [("p", f"f{i}", 1, 0, i) for i in range(500)]
    assert len(changes(it, frame(many[:200]), frame(many[200:]))) == 500
    assert held.calls <= 2 and len(held.rows) == 500
    held.calls = 0
    assert changes(it, frame([(*m[:2], 2, *m[3:]) for m in many])) == []  # seen again unchanged: nothing is written
    assert held.calls == 1
    assert {c for _, _, c, _ in changes(it, frame([(*m[:2], 3, 0, None) for m in many]))} == {"removed"}
    assert held.rows == []


def test_changes_are_those_of_each_file_alone():
    rng = random.Random(3)
    it, held = listing()
    known, turn = {}, 0
    for _ in range(40):
        sights = []
        for _ in range(rng.randrange(0, 12)):
            turn += 1
            sights.append((rng.choice(["p", "q", None]), f"f{rng.randrange(6)}", turn, rng.randrange(2), rng.choice([None, -7, 8, 2 ** 62 + 1])))
        want, last = [], {(p, f): (at, h) for p, f, _, at, h in sights}
        for file, (at, h) in last.items():
            if h is None:
                change = "removed" if known.pop(file, None) else None
            else:
                change = None if known.get(file) == (at, h) else "modified" if file in known else "added"
                known[file] = (at, h)
            if change:
                want.append((file[0] or "", file[1], change, None if h is None else f"text {h}"))
        rng.shuffle(sights)
        cut = rng.randrange(0, len(sights) + 1)
        assert changes(it, frame(sights[:cut]), frame(sights[cut:])) == sorted(want)
        assert {(p, f): (at, h) for p, f, at, h in held.rows} == known


def test_sightings_of_a_file_meet_in_one_of_a_fixed_number_of_buckets(spark):
    files = spark.range(6000).select(F.lit("p").alias("project"), F.concat(F.lit("f"), F.col("id") % 3000).alias("path"), F.lit(".c").alias("ext"), F.lit("C").alias("language"),
                                     F.lit("x").alias("content"), F.lit(1).alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(1).alias("seen"))
    rows = stateful.sightings(files)
    assert rows.groupBy("project", "path").agg(F.countDistinct("bucket").alias("n")).filter("n > 1").count() == 0
    assert 500 < rows.select("bucket").distinct().count() <= stateful.BUCKETS
