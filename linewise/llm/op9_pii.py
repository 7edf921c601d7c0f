"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks.  High-
recall generators propose further, overlapping spans; boosted trees judge them
by format and context, and a threshold calibrated on out-of-fold scores selects
what is added.  Everything stays in the row: matches and the pieces between
them give code-point positions, the trees are literal arrays that an
`aggregate` walks, so there is no shuffle and no Python code on executors.

The trees are fitted from the candidates of all documents (on the driver up to
`max_candidates` of them, else by sums over the executors) with the base checks
as labels; secrets are labelled by a rule of length and alphabet.

Defined results: a null text is an empty text without spans; repeated rows give
equal spans; new columns replace clashing old ones.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.llm import boosting
from linewise.llm.common import drop_new, read, written

MAX_CANDIDATES, FOLDS, PRECISION = 20_000, 5, 0.99  # candidates up to which the trees are fitted on the driver
KINDS = ("email", "ip", "card", "phone")
ADDED = ("email", "number", "secret")
SPAN = "array<struct<start:int,end:int>>"

# Matches start only where a run starts (or right after a match), so that a
# long run without the sign that follows is read once, not once per character.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERN = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATOR = {
    "email": r"(?<![^\s@<>()\[\],;:])[^\s@<>()\[\],;:]++ ?(?:@|\[at\]|\(at\)) ?[^\s@<>()\[\],;:]++",
    "number": r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/=_.-]{8,}+",
}
GUARD = {  # a cheap look that most texts fail
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
}
GUARD_NEW = {
    "email": lambda t: t.contains("@") | t.contains("[at]") | t.contains("(at)"),
    "number": lambda t: t.rlike(r"[0-9](?:[ ().-]{0,2}[0-9]){6}"),
    "secret": lambda t: t.rlike(r"(?i)token|secret|passw|key"),
}


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        def small(part):
            bare = F.ltrim(part, F.lit("0"))
            return (F.length(bare) <= 2) | ((F.length(bare) == 3) & (bare <= "255"))
        return F.forall(F.split(s, r"\."), small)
    d = _digits(s)
    if kind == "card":
        return F.length(d).between(16, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, before, start, end>> of all matches: the pieces between
    matches give the positions (code points), added up once, left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda s, g: F.struct(s.alias("s"), g.alias("before")))
    empty = F.array().cast("array<struct<s:string,before:string,start:int,end:int>>")

    def add(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["s"])
        one = F.struct(x["s"].alias("s"), F.right(x["before"], F.lit(24)).alias("before"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda a: a["out"])


def base_spans(text: Column, kind: str) -> Column:
    hits = F.filter(located(text, PATTERN[kind]), lambda x: _valid(kind, x["s"]))
    only = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return F.when(GUARD[kind](text), only).otherwise(F.array().cast(SPAN))


def features(kind: str, x: Column) -> Column:
    """Format and context of a candidate, as array<double>."""
    s, before = x["s"], x["before"]
    n = F.length(s)
    d = F.length(_digits(s))
    letters = F.length(F.regexp_replace(s, "[^A-Za-z]", ""))
    flag = lambda c: c.cast("int")
    said = r"(?i)(?:phone|tel|call|fax|mobile|card|visa|account|mail|contact|token|secret|passw|key|ssn)"
    parts = [n, d, letters, n - d - letters, F.size(F.split(s, "[^0-9A-Za-z]+")), flag(s.startswith("+")),
             flag(F.call_function("luhn_check", _digits(s)) & (d >= 13)), flag(s.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+$")),
             flag(s.rlike(r"^[A-Za-z0-9._%+-]+ ?[@\[(]")), flag(s.rlike(r"^\(?[0-9]{3}[) .-]")), flag(before.rlike(said + r"\W{0,4}$")),
             flag(before.rlike(r"[0-9A-Za-z.]$")), F.lit(ADDED.index(kind))]
    return F.array(*[F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts])


def candidates(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, f>>."""
    got = F.transform(located(text, GENERATOR[kind]), lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), features(kind, x).alias("f"),
        ((F.length(x["s"]) >= 24) & x["s"].rlike("[0-9]") & x["s"].rlike("[A-Za-z]")).alias("long")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,f:array<double>,long:boolean>>")
    return F.when(GUARD_NEW[kind](text), got).otherwise(none)


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def with_base(df: DataFrame, text_col: str) -> DataFrame:
    """df with __t (the text) and one span array per kind."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = df.withColumn("__t", t)
    return out.select("*", *[base_spans(F.col("__t"), k).alias(f"__{k}") for k in KINDS],
                      F.concat(*[candidates(F.col("__t"), k) for k in ADDED]).alias("__new"))


class Model:
    def __init__(self, trees: boosting.Trees, threshold: float, depth: int):
        self.trees, self.threshold, self.depth = trees, threshold, depth

    def margin(self, f: Column) -> Column:
        """The flattened trees as a literal array, walked level by level."""
        t = self.trees
        lit = F.array(*[F.struct(F.array(*[F.lit(int(i)) for i in a]).alias("feature"),
                                 F.array(*[F.lit(float(min(x, 1e300))) for x in b]).alias("threshold"),
                                 F.array(*[F.lit(float(x)) for x in c]).alias("value"))
                        for a, b, c in zip(t.feature, t.threshold, t.value)])
        steps = F.array(*[F.lit(0)] * self.depth)

        def leaf(tree):
            def down(node, _):
                right = F.get(f, F.get(tree["feature"], node)) > F.get(tree["threshold"], node)
                return 2 * node + 1 + right.cast("int")
            return F.aggregate(steps, F.lit(0), down) - t.feature.shape[1]

        return F.aggregate(lit, F.lit(t.base), lambda acc, tree: acc + F.get(tree["value"], leaf(tree)))


def fit(df: DataFrame, text_col: str = "text", max_candidates: int = MAX_CANDIDATES, trees: int = 16, depth: int = 3) -> Model:
    both = with_base(df.select(F.col(f"`{text_col}`").alias("text")), "text").filter(F.size("__new") > 0)
    spans = F.concat(*[F.col(f"__{k}") for k in KINDS])
    rows = both.select(F.transform("__new", lambda c: F.struct(
        c["f"].alias("f"), F.when(c["kind"] == "secret", c["long"]).otherwise(F.exists(spans, lambda b: _meets(b, c))).alias("y"))
    ).alias("c")).select(F.explode("c").alias("c")).select("c.f", "c.y")
    # candidates that look alike are one row with their number
    rows = written(rows.groupBy("f", "y").agg(F.count("*").alias("n")), "pii-candidates")
    if (rows.agg(F.sum("n")).first()[0] or 0) > max_candidates:
        return _fit_large(rows, trees, depth)
    got = [r for r in rows.orderBy(F.xxhash64("f"), "f", "y").collect() for _ in range(r["n"])]
    x = np.array([r["f"] for r in got]).reshape(-1, 13)
    y = np.array([r["y"] for r in got], dtype=float)
    model = boosting.fit(x, y, trees=trees, depth=depth, rate=0.4)
    # calibration: the lowest out-of-fold probability from which on the precision holds
    fold, p = np.arange(len(y)) % FOLDS, np.zeros(len(y))
    for k in range(FOLDS):
        held = fold == k
        if held.any():
            p[held] = boosting.fit(x[~held], y[~held], trees=trees, depth=depth, rate=0.4).probability(x[held])
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero((right >= PRECISION) & (p[order] > 0.5))
    q = float(p[order][good[-1]]) if len(good) else 2.0
    return _model(model, q, depth)


def _model(trees: boosting.Trees, q: float, depth: int) -> Model:
    """Candidates of probability q or more are added; q above 1: none."""
    return Model(trees, float(np.log(q / (1 - q))) if q < 1 else float("inf") if q > 1 else 30.0, depth)


def _fit_large(rows: DataFrame, trees: int, depth: int) -> Model:
    """The same from (f, y, n) of any number; candidates that look alike share a fold."""
    at = rows.select(F.col("f").alias("x"), F.col("y").cast("double").alias("y"), F.col("n").cast("double").alias("w"),
                     F.pmod(F.xxhash64("f"), F.lit(FOLDS)).cast("int").alias("fold"))
    models, (n, right) = boosting.fit_frame(at, trees=trees, depth=depth, rate=0.4, folds=FOLDS)
    n, right = n[::-1], right[::-1]  # from the likeliest step down; lower[i]: the least probability of a step
    lower = np.arange(len(n))[::-1] / len(n)
    good = np.flatnonzero((np.cumsum(right) >= PRECISION * np.cumsum(n)) & (n > 0) & (lower >= 0.5))
    return _model(models[0], float(lower[good[-1]]) if len(good) else 2.0, depth)


def find(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with base array<struct<kind,start,end>> and spans (base and added),
    each by kind as listed, then start; added kinds follow the base ones."""
    both = with_base(df, text_col)
    base = F.concat(*[F.col(f"__{k}") for k in KINDS])
    taken = F.filter(F.col("__new"), lambda c: ~F.exists(base, lambda b: _meets(b, c)))
    judged = F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
                                                   model.margin(c["f"]).alias("p")))
    both = both.withColumn("__ok", F.when(F.size("__new") == 0, F.array().cast("array<struct<kind:string,start:int,end:int,p:double>>"))
                           .otherwise(F.filter(judged, lambda c: c["p"] >= model.threshold)))
    # of accepted candidates that overlap, the likelier one stays, then the earlier and the longer one
    beaten = lambda c: F.exists("__ok", lambda o: _meets(o, c) & (
        F.struct(o["p"], -o["start"], o["end"], o["kind"]) > F.struct(c["p"], -c["start"], c["end"], c["kind"])))
    both = both.withColumn("__add", F.filter("__ok", lambda c: ~beaten(c)))
    named = lambda arr, kind: F.transform(arr, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    added = lambda kind: F.transform(F.filter("__add", lambda c: c["kind"] == kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    all_of = [F.array_sort(F.concat(named(F.col(f"__{k}"), k), added(k))) if k in ADDED else named(F.col(f"__{k}"), k) for k in KINDS]
    all_of += [added(k) for k in ADDED if k not in KINDS]
    keep = drop_new(df, ["base", "spans"]).columns
    return both.select(*[F.col(f"`{c}`") for c in keep], F.concat(*[named(F.col(f"__{k}"), k) for k in KINDS]).alias("base"),
                       F.concat(*all_of).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind, as [EMAIL]; of spans that
    overlap the earlier, then longer one is replaced, up to the later end."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"))))

    def step(acc, s):
        end = -s["to"]
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(
            F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], end).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(order, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
