"""Operator 13: Merkle manifest of a dataset by bitmap-rank indexing.

Every row of `documents` is a leaf.  A leaf's place among the leaves of its
language is a rank query: ids are gathered into 64-bit words per (language,
id div 64) by a hash aggregate (the compressed bitmap: words without a bit do
not exist), a popcount directory over the words gives the leaves before each
word, and the popcount of the lower bits of its word completes the rank.  The
directory is summed in steps of at most 65,536 rows, so no language, however
hot, meets in one task.  Leaves are never sorted across the table.

Levels are then reduced in slot arrays: blocks of 4,096 consecutive places are
keyed by (language, place div 4096) and folded four levels inside their row;
the tops of the blocks are the places of the next round.  Sibling paths come
back down block by block, and each leaf's proof, refolded root and verdict are
computed inside the block's row.

Defined results: null fields hash as `-`; a null lang is a language of its own
that comes first; a null doc_id is placed as the least bigint.  Rows of one
language with the same doc_id are ordered by their leaf hash; rows that are
equal throughout are one leaf each, next to each other.  An empty table gives
no row; columns of other names are ignored, missing ones count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewise.llm.common import crc_mod, read, written
from linewise.operators.numbering import numbered

RUN = 8  # consecutive nodes that share a parent
LEVELS = 4  # levels that a block folds in its row
BLOCK = RUN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEAST = -(1 << 63)
SHIFTS = (10, 16, 16)  # directory steps above the 6 bits of a word; 16 bits are left at the top
LOWER = "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaves(docs: DataFrame) -> DataFrame:
    """key (language), id (place value), doc_id, leaf, tampered (leaf of the tampered row, else null)."""
    have = {c.lower() for c in docs.columns}
    types = dict.fromkeys(("doc_id", "n_chars"), "long")
    d = docs.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(types.get(c, "string")).alias(c) for c in FIELDS])
    first = [field(F.col(c)) for c in FIELDS[:-1]]
    lower = F.translate("text", LOWER.upper(), LOWER)
    return d.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("key"),
                    F.coalesce(F.col("doc_id"), F.lit(LEAST)).alias("id"), "doc_id",
                    digest(*first, field(F.col("text"))).alias("leaf"),
                    F.when(crc_mod(F.col("doc_id"), 3) == 0, digest(*first, field(lower))).alias("tampered"))


def offsets(df: DataFrame, groups: list[str], value: str, weight: str, shifts=SHIFTS) -> DataFrame:
    """df with `before` (weight of the group's smaller values) and `total` (the
    group's whole weight), by prefix sums in steps of bounded width."""
    if not shifts:
        w = Window.partitionBy(*groups)
        upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.coalesce(F.sum(weight).over(upto), F.lit(0))).withColumn("total", F.sum(weight).over(w))
    up = f"up{len(shifts)}"
    d = df.withColumn(up, F.shiftright(value, shifts[0]))
    upto = Window.partitionBy(*groups, up).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum(weight).over(upto), F.lit(0)))
    above = offsets(d.groupBy(*groups, up).agg(F.sum(weight).alias("w")), groups, up, "w", shifts[1:])
    return (d.join(above.select(*groups, up, "before", "total"), [*groups, up])
            .withColumn("before", F.col("before") + F.col("inside")).drop(up, "inside"))


def directory(found: DataFrame) -> DataFrame:
    """One row per 64-bit word of a group's bitmap: key, word, bits, n (leaves), before, total."""
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    words = written(found.groupBy("key", F.shiftright("id", 6).alias("word"))
                    .agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n")), "op13-words")
    return written(offsets(words, ["key"], "word", "n"), "op13-directory")


def places(found: DataFrame) -> DataFrame:
    """found with `place` (0, 1, ... in its group) and `total`: one join with the directory."""
    words = directory(found)
    ranked = "before + bit_count(bits & ~shiftleft(-1L, cast(id & 63 as int)))"
    if words.filter("n > bit_count(bits)").isEmpty():
        keyed = found.withColumn("word", F.shiftright("id", 6))
        return (keyed.join(words.hint("shuffle_hash"), ["key", "word"])
                .select("key", "doc_id", "leaf", "tampered", F.expr(ranked).alias("place"), "total"))
    # ids that stand in several rows: their surplus counts beside the bits, and leaf hashes order them
    rows = written(found.groupBy("key", "id", "leaf").agg(F.first("doc_id").alias("doc_id"), F.first("tampered").alias("tampered"),
                                                          F.count("*").alias("copies"))
                   .withColumn("hash", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")), "op13-rows")
    ids = rows.groupBy("key", "id").agg(F.sum("copies").alias("n"), F.count("*").alias("kinds"))
    surplus = (ids.filter("n > 1").groupBy("key", F.shiftright("id", 6).alias("word"))
               .agg(F.collect_list(F.struct(F.expr("cast(id & 63 as int)").alias("low"), (F.col("n") - 1).alias("n"))).alias("more")))
    words = words.join(surplus, ["key", "word"], "left")
    many = rows.join(ids.filter("kinds > 1").select("key", "id"), ["key", "id"])
    hashes = offsets(many.groupBy("key", "id", "hash").agg(F.sum("copies").alias("w")), ["key", "id"], "hash", "w", (16, 16, 16))
    # leaves that agree in 60 bits of sha256 meet here, a handful at most
    equal = Window.partitionBy("key", "id", "hash").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    inside = (many.withColumn("same", F.coalesce(F.sum("copies").over(equal), F.lit(0)))
              .join(hashes.select("key", "id", "hash", "before"), ["key", "id", "hash"])
              .select("key", "id", "leaf", (F.col("before") + F.col("same")).alias("inside")))
    keyed = rows.withColumn("word", F.shiftright("id", 6)).join(words, ["key", "word"]).join(inside, ["key", "id", "leaf"], "left")
    lower = "aggregate(filter(coalesce(more, array()), m -> m.low < (id & 63)), 0L, (a, m) -> a + m.n)"
    first = keyed.withColumn("place", F.expr(f"{ranked} + {lower} + coalesce(inside, 0L)"))
    # equal rows take neighbouring places; a hot row is spread in two steps
    spread = (first.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {BLOCK})")))
              .repartition("key", "id", "leaf", "chunk")
              .withColumn("at", F.explode(F.expr(f"sequence(chunk * {BLOCK}, least(copies, (chunk + 1) * {BLOCK}) - 1)"))))
    return spread.select("key", "doc_id", "leaf", "tampered", (F.col("place") + F.col("at")).alias("place"), "total")


def folded(nodes: DataFrame, rounds: int, name: str, payload: Column | None = None) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of slot arrays of (key, place, total, hash) and (key, root) of every key.

    Each round's table has a row per block: runs of eight nodes at each level,
    the number of levels that its key still needs, and its top."""
    out = []
    for k in range(rounds):
        left = F.expr(f"size(filter(sequence(0, 20), x -> shiftleft(1L, 3 * x) < total)) - {LEVELS * k}")
        item = F.struct(F.expr(f"cast(place % {BLOCK} as int)").alias("slot"), "hash", *([payload] if payload is not None else []))
        b = (nodes.groupBy("key", F.expr(f"place div {BLOCK}").alias("block"))
             .agg(F.sort_array(F.collect_list(item)).alias("slots"), F.max("total").alias("total"))
             .withColumn("steps", F.greatest(F.lit(0), F.least(F.lit(LEVELS), left)).cast("int"))
             .withColumn("n0", F.expr("transform(slots, x -> x.hash)")))
        for i in range(LEVELS):
            b = b.withColumn(f"r{i}", F.expr(
                f"if(steps > {i}, transform(sequence(0, (size(n{i}) - 1) div {RUN}), g -> transform(sequence(0, least({RUN - 1}, size(n{i}) - 1 - {RUN} * g)), "
                f"t -> n{i}[{RUN} * g + t])), null)"))
            b = b.withColumn(f"n{i + 1}", F.expr(f"if(steps > {i}, transform(r{i}, run -> sha2(array_join(run, ''), 256)), n{i})"))
        b = b.withColumn("top", F.expr(f"n{LEVELS}[0]")).drop(*[f"n{i}" for i in range(LEVELS + 1)])
        out.append(written(b, f"op13-{name}-{k}"))
        nodes = out[-1].select("key", F.col("block").alias("place"), "total", F.col("top").alias("hash"))
        payload = None
    return out, nodes.select("key", F.col("hash").alias("root"))


def path(slot: str) -> str:
    """SQL: the siblings left and right of a slot on every level of its block."""
    level = (f"if(steps > {{i}}, struct(array_join(slice(r{{i}}[shiftright({slot}, {{up}})], 1, shiftright({slot}, {{lo}}) & 7), '') as l, "
             f"array_join(slice(r{{i}}[shiftright({slot}, {{up}})], (shiftright({slot}, {{lo}}) & 7) + 2, {RUN}), '') as r), null)")
    each = ", ".join(level.format(i=i, lo=3 * i, up=3 * i + 3) for i in range(LEVELS))
    return f"filter(array({each}), p -> p is not null)"


def descend(rounds: list[DataFrame], above: DataFrame, carry: list[str]) -> DataFrame:
    """The blocks of the first round with the columns of `above`: a row per key
    with `upper` (the siblings above its root) and the columns of carry."""
    # the last round has one block per key, so this join has no hot key
    upper = rounds[-1].select("key", "block").join(above, "key")
    for k in range(len(rounds) - 1, 0, -1):
        down = F.expr(f"transform(slots, x -> struct(block * {BLOCK} + x.slot as block, concat({path('x.slot')}, upper) as upper))")
        upper = written(rounds[k].join(upper, ["key", "block"]).select("key", F.inline(down), *carry), f"op13-upper-{k}")
    return rounds[0].join(upper, ["key", "block"])


def rounds_for(total: int) -> int:
    """Rounds of slot arrays that bring `total` places down to one node."""
    n = 1
    while total > BLOCK:
        total, n = -(-total // BLOCK), n + 1
    return n


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, lang, place (in its language, from 0)."""
    laid = written(places(leaves(docs)), "op13-placed")
    most = laid.agg(F.max("total")).first()[0] or 0
    rounds, sub = folded(laid.withColumnRenamed("leaf", "hash"), rounds_for(most), "blocks", F.struct("doc_id", "tampered").alias("row"))
    sub = written(sub, "op13-subroots")
    langs = sub.count()
    tops = numbered(sub.withColumnRenamed("key", "lang"), [F.col("lang").asc()], "n")
    tops = tops.select(F.lit("").alias("key"), (F.col("n") - 1).alias("place"), F.lit(langs).cast("long").alias("total"), F.col("root").alias("hash"), "lang")
    whole, root = folded(tops, rounds_for(langs), "languages", F.struct("lang").alias("row"))
    none = F.expr("cast(array() as array<struct<l: string, r: string>>)")
    over = descend(whole, root.withColumn("upper", none), ["root"])
    heads = F.expr(f"transform(slots, x -> struct(x.row.lang as key, x.hash as subroot, concat({path('x.slot')}, upper) as upper))")
    heads = written(over.select("root", F.inline(heads)), "op13-heads")
    blocks = descend(rounds, heads, ["subroot", "root"])
    each = F.expr(
        f"transform(slots, x -> struct(x.row.doc_id as doc_id, block * {BLOCK} + x.slot as place, x.hash as leaf, "
        f"coalesce(x.row.tampered, x.hash) as start, concat({path('x.slot')}, upper) as path))")
    told = F.expr(
        "transform(each, x -> struct(x.doc_id as doc_id, x.place as place, x.leaf as leaf, "
        "sha2(array_join(transform(x.path, p -> concat(p.l, p.r)), ''), 256) as proof_sha256, "
        "aggregate(x.path, x.start, (h, p) -> sha2(concat(p.l, h, p.r), 256)) as folded_root))")
    lang = F.expr("if(key = '-', null, substring(key, 2))")
    return (blocks.withColumn("each", each).select("key", "subroot", "root", F.inline(told))
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"), lang.alias("lang"), "place"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of the query: row numbers, levels by recursion, crc32 by its table."""
    text = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR), ':', CAST({c} AS VARCHAR)) END"
    head = ", ".join(text(c) for c in FIELDS[:-1])
    lower = f"translate(text, '{LOWER.upper()}', '{LOWER}')"

    def tree(name: str, start: str) -> str:
        return f"""{name}(lang, lvl, idx, total, hash) AS (
  SELECT lang, 0, idx, total, {start}
  UNION ALL
  SELECT lang, lvl + 1, idx // {RUN}, (total + {RUN - 1}) // {RUN}, sha256(string_agg(hash, '' ORDER BY idx)) FROM {name} WHERE total > 1
  GROUP BY lang, lvl, idx // {RUN}, total),
{name}_run AS (SELECT lang, lvl, idx // {RUN} AS up, list(hash ORDER BY idx) AS hs FROM {name} WHERE total > 1 GROUP BY lang, lvl, idx // {RUN})"""

    def steps(of: str, runs: str, more: str, base: int) -> str:
        at = f"((o.idx // CAST(power({RUN}, r.lvl) AS BIGINT)) % {RUN})"
        return (f"SELECT {more}, r.lvl + {base} AS lvl, array_to_string(r.hs[1:{at}], '') AS l, array_to_string(r.hs[{at} + 2:], '') AS r FROM {of} o "
                f"JOIN {runs} r ON r.up = o.idx // CAST(power({RUN}, r.lvl + 1) AS BIGINT)")

    return f"""
WITH RECURSIVE
crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
        FROM (SELECT unnest(range(0, 256)) AS i) x),
doc AS (SELECT doc_id, lang, sha256(concat({head}, {text('text')})) AS leaf,
  xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 0 AS hit,
  sha256(concat({head}, {text(lower)})) AS low FROM documents, crc),
leaf AS (SELECT doc_id, lang, leaf, CASE WHEN hit THEN low ELSE leaf END AS start, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS total FROM doc),
{tree('nodes', 'leaf FROM leaf')},
sub AS (SELECT lang AS name, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS total FROM nodes WHERE total = 1),
{tree('tops', 'subroot FROM (SELECT 0 AS lang, idx, total, subroot FROM sub) q')},
step AS ({steps('leaf', 'nodes_run', 'o.doc_id', 0)} AND r.lang IS NOT DISTINCT FROM o.lang
  UNION ALL
  SELECT d.doc_id, s.lvl, s.l, s.r FROM leaf d JOIN ({steps('sub', 'tops_run', 'o.name', 100)}) s ON s.name IS NOT DISTINCT FROM d.lang),
way AS (SELECT doc_id, list({{'l': l, 'r': r}} ORDER BY lvl) AS p, string_agg(concat(l, r), '' ORDER BY lvl) AS sib FROM step GROUP BY doc_id),
told AS (SELECT d.doc_id, d.leaf, s.subroot, (SELECT hash FROM tops WHERE total = 1) AS root, sha256(coalesce(w.sib, '')) AS proof_sha256,
  list_reduce(list_concat([{{'l': d.start, 'r': ''}}], coalesce(w.p, [])), lambda a, q: {{'l': sha256(concat(q.l, a.l, q.r)), 'r': ''}}).l AS folded_root, d.lang, d.idx AS place
  FROM leaf d JOIN sub s ON s.name IS NOT DISTINCT FROM d.lang LEFT JOIN way w ON w.doc_id = d.doc_id)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified, lang, place FROM told"""
