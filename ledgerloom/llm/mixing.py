"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source with `ratio = target / size` gives every document `floor(ratio)` whole copies for certain; what is left of the
target is a sample. A document's inclusion probability grows with its size, within bounds: documents fall into five
classes of size with fixed weights, and the probability is weight times a factor, so chosen for each source that the
expected words are what is left; classes that reach 1 are taken for certain and the factor is worked out anew for the
rest. Documents are ranked by the odds of a fixed random number over the odds of their inclusion, and taken in that
order while the next one brings the words nearer to what is left: the sample is fixed in words, since targets are. The
order is never sorted as a whole: two histograms of the rank, the second within one bar of the first, find where each
source's quota ends, and only that bar (1/65536 of a source) is ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, cut, spare, table, whole

#: Weights of the sources in code point order, repeating; no target exceeds CAP times its source's size.
WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-2"
#: Words from which each class of size begins, and the classes' weights of inclusion.
CLASSES, FAVOUR = (0, 128, 256, 512, 1024), (1.0, 1.5, 2.0, 3.0, 4.0)
#: Bars of each of the two histograms.
BARS = 256
#: Sources up to which their plan (some 200 bytes a source) is broadcast; beyond it documents are joined by shuffle.
BROADCAST_SOURCES = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (one row per source: source, source_size, ...) with `target`: weight shares of all words, filled up to the caps.

    The capped sources are those with the least cap per weight, so running sums in that order give the common level.
    Sources are numbered by order, so their table (not the documents) is sorted in one task: ten million are some 500 MB.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long")
    w = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap)
    filled = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    heft = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    w = w.withColumn("level", left / heft).withColumn("rank", F.row_number().over(filled))
    w = w.withColumn("full", F.col("limit") < F.col("weight") * F.col("level"))
    level = F.coalesce(F.min_by("level", F.when(~F.col("full"), F.col("rank"))).over(everything), F.lit(0.0))
    return w.withColumn("target", F.least(F.col("weight") * level, F.col("limit").cast("double"))).drop("weight", "limit", "level", "rank", "full")


def size_class(size: Column) -> Column:
    """0 to 4."""
    return reduce(lambda a, k: F.when(size >= CLASSES[k], k).otherwise(a), range(1, len(CLASSES)), F.lit(0))


def uniform(identity: Column, text: Column, seed: str = SEED) -> Column:
    """A fixed number strictly between 0 and 1, of id and text: rows that share an id, or have none, differ by their texts."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sized(df: DataFrame, size: str, u: str, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """df with two more columns: a document's words, and its random number."""
    return df.withColumns({size: F.regexp_count(whole(text_col), F.lit(WORD)).cast("long"), u: uniform(F.col(f"`{id_col}`"), whole(text_col), seed)})


def inclusion(quota: Column, words: list[Column]) -> Column:
    """The factor by which the weights become probabilities min(1, factor * weight) that take `quota` of the classes' words.

    Classes fill up from the heaviest weight down: with the j heaviest full, the rest shares what they leave; the first
    j at which the next class does not exceed 1 holds.
    """
    out = F.lit(None).cast("double")
    for j in reversed(range(len(words))):
        rest = range(len(words) - j)
        left = quota - reduce(lambda a, b: a + b, words[len(words) - j :], F.lit(0))
        factor = left / reduce(lambda a, b: a + b, [words[k] * FAVOUR[k] for k in rest])
        out = F.when((reduce(lambda a, b: a + b, [words[k] for k in rest]) > 0) & (factor * FAVOUR[len(words) - 1 - j] <= 1), factor).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


_PLAN = ("source", "source_size", "target", "base", "quota", "factor", "end_bar", "last_in", "rank", "bar", "sure")
_OUT = ("size", "source_size", "target", "copies", "taken")


def _chance(size: Column, factor: Column) -> Column:
    return F.least(F.lit(1.0), factor * F.element_at(F.array(*map(F.lit, FAVOUR)), size_class(size) + 1))


def _ranked(df: DataFrame, plan: DataFrame, source_col: str, size: str, u: str, names: dict[str, str]) -> DataFrame:
    """df with its source's row of the plan, whether it is sure, and else its rank and bar; names renames these columns."""
    out = df.join(plan.withColumnsRenamed(names), F.col(f"`{source_col}`").eqNullSafe(F.col(names["source"])), "left")
    chance = _chance(F.col(size), F.col(names["factor"]))
    rank = F.when((chance > 0) & (chance < 1), F.col(u) / (1 - F.col(u)) * (1 - chance) / chance)
    bar = F.floor(rank / (1 + rank) * (BARS * BARS)).cast("long")
    return out.withColumns({names["sure"]: F.coalesce(chance >= 1, F.lit(False)), names["rank"]: rank, names["bar"]: bar})


def _place(rank: str, identity: str, size: str, *more: str) -> Column:
    return F.struct(F.col(rank).alias("rank"), F.col(f"`{identity}`").isNotNull().alias("has"), F.col(f"`{identity}`").alias("id"), F.col(size).alias("size"), *more)


def mix_plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source, from id, source, size, u: source_size, target, whole copies (`base`), quota and factor of the
    sample, and where it ends: `end_bar`, and within it `last_in`, the last entry taken, with `fit` of its `rows`."""
    n = range(len(CLASSES))
    kinds = [F.sum(F.when(size_class(F.col("size")) == k, F.col("size")).otherwise(0)).alias(f"words{k}") for k in n]
    per = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"), *kinds), weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("base", F.floor(ratio)).withColumn("whole", F.col("target") - F.col("base") * F.col("source_size"))
    per = per.withColumn("factor", inclusion(F.col("whole"), [F.col(f"words{k}") for k in n]))
    full = reduce(lambda a, b: a + b, [F.when(F.col("factor") * FAVOUR[k] >= 1, F.col(f"words{k}")).otherwise(0) for k in n])
    per = cut(per.withColumn("quota", F.col("whole") - full).select(*_PLAN[:6]))
    some = _ranked(docs, per, "source", "size", "u", {c: c for c in _PLAN} | {"source": "source2"}).filter("rank IS NOT NULL AND size > 0")
    coarse, words = F.floor(F.col("bar") / BARS), F.sum("size").alias("words")

    def last(bars: DataFrame, start: Column) -> DataFrame:
        """Of each source the last bar that begins within the quota, and the words before it; a source has BARS bars at most."""
        upto = start + F.sum("words").over(Window.partitionBy("source").orderBy("at"))
        begun = bars.withColumn("before", upto - F.col("words")).filter(F.col("before") <= F.col("quota"))
        return begun.groupBy("source").agg(F.max_by(F.struct("at", "before"), "at").alias("end"))

    def within(rows: DataFrame, ends: DataFrame, at: Column) -> DataFrame:
        met = ends.select(F.col("source").alias("source3"), F.col("end.at").alias("end_at"), F.col("end.before").alias("start"))
        return rows.join(met, F.col("source").eqNullSafe(F.col("source3")) & (at == F.col("end_at"))).drop("source3", "end_at")

    first = cut(last(some.groupBy("source", "quota", coarse.alias("at")).agg(words), F.lit(0)))
    second = cut(last(within(some, first, coarse).groupBy("source", "quota", "start", F.col("bar").alias("at")).agg(words), F.col("start")))
    # Rows alike in rank, id and size are one entry with their number, so that a part of them can be taken.
    edge = within(some, second, F.col("bar")).groupBy("source", "quota", "start", "rank", "id", "size").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(F.col("size") * F.col("rows")).over(order) - F.col("size") * F.col("rows") + F.col("start")
    fit = F.floor((F.col("quota") - before) / F.col("size") + 0.5)
    part = edge.withColumn("fit", F.least(fit, F.col("rows")).cast("long")).filter("fit > 0")
    cuts = part.groupBy(F.col("source").alias("source4")).agg(F.max(_place("rank", "id", "size", "fit", "rows")).alias("last_in"))
    ends = second.select(F.col("source").alias("source3"), F.col("end.at").alias("end_bar"))
    ends = ends.join(cuts, F.col("source3").eqNullSafe(F.col("source4")), "left").select("source3", "end_bar", "last_in")
    return cut(per.join(ends, F.col("source").eqNullSafe(F.col("source3")), "left").drop("source3"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """df with the columns size, source_size, target, copies, taken.

    Sizes are words; a null text has none, and a document without words is never taken. A null source sorts last.
    Equal ranks go by id, then size; of rows that repeat id and text just as many are taken as the target has room for.
    Reruns agree. An empty df gives no rows. Columns of df with the names of added columns are replaced; all others pass
    through.
    """
    plain = df.drop(*_OUT)
    size, u = spare(plain, "size", "u")
    rows = sized(plain, size, u, id_col, text_col, seed)
    narrow = cut(rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(size).alias("size"), F.col(u).alias("u")))
    return _taken(rows, mix_plan(narrow, weights=weights, cap=cap), plain.columns, id_col, source_col, size, u, broadcast_sources)


def _taken(rows: DataFrame, plan: DataFrame, keep: list[str], id_col: str, source_col: str, size: str, u: str, broadcast_sources: int) -> DataFrame:
    """rows (with size and u) under a plan: the columns `keep` and those that mix adds."""
    names = dict(zip(_PLAN, spare(rows, *(f"_{c}" for c in _PLAN)), strict=True))
    p = {k: F.col(v) for k, v in names.items()}
    ranked = _ranked(rows, bounded(plan, broadcast_sources), source_col, size, u, names)
    here, end = _place(names["rank"], id_col, size), p["last_in"]
    bound = F.struct(end["rank"].alias("rank"), end["has"].alias("has"), end["id"].alias("id"), end["size"].alias("size"))
    inside = F.coalesce((p["bar"] < p["end_bar"]) | ((p["bar"] == p["end_bar"]) & end.isNotNull() & (here <= bound)), F.lit(False))
    split = F.coalesce((p["bar"] == p["end_bar"]) & (here == bound) & (end["fit"] < end["rows"]), F.lit(False))

    def finish(df: DataFrame, more: Column) -> DataFrame:
        copies = F.when(F.col(size) == 0, F.lit(0)).otherwise(p["base"] + more.cast("long")).cast("long")
        return df.select(*(F.col(f"`{c}`") for c in keep), F.col(size).alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), copies.alias("copies"), (copies * F.col(size)).alias("taken"))

    if plan.filter("last_in.fit < last_in.rows").isEmpty():
        return finish(ranked, p["sure"] | inside)
    # Rows that repeat the last document taken: equal rows become one with their number, and part of that is taken.
    others, ties = finish(ranked.filter(~split), p["sure"] | inside), ranked.filter(split)
    alike, before, taken = spare(ranked, "alike", "before", "in_mix")
    grouped = ties.groupBy(*ties.columns).agg(F.count(F.lit(1)).alias(alike))
    order = Window.partitionBy(names["source"]).orderBy(F.xxhash64(*keep)).rowsBetween(Window.unboundedPreceding, -1)
    grouped = grouped.withColumn(before, F.coalesce(F.sum(alike).over(order), F.lit(0)))
    fit = F.greatest(F.least(end["fit"] - F.col(before), F.col(alike)), F.lit(0))
    two = F.array(F.struct(F.lit(True).alias("t"), fit.alias("n")), F.struct(F.lit(False).alias("t"), (F.col(alike) - fit).alias("n")))
    apart = grouped.withColumn(taken, F.explode(two)).filter(F.col(f"{taken}.n") > 0)
    apart = apart.withColumn(alike, F.explode(F.sequence(F.lit(1), F.col(f"{taken}.n"))))
    return others.unionByName(finish(apart, F.col(f"{taken}.t")))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted once: the output needs no text, so the documents are the narrow table of the plan itself."""
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "size", "u")
    narrow = cut(docs.select(F.col("doc_id").alias("id"), "source", "size", "u"))
    out = _taken(narrow, mix_plan(narrow), ["id"], "id", "source", "size", "u", BROADCAST_SOURCES)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


_W = [f"w{k}" for k in range(len(CLASSES))]
_CLASS = "CASE " + " ".join(f"WHEN size >= {c} THEN {k}" for k, c in reversed(list(enumerate(CLASSES)))) + " END"


def _sql_factor() -> str:
    out = []
    for j in range(len(CLASSES)):
        rest = range(len(CLASSES) - j)
        full = " + ".join([*_W[len(CLASSES) - j :], "0"])
        share = f"(quota - ({full})) / nullif({' + '.join(f'{_W[k]} * {FAVOUR[k]}::DOUBLE' for k in rest)}, 0)"
        out.append(f"WHEN {' + '.join(_W[k] for k in rest)} > 0 AND {share} * {FAVOUR[len(CLASSES) - 1 - j]}::DOUBLE <= 1 THEN {share}")
    return f"CASE {' '.join(out)} ELSE 0.0::DOUBLE END"


SQL = {
    "op4_mix_sources": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  (('0x' || md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[:13])::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r} AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {", ".join(f"coalesce(sum(size) FILTER ({_CLASS} = {k}), 0)::BIGINT AS {w}" for k, w in enumerate(_W))} FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, {CAP} * source_size AS lim FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level, row_number() OVER (ORDER BY lim::DOUBLE / weight, source NULLS LAST) AS rk
  FROM w WINDOW b AS (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT arg_min(level, rk) FILTER (WHERE NOT lim < weight * level) AS level FROM l),
t AS (SELECT source, source_size, {", ".join(_W)}, least(weight * coalesce(g.level, 0.0), lim::DOUBLE) AS target FROM l, g),
o AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END) AS base FROM t),
q AS (SELECT *, target - base * source_size AS quota FROM o),
f AS (SELECT *, {_sql_factor()} AS factor FROM q),
k AS (SELECT doc_id, size, u, f.source, source_size, target, base, quota, least(1.0::DOUBLE, factor * {list(FAVOUR)}[{_CLASS} + 1]::DOUBLE) AS chance FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
r AS (SELECT *, quota - coalesce(sum(size) FILTER (chance >= 1) OVER (PARTITION BY source), 0) AS room, CASE WHEN chance > 0 AND chance < 1 THEN u / (1 - u) * (1 - chance) / chance END AS rank FROM k),
c AS (SELECT *, sum(size) FILTER (rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS running FROM r)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE ((base::BIGINT + CASE WHEN chance >= 1 OR (rank IS NOT NULL AND 2 * running - size <= 2 * room) THEN 1 ELSE 0 END) * size)::BIGINT END AS taken FROM c
"""
}
QUERIES = {"op4_mix_sources": op4_mix_sources}
