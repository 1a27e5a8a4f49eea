"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a site when the pages of the site that contain it, divided by the site's pages, exceed a
ratio. Pages are distinct texts, so that a text is no boilerplate for being copied. The flagged lines of a site are at
most `mean lines per page / ratio`, so its row of hashes is small however large the site is; texts are joined with that
row and rebuilt in place, never regrouped line by line. A text's lines meet the site's by hashed set intersection, so the
work is linear in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, spare, table, whole

#: A line is dropped when it stands on more than this share of its site's pages, and on more than one page.
RATIO = 0.1
#: Flagged lines, over all sites, up to which their hashes (33 bytes a line) are broadcast; beyond it sites are joined by shuffle.
BROADCAST_LINES = 100_000


def _hash(line: Column) -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _key(a: Column, b: Column) -> Column:
    """The hash as text, since sets of plain values are hashed and sets of structs are not."""
    return F.concat(F.hex(a), F.lit("."), F.hex(b))


def boilerplate(df: DataFrame, text_col: str = "text", site_col: str = "source", *, ratio: float = RATIO, by_content: bool = True) -> DataFrame:
    """site, line (its hash, a and b), pages, total: the lines to drop. A page counts a line once; empty lines never count.

    Pages are the distinct texts of a site, or its rows if not by content. A line on a single page is shared by nothing
    and never dropped, or a site of fewer than 1 / ratio pages would lose all it has.
    """
    pages = df.select(F.col(site_col).alias("site"), whole(text_col).alias("body"), _hash(whole(text_col)).alias("page"))
    lines = pages.select("site", "page", F.explode(F.array_distinct(F.split("body", "\n"))).alias("line")).filter("line != ''")
    number = F.count_distinct("page") if by_content else F.count(F.lit(1))
    seen = lines.select("site", "page", _hash(F.col("line")).alias("line")).groupBy("site", "line").agg(number.alias("pages")).filter("pages > 1")
    totals = pages.groupBy(F.col("site").alias("site2")).agg(number.alias("total"))
    both = seen.join(totals, F.col("site").eqNullSafe(F.col("site2")))
    return both.filter(F.col("pages") > ratio * F.col("total")).select("site", "line", "pages", "total")


def line_dedup(
    df: DataFrame, text_col: str = "text", site_col: str = "source", *, ratio: float = RATIO, broadcast_lines: int = BROADCAST_LINES, by_content: bool = True
) -> DataFrame:
    """df with boilerplate lines removed from its text, and the columns lines_in and lines_dropped.

    Lines end at LF only. A null site is a site of its own; a null text counts as empty (and comes out empty). Every
    row stays, even if its text becomes empty. Rows that repeat a text are one page, unless pages are rows. Columns of
    df named lines_in or lines_dropped are replaced; all others pass through. An empty df gives no rows.
    """
    flagged = boilerplate(df, text_col, site_col, ratio=ratio, by_content=by_content)
    by_site = cut(flagged.groupBy("site").agg(F.collect_list(_key(F.col("line.a"), F.col("line.b"))).alias("flagged"), F.count(F.lit(1)).alias("n")))
    n = by_site.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    site, marks, here, left = spare(df.drop("lines_in", "lines_dropped"), "site", "flagged", "here", "left")
    by_site = by_site.select(F.col("site").alias(site), F.col("flagged").alias(marks))
    side = F.broadcast(by_site) if n <= broadcast_lines else by_site
    plain = df.drop("lines_in", "lines_dropped")
    out = plain.join(side, F.col(f"`{site_col}`").eqNullSafe(F.col(site)), "left")
    lines = F.split(whole(text_col), "\n")
    named = lambda x: _key(F.xxhash64(x), F.xxhash64(F.lit("line"), x))
    met = F.when(F.col(marks).isNotNull(), F.array_intersect(F.transform(lines, named), F.col(marks)))
    out = out.withColumn(here, met)
    kept = F.when(F.size(here) > 0, F.filter(lines, lambda x: ~F.array_contains(F.col(here), named(x)))).otherwise(lines)
    out = out.withColumn(left, kept).withColumn("lines_in", F.size(lines).cast("long"))
    out = out.withColumn("lines_dropped", F.col("lines_in") - F.size(left)).withColumn(text_col, F.array_join(left, "\n"))
    return out.drop(site, marks, here, left)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, with `source` as the site."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select(
        "doc_id", "source", "lines_in", "lines_dropped", F.octet_length("text").cast("long").alias("bytes_left"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


SQL = {
    "op2_line_dedup": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT source, body, unnest(list_distinct(lines)) AS line FROM d),
s AS (SELECT source, line, count(DISTINCT body) AS pages FROM p WHERE line <> '' GROUP BY source, line),
t AS (SELECT source, count(DISTINCT body) AS total FROM d GROUP BY source),
f AS (SELECT s.source, list(line) AS flagged FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source WHERE pages > 1 AND pages > {RATIO} * total GROUP BY s.source),
k AS (SELECT doc_id, d.source, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(flagged, []), x)) AS kept FROM d LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source),
j AS (SELECT *, coalesce(array_to_string(kept, chr(10)), '') AS body FROM k)
SELECT doc_id, source, len(lines)::BIGINT AS lines_in, (len(lines) - len(kept))::BIGINT AS lines_dropped, strlen(body)::BIGINT AS bytes_left, sha256(body) AS text_sha256 FROM j
"""
}
QUERIES = {"op2_line_dedup": op2_line_dedup}
