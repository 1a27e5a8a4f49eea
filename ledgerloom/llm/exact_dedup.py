"""Exact dedup by progressive refinement.

Length, then a hash of a short prefix, then a hash of everything; each level only looks at rows that the level before
could not tell apart. Lengths and prefixes come out of one pass into a narrow table; what a level passes on is a bitmap
over hashed keys (`2**bits` bits at most, 2 MB by default), so the broadcast is bounded whatever the input, and a false
positive only costs one more hash. Whole texts are read in a second pass, for rows that both bitmaps pass. Where every
digest is wanted anyway, that pass comes first and the narrow table keeps the digests: texts are read once. Groups are
found by a pre-aggregated `groupBy`; large ones go back to their rows by broadcast, so none ever meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HEAVY, ascii_lower, cut, join_heavy, table, whole

#: log2 of the bits of one level's bitmap: 2**24 bits are 2 MB.
BITS = 24
PREFIX_CHARS = 64


def _slot(*keys: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits)) + 1


def _bitmap(slots: DataFrame) -> DataFrame:
    """One row of 4 KB for each 32,768 slots in use, from a column `slot`."""
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def _passes(df: DataFrame, name: str, slot: Column, bitmap: DataFrame) -> DataFrame:
    """df with a boolean column `name`: its slot is set in the bitmap."""
    at = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    asked = df.withColumn("slot", slot).withColumn("bucket", F.bitmap_bucket_number("slot"))
    met = asked.join(F.broadcast(bitmap), "bucket", "left")
    return met.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("slot", "bucket", "bits")


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest_all: bool = False, bits: int = BITS, prefix_chars: int = PREFIX_CHARS, heavy: int = HEAVY
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest id of a group
    stays; a row is kept when its id is that id, so rows that repeat an id are all kept or all dropped, and a group
    whose ids are all null keeps every row. `digest` (SHA-256, lowercase hex) is null where the refinement never had
    to read the whole text, unless `digest_all`. Other columns of df are ignored; an empty df gives no rows. Groups of
    over `heavy` rows go back to their rows by broadcast.
    """
    body, slot1, slot2 = whole(text_col), _slot(F.col("size"), bits=bits), _slot(F.col("size"), F.col("prefix"), bits=bits)
    full = F.sha2(ascii_lower(body).cast("binary"), 256)
    size, prefix = F.octet_length(body).cast("long"), F.xxhash64(ascii_lower(F.substring(body, 1, prefix_chars)))
    sized = df.select(F.col(id_col).alias("id"), size.alias("size"), prefix.alias("prefix"), full.alias("digest"))
    narrow = cut(sized if digest_all else sized.select("size", "prefix"))
    by_size = narrow.groupBy("size").count().filter("count > 1")
    first = cut(_bitmap(by_size.select(slot1.alias("slot"))))
    by_prefix = _passes(narrow, "alive", slot1, first).filter("alive").groupBy("size", "prefix").count().filter("count > 1")
    second = cut(_bitmap(by_prefix.select(slot2.alias("slot"))))
    marked = _passes(_passes(narrow if digest_all else sized, "one", slot1, first), "two", slot2, second)
    # A digest that no branch asks for is never computed: whole texts are hashed for survivors only.
    key = F.when(F.col("one") & F.col("two"), F.col("digest"))
    rows = marked.select("id", key.alias("key"), (F.col("digest") if digest_all else key).alias("digest"))
    rows = rows if digest_all else cut(rows)
    alike, alone = rows.filter("key IS NOT NULL"), rows.filter("key IS NULL")
    groups = cut(alike.groupBy("key").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = join_heavy(alike, groups, "key", "n", F.col("id"), heavy=heavy)
    met = met.select("id", F.col("largest").alias("keep_id"), F.col("n").alias("group_size"), "digest")
    out = met.unionByName(alone.select("id", F.col("id").alias("keep_id"), F.lit(1).alias("group_size"), "digest"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "digest")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return out.withColumnRenamed("digest", "text_sha256")


SQL = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
