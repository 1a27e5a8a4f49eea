"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 2-bit segments. Flipping one bit moves one count by one, so the
Manhattan distance of the counts is a lower bound of the Hamming distance. Counts are laid out in eight blocks of four
segments; a distance of r touches r blocks at most, so two fingerprints within it stand in one cell of at least one grid
that leaves out r of the blocks. Those that meet in a cell are held against the Manhattan bound, then verified exactly by
the bits in which they differ. Two bits make 28 grids of some 34 bits a cell, so a billion random fingerprints meet by
chance about as often as there are fingerprints. Only distinct fingerprints are joined, so copies cost nothing and a
fingerprint has a bounded number of links (2,080 at two bits). Components come from alternating star contractions with
checkpoints; nothing is collected.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import FOLD, bounded, cut, join_heavy, per_row, spare, table

SEED, WORDS, RADIUS = 42, 3, 2
#: Blocks of four segments (eight bits of a fingerprint).
BLOCKS = 8
#: Near duplicates by similarity: words of a shingle, least Jaccard similarity, members of a block of pairs, and least and
#: most bits of a set's parity.
NEAR_WORDS, SIMILARITY, BLOCK, BITS = 5, 0.8, 1000, (1024, 65_536)
#: One document in how many is sampled for common shingles, the count there that makes one common, and how many are taken at most.
HOT_OF, HOT_LEAST, HOT_MOST = 16, 3, 300_000
#: Ids up to which a set of them (some 10 bytes each) is broadcast.
BROADCAST_IDS = 1_000_000


def hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included, as uint64."""
    w = (text or "").encode().translate(FOLD).split()
    if not w:
        return np.empty(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = map(join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [join(w)]  # noqa: B905
    return np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none. Blocks bound the memory of very long texts."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id and `fp`, a signed long. Whole texts; fewer words than a shingle make one; none make fingerprint zero."""

    def make():
        return lambda texts: [[signed(majority(hashes(t, words))) for t in texts]]

    return per_row(df, [id_col], text_col, {"fp": "long"}, make)


def segment_counts(fp: Column) -> Column:
    """The bit count of every 2-bit segment, kept in the segment's own two bits."""
    even, odd = fp, F.shiftrightunsigned(fp, 1)
    ones, twos = (x.bitwiseAND(F.lit(0x5555555555555555)) for x in (even.bitwiseXOR(odd), even.bitwiseAND(odd)))
    return ones.bitwiseOR(F.shiftleft(twos, 1))


def manhattan(a: Column, b: Column) -> Column:
    """The distance of two rows of counts, from their difference segment by segment.

    A count is 0, 1 or 2; in two bits, differing in the lower bit is a distance of 1, in the upper alone one of 2.
    """
    low = a.bitwiseXOR(b).bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned(a.bitwiseXOR(b), 1).bitwiseAND(F.lit(0x5555555555555555))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def cells(counts: Column, radius: int) -> Column:
    """The cells of all grids: the counts of the blocks that a grid keeps, with its number in place of one it leaves out."""
    out = []
    for n, left_out in enumerate(itertools.combinations(range(BLOCKS), radius)):
        mask = sum(0xFF << 8 * b for b in range(BLOCKS) if b not in left_out)
        number = sum(n << 8 * b for b in left_out[:1])
        out.append(counts.bitwiseAND(F.lit(signed(mask))).bitwiseOR(F.lit(signed(number))))
    return F.array(*out)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints of column `fp` that differ in 1 to `radius` bits; radius is 4 at most."""
    if not 0 <= radius <= 4:
        raise ValueError("a grid keeps at least four blocks")
    counts = segment_counts(F.col("fp"))
    placed = fps.select("fp", F.explode(cells(counts, radius)).alias("cell"))
    met = placed.withColumnRenamed("fp", "a").join(placed.withColumnRenamed("fp", "b"), "cell").filter("a < b")
    near = manhattan(segment_counts(F.col("a")), segment_counts(F.col("b"))) <= radius
    return met.filter(near & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b").distinct()


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """id, fp, component_id, links: one row per input row.

    component_id is the smallest id reachable over links, itself included; `links` counts the other fingerprints within
    the radius. Null texts count as empty; empty texts have fingerprint zero and link like any other. Null ids count in
    no minimum, so a component of null ids alone has a null id. Repeated rows stay. Other columns are ignored; an empty
    df gives no rows.
    """
    docs = cut(fingerprints(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", words))
    each = cut(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    pairs = cut(links(each.select("fp"), radius))
    roots = components(pairs)
    number = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    linked = cut(each.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    far = linked.select("fp", "root").join(ids, "root").join(number, F.col("fp") == F.col("node")).select("fp", "component_id", "links", F.lit(True).alias("met"))
    known = each.join(far, "fp", "left")
    own = F.when(F.col("met"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")
    known = cut(known.select("fp", own, F.coalesce("links", F.lit(0)).cast("long").alias("links"), "n"))
    out = join_heavy(docs, known, "fp", "n", F.col("id"))
    return out.select(F.col("id").alias(id_col), "fp", "component_id", "links")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "links")


def prefix_length(size: int, similarity: float) -> int:
    """Of two sets that reach the similarity, the first so many members of each, in one common order, share one."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([*parts, np.empty(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def parity(h: np.ndarray) -> np.ndarray:
    """For each of some bits, whether the set has an odd number of members there: as many bits as members, up to the next
    power of two, within BITS. Sets differ in at least as many members as parities in bits."""
    n = min(max(1 << (len(h) - 1).bit_length(), BITS[0]), BITS[1]) if len(h) else BITS[0]
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def parity_distance(x: Column, y: Column) -> Column:
    """Bits in which two parities differ; one of twice the other's length is folded first. Null beyond that."""
    length = F.least(F.size(x), F.size(y))
    xor = lambda a, b: a.bitwiseXOR(b)
    folded = lambda c: F.when(F.size(c) > length, F.zip_with(F.slice(c, F.lit(1), length), F.slice(c, length + 1, F.size(c) - length), xor)).otherwise(c)
    return F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda a, b: a + b)


def words_digest(text: str | None) -> bytes:
    """128 bits of the words, whatever stands between them."""
    return xxhash.xxh3_128_digest(b" ".join((text or "").encode().translate(FOLD).split()), 7)


def frequent(ids: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that one document in HOT_OF shows to be common, sorted, and their counts there; at most HOT_MOST."""

    def make():
        return lambda texts: [lists([np.unique(hashes(t, words)) for t in texts])]

    some = per_row(ids.filter(F.pmod(F.xxhash64("id"), F.lit(HOT_OF)) == 0), [], "body", {"set": "array<long>"}, make)
    n = some.select(F.explode("set").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_LEAST)
    t = n.orderBy(F.desc("n"), "s").limit(HOT_MOST).toArrow()
    s, n = t["s"].to_numpy().astype(np.int64).view(np.uint64), t["n"].to_numpy().astype(np.int64)
    at = np.argsort(s)
    return s[at], n[at]


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = NEAR_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """id, group_id for the rows that belong to a group of near duplicates: group_id is the group's least id.

    Two texts are near when the Jaccard similarity of their sets of word shingles reaches `similarity`; groups are the
    components of all near pairs, and none is missed. Candidates come in two rounds. The first takes texts whose
    fingerprints the grid join links, and, with each text, the one that it meets most among the hubs of its prefix
    shingles. What is verified there is one component. Fingerprints cannot reach all pairs of this similarity, so the
    second round is an exact prefix filter: sets are put into one order, common shingles last, and near sets share one of
    their first |s| - ceil(similarity |s|) + 1; all pairs that share one and are not in one component yet are verified,
    those of much-shared shingles in blocks of `block` members. Which shingles count as common is sampled; any order is
    exact, the sample only keeps groups small. Three exact bounds (sizes, positions, parities of the sets) come before
    whole sets are compared. Texts of the same words are one class from the start, whose least id stands for it.

    Null and empty texts are never grouped. Null ids are ignored. Repeated ids count as one document, near to what any of
    its texts is near to. Other columns are ignored; an empty df gives no rows.
    """
    ids = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    common = df.sparkSession.sparkContext.broadcast(frequent(ids, words))

    def make():
        hot, times = common.value

        def first(h: np.ndarray) -> np.ndarray:
            keep = prefix_length(len(h), similarity)
            if not len(h) or not len(hot):
                return h[:keep]
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            return h[np.argsort(np.where(hot[at] == h, times[at], 0), kind="stable")[:keep]]

        def work(texts: list) -> list:
            all_hashes = [hashes(t, words) for t in texts]
            sets = [np.unique(h) for h in all_hashes]
            return [
                [len(h) for h in sets], [signed(majority(h)) for h in all_hashes], [words_digest(t) for t in texts],
                lists([first(h) if len(h) else h for h in sets]), lists([parity(h) for h in sets]),
            ]

        return work

    columns = {"size": "long", "fp": "long", "same": "binary", "first": "array<long>", "bits": "array<long>"}
    docs = cut(per_row(ids, ["id"], "body", columns, make).filter("size > 0").withColumn("row", F.monotonically_increasing_id()))
    many = docs.groupBy("same").agg(F.min("id").alias("cid"), F.min_by("row", F.struct("id", "row")).alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = join_heavy(docs.select("id", "row", "same"), cut(many), "same", "n", F.col("row")).filter("row != leader")
    copies = cut(copies.select("row", "id", "cid"))
    classes = docs.join(bounded(copies.select("row"), BROADCAST_IDS), "row", "left_anti").select(F.col("id").alias("cid"), "size", "fp", "first", "bits")
    twins = copies.filter("id != cid").select(F.col("id").alias("a"), F.col("cid").alias("b")).distinct()

    # Size and place of a shingle in its set travel in one long; a class whose shingles nobody shares is out of it.
    shared = classes.select("cid", F.posexplode("first").alias("at", "cell"), F.shiftleft("size", 32).alias("size"))
    shared = shared.select("cell", "cid", F.col("size").bitwiseOR(F.col("at").cast("long")).alias("place"))
    met = cut(shared.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell"))).filter("n > 1"))
    size_of = lambda place: F.shiftright(place, 32)
    at_of = lambda place: place.bitwiseAND(F.lit(0xFFFFFFFF))

    def possible(px: Column, py: Column) -> Column:
        """Sizes allow the similarity, and so do the members left if this shingle is the first that both have."""
        nx, ny = size_of(px), size_of(py)
        left = F.least(nx - at_of(px), ny - at_of(py)) >= similarity / (1 + similarity) * (nx + ny) - 1e-6
        return (F.least(nx, ny) >= similarity * F.greatest(nx, ny) - 1e-6) & left

    def sketches(name: str) -> DataFrame:
        return classes.select(F.col("cid").alias(name), F.col("bits").alias(f"bits_{name}"), F.col("size").alias(f"n_{name}"))

    def sets(who: DataFrame) -> DataFrame:
        """The whole sets of some documents, from their texts."""
        chosen = ids.join(bounded(cut(who.toDF("id").distinct()), BROADCAST_IDS), "id", "left_semi")

        def build():
            return lambda bodies: [lists([np.unique(hashes(t, words)) for t in bodies])]

        return cut(per_row(chosen, ["id"], "body", {"set": "array<long>"}, build))

    def verify(pairs: DataFrame) -> DataFrame:
        odd = parity_distance(F.col("bits_x"), F.col("bits_y"))
        most = (1 - similarity) / (1 + similarity) * (F.col("n_x") + F.col("n_y")) + 1e-6
        sizes = F.least("n_x", "n_y") >= similarity * F.greatest("n_x", "n_y") - 1e-6
        close = cut(pairs.join(sketches("x"), "x").join(sketches("y"), "y").filter(sizes & (odd <= most)).select("x", "y").distinct())
        whole = sets(close.select(F.explode(F.array("x", "y"))))
        left = whole.join(bounded(close, BROADCAST_IDS), F.col("id") == F.col("x")).select("x", "y", F.col("set").alias("set_x"))
        both = left.join(whole.select(F.col("id").alias("y"), F.col("set").alias("set_y")), "y")
        common_members = F.size(F.array_intersect("set_x", "set_y"))
        near = common_members >= similarity * (F.size("set_x") + F.size("set_y") - common_members)
        return cut(both.filter(near).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())

    # First round: linked fingerprints, by the least class of each, and the hub that a class meets most.
    least = cut(classes.groupBy("fp").agg(F.min("cid").alias("y"), F.count(F.lit(1)).alias("n")))
    alike = join_heavy(classes.select(F.col("cid").alias("x"), "fp"), least.filter("n > 1"), "fp", "n", F.col("x")).filter("y IS NOT NULL AND x != y").select("x", "y")
    near = links(least.select("fp"), radius)
    near = near.join(least.select(F.col("fp").alias("a"), F.col("y").alias("x")), "a").join(least.select(F.col("fp").alias("b"), "y"), "b").select("x", "y")
    score = met.groupBy("cid").agg(F.sum("n").alias("score"))
    hubs = met.join(score, "cid").groupBy("cell").agg(F.max_by(F.struct("cid", "place"), F.struct("score", -F.col("cid"))).alias("hub"))
    meets = met.join(hubs, "cell").filter("cid != hub.cid").filter(possible(F.col("place"), F.col("hub.place")))
    meets = meets.groupBy("cid", F.col("hub.cid").alias("y")).agg(F.count(F.lit(1)).alias("cells"))
    best = meets.groupBy(F.col("cid").alias("x")).agg(F.max_by("y", F.struct("cells", -F.col("y"))).alias("y"))
    found = verify(alike.unionByName(near).unionByName(best).distinct())
    roots = components(found)

    # Second round: whatever else shares a prefix shingle.
    rooted = met.join(roots, F.col("cid") == F.col("node"), "left").select("cell", "cid", "place", "n", F.coalesce("root", "cid").alias("root"))
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("cell")
    blocks = F.ceil(F.col("n") / block).cast("int")
    still = rooted.join(mixed, "cell", "left_semi").withColumn("blocks", blocks)
    still = cut(still.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def side(name: str, own: str, others: str) -> DataFrame:
        return still.select("cell", F.col("cid").alias(name), F.col("place").alias(f"p{name}"), F.col("root").alias(f"r{name}"), F.col("own").alias(own), other.alias(others))

    pairs = side("x", "i", "j").join(side("y", "j", "i"), ["cell", "i", "j"]).filter("x < y AND rx != ry")
    pairs = pairs.filter(possible(F.col("px"), F.col("py"))).select("x", "y").distinct()
    roots = components(found.unionByName(verify(pairs)).unionByName(twins))
    return roots.select(F.col("node").alias(id_col), F.col("root").alias("group_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df without the documents whose group has a smaller id; of rows that share an id all stay."""
    name = spare(df, "dropped")[0]
    groups = near_duplicates(df, id_col, text_col, **how).filter(F.col(id_col) != F.col("group_id")).select(F.col(id_col).alias(name))
    return df.join(bounded(cut(groups), BROADCAST_IDS), F.col(f"`{id_col}`") == F.col(name), "left_anti")


SQL: dict[str, str] = {}
QUERIES = {"op3_simhash": op3_simhash}
