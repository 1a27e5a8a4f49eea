"""What the queries need on large tables: results as before, in time that grows with the input only."""

import os
import random
import struct
import time

import pytest
from ledgerloom.functions import identity
from ledgerloom.operators import control, graph, normalize, rules
from ledgerloom.sources import segments
from ledgerloom.streaming import folds
from pyspark.sql import functions as F


def _seconds(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_many_digests_go_side_by_side(spark, monkeypatch):
    values = [os.urandom(n) for n in (0, 1, 64, 65, 300, 1023, 1024, 1025, 2048, 2049, 3072, 5000, 7169, 8192, 8193, 20_000)] * 2
    assert identity.blake3_many(values) == [struct.pack("<8I", *identity._node(v, 0, identity.ROOT)) for v in values]
    assert identity.blake3_many([]) == [] and identity.blake3_known([None, b""]) == [None, identity.blake3(b"")]
    monkeypatch.setattr(identity, "_compress", None)  # the plain compression has no part in it
    assert len(identity.blake3_many(values[:14])) == 14
    ids = spark.range(20_000, numPartitions=1).select(identity.blake3_hex(F.repeat(F.lit("ab"), 160).cast("binary")), control.outbox_key("o", F.col("id").cast("string"), F.lit("pending")).alias("key"))
    assert _seconds(ids) < 12 and ids.filter("key IS NOT NULL").isEmpty()


def test_many_alert_ids(spark):
    e = spark.range(40_000, numPartitions=1).select("id", F.lit("n").alias("network"), F.repeat(F.lit("x"), 150).alias("disconnected_tip_hash"), F.col("id").alias("revision"), F.lit(9).alias("reorg_depth"), F.lit("complete").alias("completeness"))
    a = rules.reorg_alerts(e, "deep", 4).select("id", "alert_id")
    assert _seconds(a) < 12
    assert a.filter("id = 7").first()[1] == identity.blake3(b"\0".join([b"deep", b"n", b"x" * 150, b"7"])).hex()


def test_many_fixture_facts(spark):
    body = F.concat(F.lit('{"fixture_id": "f'), "id", F.lit('", "value": "v", "source_sequence": '), "id", F.lit("}"))
    o = spark.range(20_000, numPartitions=1).select(
        body.cast("binary").alias("payload"), F.col("id").alias("source_sequence"), F.unhex(F.sha2(body, 256)).alias("observation_id"), F.unhex(F.md5(body)).alias("source_session_id"),
        F.lit("c").alias("chain"), F.lit("n").alias("network"), F.lit("s").alias("source_id"), F.lit(1).alias("observed_at_unix_ns"), F.lit(2).alias("durable_at_unix_ns"),
    )
    f = normalize.fixture_facts(o)
    assert _seconds(f) < 10
    one = f.filter("source_sequence = 7").first()
    key = identity.fact_key("f7")
    assert one.fact_key == key.hex() and one.fact_id == identity.fact_id(key, 1, bytes.fromhex(one.observation_id)).hex()


def test_many_observation_ids(spark):
    made = spark.range(40_000, numPartitions=1).select("id", identity.observation_ids(F.lit("s" * 100), F.lit(bytes(16)), F.col("id"), F.col("id").cast("string").cast("binary")).alias("o"))
    assert _seconds(made) < 12
    assert made.filter("id = 7").first()[1] == identity.observation_id("s" * 100, bytes(16), 7, b"7").hex()


def test_many_cursors(spark, tmp_path):
    from ledgerloom.plans import native_queries  # here, or its queries would join those of test_engine

    texts = [identity.cursor(b"page:1"), "00" + identity.cursor(b"page:1"), "00.00", "zz.00", "", identity.cursor(b"")]

    def reads(t: str) -> bool:
        try:
            return identity.read_cursor(t) is not None
        except ValueError:
            return False

    assert identity.good_cursors(texts) == [reads(t) for t in texts]
    assert identity.cursors([b"page:1", b""]) == [texts[0], texts[5]]
    spark.range(40_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert _seconds(native_queries.page_cursors(spark, str(tmp_path))) < 12


def test_many_segments(spark, tmp_path):
    values = os.urandom(3000)
    row = lambda n: {"schema_version": 1, "observation_id": bytes(32), "source_id": "s", "source_session_id": bytes(16), "collector_sequence": n, "payload": str(n).encode() * 90}
    writers = [[segments.SegmentWriter(bytes(16), later=later) for _ in range(3)] for later in (False, True)]
    for k, w in [(k, w) for many in writers for k, w in enumerate(many)]:
        for n in range(9 + k):
            w.append(row(n))
            if n % 4 == 3:
                w.commit(n)
    with pytest.raises(ValueError):
        writers[1][0].seal()
    segments.settle(writers[1])
    data = [bytes(w.data) for w in writers[1]]
    assert data == [bytes(w.data) for w in writers[0]]
    assert segments.recover_many(data) == [list(segments.recover(d)) for d in data] and len(segments.recover_many(data)[0]) == 10
    wrong = segments.SegmentWriter(bytes(16), later=True)  # the second hash stays blank
    for n in range(8):
        wrong.append(row(n))
        if n % 4 == 3:
            wrong.commit(n)
            if n == 3:
                segments.settle([wrong])
    told = segments.recover(bytes(wrong.data))
    assert [next(told)[1]["collector_sequence"] for _ in range(4)] == [0, 1, 2, 3]
    with pytest.raises(segments.Corrupt, match="hash"):
        next(told)
    with pytest.raises(segments.Corrupt, match="hash"):
        segments.recover_many([data[0], bytes(wrong.data)])
    for size in (3, 4, 1023, 1024, 1025, 1027, 3000):
        c = 0xFFFFFFFF
        for b in values[:size]:
            c = identity._CRC[(c ^ b) & 255] ^ c >> 8
        assert identity.crc32c(values[:size]) == c ^ 0xFFFFFFFF
    from ledgerloom.plans import native_queries

    spark.range(8000).selectExpr("id AS event_id", "id % 200 AS user_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    q = native_queries.segment_recovery(spark, str(tmp_path))
    assert _seconds(q) < 6 and q.count() == 8000
    assert q.rdd.getNumPartitions() >= 8  # one group's work in Python is no reason to merge tasks


def test_many_small_folds(spark):
    """Keys beyond 2**53 beside a null, refused rows in the middle, and more keys than one Python group each allows in the time."""
    step = lambda state, row: (_ for _ in ()).throw(folds.Refused("no")) if row["v"] == 5 else ({"n": state.get("n", 0) + 1}, [{"n": state.get("n", 0) + 1, "v": row["v"]}])
    rows = [(2**60 + 1, 2, 1), (2**60 + 1, 1, 3), (None, 1, 7), (None, 2, 8), (4, 1, 1), (4, 2, 5), (4, 3, 6)]
    df = spark.createDataFrame(rows, "k long, o long, v long")
    got = folds.fold_batch(df, ["k"], "o", step, "k long, n long, v long, fault string", refusals=True).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(2**60 + 1, 1, 3, None), (2**60 + 1, 2, 1, None), (None, 1, 7, None), (None, 2, 8, None), (4, None, None, "no")], key=str)
    many = folds.fold_batch(spark.range(40_000).selectExpr("id div 2 AS k", "id AS o", "id + 10 AS v"), ["k"], "o", step, "k long, n long, v long")
    assert _seconds(many) < 15 and many.filter("n = 2").count() == 20_000 and many.rdd.getNumPartitions() >= 8


@pytest.mark.parametrize("far", [1, 3, 40, 1000])
def test_marks_cross_ranges(spark, monkeypatch, far):
    """Trees that run within ranges, and ones that leave them at every step, against walks node by node."""
    monkeypatch.setattr(graph, "PART", 64)
    r = random.Random(far)
    up = {i: i - r.randrange(1, far + 1) for i in range(400)} | {500: 500, 501: None, 502: 501}
    some = r.sample(sorted(up), 9)
    nodes, marks = spark.createDataFrame(list(up.items()), "n long, p long"), spark.createDataFrame([(x,) for x in [*some, 9999, None]], "t long")

    def path(x):
        while x in up:
            yield x
            x = up[x] if up[x] != x else None

    assert sorted(r[0] for r in graph.above(nodes, "n", "p", marks).collect()) == sorted({y for x in some for y in path(x)})
    assert sorted(r[0] for r in graph.below(nodes, "n", "p", marks).collect()) == sorted(x for x in up if set(path(x)) & set(some))
    names = nodes.selectExpr("concat('x', n) AS n", "concat('x', p) AS p")
    assert graph.below(names, "n", "p", marks.selectExpr("concat('x', t)")).count() == sum(bool(set(path(x)) & set(some)) for x in up)


def test_long_paths_take_few_jobs(spark, monkeypatch):
    """The number of checkpoints does not follow the depth; a cycle over ranges is still an error, and two parents count both."""
    made = []
    monkeypatch.setattr(graph, "cut", lambda df: made.append(1) or df.checkpoint(eager=True))
    chain = spark.range(200_000).selectExpr("id AS n", "id - 1 AS p")
    assert graph.below(chain, "n", "p", spark.range(5, 6)).count() == 199_995 and graph.above(chain, "n", "p", spark.range(199_999, 200_000)).count() == 200_000
    assert len(made) <= 6
    monkeypatch.setattr(graph, "PART", 16)
    with pytest.raises(ValueError):
        graph.below(spark.range(100).selectExpr("id AS n", "(id + 1) % 100 AS p"), "n", "p", spark.range(1))
    two = spark.createDataFrame([(1, None), (2, None), (3, 1), (3, 2), (4, 3)], "n long, p long")
    assert sorted(r[0] for r in graph.above(two, "n", "p", spark.range(4, 5)).collect()) == [1, 2, 3, 4]
