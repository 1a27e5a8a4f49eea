"""Relational operators against DuckDB; identities, codecs and folds against known values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import codecs, identity
from ledgerloom.operators import graph, joins, sequences
from ledgerloom.plans import rule_queries, store_queries  # noqa: F401 - registers its queries
from ledgerloom.plans.driver_queries import QUERIES, SQL
from ledgerloom.streaming import folds

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(f"CREATE TEMP VIEW want AS {SQL[name]}")
    names = sorted(c for c, *_ in con.execute("DESCRIBE want").fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    as_text = lambda rows: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else repr(x) for x in r) for r in rows)
    assert as_text(con.execute(f"SELECT {', '.join(names)} FROM want").fetchall()) == as_text(got.select(*names).collect())


def test_identities():
    assert identity.blake3(b"").hex().startswith("af1349b9f5f9a1a6")
    session = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert identity.observation_id("btc-observer-waw-1", session, 0, b"transaction-a").hex() == "aac819b5661872cc63649a8d91ae527b2373a0dfc7f02c66cb71dc7b502f78c2"
    key = identity.fact_key("phase0-001")
    assert key.hex() == "b5651831e8bd4d13edb77fa19aa3dda56691807dc42910b37f11f8d74e772bd0"
    seen = bytes.fromhex("e1cccf296c767900b1a187173b16cf64c642c2e93d8d9c1304314a0898762189")
    assert identity.fact_id(key, 1, seen).hex() == "005046306e6d1a3ba16e299004a5c90c5d44544b2af3f76dc080284f27d9b83e"
    assert identity.crc32c(b"123456789") == 0xE3069283 and identity.block_work(0x1D00FFFF) == 0x100010001
    assert identity.read_cursor(identity.cursor(b"x" * 3000)) == b"x" * 3000
    with pytest.raises(ValueError):
        identity.read_cursor("00.00")


def test_identity_column(spark):
    df = spark.createDataFrame([("btc-observer-waw-1", bytearray.fromhex("00112233445566778899aabbccddeeff"), 0, bytearray(b"transaction-a")), (None, None, 1, None)], "s string, z binary, n long, p binary")
    got = [r[0] for r in df.select(identity.observation_ids(F.col("s"), F.col("z"), F.col("n"), F.col("p"))).collect()]
    assert got == ["aac819b5661872cc63649a8d91ae527b2373a0dfc7f02c66cb71dc7b502f78c2", None]


def test_codecs(spark):
    df = spark.createDataFrame([("0x10", "007", '{"a": 1}', bytearray.fromhex("5120" + "00" * 32)), ("0x01", str(2**256), '{"a": 1, "b": 2}', bytearray.fromhex("6a00")), ("0xffffffffffffffff", "x", "no", bytearray(b""))], "q string, u string, j string, s binary")
    rows = df.select(codecs.parse_quantity(F.col("q")), codecs.u256(F.col("u")), codecs.json_has_only(F.col("j"), ["a"]), codecs.script_class(F.col("s"))).collect()
    assert [tuple(map(str, r)) for r in rows] == [("16", "7", "True", "taproot"), ("None", "None", "False", "op_return"), ("18446744073709551615", "None", "False", "other")]
    truth = spark.createDataFrame([("non_canonical", "reorged"), ("canonical", "reorged"), ("candidate", "pending")], "c string, f string")
    assert [r[0] for r in truth.select(codecs.truth_is_consistent("bitcoin", F.col("c"), F.col("f"))).collect()] == [True, False, True]


def test_gaps_and_quality(spark):
    df = spark.createDataFrame([("a", 44), ("a", 42), ("b", 44), ("b", 42), ("b", 43), ("b", 43)], "source string, n long")
    assert [tuple(r) for r in sequences.gaps(df, ["source"], "n").collect()] == [("a", 43, 43)]
    sources = spark.createDataFrame([("a", "healthy", 0), ("b", "gapped", 0)], "s string, health string, clock_offset long")
    assert joins.observer_quality(sources, 1000).first().quality == "degraded"
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "n long, p long"), "n", "p", limit=6)


RULE = {"quorum": 2, "threshold": 1_000_000, "needed": 1, "cooldown": 60, "suppress": True}


def snapshot(revision, at, vbytes, eligible=2, unavailable=0, correction=False):
    return {"revision": revision, "at": at, "vbytes": vbytes, "eligible": eligible, "unavailable": unavailable, "correction": correction}


def told(step, rows):
    state, out = {}, []
    for r in rows:
        state, more = step(state, r)
        out += [x["transition"] for x in more]
    return out


def test_alert():
    assert told(folds.alert_step(RULE | {"needed": 2}), [snapshot(10, 1000, 1_100_000), snapshot(11, 1010, 1_200_000), snapshot(12, 1020, 1_300_000)]) == ["pending", "triggered", "confirmed"]
    flow = [snapshot(1, 5000, 2_000_000), snapshot(2, 5010, 0), snapshot(3, 5020, 2_000_000), snapshot(4, 5061, 2_000_000), snapshot(4, 5061, 2_000_000), snapshot(5, 5062, 2_000_000, unavailable=1), snapshot(6, 5063, 0, correction=True)]
    assert told(folds.alert_step(RULE), flow) == ["triggered", "retracted", "cooldown_suppressed", "triggered", "duplicate_revision", "degraded_source", "corrected"]
    for bad in (snapshot(1, 5000, 7), snapshot(2, 4000, 7)):
        with pytest.raises(folds.Refused):
            told(folds.alert_step(RULE), [flow[0], bad])


def test_coverage_and_membership():
    state, out = folds.coverage_step({}, {"action": "open", "at": 100, "revision": 1, "evidence": []})
    with pytest.raises(folds.Refused):
        folds.coverage_step(state, {"action": "close", "at": 110, "revision": 2, "evidence": []})
    assert folds.coverage_step(state, {"action": "close", "at": 110, "revision": 2, "evidence": ["b", "a", "b"]})[1][0]["evidence"] == ["a", "b"]
    state = {}
    seen = []
    for row in ({"action": "add", "txid": "x"}, {"action": "add", "txid": "x"}, {"action": "snapshot", "sequence": 3, "members": ["y"]}, {"action": "remove", "txid": "z"}, {"action": "add", "txid": "x"}):
        state, out = folds.membership_step(state, row)
        seen += [(r["txid"], r["epoch"], r["epoch_revision"]) for r in out]
    assert seen == [("x", 1, 1), ("x", 1, 2), ("y", 1, 1), ("x", 2, 1)]


def test_chains():
    state, out = {}, []
    for h, p, w in (("g", None, 1), ("a1", "g", 1), ("b1", "g", 1), ("b2", "b1", 1), ("b2", "b1", 1)):
        state, more = folds.fork_choice_step(state, {"hash": h, "parent": p, "work": w})
        out += [(r["action"], r["hash"]) for r in more]
    assert out == [("connect", "g"), ("connect", "a1"), ("disconnect", "a1"), ("connect", "b1"), ("connect", "b2")] and state["revision"] == 5
    s0, _ = folds.utxo_apply({}, {"hash": "g", "parent": None, "txs": [{"txid": "c0", "inputs": [], "outputs": [50]}]})
    block = {"hash": "b", "parent": "g", "txs": [{"txid": "c1", "inputs": [], "outputs": [50]}, {"txid": "t", "inputs": ["c0:0"], "outputs": [49]}]}
    s1, events = folds.utxo_apply(s0, block)
    assert len(events) == 3 and len(s1["live"]) == 2 and folds.utxo_revert(s1, "b")[0] == s0
    for bad in ([{"txid": "t", "inputs": ["no:0"], "outputs": []}], [{"txid": "t", "inputs": ["c0:0"], "outputs": [51]}], [{"txid": "c0", "inputs": [], "outputs": [1]}]):
        with pytest.raises(folds.Refused):
            folds.utxo_apply(s0, block | {"txs": bad})
    with pytest.raises(folds.Refused):
        folds.utxo_revert(s1, "g")
    c, _ = folds.canonical_step({}, {"action": "commit", "parent": None, "blocks": ["1", "2", "3"]})
    c, out = folds.canonical_step(c, {"action": "reorg", "old": ["2", "3"], "parent": "1", "blocks": ["4", "5"]})
    assert [(r["hash"], r["finality"], r["revision"]) for r in out] == [("3", "reorged", 4), ("2", "reorged", 5), ("4", "canonical_head", 6), ("5", "canonical_head", 7)]
    c, _ = folds.canonical_step(c, {"action": "finalize", "hash": "4"})
    with pytest.raises(folds.Refused):
        folds.canonical_step(c, {"action": "reorg", "old": ["4", "5"], "parent": "1", "blocks": ["6"]})


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [(k, i, 1000 + i, 2_000_000 if (i * k) % 3 else 0, 2, 0, False) for k in (1, 2) for i in range(1, 12)]
    kind = "network long, revision long, at long, vbytes long, eligible long, unavailable long, correction boolean"
    df, schema = spark.createDataFrame(rows, kind), "network long, revision long, transition string, active boolean"
    batch = sorted(tuple(r) for r in folds.fold_batch(df, ["network"], "revision", folds.alert_step(RULE), schema).collect())
    for n, part in enumerate((df.filter("revision <= 5"), df.filter("revision > 5"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p={n}"))
        stream = folds.fold_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in" / "*")), ["network"], "revision", folds.alert_step(RULE), schema)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch


def test_entry_works_without_the_llm_folder():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for p in (root / "ledgerloom").rglob("*.py"):
        if "llm" not in p.parts:
            for node in ast.walk(ast.parse(p.read_text())):
                assert not (isinstance(node, ast.ImportFrom) and "llm" in (node.module or "")), p
