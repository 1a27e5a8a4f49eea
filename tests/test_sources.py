"""Segments, archives, consensus bytes, strict records, normalisation and control tables against known values."""

import hashlib
import json

import fixed
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import consensus, identity
from ledgerloom.operators import control, normalize
from ledgerloom.sources import archives, records, segments, wire

SESSION = bytes(range(16))
HOUR = 3_600_000_000_000


def observation(n: int, **other) -> dict:
    payload = json.dumps({"fixture_id": f"f{n}", "value": "v", "source_sequence": n}).encode()
    row = dict(schema_version=1, observation_id=identity.observation_id("s", SESSION, n, payload), source_id="s", source_session_id=SESSION, collector_sequence=n, chain="bitcoin", network="main", channel="rawtx", source_message_type="tx", source_sequence=n, source_cursor=None, observed_at_unix_ns=n, observed_at_monotonic_ns=2**64 - 1, source_time_unix_ns=-5, payload_hash=hashlib.sha256(payload).digest(), payload=payload, attributes={"b": "2", "a": "1"}, quality_flags=["x"])
    return row | other


def segment() -> segments.SegmentWriter:
    w = segments.SegmentWriter(SESSION)
    for n in range(3):
        w.append(observation(n))
    w.commit(77)
    return w


def rows_of(data: bytes) -> list[dict]:
    return [r for kind, r in segments.recover(data) if kind == "row"]


def test_wire_round_trip():
    row = observation(3)
    assert wire.decode(wire.OBSERVATION, wire.encode(wire.OBSERVATION, row)) == row
    assert wire.decode(wire.OBSERVATION, wire.encode(wire.OBSERVATION, row) + wire.put_varint(99 << 3) + b"\5") == row
    with pytest.raises(ValueError):
        wire.decode(wire.OBSERVATION, wire.encode(wire.OBSERVATION, row)[:-1])


def test_hash_of_many_chunks():
    import struct

    for n in (8193, 9216, 16384, 31_745, 65_537):
        data = bytes(i % 251 for i in range(n))
        assert identity.blake3(data) == struct.pack("<8I", *identity._node(data, 0, identity.ROOT))


def test_recovery():
    w = segment()
    committed = bytes(w.data)
    assert [r["collector_sequence"] for r in rows_of(committed)] == [0, 1, 2]
    w.append(observation(3))
    told = dict(segments.recover(bytes(w.data)))
    assert told["incident"] == {"incident": "uncommitted_tail", "at_offset": len(committed), "observations": 1}
    assert told["end"] == {"next_sequence": 3, "sealed": False, "logical_end": len(committed)}
    told = dict(segments.recover(bytes(w.data)[:-1]))
    assert told["incident"]["incident"] == "truncated_tail" and len(rows_of(bytes(w.data)[:-1])) == 3
    assert dict(segments.recover(committed + b"\0" * 64))["end"]["logical_end"] == len(committed)
    broken = bytearray(committed)
    broken[20] ^= 1
    with pytest.raises(segments.Corrupt):
        list(segments.recover(bytes(broken)))
    sealed = segment()
    sealed.seal()
    assert dict(segments.recover(bytes(sealed.data)))["end"]["sealed"]
    with pytest.raises(segments.Corrupt):
        list(segments.recover(bytes(sealed.data) + committed))
    with pytest.raises(segments.Corrupt):
        list(segments.recover(committed, b"x" * 16))
    with pytest.raises(ValueError):
        w.append(observation(9))


def test_segments_and_archives(spark, tmp_path):
    good = segment()
    good.seal()
    bad = bytearray(good.data)
    bad[20] ^= 1
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.seg").write_bytes(good.data)
    states = segments.segment_states(spark, str(tmp_path / "log"))
    rows = segments.read_segments(spark, str(tmp_path / "log"))
    got = rows.orderBy("collector_sequence").collect()
    assert [int(r.collector_sequence) for r in got] == [0, 1, 2] and got[0].attributes == {"a": "1", "b": "2"} and int(got[0].observed_at_monotonic_ns) == 2**64 - 1
    assert states.first().sealed and segments.quarantined(states).isEmpty()
    (tmp_path / "log" / "b.seg").write_bytes(bad)
    assert [r.path[-5:] for r in segments.quarantined(segments.segment_states(spark, str(tmp_path / "log"))).collect()] == ["b.seg"]

    b = archives.batches(spark.createDataFrame([(r.chain, r.network, r.source_id, r.channel, r.source_session_id, int(r.collector_sequence), r.observed_at_unix_ns) for r in got], "chain string, network string, source_id string, channel string, source_session_id binary, collector_sequence long, observed_at_unix_ns long")).first()
    key = f"raw/chain=bitcoin/network=main/source=s/channel=rawtx/date=1970-01-01/hour=00/part-{SESSION.hex()}-0-2.bin.zst"
    assert b.archivable and b.object_key == key and b.record_count == 3
    data = archives.pack(rows_of(bytes(good.data)))
    place = tmp_path / "store" / key
    place.parent.mkdir(parents=True)
    place.write_bytes(data)
    m = spark.createDataFrame([(SESSION, 0, 2, key, hashlib.sha256(data).digest(), len(data), 3, None)], "source_session_id binary, first_collector_sequence long, last_collector_sequence long, object_key string, object_sha256 binary, compressed_bytes long, record_count long, previous_manifest_hash binary")
    out = archives.replay(spark, str(tmp_path / "store"), m).orderBy("collector_sequence").collect()
    assert [r.asDict() for r in out] == [{"object_key": key} | {k: v for k, v in r.asDict().items() if k != "path"} for r in got]
    text = m.select(archives.manifest_json()).first()[0]
    want = {"source_session_id": list(SESSION), "first_collector_sequence": 0, "last_collector_sequence": 2, "object_key": key, "object_sha256": list(hashlib.sha256(data).digest()), "compressed_bytes": len(data), "record_count": 3, "previous_manifest_hash": None}
    assert text == json.dumps(want, separators=(",", ":"))
    digest = hashlib.sha256(text.encode()).digest()
    more = spark.createDataFrame([(SESSION, 3, 5, "k", b"a" * 32, 1, 3, digest), (SESSION, 6, 7, "k2", b"a" * 32, 1, 2, digest)], m.schema)
    assert [(r.object_key, r.fault) for r in archives.manifest_faults(m.unionByName(more)).collect()] == [("k2", "chain")]
    place.write_bytes(data[:-1] + b"x")
    with pytest.raises(Exception, match="altered"):
        archives.replay(spark, str(tmp_path / "store"), m).collect()
    with pytest.raises(ValueError):
        list(archives.unpack(archives.zstandard.ZstdCompressor().compress(b"\0\0\0\5ab")))


def test_consensus_bytes():
    for name, (kind, digits, want) in fixed.OBJECTS.items():
        parse, data = getattr(consensus, kind), bytes.fromhex(digits)
        if want is None:
            with pytest.raises(consensus.Malformed):
                parse(data)
            continue
        got = parse(data)
        assert {k: got[k] for k in want} == want, name
        for other in (data + b"\0", data[:-1]):
            with pytest.raises(consensus.Malformed):
                parse(other)


def test_addresses_and_targets(spark):
    assert consensus.base58check(bytes(21)) == "1111111111111111111114oLvT2"
    assert consensus.unbase58(consensus.base58(b"\0\0abc")) == b"\0\0abc"
    program = bytes.fromhex("751e76e8199196d454941c45d1b3a323f1433bd6")
    assert consensus.address(b"\0\x14" + program) == "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"
    assert consensus.address(bytes.fromhex("512079be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798")) == "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"
    assert consensus.address(b"\x6a\0") is None and consensus.address(b"") is None
    assert consensus.compact(consensus.target(0x1B0404CB)) == 0x1B0404CB
    # The first adjustment that changed a target, at height 32256.
    assert consensus.next_target(0x1D00FFFF, 32256, 1261130161, 1262152739) == 0x1D00D86A
    assert consensus.next_target(5, 2017) == 5 and consensus.next_target(5, 2016) is None
    df = spark.createDataFrame([(bytearray(b"\0\x14" + program),), (None,)], "s binary")
    assert [r[0] for r in df.select(consensus.addresses(F.col("s"), "testnet")).collect()] == ["tb1qw508d6qejxtdg4y5r3zarvary0c5xw7kxpjzsx", None]


LINEAGE = ("s", bytearray(SESSION), bytearray(b"o" * 32), 9, 1, "canonical")
CONTEXT = "source_id string, source_session_id binary, observation_id binary, recorded_at_unix_ns long, revision long, canonicality string"


def test_bitcoin_tables(spark):
    data = bytes.fromhex(fixed.OBJECTS["reorg_main_2"][1])
    df = spark.createDataFrame([("regtest", 2, bytearray(data), *LINEAGE)], f"network string, height long, raw binary, {CONTEXT}")
    want = consensus.block(data)
    t = normalize.bitcoin_tables(df)
    b = t["bitcoin_blocks"].first()
    assert (b.block_hash, b.parent_block_hash, b.transaction_count, b.source_session_id, b.parser_version) == (want["block_hash"], want["parent_block_hash"], len(want["transactions"]), SESSION.hex(), "bitcoin-native/1.0.0")
    assert t["bitcoin_inputs"].count() == sum(len(x["inputs"]) for x in want["transactions"])
    out = t["bitcoin_outputs"].first()
    script = want["transactions"][0]["outputs"][0]["script_pubkey"]
    assert (out.script_pubkey_hex, out.script_pubkey_id) == (script.hex(), hashlib.sha256(script).hexdigest())
    assert t["bitcoin_transactions"].first().virtual_size == want["transactions"][0]["virtual_size"]
    with pytest.raises(Exception, match="malformed"):
        normalize.bitcoin_tables(df.withColumn("raw", F.lit(b"x")))["bitcoin_blocks"].collect()


def test_evm_tables(spark):
    log = "struct<transaction_hash string, log_index long, address string, topics array<string>, data binary>"
    schema = f"chain_id long, block_hash string, parent_block_hash string, block_number long, transactions array<struct<transaction_hash string, sender string, recipient string, value string, nonce long, gas_limit long, max_fee_per_gas string, blob_versioned_hashes array<string>>>, receipts array<struct<transaction_hash string, success boolean, cumulative_gas_used long, logs array<{log}>>>, finality string, {CONTEXT}"
    row = lambda logs: (1, "b", "p", 5, [("t0", "a", None, "1", 0, 21, None, []), ("t1", "a", "c", "2", 1, 21, "7", ["h"])], [("t0", True, 21, []), ("t1", False, 42, logs)], "canonical_head", *LINEAGE)
    t = normalize.evm_tables(spark.createDataFrame([row([("t1", 0, "x", ["q"], bytearray(b"\x0a")), ("t1", 1, "y", [], bytearray())])], schema))
    assert {k: v.count() for k, v in t.items()} == {"evm_blocks": 1, "evm_transactions": 2, "evm_receipts": 2, "evm_logs": 2}
    assert [(r.transaction_index, r.transaction_hash, r.recipient) for r in t["evm_transactions"].collect()] == [(0, "t0", None), (1, "t1", "c")]
    assert [(r.log_index, r.raw_data_hex) for r in t["evm_logs"].collect()] == [(0, "0a"), (1, "")]
    for logs, why in (([("t0", 0, "x", [], None)], "another transaction"), ([("t1", 0, "x", [], None)] * 2, "repeated"), ([("t1", 0, "x", list("abcde"), None)], "over 4 topics")):
        with pytest.raises(Exception, match=why):
            normalize.evm_tables(spark.createDataFrame([row(logs)], schema))["evm_blocks"].collect()


def test_solana_tables(spark):
    j = fixed.MESSAGE
    ins = "program_id_index int, account_indexes array<int>, data binary"
    schema = f"signature string, slot long, blockhash string, message_version string, static_account_keys array<string>, address_table_lookup_accounts array<string>, raw binary, fee decimal(20,0), compute_units_consumed long, error string, instructions array<struct<{ins}>>, inner_instructions array<struct<outer_index int, inner_index int, {ins}>>, logs array<string>, pre_balances array<decimal(20,0)>, post_balances array<decimal(20,0)>, token_balances array<struct<account_index int, mint string, pre_amount string, post_amount string, decimals int>>, commitment string, coverage_tier string, {CONTEXT}"
    from decimal import Decimal

    each = [(i["program_id_index"], i["accounts"], bytearray(consensus.unbase58(i["data_base58"]))) for i in j["instructions"]]
    lamports = lambda k: [Decimal(x) for x in j[k]]
    row = (j["signature"], j["slot"], j["blockhash"], "v0", j["account_keys"], [], bytearray(b"raw"), Decimal(j["fee"]), j["compute_units_consumed"], None, each, [(3, 0, 1, [0], bytearray(b"\xff"))], j["logs"], lamports("pre_balances"), lamports("post_balances"), [(0, "m", "1", "2", 6)], "finalized", "all_transactions", *LINEAGE)
    df = spark.createDataFrame([row], schema)
    t = normalize.solana_tables(df)
    assert {k: v.count() for k, v in t.items()} == {"solana_transactions": 1, "solana_instructions": 5, "solana_logs": 9, "solana_balance_changes": 4, "solana_token_balance_changes": 1}
    payer = t["solana_balance_changes"].filter("account_index = 0").first()
    assert int(payer.pre_lamports) - int(payer.post_lamports) == 62984
    paths = sorted((r.outer_index, -1 if r.inner_index is None else r.inner_index) for r in t["solana_instructions"].collect())
    assert paths == [(0, -1), (1, -1), (2, -1), (3, -1), (3, 0)]
    with pytest.raises(Exception, match="commitment differ"):
        normalize.solana_tables(df.withColumn("commitment", F.lit("dead")))["solana_logs"].collect()
    with pytest.raises(Exception, match="tier"):
        normalize.solana_tables(df.withColumn("coverage_tier", F.lit("selected_accounts")))["solana_logs"].collect()


def test_fixture_facts(spark):
    o = observation(0, chain="fixture", observation_id=bytes.fromhex("e1cccf296c767900b1a187173b16cf64c642c2e93d8d9c1304314a0898762189"), payload=b'{"fixture_id": "phase0-001", "value": "x", "source_sequence": 0}')
    batches = list(segments.to_batches(iter([o | {"durable_at_unix_ns": 8, "wal_commit_hash": b""}]), segments.COMMITTED_SCHEMA))
    import pyarrow as pa

    df = spark.createDataFrame(pa.Table.from_batches(batches))
    fact = normalize.fixture_facts(df).first()
    assert fact.fact_id == "005046306e6d1a3ba16e299004a5c90c5d44544b2af3f76dc080284f27d9b83e" and fact.fact_key == "b5651831e8bd4d13edb77fa19aa3dda56691807dc42910b37f11f8d74e772bd0"
    with pytest.raises(Exception, match="sequence differs"):
        normalize.fixture_facts(df.withColumn("source_sequence", F.lit(4).cast("decimal(20,0)"))).collect()


def test_records(spark):
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "raw_json string")
    reorg = fixed.NOTIFICATION
    extra = reorg.replace('"number":"0x2","hash":"0x04', '"more":1,"number":"0x2","hash":"0x04')
    good, *bad = records.notifications(texts(reorg, extra, '{"kind":"committed","new":[]}', "no", None)).collect()
    assert (good.kind, int(good.old[0].number), good.new[0].hash[:4], good.error) == ("reorged", 2, "0x04", None)
    assert {b.error for b in bad} == {"malformed"}
    c = fixed.CHECKPOINT
    good, bad = records.checkpoints(texts(c, c.replace("0x64", "0x064"))).collect()
    assert (int(good.slot), good.safe[:4], bad.error) == (100, "0x02", "malformed")
    h = fixed.HEADS
    good, *bad = records.bsc_heads(texts(h, h.replace("0x38", "0x1"), h.replace('"number":"0x1"', '"number":"0x3"'), h.replace("1721000000000", "0"))).collect()
    assert (int(good.head.number), int(good.finalized.number), int(good.observed_at_unix_ms)) == (2, 1, 1721000000000)
    assert [b.error for b in bad] == ["malformed"] * 3
    g = fixed.GENESIS
    r = records.recorded_blocks(texts(g)).first()
    assert (r.error, int(r.number), r.raw_sha256) == (None, 0, hashlib.sha256(g.encode()).hexdigest())


def test_control(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    schema = "consumer string, source_session_id string, last_collector_sequence long"
    now = control.advance(make([("a", "s", 5), ("b", "s", 5), ("c", "s", 5)], schema), make([("a", "s", 7), ("b", "s", 4), ("c", "t", 9), ("d", "s", 1)], schema))
    assert sorted((r.consumer, r.last_collector_sequence, r.fault) for r in now.collect()) == [("a", 7, None), ("b", 5, "regression"), ("c", 5, "session_mismatch"), ("d", 1, None)]
    schema = "source_id string, source_session_id string, last_collector_sequence long"
    seg = make([(x, "s", 5) for x in "abcd"], schema)
    out = control.reclaimable(seg, make([("a", "s", 5), ("b", "t", 9), ("c", "s", 4)], schema), make([("a", "s", 6), ("b", "s", 6), ("c", "s", 6), ("d", "s", 6)], schema))
    assert {r.source_id: r.blocker for r in out.collect()} == {"a": None, "b": "broker_session_mismatch", "c": "broker_insufficient", "d": "missing_broker"}
    got = control.register(make([("r", 1, "x"), ("r", 2, "x")], "rule string, version int, body string"), make([("r", 1, "x"), ("r", 2, "y"), ("r", 3, "z")], "rule string, version int, body string"), ["rule", "version"], "body")
    assert sorted((r.version, r.outcome) for r in got.collect()) == [(1, "duplicate"), (2, "conflict"), (3, "registered")]
    stored, new = make([("e1", "c1")], "id string, content string"), make([("e1", "c1"), ("e2", "c2"), ("e2", "c2")], "id string, content string")
    assert [r.id for r in control.unseen(new, stored, "id", "content").collect()] == ["e2"]
    with pytest.raises(Exception, match="replay differs"):
        control.unseen(make([("e1", "other")], "id string, content string"), stored, "id", "content").collect()

    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    box = control.outbox_rows(make([("k1", "ok"), ("k2", "bad"), (None, "none")], "k string, payload string"), F.col("k"), at)

    def send(key, body):
        if body == "bad":
            raise RuntimeError("é" * 1000)

    after = control.settle(box, control.deliver(box, send, 60), at).orderBy("idempotency_key").collect()
    assert [(r.idempotency_key, r.status, r.attempts, (r.available_at - r.created_at).seconds) for r in after] == [("k1", "delivered", 1, 0), ("k2", "pending", 1, 60)]
    assert after[1].last_error == "é" * 512
    assert control.clip_bytes("aé", 2) == "a"


def test_split(spark):
    good, bad = normalize.split(spark.range(3), even=F.col("id") % 2 == 0, small=F.col("id") < 1)
    assert [r.id for r in good.collect()] == [0] and [(r.id, r.faults) for r in bad.collect()] == [(1, ["even", "small"]), (2, ["small"])]
