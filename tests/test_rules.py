"""Slot chain, finality, rules and decoders against the contract's cases."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.identity import blake3
from ledgerloom.operators import graph, rules
from ledgerloom.streaming import folds, slots


def play(step, *rows, state=None):
    state, out = state or {}, []
    for row in rows:
        state, more = step(state, row)
        out += more
    return state, out


def slot(f, n, parent):
    return {"action": "slot", "fork": f, "slot": n, "parent": parent}


def write(f, lamports, version, key="07"):
    return {"action": "write", "fork": f, "pubkey": key * 32, "owner": "01" * 32, "lamports": lamports, "data": "aa", "executable": False, "rent_epoch": 0, "write_version": version}


def go(f, action="activate", **more):
    return {"action": action, "fork": f} | more


TREE = (slot("r", 100, None), slot("a", 101, "r"), slot("b", 101, "r"), go("r"))


def test_switching_forks_restores_accounts():
    s, _ = play(slots.slot_step, *TREE)
    root = slots.account_hash(s)
    assert root == blake3(b"solana-account-state/v1").hex()
    s, _ = play(slots.slot_step, write("a", 10, 1), go("a"), state=s)
    first = slots.account_hash(s)
    assert [w["lamports"] for w in slots.accounts(s).values()] == [10]
    s, _ = play(slots.slot_step, write("b", 20, 1), go("b"), state=s)
    assert [w["lamports"] for w in slots.accounts(s).values()] == [20] and slots.account_hash(s) not in (root, first)
    s, out = play(slots.slot_step, go("b", "dead"), state=s)
    assert s["tip"] == "r" and slots.accounts(s) == {} and slots.account_hash(s) == root
    assert out == [{"revision": 1, "fork": "b", "before": "received", "after": "dead"}]
    s, _ = play(slots.slot_step, go("a"), state=s)
    assert slots.account_hash(s) == first


def test_late_writes_wait_for_the_next_activation():
    s, _ = play(slots.slot_step, *TREE, go("a"), write("r", 5, 1))
    assert slots.accounts(s) == {}
    s, _ = play(slots.slot_step, go("r"), write("r", 6, 2, "08"), state=s)
    assert [w["lamports"] for w in slots.accounts(s).values()] == [6]


@pytest.mark.parametrize(
    "rows",
    [
        (slot("a", 101, "b"),), (slot("c", 90, None),), (slot("c", 101, "a"),), (slot("c", 200, "x"),), (go("x"),), (write("a", 1, 3), write("a", 1, 3)), (go("a", "dead"), write("a", 1, 1)), (go("a", "dead"), slot("c", 200, "a")), (go("a", "dead"), go("a")),
        (go("a", "commitment", status="confirmed"), go("a", "commitment", status="processed")), (go("a", "commitment", status="finalized"), go("a", "dead")), (go("a", "commitment", status="finalized"), go("r", "dead")), (go("a", "nothing"),),
    ],
)
def test_slot_chain_refuses(rows):
    s, _ = play(slots.slot_step, *TREE, *rows[:-1])
    before = str(s)
    with pytest.raises(folds.Refused):
        slots.slot_step(s, rows[-1])
    assert str(s) == before


def test_commitments_and_executions():
    s, out = play(slots.slot_step, *TREE, slot("c", 102, "a"), go("a", "commitment", status="processed"), go("a", "commitment", status="processed"), go("a", "execution", signature="s"), go("a", "execution", signature="s"), go("a", "dead"), go("a", "dead"))
    assert [(r["revision"], r["after"]) for r in out] == [(1, "processed"), (2, "dead")]
    assert s["forks"]["c"]["status"] == "dead" and s["forks"]["a"]["executed"] == ["s"]


def test_checkpoints_and_fast_finality():
    c, _ = play(folds.canonical_step, {"action": "commit", "parent": None, "blocks": ["1", "2", "3"]})
    point = lambda f, s, h="3": {"action": "checkpoint", "head": h, "safe": s, "finalized": f}
    e, out = play(folds.canonical_step, point("1", "2"), point("1", "2"), point("1", "3"), state=c)
    assert [(r["hash"], r["finality"]) for r in out] == [("2", "safe"), ("1", "finalized"), ("3", "safe")]
    for bad in (point("3", "2"), point("1", "2"), point("x", "3"), point("1", "2", "2")):
        with pytest.raises(folds.Refused):
            folds.canonical_step(e, bad)
    e, out = play(folds.canonical_step, {"action": "reorg", "old": ["3"], "parent": "2", "blocks": ["4"]}, point("1", "2", "4"), state=e)
    assert [(r["hash"], r["finality"]) for r in out] == [("3", "reorged"), ("4", "canonical_head"), ("2", "safe")]
    with pytest.raises(folds.Refused):
        folds.canonical_step(e, {"action": "reorg", "old": ["4"], "parent": "2", "blocks": []})
    seen = lambda f, at: {"action": "observe", "head": "3", "finalized": f, "at": at}
    b, out = play(folds.canonical_step, seen("1", 10), seen("1", 11), seen("2", 12), seen("2", 20), state=c)
    assert [r["hash"] for r in out] == ["1", "1", "2", "2"] and (b["changed_at"], b["observed_at"]) == (12, 20)
    for bad in (seen("2", 20), seen("1", 21)):
        with pytest.raises(folds.Refused):
            folds.canonical_step(b, bad)


def test_folds_keep_lists_nulls_and_large_numbers(spark):
    rows = [("x", 1, "commit", None, ["1", "2"], None, None), ("x", 2, "reorg", "1", ["3", "4"], ["2"], None), ("x", 3, "observe", None, None, None, 2**60 + 1)]
    df = spark.createDataFrame(rows, "chain string, n long, action string, parent string, blocks array<string>, old array<string>, at long").withColumns({"head": F.lit("4"), "finalized": F.lit("3")})
    out = folds.fold_batch(df, ["chain"], "n", folds.canonical_step, "chain string, revision long, hash string, finality string").collect()
    assert [(r.hash, r.finality) for r in sorted(out, key=lambda r: r.revision)] == [("1", "canonical_head"), ("2", "canonical_head"), ("2", "reorged"), ("3", "canonical_head"), ("4", "canonical_head"), ("3", "fast_finalized")]


def test_walks(spark):
    nodes = spark.createDataFrame([(0, None), *((i, i - 1) for i in range(1, 40)), (100, 5), (7000, 6999)], "n long, p long")
    tips = spark.createDataFrame([(10,), (100,), (55,), (None,)], "t long")
    assert sorted(r[0] for r in graph.above(nodes, "n", "p", tips).collect()) == [*range(11), 100]
    assert sorted(r[0] for r in graph.below(nodes, "n", "p", spark.createDataFrame([(30,), (100,), (7000,)], "t long")).collect()) == [*range(30, 40), 100, 7000]
    assert graph.above(nodes.limit(0), "n", "p", tips).count() == 0 and graph.below(nodes.limit(0), "n", "p", tips).count() == 0
    with pytest.raises(ValueError):
        graph.below(spark.createDataFrame([(1, 2), (2, 1)], "n long, p long"), "n", "p", tips)


def test_alert_ids_and_keys(spark):
    e = spark.createDataFrame([("net", "tip", 3, 2, "complete"), ("net", None, 3, 2, "complete"), ("net", "tip", 3, 9, "known_incomplete")], "network string, disconnected_tip_hash string, revision long, reorg_depth long, completeness string")
    got = [(r.decision, r.alert_id) for r in rules.reorg_alerts(e, "rule", 2).collect()]
    assert got == [("fire", blake3(b"rule\0net\0tip\x003").hex()), ("fire", None), ("suppressed_incomplete", None)]
    df = spark.createDataFrame([(5, 4)], "start int, end int")
    want = hashlib.sha256(b"backfill/v1" + struct.pack("<Q", 2) + b"ab" + struct.pack("<IIQ", 5, 4, 7)).hexdigest()
    assert df.select(rules.request_hash("backfill/v1", F.lit("ab"), F.col("start"), F.col("end"), F.lit(7).cast("long"))).first()[0] == want
    health = spark.createDataFrame([(None,), (10,), (9,)], "c long").select(rules.finality_health(F.col("c"), F.lit(20), 10)).collect()
    assert [r[0] for r in health] == ["unknown", "healthy", "stalled"]


def test_decoders_keep_every_fact(spark):
    facts = spark.createDataFrame([(1, "p", 5, bytearray(b"ok")), (2, "p", 50, bytearray(b"no")), (3, "q", 5, bytearray(b"ok")), (4, "p", 5, None), (5, None, 5, bytearray(b"x"))], "id long, program string, slot long, raw_data binary")
    deployments = spark.createDataFrame([("p", 0, 9, "v1"), ("p", 10, None, "v2")], "program string, valid_from long, valid_to long, decoder_version string")

    def fails(data: bytes) -> str:
        raise ValueError("é" * 2000)

    out = rules.decode(facts, deployments, {"v1": lambda d: '{"n": %d}' % len(d), "v2": fails}, "program", "slot").orderBy("id").collect()
    assert [(r.decode_status, r.decoded_json) for r in out] == [("decoded", '{"n": 2}'), ("failed", None), ("unknown", None), ("unknown", None), ("unknown", None)]
    assert out[1].error == "é" * 512 and bytes(out[1].raw_data) == b"no"
