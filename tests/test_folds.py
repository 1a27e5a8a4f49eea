"""What the steps refuse, replay and compose."""

import copy

import pytest

from ledgerloom.functions.consensus import block as parse_block
from ledgerloom.streaming import folds

RULE = {"quorum": 2, "threshold": 40, "needed": 1, "cooldown": 0, "suppress": True, "fee_rate": 5}


def play(step, *rows, state=None):
    state, out = state or {}, []
    for row in rows:
        state, more = step(state, row)
        out += more
    return state, out


def refuses(step, state, row):
    before = copy.deepcopy(state)
    with pytest.raises(folds.Refused):
        step(state, row)
    assert state == before


def commit(parent, *blocks):
    return {"action": "commit", "parent": parent, "blocks": list(blocks)}


def test_replays_inside_the_chain_tell_nothing():
    s, _ = play(folds.canonical_step, commit(None, "1", "2", "3"))
    for again in (("1", "2"), ("2",), ("2", "3"), ("1", "2", "3")):
        assert folds.canonical_step(s, commit("x", *again)) == (s, [])
    refuses(folds.canonical_step, s, commit(None, "2", "1"))
    refuses(folds.canonical_step, s, commit(None, "1", "3"))
    refuses(folds.canonical_step, s, commit("2", "3", "4"))
    refuses(folds.canonical_step, s, {"action": "reorg", "old": ["3"], "parent": "2", "blocks": ["1"]})
    refuses(folds.canonical_step, s, {"action": "reorg", "old": ["3"], "parent": "2", "blocks": ["3"]})
    refuses(folds.canonical_step, s, {"action": "reorg", "old": ["3"], "parent": "1", "blocks": ["4"]})


def snap(revision, vbytes, **more):
    return {"revision": revision, "at": revision, "vbytes": vbytes, "eligible": ["a", "b"], "unavailable": [], "correction": False, "completeness": "complete", "fee_rate": 5, "quorum": 2} | more


def test_alerts_degrade_and_refuse():
    step = folds.alert_step(RULE)
    s, out = play(step, snap(1, 50), snap(1, 50), snap(2, 50, completeness="known_incomplete"), snap(3, 10))
    assert [(r["transition"], r["delivery"]) for r in out] == [("triggered", True), ("duplicate_revision", False), ("degraded_source", False), ("retracted", True)]
    refuses(step, s, snap(3, 10, eligible=["a", "c"]))
    bad = ({"fee_rate": 6}, {"quorum": 3}, {"unavailable": ["c"]}, {"unavailable": ["a"], "completeness": "known_incomplete"}, {"eligible": [], "unavailable": []}, {"eligible": [f"s{i}" for i in range(33)]}, {"at": -1})
    for more in bad:
        refuses(step, s, snap(4, 10, **more))
    refuses(step, s, snap(0, 10))


def test_first_blocks_have_no_parent():
    refuses(folds.fork_choice_step, {}, {"hash": "b5", "parent": "b4", "work": 1})
    s, out = play(folds.fork_choice_step, {"hash": "a", "parent": "00" * 32, "work": 1}, {"hash": "b", "parent": "a", "work": 1})
    assert [r["height"] for r in out] == [0, 1]
    refuses(folds.fork_choice_step, s, {"hash": "c", "parent": None, "work": 1})


def test_proof_of_work_and_required_target():
    step, easy = folds.fork_choice(proof=True, retargets=False), 0x207FFFFF
    s, out = play(step, {"hash": "0" * 64, "parent": None, "bits": easy, "time": 1}, {"hash": "1" * 64, "parent": "0" * 64, "bits": easy, "time": 2})
    assert len(out) == 2 and s["blocks"]["1" * 64][2] == 2 * folds.block_work(easy)
    refuses(step, s, {"hash": "f" * 64, "parent": "1" * 64, "bits": easy, "time": 3})
    refuses(step, s, {"hash": "0" * 63 + "1", "parent": "1" * 64, "bits": 0x1F00FFFF, "time": 3})
    name = lambda n: f"{n:064x}"
    chain = [{"hash": name(n), "parent": name(n - 1) if n else None, "bits": 0x1D00FFFF, "time": 600 * n} for n in range(2016)]
    s, _ = play(folds.fork_choice(proof=True), *chain)
    assert folds.ancestor_at(s["blocks"], name(2015), 0) == name(0)
    slower = folds.next_target(0x1D00FFFF, 2016, 0, 600 * 2015)
    assert folds.fork_choice(proof=True)(s, {"hash": name(5000), "parent": name(2015), "bits": slower, "time": 0})[1]
    refuses(folds.fork_choice(proof=True), s, {"hash": name(5000), "parent": name(2015), "bits": 0x1C00FFFF, "time": 0})


def tx(name, inputs, *outputs):
    return {"txid": name, "inputs": list(inputs), "outputs": list(outputs)}


def test_chain_moves_all_or_nothing():
    step = folds.chain_step()
    rows = [
        {"offset": 0, "hash": "g", "parent": None, "work": 1, "txs": [tx("g", [], 50)]},
        {"offset": 1, "hash": "a", "parent": "g", "work": 1, "txs": [tx("a", [], 50), tx("s", ["g:0"], 20, 30)]},
        {"offset": 2, "hash": "b", "parent": "g", "work": 2, "txs": [tx("b", [], 50)]},
    ]
    s, out = play(step, *rows)
    assert [r["revision"] for r in out] == [1, 2, 4] and out[2]["tip"] == "b" and out[2]["events"] == 5
    assert out[2]["state_hash"] == folds.utxo_hash({"g:0": 50, "b:0": 50})
    assert step(s, rows[2]) == (s, [])
    refuses(step, s, {"offset": 3, "hash": "c", "parent": "b", "work": 1, "txs": [tx("c", [], 50), tx("d", ["a:0"], 1)]})


def test_gaps_wrap_and_align():
    row = lambda n, at: {"action": "sequence", "sequence": n, "at": at}
    _, out = play(folds.align_step, row(2**64 - 1, 1), row(0, 2), {"action": "snapshot"}, row(5, 3), row(9, 4), {"action": "snapshot"}, row(2, 5), row(3, 6))
    assert [(r["event"], r["expected"], r["sequence"], r["gap_from"], r["gap_until"]) for r in out] == [("gap", 1, 5, 3, None), ("gap", 6, 9, 4, None), ("reconciled", None, 2, 4, 5)]


def test_blocks_are_still_parsed():
    with pytest.raises(ValueError):
        parse_block(b"")
