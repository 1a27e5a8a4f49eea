"""Stateful operators as pure steps: `step(state, row) -> (state, rows)`, for batch and streams alike.

States are plain JSON values, so that a stream keeps them as one string a key. A refused row raises `Refused` and leaves
the state as it was.
"""

from __future__ import annotations

import copy
import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from .. import groups
from ..functions.consensus import INTERVAL, next_target, proves_work
from ..functions.identity import block_work

Step = Callable[[dict, dict], tuple[dict, list[dict]]]


class Refused(ValueError):
    """A row that the state does not allow."""


#: Sources that a snapshot names at most, and the transitions that are delivered.
MOST_SOURCES, DELIVERED = 32, ("triggered", "corrected", "retracted")


def _sources(value: list | int) -> tuple[list | int, int]:
    """Names of sources in order, or their number, and the number."""
    named = sorted(set(value)) if isinstance(value, list) else value
    return named, len(named) if isinstance(named, list) else named


def _snapshot(rule: dict, row: dict) -> dict:
    """What of a row makes two snapshots the same; refuses one that contradicts itself or the rule."""
    (eligible, n), (unavailable, m) = _sources(row["eligible"]), _sources(row["unavailable"])
    both = set(eligible) & set(unavailable) if isinstance(eligible, list) and isinstance(unavailable, list) else ()
    if row["revision"] < 1 or row["at"] < 0 or both or not 0 < n + m <= MOST_SOURCES:
        raise Refused("revision or time below the least, sources on both sides, none, or too many")
    if row.get("completeness") == "complete" and m:
        raise Refused("complete, though a source is unavailable")
    for name in ("fee_rate", "quorum"):
        if row.get(name) is not None and name in rule and row[name] != rule[name]:
            raise Refused(f"the snapshot has another {name} than the rule")
    seen = {c: row.get(c) for c in ("at", "vbytes", "completeness")}
    return seen | {"eligible": eligible, "unavailable": unavailable, "correction": bool(row["correction"])}


def alert_step(rule: dict) -> Step:
    """Quorum alert: more than `threshold` for `needed` snapshots in a row, with a cooldown from the last trigger.

    rule: quorum, threshold, needed, cooldown, suppress (whether known incompleteness or an unavailable source degrades),
    and, where snapshots carry one, fee_rate. row: revision, at, vbytes, eligible and unavailable (lists of sources, or
    their numbers), correction, and optionally completeness, fee_rate and quorum.
    """

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        s, seen = dict(state), _snapshot(rule, row)

        def tell(what: str) -> tuple[dict, list[dict]]:
            return s, [{"revision": row["revision"], "transition": what, "active": s.get("active", False), "delivery": what in DELIVERED}]

        if row["revision"] == s.get("revision"):
            if seen != s["seen"]:
                raise Refused("a revision came twice with different content")
            return tell("duplicate_revision")
        if row["revision"] < s.get("revision", 0) or row["at"] < s.get("seen", row)["at"]:
            raise Refused("revision or time went back")
        s |= {"revision": row["revision"], "seen": seen}
        incomplete = row.get("completeness") == "known_incomplete" or _sources(row["unavailable"])[1]
        if _sources(row["eligible"])[1] < rule["quorum"] or rule["suppress"] and incomplete:
            s["streak"] = 0
            return tell("degraded_source")
        if row["vbytes"] <= rule["threshold"]:
            was, s["streak"], s["active"] = s.get("active", False), 0, False
            return tell(("corrected" if row["correction"] else "retracted") if was else "below_threshold")
        s["streak"] = s.get("streak", 0) + 1
        if s.get("active"):
            return tell("confirmed")
        if s["streak"] < rule["needed"]:
            return tell("pending")
        if "triggered_at" in s and row["at"] - s["triggered_at"] < rule["cooldown"]:
            return tell("cooldown_suppressed")
        s |= {"active": True, "triggered_at": row["at"]}
        return tell("triggered")

    return step


def alert_of_row(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """The alert step by the rule that each row brings with it."""
    return alert_step(row["rule"])(state, row)


def coverage_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """Gap ledger: open {action, at, revision}; close also needs evidence. Appends revisions, never edits one."""
    if row["revision"] <= state.get("revision", 0):
        raise Refused("revisions rise")
    if row["action"] == "open":
        if "start" in state:
            raise Refused("a gap is open")
        return {"revision": row["revision"], "start": row["at"]}, [{"range_start": row["at"], "range_end": None, "completeness": "known_incomplete", "revision": row["revision"], "evidence": []}]
    if "start" not in state or row["at"] < state["start"] or not row["evidence"]:
        raise Refused("no open gap, an end before its start, or no evidence")
    return {"revision": row["revision"]}, [{"range_start": state["start"], "range_end": row["at"], "completeness": "recovered", "revision": row["revision"], "evidence": sorted(set(row["evidence"]))}]


def ancestor_at(blocks: dict, tip: str, height: int) -> str:
    """The ancestor of a block (or it itself) at a height."""
    while blocks[tip][1] > height:
        tip = blocks[tip][0]
    if blocks[tip][1] != height:
        raise Refused("no ancestor at this height")
    return tip


def _required(blocks: dict, parent: str, height: int, retargets: bool) -> int:
    """Target of the block after a parent: its parent's, but for the first of an interval, which looks back over the last one."""
    bits, first = blocks[parent][3], None
    if retargets and height % INTERVAL == 0:
        first = blocks[ancestor_at(blocks, parent, height - INTERVAL)][4]
    return next_target(bits, height, first, blocks[parent][4], retargets=retargets)


def fork_choice(*, proof: bool = False, retargets: bool = True) -> Step:
    """Heaviest chain: a row has hash, parent and work. Disconnects run from the old tip down, connects up to the new one.

    The first block has no parent (null, or zeros only). With `proof` rows have bits and time instead of work: the hash must
    meet the block's own target and that must be the required one; work follows from it.
    """

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        blocks, name = state.get("blocks", {}), row["hash"]
        if name in blocks:
            return state, []
        parent = blocks.get(row["parent"])
        if parent is None and (blocks or (row["parent"] or "").strip("0")):
            raise Refused("unknown parent, or a first block with one")
        height = parent[1] + 1 if parent else 0
        if proof:
            required = _required(blocks, row["parent"], height, retargets) if parent else row["bits"]
            if not proves_work(name, row["bits"], required):
                raise Refused("the hash does not prove the required work")
        work = (parent[2] if parent else 0) + (block_work(row["bits"]) if proof else int(row["work"]))
        if work >= 1 << 256:
            raise Refused("work beyond 256 bits")
        added = [row["parent"] if parent else None, height, work, row.get("bits"), row.get("time")]
        s = {"blocks": blocks | {name: added}, "tip": state.get("tip"), "revision": state.get("revision", 0)}
        if s["tip"] is not None and work <= blocks[s["tip"]][2]:
            return s, []
        known, off, on, a, b = s["blocks"], [], [], s["tip"], name
        while a != b:
            if b is not None and (a is None or known[b][1] > known[a][1]):
                on.append(b)
                b = known[b][0]
            else:
                off.append(a)
                a = known[a][0]
        moves = [("disconnect", h) for h in off] + [("connect", h) for h in reversed(on)]
        out = [{"revision": s["revision"] + i, "action": what, "hash": h, "height": known[h][1]} for i, (what, h) in enumerate(moves, 1)]
        return s | {"tip": name, "revision": s["revision"] + len(moves)}, out

    return step


fork_choice_step = fork_choice()


def utxo_apply(state: dict, block: dict) -> tuple[dict, list[dict]]:
    """Applies a block {hash, parent, txs: [{txid, inputs, outputs}]} to unspent outputs; the first tx has no inputs.

    Nothing changes unless all of it holds: parent is the tip, every input is unspent, no output is new twice, no fee is
    negative.
    """
    if block["parent"] != state.get("tip"):
        raise Refused("the parent is not the tip")
    live, undo, events = dict(state.get("live", {})), [], []
    for tx in block["txs"]:
        spent = 0
        for point in tx["inputs"]:
            if point not in live:
                raise Refused("missing output")
            spent += live[point]
            undo.append(["spent", point, live.pop(point)])
            events.append({"event": "spent", "outpoint": point, "by": tx["txid"]})
        if tx["inputs"] and sum(tx["outputs"]) > spent:
            raise Refused("negative fee")
        for n, value in enumerate(tx["outputs"]):
            if (point := f"{tx['txid']}:{n}") in live:
                raise Refused("duplicate output")
            live[point] = value
            undo.append(["created", point, value])
            events.append({"event": "created", "outpoint": point, "by": tx["txid"]})
    return {"tip": block["hash"], "live": live, "undo": [*state.get("undo", []), [block["hash"], block["parent"], undo]]}, events


def utxo_revert(state: dict, block_hash: str) -> tuple[dict, list[dict]]:
    """Takes back the tip, its steps in reverse."""
    if not state.get("undo") or state["tip"] != block_hash:
        raise Refused("only the tip can be reverted")
    live, (_, parent, undo), events = dict(state["live"]), state["undo"][-1], []
    for kind, point, value in reversed(undo):
        if kind == "created":
            del live[point]
        else:
            live[point] = value
        events.append({"event": "creation_reverted" if kind == "created" else "spend_reverted", "outpoint": point, "by": None})
    return {"tip": parent, "live": live, "undo": state["undo"][:-1]}, events


def utxo_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """apply {hash, parent, txs} or revert {hash}, by `action`."""
    return utxo_revert(state, row["hash"]) if row["action"] == "revert" else utxo_apply(state, row)


def utxo_hash(live: dict) -> str:
    """SHA-256 over the unspent outputs in the order of their names, each with its value."""
    whole = hashlib.sha256()
    for point, value in sorted(live.items()):
        whole.update(f"{point}={value};".encode())
    return whole.hexdigest()


def chain_step(choice: Step = fork_choice_step) -> Step:
    """Fork choice and unspent outputs as one: a row is a block {offset, hash, parent, work, txs}.

    All that a block moves is applied, or nothing is. Tells one checkpoint a row: the offset, the tip, the revision of the
    last move, the digest of the unspent outputs, and how many outputs were made and taken back on the way.
    """

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        if row["offset"] <= state.get("offset", -1):
            return state, []
        dag, moves = choice(state.get("dag", {}), row)
        bodies = state.get("bodies", {}) | {row["hash"]: {"hash": row["hash"], "parent": dag["blocks"][row["hash"]][0], "txs": row["txs"]}}
        utxo, events = state.get("utxo", {}), 0
        for move in moves:
            utxo, told = utxo_apply(utxo, bodies[move["hash"]]) if move["action"] == "connect" else utxo_revert(utxo, move["hash"])
            events += len(told)
        point = {"offset": row["offset"], "tip": dag["tip"], "revision": dag["revision"], "state_hash": utxo_hash(utxo.get("live", {})), "events": events}
        return {"dag": dag, "bodies": bodies, "utxo": utxo, "offset": row["offset"]}, [point]

    return step


def align_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """Sequence numbers of one feed: {action: sequence, sequence, at} or {action: snapshot}.

    A number that does not follow the last (past 2**64 - 1 comes 0) opens a gap; after a snapshot the next number aligns
    the feed anew, whatever it is, and closes the gap.
    """
    if row["action"] == "snapshot":
        return (state | {"waits": True} if "gap_from" in state else state), []
    s, n = dict(state), row["sequence"]
    last = s.get("last")
    s["last"] = n
    if s.pop("waits", False):
        return {k: v for k, v in s.items() if k != "gap_from"}, [{"event": "reconciled", "expected": None, "sequence": n, "gap_from": s["gap_from"], "gap_until": row["at"]}]
    if last is None or n == (last + 1) % (1 << 64):
        return s, []
    s["gap_from"] = row["at"]
    return s, [{"event": "gap", "expected": (last + 1) % (1 << 64), "sequence": n, "gap_from": row["at"], "gap_until": None}]


def membership_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """One observer's pool: add, remove, or snapshot {sequence, members}; what changes nothing says nothing."""
    s = copy.deepcopy(state) or {"members": {}, "epochs": {}, "sequence": -1, "snapshot": None}
    out: list[dict] = []

    def change(txid: str, present: bool, cause: str) -> None:
        if (txid in s["members"]) != present:
            if present:
                s["epochs"][txid] = s["epochs"].get(txid, 0) + 1
                s["members"][txid] = s["epochs"][txid]
            out.append({"txid": txid, "epoch": s["epochs"][txid], "epoch_revision": 1 if present else 2, "cause": cause})
            if not present:
                del s["members"][txid]

    if row["action"] != "snapshot":
        change(row["txid"], row["action"] == "add", "direct")
        return s, out
    members = sorted(set(row["members"]))
    if row["sequence"] < s["sequence"] or row["sequence"] == s["sequence"] and members != s["snapshot"]:
        raise Refused("a snapshot is old, or differs from one of the same sequence")
    for txid in sorted(set(s["members"]) - set(members)):
        change(txid, False, "reconciled")
    for txid in members:
        change(txid, True, "reconciled")
    return s | {"sequence": row["sequence"], "snapshot": members}, out


def canonical_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """Account-chain head: commit, reorg and finality over a list of hashes by number.

    commit {parent, blocks}; reorg {old, parent, blocks} with old the canonical suffix; finalize {hash}; checkpoint
    {head, safe, finalized}, which tells what moved, safe first; observe {head, finalized, at}, with `at` rising, which
    always tells. head must be the head, and finality never goes back. Revisions of reorged blocks fall, then the new
    ones rise. A finalized block is never reorged; a safe block that is reorged is safe no more, without a revision.
    """
    chain, safe, final, n = list(state.get("chain", [])), state.get("safe", -1), state.get("finalized", -1), state.get("revision", 0)
    out: list[dict] = []
    more: dict = {}

    def tell(h: str, status: str) -> None:
        out.append({"revision": n + len(out) + 1, "hash": h, "finality": status})

    def places(*names: str) -> list[int]:
        if any(row[k] not in chain for k in names):
            raise Refused("not canonical")
        return [chain.index(row[k]) for k in names]

    action = row["action"]
    if action in ("finalize", "checkpoint", "observe"):
        names = {"finalize": ("hash",), "checkpoint": ("finalized", "safe", "head"), "observe": ("finalized", "head")}[action]
        at = places(*names)
        if at != sorted(at) or action != "finalize" and at[-1] != len(chain) - 1:
            raise Refused("not the head, or in no order of ancestry")
        if at[0] < final or action == "checkpoint" and at[1] < safe:
            raise Refused("finality went back")
        if action == "observe":
            if row["at"] <= state.get("observed_at", row["at"] - 1):
                raise Refused("time went back")
            more = {"observed_at": row["at"]} | ({"changed_at": row["at"]} if at[0] > final else {})
            tell(row["finalized"], "fast_finalized")
        else:
            if action == "checkpoint" and at[1] > safe:
                safe = at[1]
                tell(row["safe"], "safe")
            if at[0] > final:
                tell(row[names[0]], "finalized")
        final = at[0]
    else:
        blocks = list(row["blocks"])
        if action == "reorg":
            old = list(row["old"])
            if not old or not blocks or chain[-len(old) :] != old:
                raise Refused("nothing old or new, or the old blocks are not the end of the chain")
            if final >= len(chain) - len(old):
                raise Refused("a finalized block would be reorged")
            if any(h in chain for h in blocks):
                raise Refused("a replacement is canonical already")
            for h in reversed(old):
                tell(h, "reorged")
            chain = chain[: -len(old)]
            safe = -1 if safe >= len(chain) else safe
        elif not blocks or all(h in chain for h in blocks):
            if blocks and chain[(at := chain.index(blocks[0])) : at + len(blocks)] != blocks:
                raise Refused("the blocks are canonical in another order")
            return state, []
        if chain and row["parent"] != chain[-1]:
            raise Refused("the blocks do not extend the head")
        for h in blocks:
            chain.append(h)
            tell(h, "canonical_head")
    return state | more | {"chain": chain, "safe": safe, "finalized": final, "revision": n + len(out)}, out


def _packed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys, the order, and each row as JSON, so that whole numbers, nulls and lists come out of pandas as they went in."""
    return df.select(*keys, F.col(order).alias("_order"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("_row"))


#: Rows told before they leave a task.
TOLD = 8192


def fold_batch(df: DataFrame, keys: list[str], order: str, step: Step, schema: str, refusals: bool = False) -> DataFrame:
    """Rows that the step tells, by key, in order; keys lead the schema. A key's rows are one sequence by nature.

    A refused row fails the query, or, with `refusals`, makes its key one row with only a `fault`. Keys follow each other in a
    task, so many small ones cost no more than their rows.
    """
    def told(own: dict, rows: Iterator[str]) -> list[dict]:
        state, out = {}, []
        try:
            for row in rows:
                state, more = step(state, json.loads(row))
                out += [own | t for t in more]
        except Refused as e:
            if not refusals:
                raise
            out = [own | {"fault": str(e)}]
        return out

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[dict] = []
        for _, same in itertools.groupby(rows, key=lambda r: r[0]):
            first = next(same)
            out += told(dict(zip(keys, first[2:], strict=True)), itertools.chain([first[1]], (r[1] for r in same)))
            if len(out) >= TOLD:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    # Keys are told apart by their JSON, in which any two that Spark holds for equal agree.
    packed = groups.gathered(_packed(df, keys, order), keys, "_order").select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), "_row", *keys)
    return packed.mapInArrow(run, schema)


def fold_stream(df: DataFrame, keys: list[str], order: str, step: Step, schema: str) -> DataFrame:
    """The same over a stream: rows of a micro-batch in order, state kept between batches as JSON."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, out = json.loads(held.get[0]) if held.exists else {}, []
        for row in pd.concat(list(batches)).sort_values("_order", kind="stable")["_row"]:
            state, told = step(state, json.loads(row))
            out += [dict(zip(keys, key, strict=True)) | t for t in told]
        held.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=names)

    return _packed(df, keys, order).groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
