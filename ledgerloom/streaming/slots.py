"""The slot chain: a tree of forks with commitments, transactions and account writes; accounts follow the active fork.

A write keeps whether it is in force. Moving the active tip takes the writes of the forks left behind out of force and
puts all writes of the forks entered into force; accounts are what the writes in force say along the active path.
"""

from __future__ import annotations

import struct

from ..functions.identity import blake3
from .folds import Refused

#: Commitments by rank; `dead` ends every one of them but the last.
RANK = {"received": 0, "processed": 1, "confirmed": 2, "finalized": 3}
ACCOUNT = ("pubkey", "owner", "lamports", "data", "executable", "rent_epoch", "write_version")


def path(forks: dict, tip: str | None) -> list[str]:
    """The forks from `tip` to the root."""
    out = []
    while tip is not None:
        out.append(tip)
        tip = forks[tip]["parent"]
    return out


def _move(forks: dict, old: str | None, new: str | None) -> None:
    left, entered = path(forks, old), path(forks, new)
    for several, force in ((set(left) - set(entered), False), (set(entered) - set(left), True)):
        for f in several:
            forks[f] = forks[f] | {"writes": [w | {"force": force} for w in forks[f]["writes"]]}


def slot_step(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """row: action and fork, and for `slot` also slot and parent (null for the one root), for `commitment` status, for
    `execution` signature, for `write` the columns of ACCOUNT (pubkey, owner and data as hex). `dead` and `activate`
    need no more.

    Tells revisions of commitments; of a fork that dies only its own, though all that stand on it die too. A write is in
    force at once only if its fork is the active tip. A finalized fork, or one that carries a finalized one, never dies.
    """
    action, f = row["action"], row["fork"]
    forks, tip, revision = dict(state.get("forks", {})), state.get("tip"), state.get("revision", 0)
    if action == "slot":
        parent = row.get("parent")
        if f in forks:
            if forks[f]["parent"] != parent:
                raise Refused("a fork came twice with different parents")
            return state, []
        if parent is None and forks:
            raise Refused("there is a root")
        if parent is not None and (parent not in forks or forks[parent]["status"] == "dead" or row["slot"] <= forks[parent]["slot"]):
            raise Refused("the parent is unknown, dead or not earlier")
        forks[f] = {"slot": row["slot"], "parent": parent, "status": "received", "writes": [], "executed": []}
        return state | {"forks": forks}, []
    if f not in forks:
        raise Refused("unknown fork")
    own, to = forks[f], "dead" if action == "dead" else row.get("status") if action == "commitment" else None
    if to is not None and to == own["status"]:
        return state, []
    if to == "dead":
        doomed = [g for g in forks if f in path(forks, g)]
        if any(forks[g]["status"] == "finalized" for g in doomed):
            raise Refused("a finalized fork would die")
        if tip in doomed:
            _move(forks, tip, own["parent"])
            tip = own["parent"]
        for g in doomed:
            forks[g] = forks[g] | {"status": "dead"}
    elif own["status"] == "dead":
        raise Refused("the fork is dead")
    elif to is not None:
        if RANK[to] < RANK[own["status"]]:
            raise Refused("a commitment went back")
        forks[f] = own | {"status": to}
    elif action == "execution":
        if row["signature"] in own["executed"]:
            return state, []
        forks[f] = own | {"executed": [*own["executed"], row["signature"]]}
    elif action == "write":
        if own["writes"] and row["write_version"] <= own["writes"][-1]["write_version"]:
            raise Refused("write versions rise")
        forks[f] = own | {"writes": [*own["writes"], {c: row[c] for c in ACCOUNT} | {"force": f == tip}]}
    elif action == "activate":
        _move(forks, tip, f)
        tip = f
    else:
        raise Refused(f"unknown action {action}")
    out = [] if to is None else [{"revision": revision + 1, "fork": f, "before": own["status"], "after": to}]
    return state | {"forks": forks, "tip": tip, "revision": revision + len(out)}, out


def accounts(state: dict) -> dict[str, dict]:
    """The accounts of the active path by key."""
    forks = state.get("forks", {})
    return {w["pubkey"]: w for f in reversed(path(forks, state.get("tip"))) for w in forks[f]["writes"] if w["force"]}


def account_hash(state: dict) -> str:
    """BLAKE3 over the accounts in the order of their keys."""
    out = [b"solana-account-state/v1"]
    for key, w in sorted(accounts(state).items()):
        data = bytes.fromhex(w["data"])
        out += [bytes.fromhex(key), bytes.fromhex(w["owner"]), struct.pack("<QQ", w["lamports"], len(data)), data, struct.pack("<?QQ", w["executable"], w["rent_epoch"], w["write_version"])]
    return blake3(b"".join(out)).hex()
