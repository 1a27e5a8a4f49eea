"""Recorded JSON of nodes: strict keys, quantities and hashes, in native expressions. Rows that do not hold get an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import json_has_only, parse_quantity

HEADER = "struct<number string, hash string, parentHash string>"
BSC_CHAIN, BSC_CLIENT = 56, "bnb-chain/bsc"


def is_hash(text: Column) -> Column:
    return text.rlike("^0x[0-9a-fA-F]{64}$")


def _header(c: Column) -> Column:
    return F.struct(parse_quantity(c["number"]).alias("number"), F.lower(c["hash"]).alias("hash"), F.lower(c["parentHash"]).alias("parent_hash"))


def _header_holds(c: Column) -> Column:
    return parse_quantity(c["number"]).isNotNull() & is_hash(c["hash"]) & is_hash(c["parentHash"])


def _keys_are(raw: Column, part: str, allowed: list[str]) -> Column:
    """Whether the object at a path, or every object of the list there, has only the allowed keys."""
    objects = F.from_json(F.get_json_object(raw, f"$.{part}"), "array<string>")
    return F.coalesce(F.forall(objects, lambda x: json_has_only(x, allowed)), json_has_only(F.get_json_object(raw, f"$.{part}"), allowed))


def _checked(df: DataFrame, raw: str, holds: Column, **columns: Column) -> DataFrame:
    good = F.coalesce(holds, F.lit(False))
    out = {name: F.when(good, c) for name, c in columns.items()} | {"raw_sha256": F.sha2(F.col(raw).cast("binary"), 256), "error": F.when(~good, "malformed")}
    return df.withColumns(out)


def notifications(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """kind (committed, reorged, reverted), old and new blocks of execution notifications; a side that the kind needs is
    never empty."""
    j, kind = F.from_json(raw, f"kind string, old array<{HEADER}>, new array<{HEADER}>"), F.get_json_object(raw, "$.kind")
    side = lambda n: (F.size(j[n]) > 0) & F.forall(j[n], _header_holds) & _keys_are(F.col(raw), n, ["number", "hash", "parentHash"])
    old, new = F.coalesce(side("old"), F.lit(False)), F.coalesce(side("new"), F.lit(False))
    holds = ((kind == "committed") & new) | ((kind == "reorged") & old & new) | ((kind == "reverted") & old)
    blocks = lambda n, kinds: F.when(kind.isin(*kinds), F.transform(j[n], _header))
    return _checked(df, raw, holds, kind=kind, old=blocks("old", ("reorged", "reverted")), new=blocks("new", ("committed", "reorged")))


def checkpoints(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """slot and the head, safe and finalized payload hashes of consensus checkpoints."""
    names = {"head": "headExecutionPayloadHash", "safe": "safeExecutionPayloadHash", "finalized": "finalizedExecutionPayloadHash"}
    j = F.from_json(raw, ", ".join(f"{n} string" for n in ("slot", *names.values())))
    holds = json_has_only(F.col(raw), ["slot", *names.values()]) & parse_quantity(j["slot"]).isNotNull()
    for n in names.values():
        holds = holds & is_hash(j[n])
    return _checked(df, raw, holds, slot=parse_quantity(j["slot"]), **{k: F.lower(j[n]) for k, n in names.items()})


def bsc_heads(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """head, finalized and observed_at_unix_ms of chain 56; finalized is never above head, and a time is never zero."""
    j = F.from_json(raw, f"chainId string, client string, head {HEADER}, finalized {HEADER}, observedAtUnixMs decimal(20,0)")
    strict = json_has_only(F.col(raw), ["chainId", "client", "head", "finalized", "observedAtUnixMs"])
    for n in ("head", "finalized"):
        strict = strict & _keys_are(F.col(raw), n, ["number", "hash", "parentHash"]) & _header_holds(j[n])
    order = parse_quantity(j["finalized"]["number"]) <= parse_quantity(j["head"]["number"])
    holds = strict & order & (parse_quantity(j["chainId"]) == BSC_CHAIN) & (j["client"] == BSC_CLIENT) & (j["observedAtUnixMs"] > 0)
    return _checked(df, raw, holds, head=_header(j["head"]), finalized=_header(j["finalized"]), observed_at_unix_ms=j["observedAtUnixMs"])


def recorded_blocks(df: DataFrame, raw: str = "raw_json") -> DataFrame:
    """number, block_hash, parent_hash and transaction_hashes of recorded execution blocks."""
    j = F.from_json(raw, "number string, hash string, parentHash string, transactions array<string>, source string, capture_scope string")
    present = j["transactions"].isNotNull() & j["source"].isNotNull() & j["capture_scope"].isNotNull()
    holds = json_has_only(F.col(raw), ["number", "hash", "parentHash", "transactions", "source", "capture_scope"]) & present & _header_holds(j) & F.forall(j["transactions"], is_hash)
    return _checked(df, raw, holds, number=parse_quantity(j["number"]), block_hash=F.lower(j["hash"]), parent_hash=F.lower(j["parentHash"]), transaction_hashes=F.transform(j["transactions"], F.lower))
