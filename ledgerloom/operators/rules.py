"""Rules over revisions: reorg alerts, replacements, resyncs, dead forks, accounts of a fork, backfills and decoders."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import little_endian, reversed_bytes
from ..functions.identity import blake3_hex
from . import graph, joins
from .control import clip_bytes

#: Reasons of a resync.
REASONS = ("sequence_gap", "cursor_expired", "schema_changed")


def _joined(*fields: Column) -> Column:
    return F.array_join(F.array(*(f.cast("string") for f in fields)), "\0").cast("binary")


def reorg_alerts(events: DataFrame, rule_id: str, minimum_depth: int) -> DataFrame:
    """events (network, disconnected_tip_hash, revision, reorg_depth, completeness, ...) with `decision` and `alert_id`.

    What is known to be incomplete is suppressed before the depth counts. Only fired alerts have an id; a null in a
    part of the id leaves it null.
    """
    if not rule_id.strip() or minimum_depth < 1:
        raise ValueError("a rule has a name and a depth")
    decision = F.when(F.col("completeness") == "known_incomplete", "suppressed_incomplete").when(F.col("reorg_depth") < minimum_depth, "below_threshold").otherwise("fire")
    parts = [F.col(c) for c in ("network", "disconnected_tip_hash", "revision")]
    whole = F.when((decision == "fire") & ~F.greatest(*(p.isNull() for p in parts)), _joined(F.lit(rule_id), *parts))
    return events.select("*", decision.alias("decision"), blake3_hex(whole).alias("alert_id"))


def replacements(transactions: DataFrame, conflicts: DataFrame, tx: str = "txid") -> DataFrame:
    """transactions (txid, evidence: direct, reconciled or null, replaced_txid) with `classification` and `valid`.

    conflicts has txid and conflicting_txid. Without a conflict there is no classification; otherwise it is observed,
    reconciled or, without evidence, inferred. Evidence that names no conflicting transaction is not valid.
    """
    edges = conflicts.select(F.col("txid").alias("_tx"), F.col("conflicting_txid").alias("_other"), F.lit(True).alias("_named")).distinct()
    met = transactions.join(edges.select("_tx").distinct(), F.col(tx) == F.col("_tx"), "left")
    pairs = edges.select(F.col("_tx").alias("_tx2"), "_other", "_named")
    met = met.join(pairs, (F.col(tx) == F.col("_tx2")) & (F.col("replaced_txid") == F.col("_other")), "left")
    kind = F.when(F.col("evidence") == "direct", "observed").when(F.col("evidence") == "reconciled", "reconciled").otherwise("inferred")
    named = F.coalesce("_named", F.lit(False))
    return met.select(transactions["*"], F.when(F.col("_tx").isNotNull(), kind).alias("classification"), (F.col("evidence").isNull() | named).alias("valid"))


def resyncs(channels: DataFrame, reason: str = REASONS[0]) -> DataFrame:
    """A resync frame for each channel (channel, last_delivered_sequence, current_sequence) that skipped a number."""
    if reason not in REASONS:
        raise ValueError("unknown reason")
    behind = (F.trim("channel") != "") & (F.col("current_sequence") > F.col("last_delivered_sequence") + 1)
    return channels.filter(behind).select(F.lit("resync_required").alias("type"), "channel", "last_delivered_sequence", "current_sequence", F.lit(reason).alias("reason"))


def with_execution(signals: DataFrame, executions: DataFrame) -> DataFrame:
    """signals (source_id, signature, observed_at_unix_ns) with `slot` and `blockhash` of the first execution of the
    signature, by slot and hash; null where none is known. Signals without a source or of negative time are left out."""
    first = executions.groupBy(F.col("signature").alias("_s")).agg(F.min(F.struct("slot", "blockhash")).alias("_at"))
    good = signals.filter((F.trim("source_id") != "") & (F.col("observed_at_unix_ns") >= 0))
    return good.join(first, F.col("signature") == F.col("_s"), "left").select(good["*"], F.col("_at.slot").alias("slot"), F.col("_at.blockhash").alias("blockhash"))


def dead_forks(nodes: DataFrame, node: str, parent: str, dead: Column, finalized: Column) -> DataFrame:
    """node: the forks marked dead and all that stand on them, but for marks on a fork that is, or carries, a finalized
    one: those are refused. Two passes of pointer doubling; no pairs of forks are made."""
    kept = graph.above(nodes, node, parent, nodes.filter(finalized).select(node))
    marked = nodes.filter(dead).select(F.col(node).alias("node")).join(kept, "node", "left_anti")
    return graph.below(nodes, node, parent, marked).withColumnRenamed("node", node)


def fork_accounts(writes: DataFrame, nodes: DataFrame, node: str, parent: str, tips: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The newest write of each key on the path to the tip: by slot, then write_version. writes has the node's column."""
    active = graph.above(nodes, node, parent, tips).withColumnRenamed("node", "_node")
    return writes.join(active, F.col(node) == F.col("_node"), "left_semi").groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct("slot", "write_version")).alias("_w")).select(*key, "_w.*")


def request_hash(domain: str, source: Column, start: Column, end: Column, in_flight: Column) -> Column:
    """Identity of a backfill: SHA-256 over a domain, its framed source, two heights of four bytes and the fetches in flight."""
    four = lambda c: F.unhex(reversed_bytes(F.lpad(F.hex(c), 8, "0")))
    return F.sha2(F.concat(F.lit(domain).cast("binary"), little_endian(F.octet_length(source).cast("long")), source.cast("binary"), four(start), four(end), little_endian(in_flight)), 256)


def resume(requests: DataFrame, checkpoints: DataFrame, domain: str) -> DataFrame:
    """requests (job_id, source_id, start_height, end_height, in_flight) with `request_hash`, `next_height`,
    `archive_from`, `remaining`, `state`.

    checkpoints has job_id, request_hash, materialized_height and archived_height; domain is that of `request_hash`. A job goes on after its last
    materialized height; what is archived beyond it is materialized but not archived again. States: mismatch (the request
    differs from the one begun), completed, resumed, new.
    """
    own = request_hash(domain, *(F.col(c) for c in ("source_id", "start_height", "end_height", "in_flight")))
    c = checkpoints.select(F.col("job_id").alias("_job"), F.col("request_hash").alias("_hash"), F.col("materialized_height").alias("_done"), F.col("archived_height").alias("_kept"))
    met = requests.withColumn("request_hash", own).join(c, F.col("job_id") == F.col("_job"), "left")
    go = F.coalesce(F.col("_done") + 1, F.col("start_height")).cast("long")
    state = F.when(F.col("_hash") != F.col("request_hash"), "mismatch").when(go > F.col("end_height"), "completed").when(F.col("_job").isNotNull(), "resumed").otherwise("new")
    left = F.when(state == "mismatch", 0).otherwise(F.greatest(F.col("end_height") - go + 1, F.lit(0))).cast("long")
    return met.select(requests["*"], "request_hash", go.alias("next_height"), F.greatest(go, F.col("_kept") + 1).cast("long").alias("archive_from"), left.alias("remaining"), state.alias("state"))


def decode(facts: DataFrame, deployments: DataFrame, decoders: dict[str, Callable[[bytes], str]], key: str, at: str, raw: str = "raw_data", most: int = 1024, largest: int = 1 << 20) -> DataFrame:
    """facts with decoder_version, decode_status, decoded_json, error; every fact stays, and its raw bytes as they are.

    The version is that of the deployment in force (`joins.decoder_for`); decoders maps it to a function of the bytes
    to JSON. No deployment or no function: unknown. A decoder that raises, or gives over `largest` bytes: failed, with the
    error cut to `most` bytes.
    """
    kind = "decode_status string, decoded_json string, error string"

    @F.pandas_udf(kind)
    def run(version: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for v, d in zip(version, data, strict=True):
            if v not in decoders or d is None:
                out.append(("unknown", None, None))
                continue
            try:
                told = decoders[v](bytes(d))
                if len(told.encode()) > largest:
                    raise ValueError(f"decoded JSON exceeds {largest} bytes")
                out.append(("decoded", told, None))
            except Exception as e:  # noqa: BLE001 - whatever a decoder raises is a result
                out.append(("failed", None, clip_bytes(str(e), most)))
        return pd.DataFrame(out, columns=["decode_status", "decoded_json", "error"], dtype=object)

    return joins.decoder_for(facts, deployments, key, at).withColumn("_d", run("decoder_version", raw)).select(*facts.columns, "decoder_version", "_d.*")


def replay_key(chain: Column, address: Column, fact: Column, selector: Column) -> Column:
    """Identity of a decode, the same each time it is replayed; selector is binary."""
    return blake3_hex(_joined(chain, address, fact, F.lower(F.hex(selector))))


def finality_health(changed_at: Column, now: Column, most: int) -> Column:
    """unknown before the first finality, stalled when it last moved over `most` ago, else healthy."""
    return F.when(changed_at.isNull(), "unknown").when(now - changed_at > most, "stalled").otherwise("healthy")


def reconstruction_is_independent(missing: Column, recovery: Column, observation: Column) -> Column:
    """Evidence from another, named source, of an observation (binary) that is not all zero."""
    return F.coalesce((F.trim(missing) != "") & (F.trim(recovery) != "") & (missing != recovery) & F.hex(observation).rlike("[1-9A-F]"), F.lit(False))
