"""Control tables: checkpoints, the reclaim gate, alert definitions, evaluations with their outbox, idempotent delivery."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.identity import blake3_hex
from .guards import COMPLETENESS, normalized_sources

#: Bytes of an error that a delivery keeps.
ERROR_BYTES = 1024


def advance(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """consumer, source_session_id, last_collector_sequence after the candidates, and `fault` for a refused one.

    One row a consumer: the highest candidate wins; one below the present sequence, or of another session, is refused
    and leaves the checkpoint as it was.
    """
    best = candidates.groupBy("consumer").agg(F.max(F.struct("last_collector_sequence", "source_session_id")).alias("n"), F.count_distinct("source_session_id").alias("sessions"))
    c = current.select("consumer", F.struct("last_collector_sequence", "source_session_id").alias("c"))
    met = c.join(best, "consumer", "full")
    fault = F.when(F.col("n").isNull(), None).when((F.col("sessions") > 1) | (F.col("c.source_session_id") != F.col("n.source_session_id")), "session_mismatch").when(F.col("n.last_collector_sequence") < F.col("c.last_collector_sequence"), "regression")
    kept = F.when(fault.isNull() & F.col("n").isNotNull(), F.col("n")).otherwise(F.col("c"))
    return met.withColumns({"fault": fault, "kept": kept}).select("consumer", "kept.source_session_id", "kept.last_collector_sequence", "fault")


def reclaimable(segments: DataFrame, broker: DataFrame, archive: DataFrame) -> DataFrame:
    """segments with `blocker`, null where the checkpoints of both broker and archive cover the segment.

    Joined by source_id; checkpoints have one row a source.
    """
    out = segments
    for name, proof in (("broker", broker), ("archive", archive)):
        out = out.join(proof.select("source_id", F.struct("source_session_id", "last_collector_sequence").alias(name)), "source_id", "left")
    blocker = F.lit(None).cast("string")
    for name in ("archive", "broker"):
        here = F.when(F.col(name).isNull(), f"missing_{name}").when(F.col(f"{name}.source_session_id") != F.col("source_session_id"), f"{name}_session_mismatch").when(F.col(f"{name}.last_collector_sequence") < F.col("last_collector_sequence"), f"{name}_insufficient")
        blocker = F.coalesce(here, blocker)
    return out.withColumn("blocker", blocker).drop("broker", "archive")


def register(known: DataFrame, offered: DataFrame, keys: list[str], body: str) -> DataFrame:
    """offered with `outcome`: registered, duplicate (same body as known) or conflict (another body, or two offered)."""
    twice = offered.groupBy(*keys).agg(F.min(body).alias("_least"), F.max(body).alias("_most"))
    met = twice.join(known.select(*keys, F.col(body).alias("_known")), keys, "left")
    told = F.when((F.col("_least") != F.col("_most")) | (F.col("_known") != F.col("_least")), "conflict").when(F.col("_known").isNotNull(), "duplicate").otherwise("registered")
    return met.select(*keys, F.col("_least").alias(body), told.alias("outcome"))


def enabled_only(evaluations: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    return evaluations.join(definitions.filter("enabled").select(*keys), keys, "left_semi")


def unseen(evaluations: DataFrame, stored: DataFrame, identity: str, content: str) -> DataFrame:
    """Evaluations not stored yet. A stored identity with other content fails the query: history is never rewritten."""
    met = evaluations.dropDuplicates([identity, content]).join(stored.select(identity, F.col(content).alias("_stored")), identity, "left")
    same = F.when(F.col("_stored").isNull(), F.lit(True)).when(F.col("_stored") == F.col(content), F.lit(False)).otherwise(F.raise_error(F.lit("a replay differs from what is stored")).cast("boolean"))
    return met.filter(same).drop("_stored")


def outbox_rows(evaluations: DataFrame, key: Column, at: Column) -> DataFrame:
    """A pending delivery for each evaluation that has an idempotency key."""
    return evaluations.withColumn("idempotency_key", key).filter("idempotency_key IS NOT NULL").withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "available_at": at, "created_at": at, "last_error": F.lit(None).cast("string")})


def clip_bytes(text: str, most: int = ERROR_BYTES) -> str:
    """The longest start of a text that is whole characters and at most `most` bytes."""
    return text.encode()[:most].decode(errors="ignore")


def deliver(due: DataFrame, send: Callable[[str, str], None], retry_after: int, key: str = "idempotency_key", body: str = "payload") -> DataFrame:
    """Sends due rows where they lie and returns key, status, attempts, last_error, wait; at least once, so sinks go by key.

    A row that fails stays pending with one attempt more; `wait` is the seconds to its next try.
    """
    schema = f"{key} string, status string, attempts int, last_error string, wait int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, b, n in zip(part[key], part[body], part["attempts"], strict=True):
                try:
                    send(k, b)
                    out.append((k, "delivered", n + 1, None, None))
                except Exception as e:  # noqa: BLE001
                    out.append((k, "pending", n + 1, clip_bytes(str(e)), retry_after))
            yield pd.DataFrame(out, columns=[key, "status", "attempts", "last_error", "wait"]).astype({"attempts": "int32", "wait": "Int32"})

    return due.select(key, body, "attempts").mapInPandas(run, schema)


def settle(outbox: DataFrame, delivered: DataFrame, now: Column) -> DataFrame:
    """The outbox with the outcomes of a delivery; rows without outcome stay as they are."""
    d = delivered.select("idempotency_key", F.struct("status", "attempts", "last_error", "wait").alias("_d"))
    met = outbox.join(d, "idempotency_key", "left")
    later = F.timestamp_seconds(F.unix_timestamp(now) + F.col("_d.wait"))
    new = {"status": F.coalesce("_d.status", "status"), "attempts": F.coalesce("_d.attempts", "attempts"), "last_error": F.when(F.col("_d").isNull(), F.col("last_error")).otherwise(F.col("_d.last_error")), "available_at": F.coalesce(later, "available_at")}
    return met.withColumns(new).drop("_d").select(*outbox.columns)


#: Codes of an evaluation's parts in its identity (fixed values, in order of code).
POLICIES = ("suppress", "evaluate_healthy_quorum")
CAUSES = ("observed", "recovered", "correction")
TRANSITIONS = ("pending", "triggered", "confirmed", "corrected", "retracted", "degraded_source", "below_threshold", "cooldown_suppressed", "duplicate_revision")
#: Transitions that are delivered.
DELIVERED = ("triggered", "corrected", "retracted")


def _short(value: Column, size: int) -> Column:
    return F.unhex(codecs.reversed_bytes(F.lpad(F.hex(value), 2 * size, "0")))


def _code(value: Column, names: tuple[str, ...]) -> Column:
    return _short(F.nullif(F.array_position(F.array(*map(F.lit, names)), value), F.lit(0)) - 1, 1)


def evaluation_id(domain: str) -> Column:
    """Identity of an evaluation, over its definition, snapshot and transition, each field framed by its length.

    Reads alert_id, network, revision, observed_at, fee_rate, vbytes, quorum, threshold, for_evaluations, cooldown,
    eligible, unavailable, policy, transition, completeness and cause. Order and repeats of sources do not matter, a null
    source counts for none; a null or unknown name in any other column gives null.
    """
    eight, text = lambda c: codecs.little_endian(F.col(c)), F.col
    several = lambda c: F.unhex(F.array_join(F.transform(normalized_sources(F.col(c)), lambda s: F.hex(codecs.framed(s))), ""))
    head = codecs.framed(F.lit(domain), text("alert_id"), text("network"), *map(eight, ("revision", "observed_at", "fee_rate", "vbytes")), _short(F.col("quorum"), 2), eight("threshold"), _short(F.col("for_evaluations"), 2), eight("cooldown"), _code(F.col("policy"), POLICIES), _code(F.col("transition"), TRANSITIONS))
    tail = codecs.framed(_code(F.col("completeness"), COMPLETENESS), _code(F.col("cause"), CAUSES))
    return blake3_hex(F.concat(head, several("eligible"), codecs.framed(F.lit("unavailable")), several("unavailable"), tail))


def outbox_key(domain: str, evaluation: Column, transition: Column) -> Column:
    """Idempotency key of a delivery; null for a transition that is not delivered."""
    return blake3_hex(F.when(transition.isin(*DELIVERED), codecs.framed(F.lit(domain), evaluation)))
