"""What the service answers, as DataFrames: truth envelopes, views, previews, replay requests, readiness, stream frames.

A request is a row, so a thousand requests are one job. Refused rows come back with the names of the rules they break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..streaming import folds
from . import guards, normalize, rules

#: Bounds and names of the answers (fixed values).
MOST_SOURCES, MOST_SOURCE_BYTES = 32, 128
MOST_SELECTED, PROVIDERS = 1024, 2
MOST_SNAPSHOTS, MOST_IN_FLIGHT = 1000, 256
CHAINS = {"ethereum": (1, "ethereum-mainnet"), "bsc": (56, "bsc-mainnet")}
SOLANA = "solana-mainnet-beta"
POLICIES = ("source", "union", "intersection", "quorum")


def source_rules(sources: str) -> dict[str, Column]:
    """Rules of a list of sources: one to 32, each of at most 128 bytes of ASCII that are not all blank."""
    known = lambda s: F.coalesce(s.rlike(rf"\A\p{{ASCII}}{{1,{MOST_SOURCE_BYTES}}}\z") & s.rlike(r"\S"), F.lit(False))
    return {"sources": F.size(sources).between(1, MOST_SOURCES), "source_identity": F.forall(F.col(sources), known)}


def truth_rules(chain: str) -> dict[str, Column]:
    """Rules of a fact's truth: source_ids, revision, canonicality, finality, completeness, and what the chain adds.

    bitcoin adds network; solana adds provider_count, selected_accounts, full_firehose, reconstruction, divergent and
    recovery_ids, and its finality is the commitment.
    """
    found = source_rules("source_ids") | {
        "revision": F.col("revision") > 0,
        "status": codecs.truth_is_consistent(chain, F.col("canonicality"), F.col("finality")),
        "completeness": F.col("completeness").isin(*guards.COMPLETENESS),
    }
    if chain == "bitcoin":
        found["network"] = F.col("network").rlike(r"\S")
    if chain == "solana":
        recovered = F.size("recovery_ids") > 0
        found |= {
            "providers": (F.col("provider_count") == PROVIDERS) & (F.size(F.array_distinct("source_ids")) == PROVIDERS),
            "coverage": (F.col("selected_accounts") <= MOST_SELECTED) & ~F.col("full_firehose"),
            "divergence": ~F.col("divergent") | (F.col("completeness") != "complete"),
            "recovery": (F.col("reconstruction") == recovered) & ((F.col("completeness") == "recovered") == recovered),
        }
    return found


def truth(chain: str) -> Column:
    """The envelope beside a fact, over the columns that `truth_rules` names."""
    sources = guards.normalized_sources(F.col("source_ids")).alias("source_ids")
    status = ["revision", "canonicality", "finality"]
    if chain == "bitcoin":
        return F.struct("network", sources, *status, "height", "completeness", "as_of_unix_ns")
    if chain == "solana":
        coverage = F.struct(
            "provider_count",
            F.lit(True).alias("all_transactions"),
            F.col("selected_accounts").alias("selected_account_filter_count"),
            F.col("full_firehose").alias("full_account_firehose"),
            "reconstruction",
        )
        return F.struct(
            F.lit(SOLANA).alias("network"), sources, "revision", "slot", "blockhash", "canonicality",
            F.col("finality").alias("commitment"), "completeness", coverage.alias("coverage"),
            F.col("divergent").alias("provider_divergent"), F.col("recovery_ids").alias("recovery_observation_ids"), "as_of_unix_ns",
        )
    number, name = CHAINS[chain]
    coverage = F.struct("full_history", "archive_state", "traces").alias("coverage")
    return F.struct(F.lit(number).cast("long").alias("chain_id"), F.lit(name).alias("network"), sources, *status, "completeness", coverage, "as_of_unix_ns")


def envelopes(facts: DataFrame, chain: str) -> tuple[DataFrame, DataFrame]:
    """Facts with `truth`, and those whose truth would contradict itself, with `faults`."""
    good, bad = normalize.split(facts, **truth_rules(chain))
    return good.withColumn("truth", truth(chain)), bad


def outputs(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """txid, vout, value_sats as text, script_pubkey_hex and truth of outputs that have one; and the others with `faults`.

    A transaction is named by 64 lowercase hex digits, a script by whole bytes of them, or by none.
    """
    good, bad = normalize.split(facts, txid=F.col("txid").rlike(r"\A[0-9a-f]{64}\z"), script=F.col("script_pubkey_hex").rlike(r"\A([0-9a-f]{2})*\z"))
    return good.select("txid", "vout", F.col("value_sats").cast("string").alias("value_sats"), "script_pubkey_hex", "truth"), bad


def view_rules() -> dict[str, Column]:
    """Rules of a membership view: kind, source_ids and threshold. One source for `source`; a quorum is not above its sources."""
    one = (F.col("kind") != "source") | (F.size("source_ids") == 1)
    reached = (F.col("kind") != "quorum") | F.coalesce(F.col("threshold").between(1, F.size(F.array_distinct("source_ids"))), F.lit(False))
    return {"kind": F.col("kind").isin(*POLICIES)} | source_rules("source_ids") | {"one_source": one, "threshold": reached}


def preview(snapshots: DataFrame, definitions: DataFrame, request: str) -> DataFrame:
    """request, revision, transition, active, delivery, final_active and `fault`: what alerts would tell over snapshots.

    definitions has a row a request: alert_id, fee_rate, threshold, quorum, for_evaluations, cooldown and suppress.
    snapshots has request, position (its place in the request), network, revision, observed_at, fee_rate, vbytes, quorum,
    eligible, unavailable, completeness and cause.

    A request is answered in whole or with one row that has only a fault: no definition or a broken one, too many snapshots
    (over 1000), a broken one, or one that another refuses. Both bounds are tested by aggregates, so only requests of at most 1000
    rows meet in a task. Requests without snapshots have no row here: `definitions` anti-joined with these tells them.
    """
    rule = {k: F.coalesce(r, F.lit(False)) for k, r in guards.definition_rules().items()}
    good = F.lit(True)
    for r in rule.values():
        good = good & r
    d = definitions.select(F.col(request), good.alias("_good"), F.struct("fee_rate", "threshold", "quorum", F.col("for_evaluations").alias("needed"), "cooldown", "suppress").alias("rule"))
    kept = F.lit(True)
    for r in guards.snapshot_rules().values():
        kept = kept & F.coalesce(r, F.lit(False))
    s = snapshots.withColumn("_kept", kept)
    sizes = s.groupBy(request).agg(F.count(F.lit(1)).alias("_n"), F.min("_kept").alias("_all")).join(d, request, "left")
    fault = F.when(~F.coalesce("_good", F.lit(False)), "definition").when(F.col("_n") > MOST_SNAPSHOTS, "too_many_snapshots").when(~F.col("_all"), "snapshot")
    sizes = sizes.select(request, "rule", fault.alias("fault"))
    rows = s.join(sizes.filter("fault IS NULL"), request).select(
        request, "revision", F.col("observed_at").alias("at"), "fee_rate", "vbytes", "quorum", "eligible", "unavailable", "completeness",
        (F.col("cause") == "correction").alias("correction"), "rule", "position",
    )
    kind = snapshots.schema[request].dataType.simpleString()
    told = folds.fold_batch(rows, [request], "position", folds.alert_of_row, f"{request} {kind}, revision long, transition string, active boolean, delivery boolean, fault string", refusals=True)
    final = F.max_by("active", "revision").over(Window.partitionBy(request))
    answered = told.withColumn("final_active", final).select(request, "revision", "transition", "active", "delivery", "final_active", "fault")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    refused = sizes.filter("fault IS NOT NULL").select(
        request, none("long", "revision"), none("string", "transition"), none("boolean", "active"), none("boolean", "delivery"), none("boolean", "final_active"), "fault"
    )
    return answered.unionByName(refused)


def replay_requests(requests: DataFrame, domain: str) -> DataFrame:
    """requests (source_id, start_height, end_height, in_flight) with `request_hash`, `block_count` and `fault`.

    A blank source, a range that ends before its start, or fetches in flight outside 1 to 256 are faults; such rows have no hash.
    """
    start, end, flight = F.col("start_height"), F.col("end_height"), F.col("in_flight")
    fault = (
        F.when(~F.coalesce(F.col("source_id").rlike(r"\S"), F.lit(False)), "empty_source")
        .when(~F.coalesce(start <= end, F.lit(False)), "range")
        .when(~F.coalesce(flight.between(1, MOST_IN_FLIGHT), F.lit(False)), "in_flight")
    )
    good = lambda c: F.when(fault.isNull(), c)
    named = rules.request_hash(domain, F.col("source_id"), start.cast("long"), end.cast("long"), flight.cast("long"))
    return requests.withColumns({"request_hash": good(named), "block_count": good((end - start + 1).cast("long")), "fault": fault})


def readiness(sessions: DataFrame, checkpoints: DataFrame, **stores: bool) -> DataFrame:
    """source_id, source_session_id, a flag a store, broker_checkpoint, archive_checkpoint, ready: a row a session.

    checkpoints has kind (broker or archive), source_id and source_session_id. A session is ready if every store answers and
    both consumers have a checkpoint of it.
    """
    own = ["source_id", "source_session_id"]
    have = checkpoints.groupBy(*own).agg(*(F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(f"{k}_checkpoint") for k in ("broker", "archive")))
    met = sessions.select(*own).join(have, own, "left").withColumns({name: F.lit(up) for name, up in stores.items()})
    met = met.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("broker_checkpoint", "archive_checkpoint")})
    whole = F.col("broker_checkpoint") & F.col("archive_checkpoint")
    for name in stores:
        whole = whole & F.col(name)
    return met.select(*own, *stores, "broker_checkpoint", "archive_checkpoint", whole.alias("ready"))


def snapshot_frames(view: DataFrame, columns: list[str]) -> DataFrame:
    """`frame`: a line of JSON a fact of the current view. A reader has the snapshot when the lines end; no task holds all facts."""
    return view.select(F.to_json(F.struct(F.lit("snapshot").alias("type"), F.struct(*columns).alias("fact"))).alias("frame"))
