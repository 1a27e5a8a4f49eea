"""Guards over configurations and alert inputs: identities, endpoints, deployments, snapshots and definitions.

A rule is a Column that is true for a good row; `normalize.split` and `normalize.demand` take dicts of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources that one snapshot may name.
MOST_SOURCES = 32
#: What a snapshot may say of its sources (fixed values, in order of code).
COMPLETENESS = ("complete", "known_incomplete", "recovered")
#: Observers of the main network that a production deployment needs.
LEAST_OBSERVERS = 3

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_PRIVATE_4 = rf"\A(127\.{_OCTET}|10\.{_OCTET}|192\.168|172\.(1[6-9]|2[0-9]|3[01]))(\.{_OCTET}){{2}}\z"
_GROUPS_6 = r"(?i)\A(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=([^:]*:){2,7}[^:]*\z)(?!.*::.*::)([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?)\z"
_PRIVATE_6 = r"(?i)\A(f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|[0:]*:0{0,3}1)\z"


def is_graphic(text: Column, most: int = 128) -> Column:
    """Not empty, visible ASCII only, at most so many bytes."""
    return text.rlike(rf"\A[!-~]{{1,{most}}}\z")


def endpoint_is_private(endpoint: Column) -> Column:
    """The host of `scheme://host:port` is an address literal of the machine itself or of a private network; names are not."""
    authority = F.regexp_replace(endpoint, r"(?s)\A.*?://", "")
    host = F.regexp_replace(F.regexp_replace(authority, r":[^:]*\z", ""), r"\A[\[\]]+|[\[\]]+\z", "")
    return host.rlike(_PRIVATE_4) | (host.rlike(_GROUPS_6) & host.rlike(_PRIVATE_6))


def endpoint_is_secure(endpoint: Column) -> Column:
    """https with a host, and no user, password, query, fragment or space."""
    return endpoint.rlike(r"(?i)\Ahttps://[^/?#@\s]+(/[^?#\s]*)?\z")


def deployment_faults(observers: DataFrame) -> DataFrame:
    """observers with `faults`: deployment, environment, source_id, network, log_path and endpoint of each are read.

    Within a deployment source and log path are its own; one in production that observes the main network alone has
    at least three observers. Null columns are faults of their row.
    """
    of = lambda *c: Window.partitionBy("deployment", *c)
    twice = lambda c: F.count(F.lit(1)).over(of(c)) > 1
    elsewhere = F.max(F.when(~F.col("network").eqNullSafe("mainnet"), 1).otherwise(0)).over(of())
    few = (F.col("environment") == "production") & (elsewhere == 0) & (F.count(F.lit(1)).over(of()) < LEAST_OBSERVERS)
    return observers.withColumn("faults", F.array_compact(F.array(
        F.when(~F.coalesce(is_graphic(F.col("source_id")), F.lit(False)), "source_identity"), F.when(twice("source_id"), "duplicate_source"), F.when(F.col("log_path").isNull() | twice("log_path"), "shared_log_path"),
        F.when(~F.coalesce(endpoint_is_private(F.col("endpoint")), F.lit(False)), "unsafe_endpoint"), F.when(few, "too_few_observers"),
    )))


def independent(first: str, second: str) -> Column:
    """Two providers (struct columns) whose source_id, provider_id and endpoint all differ; null counts as no difference."""
    differ = F.lit(True)
    for field in ("source_id", "provider_id", "endpoint"):
        differ = differ & F.coalesce(F.col(f"{first}.{field}") != F.col(f"{second}.{field}"), F.lit(False))
    return differ


def normalized_sources(sources: Column) -> Column:
    return F.array_sort(F.array_distinct(sources))


def snapshot_rules() -> dict[str, Column]:
    """Rules of a fee-band snapshot: network, revision, observed_at, quorum, eligible, unavailable, completeness."""
    eligible, away = normalized_sources(F.col("eligible")), normalized_sources(F.col("unavailable"))
    return {
        "network": is_graphic(F.col("network"), 65535),
        "revision": F.col("revision") > 0,
        "observed_at": F.col("observed_at") >= 0,
        "quorum": F.col("quorum") > 0,
        "source_identity": F.forall(F.concat(eligible, away), lambda s: F.coalesce(is_graphic(s, 65535), F.lit(False))),
        "missing_sources": F.size(eligible) + F.size(away) > 0,
        "overlapping_sources": ~F.arrays_overlap(eligible, away),
        "completeness": F.col("completeness").isin(*COMPLETENESS),
        "contradictory_completeness": (F.col("completeness") != "complete") | (F.size(away) == 0),
        "too_many_sources": F.size(eligible) + F.size(away) <= MOST_SOURCES,
    }


def definition_rules() -> dict[str, Column]:
    """Rules of an alert definition: alert_id, threshold, quorum, for_evaluations, cooldown."""
    return {
        "alert_id": is_graphic(F.col("alert_id"), 65535),
        "threshold": F.col("threshold") > 0,
        "quorum": F.col("quorum") > 0,
        "for_evaluations": F.col("for_evaluations") > 0,
        "cooldown": F.col("cooldown") >= 0,
    }
