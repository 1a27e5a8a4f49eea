"""Rules over the driver's tables: forks, accounts, alerts, replacements, resyncs, backfills, decoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, rules
from .driver_queries import query, table

#: Events as a tree of forks: an event stands on one up to seven before it.
_PARENT = "event_id - 1 - event_id % 7"
_FORKS = f"t AS (SELECT event_id, {_PARENT} AS parent, user_id, event_type, value FROM events)"


def _forks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.expr(f"{_PARENT} AS parent"), "user_id", "event_type", "value")


@query(f"""WITH RECURSIVE {_FORKS}, up(event_id) AS (SELECT event_id FROM t WHERE value > 300 UNION SELECT t.parent FROM up JOIN t USING (event_id) JOIN t p ON t.parent = p.event_id),
down(event_id) AS (SELECT event_id FROM t WHERE event_type = 'error' AND value > 200 AND event_id NOT IN (SELECT event_id FROM up) UNION SELECT t.event_id FROM down JOIN t ON t.parent = down.event_id)
SELECT event_id FROM down""")
def dead_forks(spark: SparkSession, sf: str) -> DataFrame:
    """Forks that die with the marked ones; marks under a finalized fork are refused."""
    return rules.dead_forks(_forks(spark, sf), "event_id", "parent", F.expr("event_type = 'error' AND value > 200"), F.col("value") > 300)


@query(f"""WITH RECURSIVE {_FORKS}, up(event_id) AS (SELECT max(event_id) FROM t UNION SELECT t.parent FROM up JOIN t USING (event_id) JOIN t p ON t.parent = p.event_id)
SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS slot FROM t WHERE event_id IN (SELECT event_id FROM up) GROUP BY user_id""")
def active_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts as the active fork's path leaves them."""
    t = _forks(spark, sf)
    writes = t.select("event_id", "user_id", "value", F.col("event_id").alias("slot"), F.lit(0).alias("write_version"))
    return rules.fork_accounts(writes, t, "event_id", "parent", t.agg(F.max("event_id")), ["user_id"], ["value", "slot"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'suppressed_incomplete' WHEN o_orderkey % 9 < 4 THEN 'below_threshold' ELSE 'fire' END AS decision, o_orderstatus <> 'P' AND o_orderkey % 9 >= 4 AS has_id FROM orders""")
def reorg_decisions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.lit("n").alias("network"), F.col("o_custkey").alias("disconnected_tip_hash"), F.col("o_orderkey").alias("revision"), (F.col("o_orderkey") % 9).alias("reorg_depth"), F.when(F.col("o_orderstatus") == "P", "known_incomplete").otherwise("complete").alias("completeness"))
    return rules.reorg_alerts(o, "deep", 4).select("o_orderkey", "decision", F.col("alert_id").isNotNull().alias("has_id"))


@query("""WITH i AS (SELECT l_orderkey AS txid, l_partkey AS out, l_suppkey AS vout FROM lineitem), c AS (SELECT DISTINCT a.txid, b.txid AS other FROM i a JOIN i b USING (out, vout) WHERE a.txid > b.txid),
o AS (SELECT o_orderkey AS txid, CASE o_orderstatus WHEN 'F' THEN 'direct' WHEN 'P' THEN 'reconciled' END AS evidence, o_orderkey - 1 AS replaced FROM orders)
SELECT txid, CASE WHEN txid NOT IN (SELECT txid FROM c) THEN NULL WHEN evidence = 'direct' THEN 'observed' WHEN evidence = 'reconciled' THEN 'reconciled' ELSE 'inferred' END AS classification,
evidence IS NULL OR (txid, replaced) IN (SELECT txid, other FROM c) AS valid FROM o""")
def replacement_classes(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("txid"), F.col("l_partkey").alias("out"), F.col("l_suppkey").alias("vout")).distinct()
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("txid"), F.when(F.col("o_orderstatus") == "F", "direct").when(F.col("o_orderstatus") == "P", "reconciled").alias("evidence"), (F.col("o_orderkey") - 1).alias("replaced_txid"))
    return rules.replacements(o, joins.conflicts(i, ["out", "vout"], "txid", "txid")).select("txid", "classification", "valid")


@query("""SELECT 'resync_required' AS type, user_id::VARCHAR AS channel, min(event_id) AS last_delivered_sequence, max(event_id) AS current_sequence, 'sequence_gap' AS reason FROM events GROUP BY user_id HAVING max(event_id) > min(event_id) + 1""")
def stream_resyncs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("channel")).agg(F.min("event_id").alias("last_delivered_sequence"), F.max("event_id").alias("current_sequence"))
    return rules.resyncs(e)


@query("""SELECT o_orderkey, slot, part FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS slot, arg_min(l_linenumber::VARCHAR, (l_partkey, l_linenumber)) AS part FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def signal_executions(spark: SparkSession, sf: str) -> DataFrame:
    """Signals seen before execution with the first execution of their signature."""
    signals = table(spark, sf, "orders").select("o_orderkey", F.lit("s").alias("source_id"), F.col("o_orderkey").alias("signature"), F.lit(0).cast("long").alias("observed_at_unix_ns"))
    executions = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("signature"), F.col("l_partkey").alias("slot"), F.col("l_linenumber").cast("string").alias("blockhash"))
    return rules.with_execution(signals, executions).select("o_orderkey", "slot", F.col("blockhash").alias("part"))


@query("""SELECT p_partkey, (p_size + CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END)::BIGINT AS next_height, CASE WHEN p_partkey % 2 = 1 THEN 'new' WHEN p_partkey % 10 = 0 THEN 'mismatch' ELSE 'resumed' END AS state, CASE WHEN p_partkey % 10 = 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 98 ELSE 101 END::BIGINT AS remaining FROM part""")
def backfill_resume(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), F.lit("s").alias("source_id"), F.col("p_size").alias("start_height"), (F.col("p_size") + 100).alias("end_height"), F.lit(4).cast("long").alias("in_flight"))
    begun = jobs.filter("job_id % 2 = 0").select("job_id", rules.request_hash("backfill/v1", F.col("source_id"), F.col("start_height"), F.col("end_height"), F.when(F.col("job_id") % 10 == 0, 5).otherwise(4).cast("long")).alias("request_hash"), (F.col("start_height") + 2).alias("materialized_height"), (F.col("start_height") + 5).alias("archived_height"))
    return rules.resume(jobs, begun, "backfill/v1").select(F.col("job_id").alias("p_partkey"), "next_height", "state", "remaining")
