"""The operators over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, joins, sequences, views

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Numbers of a session that one task takes.
PART = 1 << 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY ALL")
def current_view_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return views.current_view(table(spark, sf, "events"), ["user_id", "event_type"], ["value", "props"], "event_id")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return views.latest_row(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("SELECT * FROM (SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL) WHERE value >= 1")
def live_after_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The filter applies to the winning revision, not to the rows that compete."""
    return views.current_view(table(spark, sf, "events"), ["user_id", "event_type"], ["value"], "event_id").filter("value >= 1")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence FROM events")
def collector_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.collector_sequence(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id", PART)


@query("SELECT user_id, before + 1 AS missing_first, event_id - 1 AS missing_last FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_id > before + 1")
def sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.gaps(table(spark, sf, "events"), ["user_id"], "event_id", PART)


@query("""WITH b AS (SELECT user_id, event_id // 4096 AS block, sha256(string_agg(event_type || ':' || event_id, '|' ORDER BY event_id)) AS digest FROM events GROUP BY ALL)
SELECT user_id, sha256(string_agg(digest, '|' ORDER BY block)) AS state_hash FROM b GROUP BY user_id""")
def state_hash_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return views.set_digest(table(spark, sf, "events"), ["user_id"], "event_id", F.concat_ws(":", "event_type", "event_id"))


#: Deployments of the example: event type, first and last event, decoder.
DEPLOYMENTS = (("click", 0, 2999, "v1"), ("click", 3000, None, "v2"), ("view", 100, 5000, "v1"), ("purchase", 0, None, "v3"), ("error", 9000, 9500, "v1"))


@query(f"""WITH d(event_type, lo, hi, decoder_version) AS (VALUES {", ".join(f"('{a}', {b}, {'NULL' if c is None else c}, '{v}')" for a, b, c, v in DEPLOYMENTS)})
SELECT event_id, e.event_type, decoder_version FROM events e LEFT JOIN d ON e.event_type = d.event_type AND event_id >= lo AND (hi IS NULL OR event_id <= hi)""")
def decoder_range_join(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame(DEPLOYMENTS, "event_type string, valid_from long, valid_to long, decoder_version string")
    return joins.decoder_for(table(spark, sf, "events").select("event_id", "event_type"), d, "event_type", "event_id")


@query("""WITH e AS (SELECT user_id, event_type, event_id FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error'))
SELECT user_id, count(DISTINCT event_type) AS present, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS present_sources, min(event_id) AS first_seen, true AS in_union, count(DISTINCT event_type) = 4 AS in_intersection, count(DISTINCT event_type) >= 3 AS in_quorum FROM e GROUP BY user_id""")
def quorum_membership(spark: SparkSession, sf: str) -> DataFrame:
    return joins.membership(table(spark, sf, "events"), "user_id", "event_type", ["click", "view", "purchase", "error"], "event_id", 3)


@query("""WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT hour, string_agg(event_type, ',' ORDER BY event_type) AS providers FROM h GROUP BY hour HAVING min(value) <> max(value)""")
def provider_divergence(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter(F.col("event_type").isin("click", "view")).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    last = views.current_view(e, ["hour", "event_type"], ["value"], "event_id")
    return joins.divergence(last, ["hour"], "event_type", "value").select("hour", F.array_join("providers", ",").alias("providers"))


@query("""WITH m AS (SELECT user_id, event_id, (value > 20)::INT AS hit FROM events), i AS (SELECT *, sum(1 - hit) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM m)
SELECT user_id, event_id, sum(hit) OVER (PARTITION BY user_id, island ORDER BY event_id)::BIGINT AS streak FROM i""")
def consecutive_true(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.runs(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", F.col("value") > 20).drop("value")


@query("""WITH i AS (SELECT user_id, event_id, event_type = 'error' AS bad, lead(event_id) OVER w AS nxt, sum((event_type <> 'error')::INT) OVER w AS island FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, min(event_id) AS interval_start, arg_max_null(nxt, event_id) AS interval_end, count(*) AS failures FROM i WHERE bad GROUP BY user_id, island""")
def health_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.intervals(table(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type") == "error")


@query("""WITH t AS (SELECT user_id, event_id, event_type = 'signup' AS up FROM events WHERE event_type IN ('signup', 'error')), l AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM t)
SELECT user_id, event_id, sum(up::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS epoch, CASE WHEN up THEN 1 ELSE 2 END AS epoch_revision FROM l WHERE up <> was""")
def mempool_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Additions and removals: repeated ones change nothing."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin("signup", "error")).select("user_id", "event_id", "event_type")
    return sequences.toggles(e, ["user_id"], "event_id", F.col("event_type") == "signup").drop("event_type")


@query("""WITH m AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM events)
SELECT *, highest IS NULL OR value > highest AS accepted FROM m""")
def monotone_guard(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.regressions(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", PART)


@query("SELECT user_id, event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS safe_point FROM events")
def safe_point_asof(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.as_of(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_id", F.col("event_type") == "purchase", "safe_point").drop("event_type")


@query("""WITH m AS (SELECT user_id, event_id, md5(event_id::VARCHAR) AS own, lag(md5((event_id // 2 * 2)::VARCHAR)) OVER (PARTITION BY user_id ORDER BY event_id) AS parent FROM events),
l AS (SELECT *, lag(own) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM m) SELECT user_id, event_id FROM l WHERE before IS NOT NULL AND parent IS DISTINCT FROM before""")
def manifest_chain_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests name the hash of the one before; those of odd numbers name a wrong one here."""
    e = table(spark, sf, "events").select("user_id", "event_id")
    e = e.withColumn("own", F.md5(F.col("event_id").cast("string").cast("binary"))).withColumn("even", F.md5(F.expr("event_id div 2 * 2").cast("string").cast("binary")))
    e = sequences.as_of(e.withColumn("parent", F.expr("lag(even) OVER (PARTITION BY user_id ORDER BY event_id)")), ["user_id"], "event_id", "event_id", F.lit(False), "none")
    return sequences.chain_breaks(e, ["user_id"], "event_id", "parent", "own").select("user_id", "event_id")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, hour(ts)::BIGINT AS hour, min(event_id) AS first_sequence, max(event_id) AS last_sequence, count(*) AS records FROM events GROUP BY ALL")
def archive_partitions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.hour("ts").cast("long").alias("hour"), "event_id")
    return e.groupBy("user_id", "date", "hour").agg(F.min("event_id").alias("first_sequence"), F.max("event_id").alias("last_sequence"), F.count(F.lit(1)).alias("records"))


@query("SELECT event_type, count(*) AS evaluations, count_if(value > 100) AS pending, count_if(value <= 100) AS delivered, max(event_id) AS latest FROM events GROUP BY event_type")
def alert_audit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("evaluations"), F.count_if(F.col("value") > 100).alias("pending"), F.count_if(F.col("value") <= 100).alias("delivered"), F.max("event_id").alias("latest"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, true AS strict FROM events")
def decoded_props(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.codecs import json_has_only

    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), json_has_only(F.col("props"), ["k"]).alias("strict"))


@query("SELECT vec_id, generate_subscripts(embedding, 1)::BIGINT - 1 AS position, unnest(embedding)::DOUBLE AS value FROM embeddings")
def zip_explode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("position", "v")).select("vec_id", F.col("position").cast("long").alias("position"), F.col("v").cast("double").alias("value"))


@query("SELECT l_returnflag, l_linestatus, sum(l_extendedprice::DECIMAL(18, 2))::DECIMAL(38, 2)::VARCHAR AS total, count(*) AS n FROM lineitem GROUP BY ALL")
def exact_decimal_total(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").cast("string").alias("total"), F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18, 2))::DECIMAL(38, 2) AS spent FROM lineitem GROUP BY ALL)
SELECT o_orderkey, (o_totalprice::DECIMAL(18, 2) - coalesce(spent, 0))::DECIMAL(38, 2)::VARCHAR AS fee, o_totalprice::DECIMAL(18, 2) < coalesce(spent, 0) AS negative_fee, spent IS NULL AS missing FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def transaction_fees(spark: SparkSession, sf: str) -> DataFrame:
    spent = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("spent"))
    total, out = F.col("o_totalprice").cast("decimal(18,2)"), F.coalesce("spent", F.lit(0).cast("decimal(38,2)"))
    return table(spark, sf, "orders").join(spent, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", (total - out).cast("decimal(38,2)").cast("string").alias("fee"), (total < out).alias("negative_fee"), F.col("spent").isNull().alias("missing"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = p_partkey % 10)")
def unspent_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as outputs of the supplier that their key names; every item is a spend of its part and supplier."""
    spends = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("vout"))
    outputs = table(spark, sf, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 10).alias("vout"))
    return joins.unspent(outputs, spends, ["p_partkey", "vout"]).drop("vout")


@query("""WITH i AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem)
SELECT a.l_partkey, a.l_suppkey, a.l_orderkey AS txid, b.l_orderkey AS conflicting_txid FROM i a JOIN i b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey > b.l_orderkey""")
def conflict_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All items: an order spends the output that part and supplier name."""
    i = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey").distinct().withColumn("arrival", F.col("l_orderkey"))
    return joins.conflicts(i, ["l_partkey", "l_suppkey"], "l_orderkey", "arrival")


@query("""WITH i AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_linenumber <= b.l_linenumber + 2 AND b.l_linenumber <= a.l_linenumber + 2""")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("end", F.col("l_linenumber") + 2)
    return joins.overlaps(i, ["l_orderkey"], "l_linenumber", "end", "l_linenumber")


@query("""WITH c AS (SELECT DISTINCT user_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type = 'click'), s AS (SELECT DISTINCT user_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type = 'view')
(SELECT *, 'removed' AS change FROM (SELECT * FROM c EXCEPT SELECT * FROM s)) UNION ALL (SELECT *, 'added' AS change FROM (SELECT * FROM s EXCEPT SELECT * FROM c))""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return views.snapshot_changes(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id", "k"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return views.keyset_page(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5000, 50)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def top_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100)


@query("SELECT l_orderkey, l_linenumber, count(*) AS deliveries FROM lineitem GROUP BY ALL")
def redelivered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("deliveries"))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def logical_facts(spark: SparkSession, sf: str) -> DataFrame:
    return views.once(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


_TREE = "p_partkey, p_partkey // 2 AS parent, p_size"


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.expr("p_partkey div 2").alias("parent"), F.col("p_size").cast("long").alias("p_size"))


_WALK = f"""WITH RECURSIVE t AS (SELECT {_TREE} FROM part), w(node, cur, root, depth, work) AS (
SELECT p_partkey, parent, p_partkey, 0, p_size::BIGINT FROM t UNION ALL SELECT node, t.parent, t.p_partkey, depth + 1, work + t.p_size FROM w JOIN t ON cur = t.p_partkey AND cur <> root)"""


@query(f"{_WALK} SELECT node, arg_max(root, depth) AS root, max(depth)::BIGINT AS depth, max(work)::BIGINT AS work FROM w GROUP BY node")
def cumulative_work(spark: SparkSession, sf: str) -> DataFrame:
    return graph.paths_to_root(_tree(spark, sf), "p_partkey", "parent", "p_size")


@query(f"{_WALK}, m AS (SELECT node, arg_max(root, depth) AS root, max(work)::BIGINT AS work FROM w GROUP BY node) SELECT root, arg_max(node, (work, -node)) AS tip, max(work) AS work FROM m GROUP BY root")
def heaviest_tip(spark: SparkSession, sf: str) -> DataFrame:
    """Fork choice: the strictly heaviest tip of each root; of equals the first seen stays."""
    walk = graph.paths_to_root(_tree(spark, sf), "p_partkey", "parent", "p_size")
    return walk.groupBy("root").agg(F.max_by("node", F.struct("work", -F.col("node"))).alias("tip"), F.max("work").alias("work"))


@query(f"{_WALK} SELECT node, root AS ancestor, depth::BIGINT AS steps FROM w WHERE depth > 0")
def ancestor_path(spark: SparkSession, sf: str) -> DataFrame:
    return graph.ancestors(_tree(spark, sf), "p_partkey", "parent")


@query(f"{_WALK} SELECT root AS node, count(*) AS descendants FROM w WHERE depth > 0 GROUP BY root")
def descendant_closure(spark: SparkSession, sf: str) -> DataFrame:
    return graph.descendants(_tree(spark, sf), "p_partkey", "parent")


@query("""WITH RECURSIVE t AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey // 2 END AS parent, p_size, (p_retailprice::DECIMAL(18, 2) * 100)::BIGINT AS fee FROM part), w(node, cur) AS (
SELECT p_partkey, p_partkey FROM t UNION ALL SELECT node, t2.p_partkey FROM w JOIN t ON cur = t.p_partkey JOIN t t2 ON t.parent = t2.p_partkey AND t2.p_partkey <> t.p_partkey), r AS (SELECT node, min(cur) AS root FROM w GROUP BY node)
SELECT root, count(*) AS members, sum(fee)::BIGINT AS total_fee, sum(p_size)::BIGINT AS total_vsize, (sum(fee) // sum(p_size))::BIGINT AS fee_rate FROM r JOIN t ON node = p_partkey GROUP BY root""")
def package_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as transactions that spend the part of half their number; every seventh spends none."""
    fee = (F.col("p_retailprice").cast("decimal(18,2)") * 100).cast("long").alias("fee")
    n = table(spark, sf, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 7 <> 0 THEN p_partkey div 2 END").alias("parent"), F.col("p_size").cast("long").alias("p_size"), fee)
    edges = n.select(F.col("p_partkey").alias("a"), F.col("parent").alias("b")).join(n.select(F.col("p_partkey").alias("b")), "b", "left_semi")
    return graph.packages(n, "p_partkey", edges, "fee", "p_size")


@query(r"""WITH d AS (SELECT event_id, sha256(unhex(sha256(event_type || ':' || event_id))) AS h FROM events)
SELECT event_id, array_to_string(list_reverse(regexp_extract_all(h, '..')), '') AS display_hash, printf('0x%x', event_id) AS quantity FROM d""")
def display_hashes(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.codecs import display_hash, to_quantity

    return table(spark, sf, "events").select("event_id", display_hash(F.concat_ws(":", "event_type", "event_id").cast("binary")).alias("display_hash"), to_quantity(F.col("event_id")).alias("quantity"))


@query("SELECT user_id, sum(CASE WHEN value >= 25 THEN event_id % 400 + 100 ELSE 0 END)::BIGINT AS vbytes, count_if(value >= 25) AS members FROM events GROUP BY user_id")
def fee_band_vbytes(spark: SparkSession, sf: str) -> DataFrame:
    """Virtual bytes at or above a fee band in each observer's view."""
    above = F.col("value") >= 25
    return table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.when(above, F.col("event_id") % 400 + 100).otherwise(0)).alias("vbytes"), F.count_if(above).alias("members"))
