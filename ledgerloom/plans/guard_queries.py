"""Guards, feeds, fact tables and alert identities over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import control, guards, normalize
from ..sources import feeds, polling, tables
from .driver_queries import query, table
from .oracles import blake3_sql, framed_hex, little, text_hex


def _framed(digits: str) -> str:
    """Hex of bytes after their length."""
    return f"{little(f'length({digits}) // 2')} || {digits}"


_N = "c_custkey"
_FIELDS = " || ".join([
    framed_hex("'evaluation/v1'"), framed_hex("'a' || c_nationkey"), framed_hex("'main'"), *(_framed(little(n)) for n in (_N, _N, "c_nationkey", f"{_N} * 3")), _framed(little(f"{_N} % 5 + 1", 4)), _framed(little("1000")), _framed("'0200'"), _framed(little("60")),
    _framed("'01'"), _framed(little(f"{_N} % 9", 2)), framed_hex("'s1'"), framed_hex("'s2'"), framed_hex("'unavailable'"), framed_hex("'t' || c_nationkey"), _framed("'01'"), _framed(little(f"{_N} % 3", 2)),
])


@query(f"""WITH RECURSIVE {blake3_sql("customer", _N, _FIELDS, "e")}, d AS (SELECT key AS c_custkey, digest, {framed_hex("'outbox/v1'")} || {framed_hex("digest")} AS h FROM e WHERE key % 9 IN (1, 3, 4)),
{blake3_sql("d", _N, "h", "o")}
SELECT e.key AS c_custkey, e.digest AS evaluation_id, o.digest AS idempotency_key FROM e LEFT JOIN o ON o.key = e.key""")
def evaluation_ids(spark: SparkSession, sf: str) -> DataFrame:
    n, names = F.col(_N), lambda known, by: F.element_at(F.array(*map(F.lit, known)), (by + 1).cast("int"))
    c = table(spark, sf, "customer").select(
        n, F.concat(F.lit("a"), "c_nationkey").alias("alert_id"), F.lit("main").alias("network"), n.alias("revision"), n.alias("observed_at"), F.col("c_nationkey").alias("fee_rate"), (n * 3).alias("vbytes"), (n % 5 + 1).alias("quorum"), F.lit(1000).alias("threshold"),
        F.lit(2).alias("for_evaluations"), F.lit(60).alias("cooldown"), F.array(F.lit("s2"), F.lit("s1"), F.lit("s2")).alias("eligible"), F.array(F.concat(F.lit("t"), "c_nationkey")).alias("unavailable"), F.lit("evaluate_healthy_quorum").alias("policy"),
        names(control.TRANSITIONS, n % 9).alias("transition"), F.lit("known_incomplete").alias("completeness"), names(control.CAUSES, n % 3).alias("cause"),
    )
    made = c.select(_N, "transition", control.evaluation_id("evaluation/v1").alias("evaluation_id"))
    return made.select(_N, "evaluation_id", control.outbox_key("outbox/v1", F.col("evaluation_id"), F.col("transition")).alias("idempotency_key"))


@query("""SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_nationkey = 0 THEN 'revision' END, CASE WHEN s_suppkey % 5 = 0 THEN 'source_identity' END, CASE WHEN s_suppkey % 4 = s_nationkey % 4 THEN 'overlapping_sources' END,
CASE WHEN s_suppkey % 2 = 0 THEN 'contradictory_completeness' END, CASE WHEN s_nationkey > 30 - s_suppkey % 10 THEN 'too_many_sources' END], lambda x: x IS NOT NULL), ',') AS faults FROM supplier""")
def snapshot_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as snapshots of nation + 1 healthy sources and one absent, which may be one of them."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    name = lambda x: F.concat(F.lit("s"), x.cast("string"))
    s = table(spark, sf, "supplier").select(
        k, F.lit("main").alias("network"), n.alias("revision"), k.alias("observed_at"), F.lit(1).alias("quorum"), F.transform(F.sequence(F.lit(0), n.cast("int")), name).alias("healthy"),
        F.when(k % 4 == n % 4, name(n)).otherwise(F.lit("away")).alias("absent"), F.when(k % 2 == 0, "complete").otherwise("known_incomplete").alias("completeness"),
    )
    more = F.transform(F.sequence(F.lit(1), (k % 10).cast("int") + 1), lambda x: F.concat(F.lit("more"), x.cast("string")))
    extra = F.when(k % 5 == 0, F.array(F.lit("not graphic"))).otherwise(F.array().cast("array<string>"))
    s = s.select("s_suppkey", "network", "revision", "observed_at", "quorum", "completeness", F.concat("healthy", F.slice(more, 1, (k % 10).cast("int"))).alias("eligible"), F.concat(F.array("absent"), extra).alias("unavailable"))
    good, bad = normalize.split(s, **guards.snapshot_rules())
    return good.select("s_suppkey", F.lit("").alias("faults")).unionByName(bad.select("s_suppkey", F.array_join("faults", ",").alias("faults")))


@query("""WITH o AS (SELECT s_suppkey, s_nationkey, count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 7) AS alike, count(*) OVER (PARTITION BY s_nationkey) AS n, max((s_suppkey % 50 = 0)::INT) OVER (PARTITION BY s_nationkey) AS other FROM supplier)
SELECT s_suppkey, concat_ws(',', CASE WHEN alike > 1 THEN 'duplicate_source' END, CASE WHEN s_suppkey % 3 > 0 THEN 'unsafe_endpoint' END, CASE WHEN s_nationkey % 2 = 0 AND other = 0 AND n < 3 THEN 'too_few_observers' END) AS faults FROM o""")
def deployment_guard(spark: SparkSession, sf: str) -> DataFrame:
    k, text = F.col("s_suppkey"), lambda c: c.cast("string")
    s = table(spark, sf, "supplier").select(
        k, F.col("s_nationkey").alias("deployment"), F.when(F.col("s_nationkey") % 2 == 0, "production").otherwise("test").alias("environment"), F.concat(F.lit("s"), text(k % 7)).alias("source_id"), F.when(k % 50 == 0, "testnet").otherwise("mainnet").alias("network"), text(k).alias("log_path"),
        F.when(k % 3 == 0, "tcp://192.168.0.1:28332").when(k % 3 == 1, "tcp://192.169.0.1:28332").otherwise("http://node.example:8332").alias("endpoint"),
    )
    return guards.deployment_faults(s).select("s_suppkey", F.array_join("faults", ",").alias("faults"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'topic' WHEN 1 THEN 'sequence' WHEN 2 THEN CASE WHEN strlen(o_orderpriority) > 8 THEN 'body_too_large' END END AS fault,
CASE WHEN o_orderkey % 5 > 2 OR (o_orderkey % 5 = 2 AND strlen(o_orderpriority) <= 8) THEN o_orderkey % 4294967296 END AS transport_sequence FROM orders""")
def subscription_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as three-part frames; some have a wrong topic, a short last part or too long a body."""
    k = F.col("o_orderkey")
    body = F.when(k % 5 == 2, F.col("o_orderpriority")).otherwise(F.lit("b")).cast("binary")
    last = F.when(k % 5 == 1, F.lit(b"abc")).otherwise(F.substring(codecs.little_endian(k), 1, 4))
    parts = F.array(F.when(k % 5 == 0, "hashtx").otherwise("rawtx").cast("binary"), body, last)
    return feeds.notifications(table(spark, sf, "orders").select("o_orderkey", parts.alias("parts")), "parts", 8).select("o_orderkey", "fault", "transport_sequence")


@query("SELECT DISTINCT user_id::VARCHAR AS record_key, sha256(event_id::VARCHAR) AS event_id, event_type AS value FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def broker_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Events, each sent twice, without those published before."""
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("source_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("observation_id"), F.col("event_type").cast("binary").alias("payload"))
    sent = feeds.broker_records(e.unionByName(e))
    new = feeds.new_events(sent, sent.filter("cast(value as string) = 'click'"))
    return new.select(F.col("key").cast("string").alias("record_key"), F.element_at("headers", 1)["value"].cast("string").alias("event_id"), F.col("value").cast("string").alias("value"))


_RAW = "sha256(p_partkey::VARCHAR) || sha256(p_name) || sha256(p_brand)"
_HASH = f"array_to_string(list_reverse(regexp_extract_all(sha256(unhex(sha256(unhex(substr({_RAW}, 1, 160))))), '..')), '')"


@query(f"""SELECT 'src' AS source_id, p_partkey AS height, CASE WHEN p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 3 = 0 THEN md5(p_partkey::VARCHAR) ELSE {_HASH} END END AS block_hash,
CASE WHEN p_partkey % 5 = 0 THEN 'unknown_height' WHEN p_partkey % 7 = 0 THEN 'missing_block' WHEN p_partkey % 3 = 0 THEN 'hash_mismatch' END AS fault FROM part""")
def backfilled_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as blocks: some heights unknown, some bytes missing, some of another hash."""
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    raw = F.unhex(F.concat(*(F.sha2(text(c), 256) for c in ("p_partkey", "p_name", "p_brand"))))
    named = F.when(k % 3 == 0, F.md5(text("p_partkey"))).otherwise(codecs.display_hash(F.substring(raw, 1, feeds.HEADER_BYTES)))
    b = table(spark, sf, "part").select(k.alias("height"), named.alias("block_hash"), raw.alias("raw_block"))
    ranges = b.agg(F.lit("src").alias("source_id"), F.min("height").alias("start"), F.max("height").alias("end"))
    return feeds.backfill(ranges, b.filter("height % 5 > 0"), b.filter("height % 7 > 0")).select("source_id", "height", "block_hash", "fault")


@query("""WITH RECURSIVE p(k) AS (SELECT max(p_partkey) FROM part UNION ALL SELECT k - 1 FROM p WHERE (k - 1) % 500 > 0) SELECT k AS p_partkey, (k - 1) % 500 = 0 AS anchored FROM p WHERE k % 500 > 0""")
def gap_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """From the last part back to the nearest known one; every 500th is known."""
    t = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") - 1).alias("parent"))
    got = feeds.recovered(t, "p_partkey", "parent", t.filter("p_partkey % 500 = 0").select("p_partkey"), t.agg(F.max("p_partkey").alias("p_partkey")))
    return got.select("p_partkey", "anchored")


@query("""WITH c AS (SELECT l_orderkey, max(l_linenumber) AS head FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL), n AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT n.l_orderkey, n.l_linenumber, CASE WHEN l_linenumber <= 3 THEN 'duplicate' WHEN head IS DISTINCT FROM l_linenumber - 1 THEN 'chain_mismatch' ELSE 'committed' END AS outcome FROM n LEFT JOIN c USING (l_orderkey)""")
def manifest_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as manifests of their order; the first three are there, all are offered."""
    own = lambda c: F.concat_ws("-", "l_orderkey", c)
    m = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumns({"own": own("l_linenumber"), "previous": own(F.col("l_linenumber") - 1)})
    return tables.offered_manifests(m.filter("l_linenumber <= 3"), m, "l_orderkey", "l_linenumber", "l_linenumber", "own", "previous").select("l_orderkey", "l_linenumber", "outcome")


@query("""WITH s AS (SELECT user_id, sha256(event_id || '|' || event_type) AS h FROM events) SELECT user_id, count(*) AS facts, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT)::VARCHAR || ':' || sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM s GROUP BY ALL""")
def replay_digests(spark: SparkSession, sf: str) -> DataFrame:
    return tables.replay_digest(table(spark, sf, "events"), ["user_id"], F.concat_ws("|", "event_id", "event_type"))


@query("""SELECT c_custkey, c_name, '{"source_id":"s","source_session_id":"' || md5(c_name) || '","observation_id":' || c_custkey || ',"parser_version":"p1"}' AS lineage
FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def fact_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as facts with lineage, as the serving layer writes them, without those removed, of one segment."""
    c = table(spark, sf, "customer").withColumns({"source_id": F.lit("s"), "source_session_id": F.md5(F.col("c_name").cast("binary")), "observation_id": F.col("c_custkey"), "parser_version": F.lit("p1")})
    kept = tables.without(tables.fact(c, "c_mktsegment", "BUILDING"), table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return tables.with_lineage(kept, ["c_custkey", "c_name"]).withColumn("lineage", F.to_json("lineage"))


def _sum_sql() -> str:
    """Two numbers of 64 hex digits by their parts of 15 digits, one nested SELECT a part."""
    sql, parts = "(SELECT c_custkey, sha256(c_name) AS a, sha256(c_custkey::VARCHAR) AS b, 0::BIGINT AS carry, '' AS s FROM customer)", ((50, 15), (35, 15), (20, 15), (5, 15), (1, 4))
    for start, size in parts:
        total = f"(('0x' || substr(a, {start}, {size}))::BIGINT + ('0x' || substr(b, {start}, {size}))::BIGINT + carry)"
        sql = f"(SELECT c_custkey, a, b, {total} // {16**size} AS carry, printf('%0{size}x', {total} % {16**size}) || s AS s FROM {sql})"
    return f"SELECT c_custkey, CASE WHEN carry = 0 THEN s END AS total FROM {sql}"


@query(_sum_sql())
def work_sums(spark: SparkSession, sf: str) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256)
    return table(spark, sf, "customer").select(_N, codecs.hex_add(sha("c_name"), sha(_N)).alias("total"))


@query("""SELECT event_id AS tick, n_name AS message_type, event_id % 25 = 24 AS cycle_complete, '{"id":' || n_nationkey || ',"jsonrpc":"2.0","method":"' || n_name || '","params":["' || event_type || '",false]}' AS body FROM events JOIN nation ON n_nationkey = event_id % 25""")
def poll_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ticks of a plan of 25 calls."""
    plan = table(spark, sf, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("message_type"))
    ticks = table(spark, sf, "events").select(F.col("event_id").alias("tick"), "event_type")
    params = F.concat(F.lit('["'), "event_type", F.lit('",false]'))
    body = polling.json_rpc(F.col("message_type"), params, F.col("position"))
    return polling.turns(ticks, plan, 25).select("tick", "message_type", "cycle_complete", body.alias("body"))
