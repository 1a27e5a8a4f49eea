"""What the service answers, and capture and archiving, over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_dir
from ..operators import guards, normalize, serving
from ..sources import capture, feeds
from .driver_queries import PART, query, table

_SOURCES = "[p_brand, 's', CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE 's' END]"
_FINALITY = ("pending", "included", "confirmed", "reorged", "unknown")


def _choice(index, names):
    """The name at an index (a whole number from 0) of a fixed list."""
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def _faults(good: DataFrame, bad: DataFrame, key: str, **columns) -> DataFrame:
    """key, faults as text and columns of the good rows (null in the others)."""
    own = good.select(key, F.lit("").alias("faults"), *(c.alias(n) for n, c in columns.items()))
    kinds = {n: own.schema[n].dataType for n in columns}
    return own.unionByName(bad.select(key, F.array_join("faults", ",").alias("faults"), *(F.lit(None).cast(k).alias(n) for n, k in kinds.items())))


_STATUS = """(c = 'non_canonical' AND f = 'reorged' OR c = 'canonical' AND f IN ('included', 'confirmed') OR c = 'candidate' AND f IN ('pending', 'included'))"""


@query(f"""WITH p AS (SELECT *, ['candidate', 'canonical', 'non_canonical'][p_partkey % 3 + 1] AS c, {list(_FINALITY)}[p_partkey // 3 % 5 + 1] AS f, {list(guards.COMPLETENESS)}[p_partkey % 3 + 1] AS m, {_SOURCES} AS s FROM part),
e AS (SELECT *, concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'source_identity' END, CASE WHEN p_size % 7 = 0 THEN 'revision' END, CASE WHEN NOT {_STATUS} THEN 'status' END, CASE WHEN p_partkey % 17 = 0 THEN 'network' END) AS faults FROM p)
SELECT p_partkey, faults, CASE WHEN faults = '' THEN to_json({{network: 'main', source_ids: list_sort(list_distinct(s)), revision: p_size % 7, canonicality: c, finality: f, height: p_partkey, completeness: m, as_of_unix_ns: p_partkey * 1000}})::VARCHAR END AS truth FROM e""")
def truth_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as facts whose statuses, sources and revisions do not always go together."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        k, F.array("p_brand", F.lit("s"), F.when(k % 11 == 0, " ").otherwise("s")).alias("source_ids"), (F.col("p_size") % 7).alias("revision"),
        _choice(k % 3, ("candidate", "canonical", "non_canonical")).alias("canonicality"), _choice(F.floor(k / 3) % 5, _FINALITY).alias("finality"),
        _choice(k % 3, guards.COMPLETENESS).alias("completeness"), F.when(k % 17 == 0, " ").otherwise("main").alias("network"), k.alias("height"), (k * 1000).alias("as_of_unix_ns"),
    )
    return _faults(*serving.envelopes(p, "bitcoin"), "p_partkey", truth=F.to_json("truth"))


@query("""WITH s AS (SELECT *, s_suppkey % 4 = 0 AS rebuilt, s_suppkey % 8 = 0 OR s_suppkey % 5 = 1 AS proved, ['complete', 'known_incomplete'][s_suppkey % 2 + 1] AS m FROM supplier),
e AS (SELECT *, CASE WHEN proved AND s_suppkey % 3 > 0 THEN 'recovered' ELSE m END AS completeness FROM s)
SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey = 0 THEN 'revision' END, CASE WHEN s_nationkey = 0 THEN 'providers' END, CASE WHEN s_suppkey % 31 = 0 OR s_nationkey * 50 > 1024 THEN 'coverage' END, CASE WHEN s_suppkey % 6 = 0 AND completeness = 'complete' THEN 'divergence' END,
CASE WHEN rebuilt <> proved OR (completeness = 'recovered') <> proved THEN 'recovery' END) AS faults FROM e""")
def slot_truth_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as facts of two providers, with divergence and recovery that need what goes with them."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    proved = (k % 8 == 0) | (k % 5 == 1)
    s = table(spark, sf, "supplier").select(
        k, F.array(F.lit("a"), F.when(n == 0, "a").otherwise("b")).alias("source_ids"), F.lit(2).alias("provider_count"), k.alias("revision"), F.lit("canonical").alias("canonicality"), F.lit("confirmed").alias("finality"),
        F.when(proved & (k % 3 > 0), "recovered").otherwise(_choice(k % 2, ("complete", "known_incomplete"))).alias("completeness"), (n * 50).alias("selected_accounts"), (k % 31 == 0).alias("full_firehose"),
        (k % 4 == 0).alias("reconstruction"), (k % 6 == 0).alias("divergent"), F.when(proved, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("recovery_ids"),
        k.alias("slot"), F.lit("b").alias("blockhash"), k.alias("as_of_unix_ns"),
    )
    return _faults(*serving.envelopes(s, "solana"), "s_suppkey")


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 5 = 4 THEN 'kind' END, CASE WHEN c_nationkey = 0 THEN 'sources' END, CASE WHEN c_custkey % 5 = 0 AND c_nationkey <> 1 THEN 'one_source' END,
CASE WHEN c_custkey % 5 = 3 AND NOT c_custkey % 7 BETWEEN 1 AND c_nationkey THEN 'threshold' END) AS faults FROM customer""")
def membership_view_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as views of as many sources as the number of their nation."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    names = F.filter(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda x: F.concat(F.lit("s"), x.cast("string"))), lambda s: s != "s0")
    c = table(spark, sf, "customer").select(k, _choice(k % 5, (*serving.POLICIES, "other")).alias("kind"), names.alias("source_ids"), (k % 7).alias("threshold"))
    return _faults(*normalize.split(c, **serving.view_rules()), "c_custkey")


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_linenumber = 3 THEN 'txid' END, CASE WHEN l_linenumber = 4 THEN 'script' END) AS faults, CASE WHEN l_linenumber NOT IN (3, 4) THEN l_partkey::VARCHAR END AS value_sats,
CASE WHEN l_linenumber NOT IN (3, 4) THEN CASE WHEN l_linenumber = 5 THEN '' ELSE md5(l_suppkey::VARCHAR) END END AS script_pubkey_hex FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)""")
def output_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as outputs of their orders; the third has a short name, the fourth half a byte of script, the fifth none."""
    n, sha = F.col("l_linenumber"), F.sha2(F.col("l_orderkey").cast("string"), 256)
    md5 = F.md5(F.col("l_suppkey").cast("string").cast("binary"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().select(
        "l_orderkey", F.when(n == 3, F.substring(sha, 1, 63)).otherwise(sha).alias("txid"), n.alias("vout"), F.col("l_partkey").alias("value_sats"),
        F.when(n == 4, F.concat(md5, F.lit("a"))).when(n == 5, "").otherwise(md5).alias("script_pubkey_hex"), F.struct(F.col("l_orderkey").alias("height"), n.alias("line")).alias("truth"),
    )
    good, bad = serving.outputs(rows)
    good = good.select(F.col("truth.height").alias("l_orderkey"), F.col("vout").alias("l_linenumber"), F.lit("").alias("faults"), "value_sats", "script_pubkey_hex")
    none = lambda name: F.lit(None).cast("string").alias(name)
    return good.unionByName(bad.select("l_orderkey", F.col("vout").alias("l_linenumber"), F.array_join("faults", ",").alias("faults"), none("value_sats"), none("script_pubkey_hex")))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice > 150000 AS above, row_number() OVER w AS n, lag(o_totalprice > 150000) OVER w AS was, last_value(o_totalprice > 150000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final,
bool_or(o_orderkey % 97 = 0) OVER (PARTITION BY o_custkey) AS broken, count(*) OVER (PARTITION BY o_custkey) AS many FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
c AS (SELECT *, CASE WHEN o_custkey % 10 = 3 THEN 'definition' WHEN many > 1000 THEN 'too_many_snapshots' WHEN broken THEN 'snapshot' WHEN o_custkey % 10 = 7 THEN 'the snapshot has another fee_rate than the rule' END AS fault FROM o)
SELECT o_custkey, CASE WHEN fault IS NULL THEN o_orderkey END AS revision, CASE WHEN fault IS NULL THEN CASE WHEN above AND was THEN 'confirmed' WHEN above THEN 'triggered' WHEN was THEN 'retracted' ELSE 'below_threshold' END END AS transition,
CASE WHEN fault IS NULL THEN above END AS active, CASE WHEN fault IS NULL THEN above <> coalesce(was, false) END AS delivery, CASE WHEN fault IS NULL THEN final END AS final_active, fault
FROM c WHERE fault IS NULL OR n = 1""")
def alert_previews(spark: SparkSession, sf: str) -> DataFrame:
    """A request a customer, whose orders are its snapshots; some requests have no definition, a broken snapshot, or one of another fee band."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = lambda *n: F.array(*map(F.lit, n)) if n else F.array().cast("array<string>")
    s = table(spark, sf, "orders").select(
        c, k.alias("position"), F.lit("main").alias("network"), k.alias("revision"), F.when(k % 97 == 0, -1).otherwise(k).alias("observed_at"), F.when(c % 10 == 7, 2).otherwise(1).alias("fee_rate"), F.col("o_totalprice").alias("vbytes"),
        F.lit(2).alias("quorum"), names("a", "b").alias("eligible"), names().alias("unavailable"), F.lit("complete").alias("completeness"), F.lit("observed").alias("cause"),
    )
    d = s.select(c).distinct().select(
        c, F.lit("a").alias("alert_id"), F.lit(1).alias("fee_rate"), F.when(c % 10 == 3, 0).otherwise(150000).alias("threshold"), F.lit(2).alias("quorum"), F.lit(1).alias("for_evaluations"), F.lit(0).alias("cooldown"), F.lit(True).alias("suppress")
    )
    return serving.preview(s, d, "o_custkey")


@query("""WITH r AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 'empty_source' WHEN c_nationkey < 5 THEN 'range' WHEN c_custkey % 300 = 0 OR c_custkey % 300 > 256 THEN 'in_flight' END AS fault FROM customer)
SELECT c_custkey, fault, CASE WHEN fault IS NULL THEN c_nationkey - 4 END AS block_count, CASE WHEN fault IS NULL THEN sha256(unhex('{d}' || '0100000000000000' || '73' || '05000000' || {e} || {f})) END AS request_hash FROM r""".format(
    d=b"replay/v1".hex(), e="printf('%02x', c_nationkey) || '000000'", f="printf('%02x', c_custkey % 300 % 256) || CASE WHEN c_custkey % 300 > 255 THEN '01' ELSE '00' END || '000000000000'"))
def replay_requests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    r = table(spark, sf, "customer").select(k, F.when(k % 7 == 0, " ").otherwise("s").alias("source_id"), F.lit(5).alias("start_height"), F.col("c_nationkey").alias("end_height"), (k % 300).alias("in_flight"))
    return serving.replay_requests(r, "replay/v1").select("c_custkey", "fault", "block_count", "request_hash")


@query("""WITH c AS (SELECT user_id, bool_or(event_type = 'click') AS b, bool_or(event_type = 'purchase') AS a FROM events WHERE event_id % 2 = user_id % 2 GROUP BY ALL)
SELECT user_id, true AS facts, coalesce(b, false) AS broker_checkpoint, coalesce(a, false) AS archive_checkpoint, coalesce(a AND b, false) AS ready FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN c USING (user_id)""")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Users as sessions; clicks are checkpoints of the broker, purchases of the archive, for some events."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("source_id"), F.md5(F.col("user_id").cast("string").cast("binary")).alias("source_session_id"), F.when(F.col("event_type") == "click", "broker").when(F.col("event_type") == "purchase", "archive").otherwise("other").alias("kind"))
    told = serving.readiness(e.select("source_id", "source_session_id").distinct(), e.filter("event_id % 2 = source_id % 2"), facts=True)
    return told.withColumnRenamed("source_id", "user_id").drop("source_session_id")


@query("""SELECT '{"type":"snapshot","fact":{"user_id":' || user_id || ',"event_type":"' || event_type || '","event_id":' || max(event_id) || '}}' AS frame FROM events GROUP BY user_id, event_type""")
def snapshot_frames(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.views import current_view

    return serving.snapshot_frames(current_view(table(spark, sf, "events"), ["user_id", "event_type"], ["value"], "event_id"), ["user_id", "event_type", "event_id"])


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages of a session a user."""
    u, k, text = F.col("user_id"), F.col("event_id"), lambda c: F.col(c).cast("string")
    return table(spark, sf, "events").select(
        k, F.when(k % 13 == 0, "not graphic").otherwise(F.concat(F.lit("s"), u.cast("string"))).alias("source_id"), F.unhex(F.md5(text("user_id").cast("binary"))).alias("source_session_id"), F.lit("c").alias("chain"), F.lit("main").alias("network"),
        F.when(k % 5 == 0, "rpc").otherwise("rawtx").alias("channel"), F.col("event_type").alias("source_message_type"), text("event_id").cast("binary").alias("payload"),
        F.when(k % 11 == 0, F.repeat(F.lit("x"), capture.MOST_CURSOR + 1)).cast("binary").alias("source_cursor"), k.alias("arrival"), u,
    )


@query("""WITH e AS (SELECT *, concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'source_identity' END, CASE WHEN event_id % 11 = 0 THEN 'cursor_too_large' END) AS faults FROM events)
SELECT event_id, faults, CASE WHEN faults = '' THEN row_number() OVER (PARTITION BY user_id, faults = '' ORDER BY event_id) - 1 + CASE WHEN user_id % 2 = 0 THEN 100 ELSE 0 END END AS collector_sequence,
CASE WHEN faults = '' THEN sha256(event_id::VARCHAR) END AS payload_hash, CASE WHEN faults = '' THEN CASE WHEN event_id % 5 = 0 THEN 'recovered_by_rpc' ELSE '' END END AS quality_flags FROM e""")
def captured_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages; some have a broken identity or too long a cursor; the numbers of even users go on at 100."""
    m = _messages(spark, sf)
    taken = m.filter("user_id % 2 = 0 AND event_id % 13 > 0").select(*capture.SESSION).distinct().withColumn("next", F.lit(100))
    good, bad = capture.captured(m, taken, "arrival", PART)
    return _faults(good, bad, "event_id", collector_sequence=F.col("collector_sequence"), payload_hash=F.lower(F.hex("payload_hash")), quality_flags=F.array_join("quality_flags", ","))


_SUM = "sum(('0x' || substr(h, {at}, 15))::BIGINT::HUGEINT)::VARCHAR"
_MARK = "sha256(concat_ws('|', 's' || user_id, md5(user_id::VARCHAR), first, last, records, digest, {before}))"


@query(f"""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, sha256(upper(sha256(event_id::VARCHAR))) AS h FROM events),
m AS (SELECT user_id, n >= 20 AS late, min(n) AS first, max(n) AS last, count(*) AS records, {_SUM.format(at=1)} || ':' || {_SUM.format(at=16)} AS digest FROM e GROUP BY ALL),
a AS (SELECT *, {_MARK.format(before="''")} AS mark FROM m WHERE NOT late), b AS (SELECT m.*, a.mark AS before FROM m JOIN a USING (user_id) WHERE m.late)
SELECT user_id, first, last, records, mark AS manifest_hash, records AS readable FROM a UNION ALL SELECT user_id, first, last, records, {_MARK.format(before="before")}, records FROM b""")
def archived_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Events archived in three batches: the first twenty of each user, the same once more, and the rest."""
    root = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    from ..operators.sequences import collector_sequence

    e = table(spark, sf, "events").select("user_id", "event_id")
    numbered = collector_sequence(e, ["user_id"], "event_id", PART).withColumnRenamed("sequence", "collector_sequence")
    o = numbered.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("source_id"), F.unhex(F.md5(F.col("user_id").cast("string").cast("binary"))).alias("source_session_id"), "collector_sequence",
        F.unhex(F.sha2(F.col("event_id").cast("string"), 256)).alias("observation_id"), F.col("event_id").cast("string").cast("binary").alias("payload"),
    )
    broker = f"{root}/broker"

    def publish(records: DataFrame) -> None:
        known = capture.stored(spark, root, "broker", records.schema.simpleString().removeprefix("struct<").removesuffix(">"))
        feeds.new_events(records, known).write.mode("append").parquet(broker)

    o = cut(o)
    early, late = o.filter("collector_sequence < 20"), o.filter("collector_sequence >= 20")
    for name, batch in (("0", early), ("1", early), ("2", late)):
        capture.publish_and_archive(batch, name, root, publish)
    n = capture.archived(spark, root, o.schema).groupBy(*capture.SESSION, F.col("collector_sequence") >= 20).agg(F.min("collector_sequence").alias("first_collector_sequence"), F.count(F.lit(1)).alias("readable"))
    met = capture.manifests(spark, root).join(n, [*capture.SESSION, "first_collector_sequence"], "left")
    return met.select(F.substring("source_id", 2, 20).cast("long").alias("user_id"), F.col("first_collector_sequence").alias("first"), F.col("last_collector_sequence").alias("last"), "records", "manifest_hash", "readable")
