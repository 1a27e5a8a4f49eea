"""Parsing, normalisation, archives and control tables over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, consensus
from ..operators import control, normalize
from ..sources import archives, records
from .driver_queries import query, table


def _latest(df: DataFrame, kind: str) -> DataFrame:
    return df.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("source_id")).agg(F.max("event_id").alias("last_collector_sequence"), F.max_by("props", "event_id").alias("source_session_id"))


_LATEST = "SELECT user_id AS source_id, max(event_id) AS last, arg_max(props, event_id) AS session FROM events WHERE event_type = '{}' GROUP BY user_id"


@query(f"""WITH s AS ({_LATEST.format("click")}), b AS ({_LATEST.format("view")}), a AS ({_LATEST.format("purchase")})
SELECT s.source_id, s.last AS last_collector_sequence, CASE WHEN b.last IS NULL THEN 'missing_broker' WHEN b.session <> s.session THEN 'broker_session_mismatch' WHEN b.last < s.last THEN 'broker_insufficient'
WHEN a.last IS NULL THEN 'missing_archive' WHEN a.session <> s.session THEN 'archive_session_mismatch' WHEN a.last < s.last THEN 'archive_insufficient' END AS blocker FROM s LEFT JOIN b USING (source_id) LEFT JOIN a USING (source_id)""")
def reclaim_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks stand for segments, views for the broker's checkpoints, purchases for the archive's; props for sessions."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "props")
    return control.reclaimable(_latest(e, "click"), _latest(e, "view"), _latest(e, "purchase")).select("source_id", "last_collector_sequence", "blocker")


@query("""WITH c AS (SELECT user_id, max(event_id) AS n FROM events WHERE event_type = 'click' GROUP BY user_id), v AS (SELECT user_id, max(event_id) AS n FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT user_id AS consumer, CASE WHEN c.n IS NULL OR v.n >= c.n THEN v.n ELSE c.n END AS last_collector_sequence, CASE WHEN v.n < c.n THEN 'regression' END AS fault FROM c FULL JOIN v USING (user_id)""")
def checkpoint_advance(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("consumer"), F.lit("s").alias("source_session_id"), F.col("event_id").alias("last_collector_sequence"), "event_type")
    now = e.filter("event_type = 'click'").groupBy("consumer", "source_session_id").agg(F.max("last_collector_sequence").alias("last_collector_sequence"))
    return control.advance(now, e.filter("event_type = 'view'")).select("consumer", "last_collector_sequence", "fault")


@query("""WITH k AS (SELECT user_id, arg_min(props, event_id) AS body FROM events WHERE event_type = 'signup' GROUP BY user_id), o AS (SELECT user_id, min(props) AS props, max(props) AS most FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, props, CASE WHEN props <> most OR (body IS NOT NULL AND body <> props) THEN 'conflict' WHEN body IS NOT NULL THEN 'duplicate' ELSE 'registered' END AS outcome FROM o LEFT JOIN k USING (user_id)""")
def definition_register(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "props")
    known = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min_by("props", "event_id").alias("props"))
    return control.register(known, e.filter("event_type = 'error'"), ["user_id"], "props")


@query("""WITH e AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS date, hour(ts)::BIGINT AS hour FROM events)
SELECT user_id::VARCHAR AS source_id, date, hour, min(event_id) AS first_sequence, max(event_id) AS last_sequence, count(*) AS record_count, count(*) = max(event_id) - min(event_id) + 1 AS archivable,
'raw/chain=c/network=n/source=' || user_id || '/channel=x/date=' || date || '/hour=' || printf('%02d', hour) || '/part-00000000000000000000000000000000-' || min(event_id) || '-' || max(event_id) || '.bin.zst' AS object_key FROM e GROUP BY user_id, date, hour""")
def archive_batches(spark: SparkSession, sf: str) -> DataFrame:
    named = {"chain": F.lit("c"), "network": F.lit("n"), "channel": F.lit("x"), "source_id": F.col("user_id").cast("string"), "source_session_id": F.unhex(F.lit("00" * 16)), "collector_sequence": F.col("event_id"), "observed_at_unix_ns": F.unix_micros(F.col("ts").cast("timestamp")) * 1000}
    e = table(spark, sf, "events").select("user_id", "event_id", "ts").withColumns(named)
    return archives.batches(e).select("source_id", "date", F.col("hour").cast("long").alias("hour"), F.col("first_collector_sequence").alias("first_sequence"), F.col("last_collector_sequence").alias("last_sequence"), "record_count", "archivable", "object_key")


_BYTES = "'[' || array_to_string(list_transform(regexp_extract_all({}, '..'), lambda x: ('0x' || x)::INT::VARCHAR), ',') || ']'"


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, md5(l_orderkey::VARCHAR) AS session, sha256(l_partkey::VARCHAR) AS object FROM lineitem)
SELECT l_orderkey, l_linenumber, sha256('{{"source_session_id":' || {_BYTES.format("session")} || ',"first_collector_sequence":' || l_linenumber || ',"last_collector_sequence":' || l_linenumber || ',"object_key":"k/' || l_orderkey || '","object_sha256":' || {_BYTES.format("object")} || ',"compressed_bytes":7,"record_count":1,"previous_manifest_hash":null}}') AS manifest_hash FROM m""")
def manifest_hashes(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string").cast("binary")
    n = F.col("l_linenumber")
    m = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.unhex(F.md5(text("l_orderkey"))).alias("source_session_id"), n.alias("first_collector_sequence"), n.alias("last_collector_sequence"), F.concat(F.lit("k/"), F.col("l_orderkey").cast("string")).alias("object_key"), F.unhex(F.sha2(text("l_partkey"), 256)).alias("object_sha256"), F.lit(7).alias("compressed_bytes"), F.lit(1).alias("record_count"), F.lit(None).cast("binary").alias("previous_manifest_hash"))
    return m.select("l_orderkey", "l_linenumber", F.lower(F.hex(archives.manifest_hash())).alias("manifest_hash"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_orderkey END AS number, CASE WHEN o_custkey % 3 > 0 THEN '0x' || sha256(o_orderkey::VARCHAR) END AS block_hash, CASE WHEN o_custkey % 3 = 0 THEN 'malformed' END AS error FROM orders""")
def recorded_blocks_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as recorded blocks; those of every third customer carry a key that the format does not know."""
    own = F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)
    extra = F.when(F.col("o_custkey") % 3 == 0, ',"more":1').otherwise("")
    raw = F.format_string('{"number":"%s","hash":"0x%s","parentHash":"0x%s","transactions":[],"source":"s","capture_scope":"c"%s}', codecs.to_quantity(F.col("o_orderkey")), own, own, extra)
    return records.recorded_blocks(table(spark, sf, "orders").select("o_orderkey", raw.alias("raw_json"))).select("o_orderkey", F.col("number").cast("long").alias("number"), "block_hash", "error")


#: Hex of the low bytes of a number, least significant first.
_LITTLE = "array_to_string(list_reverse(regexp_extract_all(printf('%0{}x', {}), '..')), '')"


@query(f"""WITH t AS (SELECT o_orderkey, o_custkey, sha256(o_custkey::VARCHAR) AS previous, '51' AS script FROM orders), r AS (SELECT *, '0100000001' || previous || {_LITTLE.format(8, "o_orderkey")} || '00ffffffff01' || {_LITTLE.format(16, "o_orderkey")} || '01' || script || '00000000' AS raw FROM t)
SELECT o_orderkey, array_to_string(list_reverse(regexp_extract_all(sha256(unhex(sha256(unhex(raw)))), '..')), '') AS txid, array_to_string(list_reverse(regexp_extract_all(previous, '..')), '') AS previous_txid, o_orderkey AS previous_vout, o_orderkey AS value_sats, sha256(unhex(script)) AS script_pubkey_id, length(raw)::BIGINT // 2 AS virtual_size FROM r""")
def consensus_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Each order as the bytes of a transaction with one input and one output, parsed back."""
    key = F.col("o_orderkey")
    raw = F.concat(F.lit("0100000001"), F.sha2(F.col("o_custkey").cast("string").cast("binary"), 256), codecs.reversed_bytes(F.lpad(F.hex(key), 8, "0")), F.lit("00ffffffff01"), codecs.reversed_bytes(F.lpad(F.hex(key), 16, "0")), F.lit("015100000000"))
    parsed = table(spark, sf, "orders").select("o_orderkey", consensus.parse_transactions(F.unhex(raw)).alias("p")).select("o_orderkey", "p.value")
    first = parsed.select("o_orderkey", "value.txid", "value.virtual_size", F.col("value.inputs")[0].alias("i"), F.col("value.outputs")[0].alias("o"))
    return first.select("o_orderkey", "txid", "i.previous_txid", "i.previous_vout", F.col("o.value_sats").cast("long").alias("value_sats"), F.sha2("o.script_pubkey", 256).alias("script_pubkey_id"), "virtual_size")


@query("""SELECT o_orderkey AS block_number, l_linenumber::BIGINT AS log_index, md5(l_partkey::VARCHAR) AS transaction_hash, lower(hex(l_returnflag)) AS raw_data_hex FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def evm_logs_of_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as blocks, their items as transactions with one log each, nested and taken apart again."""
    own = F.md5(F.col("l_partkey").cast("string").cast("binary"))
    log = F.array(F.struct(own.alias("transaction_hash"), F.col("l_linenumber").cast("long").alias("log_index"), F.lit("x").alias("address"), F.array().cast("array<string>").alias("topics"), F.col("l_returnflag").cast("binary").alias("data")))
    tx = F.struct(own.alias("transaction_hash"), F.lit("a").alias("sender"), F.lit(None).cast("string").alias("recipient"), F.lit("1").alias("value"), F.lit(0).cast("long").alias("nonce"), F.lit(21).cast("long").alias("gas_limit"), F.lit(None).cast("string").alias("max_fee_per_gas"), F.array().cast("array<string>").alias("blob_versioned_hashes"))
    receipt = F.struct(own.alias("transaction_hash"), F.lit(True).alias("success"), F.lit(21).cast("long").alias("cumulative_gas_used"), log.alias("logs"))
    items = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", tx.alias("t"), receipt.alias("r")).alias("z")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("z")).alias("z"))
    blocks = items.join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    context = {"chain_id": F.lit(1), "block_hash": F.col("l_orderkey").cast("string"), "parent_block_hash": F.lit("p"), "block_number": F.col("l_orderkey"), "transactions": F.transform("z", lambda x: x.t), "receipts": F.transform("z", lambda x: x.r), "finality": F.lit("finalized"), "canonicality": F.lit("canonical"), "revision": F.lit(1), "source_id": F.lit("s"), "source_session_id": F.lit("s").cast("binary"), "observation_id": F.lit("o").cast("binary"), "recorded_at_unix_ns": F.lit(1)}
    logs = normalize.evm_tables(blocks.withColumns(context))["evm_logs"]
    return logs.select(F.col("block_hash").cast("long").alias("block_number"), "log_index", "transaction_hash", "raw_data_hex")


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN value > 100 THEN 'small' END, CASE WHEN event_type = 'error' THEN 'clean' END], lambda x: x IS NOT NULL), ',') AS faults FROM events WHERE value > 100 OR event_type = 'error'""")
def rule_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that break a rule, with the rules they break."""
    e = table(spark, sf, "events").select("event_id", "value", "event_type")
    return normalize.split(e, small=F.col("value") <= 100, clean=F.col("event_type") != "error")[1].select("event_id", F.array_join("faults", ",").alias("faults"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'canonical' ELSE 'candidate' END AS canonicality, CASE WHEN o_orderstatus = 'P' THEN 'reorged' ELSE 'included' END AS finality, o_orderstatus <> 'P' AS consistent FROM orders""")
def status_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c, f = F.when(F.col("o_orderstatus") == "F", "canonical").otherwise("candidate"), F.when(F.col("o_orderstatus") == "P", "reorged").otherwise("included")
    return table(spark, sf, "orders").select("o_orderkey", c.alias("canonicality"), f.alias("finality"), codecs.truth_is_consistent("bitcoin", c, f).alias("consistent"))


@query()
def script_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Witness addresses of programs made from order keys."""
    script = F.concat(F.unhex(F.lit("0014")), F.unhex(F.substring(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256), 1, 40)))
    return table(spark, sf, "orders").select("o_orderkey", consensus.addresses(script).alias("address"))
