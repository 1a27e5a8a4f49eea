"""Identities, codecs, records, guards and normalised tables over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import groups
from ..functions import codecs, consensus, identity
from ..operators import control, graph, joins, normalize, rules, sequences, views
from ..sources import archives, records, segments
from .driver_queries import SQL, query, table
from .oracles import blake3_sql, framed_hex, little, text_hex

_text = lambda c: F.col(c).cast("string")
_sha = lambda c: F.sha2(_text(c).cast("binary"), 256)
_md5 = lambda c: F.md5(_text(c).cast("binary"))


@query(f"""WITH RECURSIVE {blake3_sql("customer", "c_custkey", f"{text_hex("'observation/v1src'")} || md5(c_custkey::VARCHAR) || printf('%016x', c_custkey) || sha256(c_name)")} SELECT key AS c_custkey, digest AS observation_id FROM b3""")
def observation_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    made = identity.observation_ids(F.lit("src"), F.unhex(_md5("c_custkey")), F.col("c_custkey"), F.col("c_name").cast("binary"))
    return c.select("c_custkey", made.alias("observation_id"))


@query(f"""WITH RECURSIVE {blake3_sql("customer", "c_custkey", f"{text_hex("'fixture/v1' || c_name")}", "k")},
i AS (SELECT c_custkey, '{b"fact/v1".hex()}' || digest || '0000000000000001' || sha256(c_custkey::VARCHAR) AS h FROM customer JOIN k ON key = c_custkey),
{blake3_sql("i", "c_custkey", "h", "f")}
SELECT f.key AS source_sequence, k.digest AS fact_key, f.digest AS fact_id, c_name AS fixture_id, md5(c_custkey::VARCHAR) AS source_session_id FROM f JOIN k USING (key) JOIN customer ON c_custkey = f.key""")
def fixture_fact_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as committed fixture observations."""
    body = F.to_json(F.struct(F.col("c_name").alias("fixture_id"), F.lit("v").alias("value"), F.col("c_custkey").alias("source_sequence")))
    o = table(spark, sf, "customer").select(
        body.cast("binary").alias("payload"), F.col("c_custkey").alias("source_sequence"), F.unhex(_sha("c_custkey")).alias("observation_id"), F.unhex(_md5("c_custkey")).alias("source_session_id"),
        F.lit("c").alias("chain"), F.lit("n").alias("network"), F.lit("s").alias("source_id"), F.lit(1).alias("observed_at_unix_ns"), F.lit(2).alias("durable_at_unix_ns"),
    )
    return normalize.fixture_facts(o).select(F.col("source_sequence").cast("long").alias("source_sequence"), "fact_key", "fact_id", "fixture_id", "source_session_id")


@query(f"SELECT c_custkey, sha256(unhex('{b'epoch/v1'.hex()}' || {framed_hex('c_name')} || sha256(c_custkey::VARCHAR) || {little('c_custkey')})) AS epoch_id FROM customer")
def epoch_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", codecs.epoch_id("epoch/v1", F.col("c_name"), _sha("c_custkey"), F.col("c_custkey")).alias("epoch_id"))


@query("SELECT c_custkey, sha256(unhex('{d}' || {f} || {a} || {a} || {i})) AS request_hash FROM customer".format(d=b"backfill/v1".hex(), f=framed_hex("c_name"), a=little("c_custkey", 8), i=little("c_custkey % 7")))
def request_hashes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", rules.request_hash("backfill/v1", F.col("c_name"), n, n, n % 7).alias("request_hash"))


@query(f"""WITH RECURSIVE {blake3_sql("customer", "c_custkey", f"{text_hex("'deep'")} || '00' || {text_hex("'n'")} || '00' || {text_hex('c_name')} || '00' || {text_hex('c_custkey::VARCHAR')}")} SELECT key AS c_custkey, digest AS alert_id FROM b3""")
def reorg_alert_ids(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "customer").select("c_custkey", F.lit("n").alias("network"), F.col("c_name").alias("disconnected_tip_hash"), F.col("c_custkey").alias("revision"), F.lit(9).alias("reorg_depth"), F.lit("complete").alias("completeness"))
    return rules.reorg_alerts(e, "deep", 4).select("c_custkey", "alert_id")


@query(f"""WITH RECURSIVE {blake3_sql("customer", "c_custkey", f"{text_hex("'evm'")} || '00' || {text_hex('c_name')} || '00' || {text_hex('c_custkey::VARCHAR')} || '00' || {text_hex("'61'")}")} SELECT key AS c_custkey, digest AS replay_key FROM b3""")
def decoder_replay_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", rules.replay_key(F.lit("evm"), F.col("c_name"), F.col("c_custkey"), F.lit(b"a")).alias("replay_key"))


@query(f"""WITH RECURSIVE {blake3_sql("customer", "c_custkey", text_hex("'page:' || c_custkey"))} SELECT c_custkey, {text_hex("'page:' || c_custkey")} || '.' || digest[:32] AS cursor, 'page:' || c_custkey AS payload, c_custkey % 2 = 0 AS valid FROM customer JOIN b3 ON key = c_custkey""")
def page_cursors(spark: SparkSession, sf: str) -> DataFrame:
    """Cursors, and what comes out of them; those of odd customers are spoilt before they are read."""

    @F.pandas_udf("string")
    def made(text: pd.Series) -> pd.Series:
        return pd.Series(identity.cursors([t.encode() for t in text]), dtype=object)

    @F.pandas_udf("boolean")
    def good(cursors: pd.Series) -> pd.Series:
        return pd.Series(identity.good_cursors(list(cursors)), dtype=bool)

    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("page:"), _text("c_custkey")).alias("payload")).withColumn("cursor", made("payload"))
    return c.withColumn("valid", good(F.when(F.col("c_custkey") % 2 == 0, F.col("cursor")).otherwise(F.concat(F.lit("00"), F.col("cursor")))))


_SCRIPTS = ("76a914{h40}88ac", "a914{h40}87", "0014{h40}", "5120{h64}", "6a{h40}", "51")
_SCRIPT_SQL = "CASE o_orderkey % 6 " + " ".join(
    f"WHEN {i} THEN " + " || ".join(f"sha256(o_orderkey::VARCHAR)[:{p[1:3]}]" + (f" || '{p[4:]}'" if p[4:] else "") if p.startswith("h") else f"'{p}'" for p in s.split("{")) for i, s in enumerate(_SCRIPTS)
) + " END"


def _script() -> Column:
    digest, out = _sha("o_orderkey"), F.lit("51")
    for i, s in enumerate(_SCRIPTS):
        before, _, rest = s.partition("{h")
        made = F.concat(F.lit(before), F.substring(digest, 1, int(rest[:2])), F.lit(rest[3:])) if rest else F.lit(before)
        out = F.when(F.col("o_orderkey") % 6 == i, made).otherwise(out)
    return F.unhex(out)


@query(f"SELECT o_orderkey, ['p2pkh', 'p2sh', 'segwit_v0', 'taproot', 'op_return', 'other'][1 + o_orderkey % 6] AS script_class, sha256(unhex({_SCRIPT_SQL})) AS script_pubkey_id FROM orders")
def script_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", codecs.script_class(_script()).alias("script_class"), F.sha2(_script(), 256).alias("script_pubkey_id"))


_STEPS = "xor(xor(xor(xor(xor(((a & 33554431) << 5), v), CASE WHEN (a >> 25) & 1 = 1 THEN 996825010 ELSE 0 END), CASE WHEN (a >> 26) & 1 = 1 THEN 642813549 ELSE 0 END), CASE WHEN (a >> 27) & 1 = 1 THEN 513874426 ELSE 0 END), xor(CASE WHEN (a >> 28) & 1 = 1 THEN 1027748829 ELSE 0 END, CASE WHEN (a >> 29) & 1 = 1 THEN 705979059 ELSE 0 END))"
SQL["script_addresses"] = f"""WITH p AS (SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all(sha256(o_orderkey::VARCHAR)[:40], '..'), lambda x: lpad(bin(('0x' || x)::BIGINT), 8, '0')), '') AS bits FROM orders),
w AS (SELECT o_orderkey, list_concat([0::BIGINT], list_transform(range(32), lambda i: list_sum(list_transform(range(5), lambda j: substr(bits, (i * 5 + j + 1)::INT, 1)::BIGINT << (4 - j)))::BIGINT)) AS words FROM p),
c AS (SELECT *, xor(list_reduce(list_concat(list_concat([1, 3, 3, 0, 2, 3]::BIGINT[], words), [0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, v: {_STEPS}), 1) AS checked FROM w)
SELECT o_orderkey, 'bc1' || array_to_string(list_transform(list_concat(words, list_transform(range(6), lambda i: (checked >> (5 * (5 - i))) & 31)), lambda x: substr('{consensus.BECH32}', (x + 1)::INT, 1)), '') AS address FROM c"""


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey::HUGEINT + o_custkey + 1)::VARCHAR END AS total, (o_orderkey * 10)::VARCHAR AS plain, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR END AS number,
least(2 * pow(2, o_orderkey % 9), 60)::BIGINT AS wait, abs(o_orderkey % 7 - 3) <= 2 AS trusted, o_orderkey % 4 = 0 AS replaceable, o_orderkey % 5 = 0 AS lower_hex, o_orderkey % 2 = 0 AS independent,
CASE o_orderkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'stalled' ELSE 'healthy' END AS health FROM orders""")
def scalar_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Checked sums, canonical numbers, backoff, clocks, replacement signals, hex, evidence and health, a row an order."""
    k = F.col("o_orderkey")
    large = F.when(k % 3 == 0, F.lit(str(codecs.U64_MAX)).cast("decimal(20,0)")).otherwise(k.cast("decimal(20,0)"))
    inputs = F.array(F.lit(4294967295), F.when(k % 4 == 0, 4294967293).otherwise(4294967294))
    digits = F.when(k % 5 == 0, F.lower(F.hex(F.unhex(_md5("o_orderkey"))))).otherwise(F.lit("ABCDEF"))
    health = rules.finality_health(F.when(k % 3 > 0, F.lit(100)), F.when(k % 3 == 1, 200).otherwise(105), 10)
    return table(spark, sf, "orders").select(
        "o_orderkey", codecs.checked_add(large, F.col("o_custkey") + 1).cast("string").alias("total"), codecs.u256(F.concat(F.lit("000"), (k * 10).cast("string"))).alias("plain"),
        codecs.u256(F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.lit("-"), k.cast("string")))).alias("number"), codecs.backoff(2, 60, k % 9 + 1).alias("wait"),
        codecs.clock_is_trusted(k % 7 - 3, 2).alias("trusted"), codecs.signals_replacement(inputs).alias("replaceable"), codecs.is_lower_hex(digits, 32).alias("lower_hex"),
        rules.reconstruction_is_independent(F.lit("a"), F.when(k % 2 == 0, "b").otherwise("a"), F.unhex(F.lit("00ff"))).alias("independent"), health.alias("health"),
    )


@query(f"""SELECT o_orderkey, {little("o_orderkey % 1000", 8)} AS vout_hex, array_to_string(list_reverse(regexp_extract_all(sha256(o_orderkey::VARCHAR), '..')), '') || {little("o_orderkey % 1000", 8)} AS outpoint,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END, 0), o_orderkey) AS place FROM orders""")
def outpoints(spark: SparkSession, sf: str) -> DataFrame:
    index = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey"))
    o = table(spark, sf, "orders").withColumn("at", codecs.nullable_index(index))
    point = F.lower(F.hex(codecs.outpoint(_sha("o_orderkey"), F.col("o_orderkey") % 1000)))
    return o.select("o_orderkey", F.right(point, F.lit(8)).alias("vout_hex"), point.alias("outpoint"), F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY at, o_orderkey)").cast("long").alias("place"))


_HEADER = '{"number":"%s","hash":"0x%s","parentHash":"0x%s"}'


def _header(k: Column, h: Column) -> Column:
    return F.format_string(_HEADER, codecs.to_quantity(k), h, h)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN ['committed', 'reorged', 'reverted'][1 + o_orderkey % 4] END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END::BIGINT AS old_blocks,
CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 END::BIGINT AS new_blocks, CASE WHEN o_orderkey % 4 = 3 THEN 'malformed' END AS error FROM orders""")
def execution_notifications(spark: SparkSession, sf: str) -> DataFrame:
    """Committed, reorged and reverted blocks, and every fourth a reorg without new ones."""
    k, h = F.col("o_orderkey"), _header(F.col("o_orderkey"), _sha("o_orderkey"))
    raw = F.when(k % 4 == 0, F.format_string('{"kind":"committed","old":[],"new":[%s]}', h)).when(k % 4 == 1, F.format_string('{"kind":"reorged","old":[%s],"new":[%s]}', h, h)).when(k % 4 == 2, F.format_string('{"kind":"reverted","old":[%s],"new":[]}', h)).otherwise(F.format_string('{"kind":"reorged","old":[%s],"new":[]}', h))
    got = records.notifications(table(spark, sf, "orders").select("o_orderkey", raw.alias("raw_json")))
    number = lambda c: F.when(F.col("kind").isNotNull(), F.coalesce(F.size(c), F.lit(0)).cast("long"))
    some = lambda c: F.when(F.col(c).isNull(), F.array()).otherwise(F.transform(c, lambda x: x["hash"]))
    return got.select("o_orderkey", "kind", number(some("old")).alias("old_blocks"), number(some("new")).alias("new_blocks"), "error")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS slot, CASE WHEN o_orderkey % 3 > 0 THEN '0x' || sha256(o_orderkey::VARCHAR) END AS head, CASE WHEN o_orderkey % 3 = 0 THEN 'malformed' END AS error FROM orders""")
def consensus_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Every third has a slot with a leading zero."""
    k, h = F.col("o_orderkey"), _sha("o_orderkey")
    slot = F.when(k % 3 == 0, F.concat(F.lit("0x0"), F.lower(F.hex(k)))).otherwise(codecs.to_quantity(k))
    raw = F.format_string('{"slot":"%s","headExecutionPayloadHash":"0x%s","safeExecutionPayloadHash":"0x%s","finalizedExecutionPayloadHash":"0x%s"}', slot, h, h, h)
    return records.checkpoints(table(spark, sf, "orders").select("o_orderkey", raw.alias("raw_json"))).select("o_orderkey", F.col("slot").cast("long").alias("slot"), "head", "error")


@query("""SELECT o_orderkey, CASE WHEN ok THEN o_orderkey + 5 END AS head, CASE WHEN ok THEN o_orderkey END AS finalized, CASE WHEN NOT ok THEN 'malformed' END AS error FROM (SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_custkey % 5 <> 0 AS ok FROM orders)""")
def fast_finality_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Every third order is of another chain, every fifth customer's finalized block lies above the head."""
    k, h = F.col("o_orderkey"), _sha("o_orderkey")
    final = F.when(F.col("o_custkey") % 5 == 0, k + 6).otherwise(k)
    raw = F.format_string('{"chainId":"%s","client":"bnb-chain/bsc","head":%s,"finalized":%s,"observedAtUnixMs":7}', F.when(k % 3 == 0, "0x1").otherwise("0x38"), _header(k + 5, h), _header(final, h))
    got = records.bsc_heads(table(spark, sf, "orders").select("o_orderkey", raw.alias("raw_json")))
    at = lambda c: F.when(F.col("error").isNull(), F.col(f"{c}.number")).cast("long").alias(c)
    return got.select("o_orderkey", at("head"), at("finalized"), "error")


_BLOCK = f"""t AS (SELECT o_orderkey, sha256(o_custkey::VARCHAR) AS previous, '0100000001' || sha256(o_custkey::VARCHAR) || {little("o_orderkey", 8)} || '00ffffffff01' || {little("o_orderkey")} || '015100000000' AS raw FROM orders),
h AS (SELECT *, sha256(unhex(sha256(unhex(raw)))) AS id FROM t), b AS (SELECT *, '01000000' || previous || id || {little("o_orderkey", 8)} || 'ffff001d' || '00000000' AS header FROM h),
x AS (SELECT *, array_to_string(list_reverse(regexp_extract_all(sha256(unhex(sha256(unhex(header)))), '..')), '') AS block, array_to_string(list_reverse(regexp_extract_all(id, '..')), '') AS txid, array_to_string(list_reverse(regexp_extract_all(previous, '..')), '') AS parent FROM b)"""


@query(f"""WITH {_BLOCK} SELECT block AS block_hash, 'block' AS fact, parent AS name, o_orderkey AS number FROM x UNION ALL SELECT block, 'transaction', txid, length(raw)::BIGINT // 2 FROM x
UNION ALL SELECT block, 'input', parent, o_orderkey FROM x UNION ALL SELECT block, 'output', sha256(unhex('51')), o_orderkey FROM x""")
def bitcoin_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as blocks of one transaction in consensus bytes, parsed once, and the four tables that come of them."""
    from ..checkpoints import cut

    key, bytes_of = F.col("o_orderkey"), lambda c, n: codecs.reversed_bytes(F.lpad(F.hex(c), n, "0"))
    raw = F.concat(F.lit("0100000001"), _sha("o_custkey"), bytes_of(key, 8), F.lit("00ffffffff01"), bytes_of(key, 16), F.lit("015100000000"))
    header = F.concat(F.lit("01000000"), _sha("o_custkey"), codecs.double_sha256(F.unhex(raw)), bytes_of(key, 8), F.lit("ffff001d00000000"))
    context = {"network": F.lit("n"), "height": key, "canonicality": F.lit("canonical"), "revision": F.lit(1), "source_id": F.lit("s"), "source_session_id": F.lit(b"s"), "observation_id": F.lit(b"o"), "recorded_at_unix_ns": F.lit(1)}
    blocks = table(spark, sf, "orders").select("o_orderkey", "o_custkey").withColumns({"raw": F.unhex(F.concat(header, F.lit("01"), raw)), **context})
    t = normalize.bitcoin_tables_of(cut(normalize.parsed_bitcoin(blocks)))
    rows = lambda name, fact, n, number: t[name].select("block_hash", F.lit(fact).alias("fact"), F.col(n).alias("name"), F.col(number).cast("long").alias("number"))
    out = rows("bitcoin_blocks", "block", "parent_block_hash", "block_time").unionByName(rows("bitcoin_transactions", "transaction", "txid", "virtual_size"))
    return out.unionByName(rows("bitcoin_inputs", "input", "previous_txid", "previous_vout")).unionByName(rows("bitcoin_outputs", "output", "script_pubkey_id", "value_sats"))


def _lineage(key: str) -> dict[str, Column]:
    return {"revision": F.lit(1), "source_id": F.lit("s"), "source_session_id": F.lit(b"s"), "observation_id": F.unhex(_md5(key)), "recorded_at_unix_ns": F.lit(1)}


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem)
SELECT 'instructions' AS fact, l_orderkey AS slot, n AS place, -1 AS inner_place, l_partkey::VARCHAR AS value FROM i UNION ALL SELECT 'instructions', l_orderkey, n, 0, 'in' || l_partkey FROM i WHERE n % 2 = 0
UNION ALL SELECT 'logs', l_orderkey, n, -1, 'log ' || l_partkey FROM i UNION ALL SELECT 'balance_changes', l_orderkey, n, -1, (l_partkey + 1)::VARCHAR FROM i
UNION ALL SELECT 'token_balance_changes', l_orderkey, n, -1, l_partkey::VARCHAR FROM i UNION ALL SELECT 'transactions', l_orderkey, 0, -1, 'succeeded' FROM i GROUP BY l_orderkey""")
def solana_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transactions, their items as instructions, logs and balances; items of even place call one inner instruction."""
    items = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("i"))
    t = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("i")).alias("i"))
    part = lambda x: x["l_partkey"].cast("string")
    one = lambda data: F.struct(F.lit(0).alias("program_id_index"), F.array(F.lit(1)).alias("account_indexes"), data.cast("binary").alias("data"))
    inner = F.transform("i", lambda x, n: F.struct(n.alias("outer_index"), F.lit(0).alias("inner_index"), F.lit(0).alias("program_id_index"), F.array(F.lit(1)).alias("account_indexes"), F.concat(F.lit("in"), part(x)).cast("binary").alias("data")))
    tokens = F.transform("i", lambda x, n: F.struct(n.alias("account_index"), F.lit("m").alias("mint"), F.lit("0").alias("pre_amount"), part(x).alias("post_amount"), F.lit(6).alias("decimals")))
    rows = t.withColumns({
        "signature": _text("l_orderkey"), "slot": F.col("l_orderkey"), "blockhash": F.lit("b"), "message_version": F.lit("legacy"), "static_account_keys": F.array(F.lit("k")), "address_table_lookup_accounts": F.array().cast("array<string>"),
        "raw": F.lit(b"r"), "fee": F.lit(5), "compute_units_consumed": F.lit(7), "error": F.lit(None).cast("string"), "instructions": F.transform("i", lambda x: one(part(x))), "inner_instructions": F.filter(inner, lambda x: x["outer_index"] % 2 == 0),
        "logs": F.transform("i", lambda x: F.concat(F.lit("log "), part(x))), "pre_balances": F.transform("i", lambda x: x["l_partkey"]), "post_balances": F.transform("i", lambda x: x["l_partkey"] + 1), "token_balances": tokens,
        "commitment": F.lit("finalized"), "canonicality": F.lit("canonical"), "coverage_tier": F.lit(normalize.ALL), **_lineage("l_orderkey"),
    })
    s = normalize.solana_tables(rows)
    plain = F.unhex("raw_data_hex").cast("string")

    def facts(name: str, place: str | Column, value: str | Column, inside: Column | None = None) -> DataFrame:
        n, v = (F.col(c) if isinstance(c, str) else c for c in (place, value))
        return s[f"solana_{name}"].select(F.lit(name).alias("fact"), "slot", n.cast("long").alias("place"), (F.lit(-1) if inside is None else F.coalesce(inside, F.lit(-1))).cast("int").alias("inner_place"), v.alias("value"))

    out = facts("instructions", "outer_index", plain, F.col("inner_index")).unionByName(facts("logs", "log_index", "message")).unionByName(facts("balance_changes", "account_index", "post_lamports"))
    return out.unionByName(facts("token_balance_changes", "account_index", "post_amount")).unionByName(facts("transactions", F.lit(0), "execution_status"))


@query("SELECT c_custkey::VARCHAR AS pubkey, c_custkey AS slot, (c_custkey * 10)::VARCHAR AS lamports, lower(hex(c_name)) AS raw_data_hex, md5(c_custkey::VARCHAR) AS observation_id FROM customer")
def account_write_facts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumns({
        "pubkey": _text("c_custkey"), "slot": F.col("c_custkey"), "blockhash": F.lit("b"), "owner": F.lit("o"), "lamports": F.col("c_custkey") * 10, "data": F.col("c_name").cast("binary"), "executable": F.lit(False), "rent_epoch": F.lit(0),
        "write_version": F.lit(1), "canonicality": F.lit("candidate"), "commitment": F.lit("processed"), "coverage_tier": F.lit(normalize.SELECTED), **_lineage("c_custkey"),
    })
    return normalize.solana_account_writes(c).select("pubkey", "slot", "lamports", "raw_data_hex", "observation_id")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'decoded' ELSE 'failed' END AS decode_status, CASE WHEN c_custkey % 3 = 1 THEN '{"n": ' || strlen(c_name) || '}' END AS decoded_json, lower(hex(c_name)) AS raw_data_hex FROM customer""")
def decode_facts(spark: SparkSession, sf: str) -> DataFrame:
    """A decoder for two of three programs, one of which always fails; raw bytes stay."""

    def fails(data: bytes) -> str:
        raise ValueError("no")

    d = spark.createDataFrame([(1, 0, None, "v1"), (2, 0, None, "v2")], "program_id long, valid_from long, valid_to long, decoder_version string")
    facts = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("program_id"), F.col("c_custkey").alias("slot"), F.col("c_name").cast("binary").alias("raw_data"))
    got = rules.decode(facts, d, {"v1": lambda data: '{"n": %d}' % len(data), "v2": fails}, "program_id", "slot")
    named = got.withColumns({"instruction_identity": _text("c_custkey"), "native_fact_id": F.col("raw_data"), "revision": F.lit(1), "recorded_at_unix_ns": F.lit(1)})
    return normalize.decode_rows(named).select(F.col("instruction_identity").cast("long").alias("c_custkey"), "decode_status", "decoded_json", "raw_data_hex")


@query("SELECT o_orderkey::VARCHAR AS idempotency_key FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= DATE '1997-01-01' ORDER BY o_orderdate, o_custkey, o_orderkey::VARCHAR LIMIT 500")
def due_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(_text("o_orderkey").alias("idempotency_key"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("delivered").alias("status"), F.col("o_orderdate").alias("available_at"), F.col("o_custkey").alias("created_at"))
    return views.pending_outbox(o, F.lit("1997-01-01").cast("date"), 500).select("idempotency_key")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def enabled_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).alias("enabled"))
    return control.enabled_only(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), d, ["o_custkey"]).select("o_orderkey")


@query("SELECT user_id, event_type AS commitment, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def accounts_alive(spark: SparkSession, sf: str) -> DataFrame:
    """The newest write of an account decides, and hides the account where it is dead."""
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "error", "dead").otherwise(F.col("event_type")).alias("commitment"), "event_id")
    return views.live_accounts(views.current_view(e, ["user_id"], ["commitment"], "event_id"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT user_id::VARCHAR AS source_id, n AS collector_sequence, event_id AS payload, n // 4 AS durable_at FROM e WHERE n < total // 4 * 4""")
def segment_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """A log segment a user, with a commit after every fourth record: what a reader recovers, and no more."""
    e = sequences.collector_sequence(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id")
    session = bytes(16)

    def users(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        for user, rows in itertools.groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0]):
            yield user, [r[1:] for r in rows]

    def written(user: int, rows: list[tuple[int, int]]) -> segments.SegmentWriter:
        w = segments.SegmentWriter(session, later=True)
        for n, event in rows:
            w.append({"schema_version": 1, "observation_id": bytes(32), "source_id": str(user), "source_session_id": session, "collector_sequence": n, "chain": "c", "network": "n", "channel": "x", "source_message_type": "t", "observed_at_unix_ns": 1, "observed_at_monotonic_ns": 1, "payload_hash": bytes(32), "payload": str(event).encode(), "attributes": {}, "quality_flags": []})
            if n % 4 == 3:
                w.commit(n // 4)
        return w

    def told(writers: list[segments.SegmentWriter]) -> pa.RecordBatch:
        segments.settle(writers)
        again = [r for got in segments.recover_many([bytes(w.data) for w in writers]) for r in archives.unpack(archives.pack([r for kind, r in got if kind == "row"]))]
        columns = ([r["source_id"] for r in again], [r["collector_sequence"] for r in again], [int(r["payload"]) for r in again], [r["durable_at_unix_ns"] for r in again])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["source_id", "collector_sequence", "payload", "durable_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for user, own in users(batches):
            held.append(written(user, own))
            rows += len(own)
            if rows >= 8192:  # whole segments, so that their hashes are made side by side
                yield told(held)
                held, rows = [], 0
        if held:
            yield told(held)

    return groups.gathered(e, ["user_id"], "sequence").select("user_id", "sequence", "event_id").mapInArrow(run, "source_id string, collector_sequence long, payload long, durable_at long")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber * 10 AS lo, l_linenumber * 10 + 4 AS hi, md5(l_linenumber::VARCHAR) AS commit_hash FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
o AS (SELECT o_orderkey, o_custkey % 80 AS sequence FROM orders) SELECT o_orderkey, sequence AS collector_sequence, commit_hash FROM o JOIN c ON l_orderkey = o_orderkey AND sequence BETWEEN lo AND hi""")
def committed_observations(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    c = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("source_session_id"), (n * 10).alias("first_collector_sequence"), (n * 10 + 4).alias("last_collector_sequence"), n.alias("durable_at_unix_ns"), _md5("l_linenumber").alias("commit_hash"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_session_id"), (F.col("o_custkey") % 80).alias("collector_sequence"))
    return joins.committed(o, c).select(F.col("source_session_id").alias("o_orderkey"), "collector_sequence", "commit_hash")


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS k, p_partkey // 2 AS p FROM part), a(k) AS (SELECT max(k) FROM t UNION SELECT t.p FROM a JOIN t USING (k) WHERE t.p IN (SELECT k FROM t)), b(k) AS (SELECT max(k) // 3 FROM t UNION SELECT t.p FROM b JOIN t USING (k) WHERE t.p IN (SELECT k FROM t))
SELECT 'disconnect' AS action, k AS block FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'connect', k FROM b WHERE k NOT IN (SELECT k FROM a)""")
def fork_path_moves(spark: SparkSession, sf: str) -> DataFrame:
    """From the tip of the greatest part to that of a third of it: what leaves the chain and what enters it."""
    t = table(spark, sf, "part").select("p_partkey", F.expr("p_partkey div 2").alias("parent"))
    top = t.agg(F.max("p_partkey")).first()[0]
    return graph.path_moves(t, "p_partkey", "parent", top, top // 3).select("action", F.col("node").alias("block"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, row_number() OVER w AS n, lag(l_linenumber) OVER w AS before FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT l_orderkey, l_linenumber, CASE WHEN before + 1 < l_linenumber THEN 'gap' ELSE 'chain' END AS fault FROM m WHERE before + 1 < l_linenumber OR (n > 1)""")
def manifest_fault_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests that name no forerunner: a gap where numbers are missing, else a broken chain."""
    m = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    m = m.select(F.unhex(_md5("l_orderkey")).alias("source_session_id"), "l_orderkey", F.col("l_linenumber").alias("first_collector_sequence"), F.col("l_linenumber").alias("last_collector_sequence"), F.lit("k").alias("object_key"), F.lit(bytes(32)).alias("object_sha256"), F.lit(7).alias("compressed_bytes"), F.lit(1).alias("record_count"), F.lit(None).cast("binary").alias("previous_manifest_hash"))
    return archives.manifest_faults(m).select("l_orderkey", F.col("first_collector_sequence").alias("l_linenumber"), "fault")


@query("""WITH s AS (SELECT n_regionkey, count_if(n_nationkey % 3 > 0) AS healthy, count_if(n_nationkey % 3 = 0 OR abs(n_nationkey - 12) > 11) AS bad FROM nation GROUP BY ALL) SELECT n_regionkey, healthy, CASE WHEN healthy = 0 THEN 'unavailable' WHEN bad > 0 THEN 'degraded' ELSE 'complete' END AS quality FROM s""")
def observer_qualities(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "nation").select("n_regionkey", F.when(F.col("n_nationkey") % 3 > 0, "healthy").otherwise("down").alias("health"), (F.col("n_nationkey") - 12).alias("clock_offset"))
    return joins.observer_quality(s, 11, ["n_regionkey"])


@query("""SELECT o_orderpriority, sha256(unhex(string_agg(h, '' ORDER BY point))) AS state_hash, count(*) AS entries FROM (SELECT o_orderpriority, array_to_string(list_reverse(regexp_extract_all(sha256(o_orderkey::VARCHAR), '..')), '') || {v} AS point,
point || {a} || sha256(o_custkey::VARCHAR) AS h FROM orders) GROUP BY o_orderpriority""".format(v=little("o_orderkey % 1000", 8), a=little("o_custkey")))
def unspent_state_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as unspent outputs, by priority: one digest over all entries in the order of their 36-byte outpoints."""
    o = table(spark, sf, "orders").select("o_orderpriority", _sha("o_orderkey").alias("txid"), (F.col("o_orderkey") % 1000).alias("vout"), F.col("o_custkey").alias("value"), F.unhex(_sha("o_custkey")).alias("script_pubkey_id"))
    return views.unspent_digest(o, "o_orderpriority", "txid", "vout", "value", "script_pubkey_id")


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS k, p_partkey // 2 AS p FROM part), w(root, k, depth) AS (SELECT k, k, 0 FROM n UNION ALL SELECT w.root, n.p, depth + 1 FROM w JOIN n ON w.k = n.k WHERE n.p > 0 AND depth < 6)
SELECT root, count(*) AS nodes, max(depth)::BIGINT AS depth, CASE WHEN root = 0 THEN 'no_observation' WHEN min(k) > 1 THEN 'too_deep' END AS fault FROM w GROUP BY root""")
def lineage_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as facts made from the part of half their number; the first is an observation, six steps are allowed."""
    p = table(spark, sf, "part").select("p_partkey", F.expr("p_partkey div 2").alias("parent"))
    edges = p.filter("parent > 0").select(F.col("p_partkey").alias("node"), "parent")
    return graph.lineage(p.select(F.col("p_partkey").alias("root")), p.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") == 1).alias("observed")), edges, max_depth=6, max_nodes=1000)


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS k, p_partkey // 2 AS p FROM part), w(node, cur, h) AS (SELECT k, k, CASE WHEN k = 0 THEN 0 ELSE floor(log2(greatest(k, 1))) + 1 END::BIGINT FROM t UNION ALL SELECT node, t.p, h - 1 FROM w JOIN t ON cur = t.k WHERE h > 4) SELECT node, cur AS ancestor FROM w WHERE h = 4""")
def ancestors_at_height(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select("p_partkey", F.expr("p_partkey div 2").alias("parent"))
    return graph.ancestor_at(t, "p_partkey", "parent", 4)
