"""Nested observations to flat fact tables: projections and explodes only, so each table is one narrow pass.

Inputs carry a context: canonicality, revision, and the lineage columns. A missing lineage or a revision below 1 fails
the query, as does an input that breaks a limit of its domain.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import truth_is_consistent
from ..functions.consensus import parse_blocks
from ..functions.identity import blake3_known

# Parser versions, coverage tiers, domain limits.
FIXTURE, BITCOIN, EVM, SOLANA = "fixture-native/1.0.0", "bitcoin-native/1.0.0", "evm-native/1.0.0", "solana-native/1.0.0"
ALL, SELECTED = "all_transactions", "selected_accounts"
MOST_KEYS, MOST_INSTRUCTIONS, MOST_LOGS, MOST_DATA, MOST_TOPICS = 256, 4096, 16_384, 1 << 20, 4
LINEAGE = ("source_id", "source_session_id", "observation_id", "parser_version", "recorded_at_unix_ns")


def _hex(c: str | Column) -> Column:
    return F.lower(F.hex(c))


def demand(df: DataFrame, **rules: Column) -> DataFrame:
    """df; the first row for which a rule is not true fails the query with the rule's name."""
    for name, rule in rules.items():
        df = df.filter(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(name.replace("_", " "))).cast("boolean")))
    return df


def split(df: DataFrame, **rules: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with `faults`, the names of the rules they break."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())), lambda x: x.isNotNull())
    told = df.withColumn("faults", broken)
    return told.filter(F.size("faults") == 0).drop("faults"), told.filter(F.size("faults") > 0)


def stamp(df: DataFrame, parser_version: str) -> DataFrame:
    """df with the parser's version, session and observation as lowercase hex; lineage must be whole."""
    have = demand(
        df,
        the_source_must_be_named=F.trim("source_id") != "",
        lineage_is_missing=F.col("observation_id").isNotNull() & F.col("source_session_id").isNotNull() & F.col("recorded_at_unix_ns").isNotNull(),
        revisions_start_at_1=F.col("revision") >= 1,
    )
    return have.withColumns({"source_session_id": _hex("source_session_id"), "observation_id": _hex("observation_id"), "parser_version": F.lit(parser_version)})


def bitcoin_tables(blocks: DataFrame) -> dict[str, DataFrame]:
    """blocks, transactions, inputs, outputs from rows with `raw` (consensus bytes), network, height and a context.

    Parsing runs once a table that is read; write `parsed_bitcoin` first to share it.
    """
    return bitcoin_tables_of(parsed_bitcoin(blocks))


def parsed_bitcoin(blocks: DataFrame) -> DataFrame:
    known = demand(stamp(blocks, BITCOIN), unknown_canonicality=F.col("canonicality").isin("candidate", "canonical", "non_canonical"))
    parsed = known.withColumn("_parsed", parse_blocks(F.col("raw"))).drop("raw")
    return demand(parsed, a_block_is_malformed=F.col("_parsed.value").isNotNull()).withColumn("block", F.col("_parsed.value")).drop("_parsed")


def bitcoin_tables_of(parsed: DataFrame) -> dict[str, DataFrame]:
    tail = ("canonicality", "revision", *LINEAGE)
    own = F.col("block.block_hash").alias("block_hash")
    txs = parsed.select("network", own, "height", F.posexplode("block.transactions").alias("transaction_index", "tx"), *tail)
    inputs = txs.select("network", "block_hash", F.col("tx.txid").alias("txid"), F.posexplode("tx.inputs").alias("input_index", "i"), *tail)
    outputs = txs.select("network", "block_hash", F.col("tx.txid").alias("txid"), F.posexplode("tx.outputs").alias("output_index", "o"), *tail)
    return {
        "bitcoin_blocks": parsed.select("network", own, "block.parent_block_hash", "height", "block.block_time", F.size("block.transactions").cast("long").alias("transaction_count"), *tail),
        "bitcoin_transactions": txs.select("network", "block_hash", "height", "transaction_index", "tx.txid", "tx.wtxid", "tx.virtual_size", *tail),
        "bitcoin_inputs": inputs.select("network", "block_hash", "txid", "input_index", "i.previous_txid", "i.previous_vout", "i.sequence", *tail),
        "bitcoin_outputs": outputs.select("network", "block_hash", "txid", "output_index", "o.value_sats", F.sha2("o.script_pubkey", 256).alias("script_pubkey_id"), _hex("o.script_pubkey").alias("script_pubkey_hex"), *tail),
    }


def evm_tables(blocks: DataFrame, chain: str = "ethereum") -> dict[str, DataFrame]:
    """blocks, transactions, receipts, logs from rows with chain_id, block_hash, parent_block_hash, block_number,
    transactions, receipts (in the order of the transactions, each with its logs), finality and a context."""
    logs_of = F.flatten(F.transform("receipts", lambda r: r.logs))
    good = demand(
        stamp(blocks, EVM),
        the_chain_has_another_id=F.col("chain_id") == {"ethereum": 1, "bsc": 56}[chain],
        canonicality_and_finality_differ=truth_is_consistent(chain, F.col("canonicality"), F.col("finality")),
        receipts_do_not_match_transactions=F.transform("transactions", lambda t: t.transaction_hash) == F.transform("receipts", lambda r: r.transaction_hash),
        a_log_names_another_transaction=F.forall("receipts", lambda r: F.forall(r.logs, lambda x: x.transaction_hash == r.transaction_hash)),
        a_log_index_is_repeated=F.forall("receipts", lambda r: F.size(F.array_distinct(F.transform(r.logs, lambda x: x.log_index))) == F.size(r.logs)),
        a_log_has_over_4_topics=F.forall(logs_of, lambda x: F.size(x.topics) <= MOST_TOPICS),
    )
    tail = ("canonicality", "finality", "revision", *LINEAGE)
    both = good.select("chain_id", "block_hash", "block_number", F.posexplode(F.arrays_zip(F.col("transactions").alias("t"), F.col("receipts").alias("r"))).alias("transaction_index", "z"), *tail)
    both = both.select("chain_id", "block_hash", "block_number", "transaction_index", F.col("z.t").alias("t"), F.col("z.r").alias("r"), *tail)
    logs = both.select("chain_id", "block_hash", F.explode("r.logs").alias("x"), *tail)
    return {
        "evm_blocks": good.select("chain_id", "block_hash", "parent_block_hash", "block_number", *tail),
        "evm_transactions": both.select("chain_id", "block_hash", "block_number", "transaction_index", "t.transaction_hash", "t.sender", "t.recipient", "t.value", "t.nonce", "t.gas_limit", "t.max_fee_per_gas", "t.blob_versioned_hashes", *tail),
        "evm_receipts": both.select("chain_id", "block_hash", "r.transaction_hash", "r.success", "r.cumulative_gas_used", *tail),
        "evm_logs": logs.select("chain_id", "block_hash", "x.transaction_hash", "x.log_index", "x.address", "x.topics", _hex("x.data").alias("raw_data_hex"), *tail),
    }


def solana_tables(transactions: DataFrame) -> dict[str, DataFrame]:
    """transactions, instructions, logs, balance and token balance changes from rows with signature, slot, blockhash,
    message_version, static_account_keys, address_table_lookup_accounts, raw, fee, compute_units_consumed, error,
    instructions (program_id_index, account_indexes, data), inner_instructions (the same with outer_index and
    inner_index), logs, pre_balances, post_balances, token_balances (account_index, mint, pre_amount, post_amount,
    decimals), commitment, coverage_tier and a context. A null error means success; its text is then empty."""
    short = lambda c: F.forall(c, lambda x: F.octet_length(x.data) <= MOST_DATA)
    good = demand(
        stamp(transactions, SOLANA),
        the_tier_must_be_all_transactions=F.col("coverage_tier") == ALL,
        canonicality_and_commitment_differ=truth_is_consistent("solana", F.col("canonicality"), F.col("commitment")),
        too_many_account_keys=F.size("static_account_keys") <= MOST_KEYS,
        too_many_instructions=(F.size("instructions") <= MOST_INSTRUCTIONS) & (F.size("inner_instructions") <= MOST_INSTRUCTIONS),
        too_many_logs=F.size("logs") <= MOST_LOGS,
        instruction_data_are_too_long=short("instructions") & short("inner_instructions"),
        balances_before_and_after_differ_in_number=F.size("pre_balances") == F.size("post_balances"),
        a_legacy_message_has_lookups=F.col("message_version").isin("legacy", "v0") & ((F.col("message_version") == "v0") | (F.size("address_table_lookup_accounts") == 0)),
    )
    key, session = ("signature", "slot", "blockhash"), LINEAGE
    thin = ("revision", "source_id", "observation_id", "recorded_at_unix_ns")
    tail = ("canonicality", "commitment", "revision", *session)
    outer = good.select(*key, F.posexplode("instructions").alias("outer_index", "x"), F.lit(None).cast("int").alias("inner_index"), *tail)
    inner = good.select(*key, F.explode("inner_instructions").alias("x"), *tail).withColumns({"outer_index": F.col("x.outer_index").cast("int"), "inner_index": F.col("x.inner_index").cast("int")})
    part = lambda df: df.select(*key, "outer_index", "inner_index", "x.program_id_index", "x.account_indexes", _hex("x.data").alias("raw_data_hex"), *tail)
    balances = good.select(*key, F.posexplode(F.arrays_zip(F.col("pre_balances").alias("pre"), F.col("post_balances").alias("post"))).alias("account_index", "b"), *thin)
    return {
        "solana_transactions": good.select(*key, "message_version", "static_account_keys", "address_table_lookup_accounts", _hex("raw").alias("raw_transaction_hex"), F.col("fee").cast("string").alias("fee"), "compute_units_consumed", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("execution_status"), F.coalesce("error", F.lit("")).alias("execution_error"), "canonicality", "commitment", "coverage_tier", "revision", *session),
        "solana_instructions": part(outer).unionByName(part(inner)),
        "solana_logs": good.select(*key, F.posexplode("logs").alias("log_index", "message"), "revision", *session),
        "solana_balance_changes": balances.select(*key, "account_index", F.col("b.pre").cast("string").alias("pre_lamports"), F.col("b.post").cast("string").alias("post_lamports"), *thin),
        "solana_token_balance_changes": good.select(*key, F.explode("token_balances").alias("x"), *thin).select(*key, "x.account_index", "x.mint", "x.pre_amount", "x.post_amount", "x.decimals", *thin),
    }


def solana_account_writes(writes: DataFrame) -> DataFrame:
    """Account writes of the selected-accounts tier, with data as hex and lamports as text."""
    good = demand(stamp(writes, SOLANA), the_tier_must_be_selected_accounts=F.col("coverage_tier") == SELECTED, canonicality_and_commitment_differ=truth_is_consistent("solana", F.col("canonicality"), F.col("commitment")))
    return good.select("pubkey", "slot", "blockhash", "owner", F.col("lamports").cast("string").alias("lamports"), _hex("data").alias("raw_data_hex"), "executable", "rent_epoch", "write_version", "canonicality", "commitment", "coverage_tier", "revision", *LINEAGE)


def fixture_facts(observations: DataFrame) -> DataFrame:
    """Committed fixture observations (JSON payload of fixture_id, value, source_sequence) as facts of revision 1."""
    body = F.from_json(F.col("payload").cast("string"), "fixture_id string, value string, source_sequence decimal(20,0)", {"mode": "FAILFAST"})
    o = observations.withColumn("_b", body)
    o = demand(
        o,
        the_payload_is_no_fixture=F.col("_b.fixture_id").isNotNull() & F.col("_b.source_sequence").isNotNull(),
        the_sequence_differs_from_the_payload=F.col("source_sequence") == F.col("_b.source_sequence"),
        an_identity_has_another_length=(F.octet_length("observation_id") == 32) & (F.octet_length("source_session_id") == 16),
    )

    @F.pandas_udf("binary")
    def digest(data):
        return pd.Series(blake3_known(data), dtype=object)

    key = o.withColumn("_key", digest(F.concat(F.lit("fixture/v1"), F.col("_b.fixture_id")).cast("binary")))
    named = key.withColumn("_id", digest(F.concat(F.lit(b"fact/v1"), F.col("_key"), F.unhex(F.lit("0000000000000001")), F.col("observation_id"))))
    return named.select(
        _hex("_id").alias("fact_id"), _hex("_key").alias("fact_key"), F.lit(1).cast("long").alias("revision"), "_b.fixture_id", "_b.value", F.col("_b.source_sequence").alias("source_sequence"), "chain", "network",
        F.lit("not_applicable").alias("canonicality"), F.lit(FIXTURE).alias("parser_version"), "source_id", _hex("source_session_id").alias("source_session_id"), _hex("observation_id").alias("observation_id"),
        F.col("observed_at_unix_ns").alias("valid_from_unix_ns"), F.col("durable_at_unix_ns").alias("recorded_at_unix_ns"),
    )


def decode_rows(attempts: DataFrame) -> DataFrame:
    """Decode attempts as rows of the decoder table; decoded JSON and an error exclude each other."""
    good = demand(attempts, a_decode_has_both_result_and_error=F.col("decoded_json").isNull() | F.col("error").isNull())
    return good.select("program_id", "slot", "instruction_identity", "decoder_version", "decode_status", "decoded_json", "error", _hex("raw_data").alias("raw_data_hex"), _hex("native_fact_id").alias("native_fact_id"), "revision", "recorded_at_unix_ns")
