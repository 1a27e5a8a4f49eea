"""Scalar functions that Catalyst can express: digests, hex, quantities, ranges, strict JSON, script classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = 18446744073709551615
#: Script patterns over upper-case hex; fixed values.
SCRIPTS = (("p2pkh", "^76A914.{40}88AC$"), ("p2sh", "^A914.{40}87$"), ("taproot", "^5120.{64}$"), ("segwit_v0", "^00(14.{40}|20.{64})$"), ("op_return", "^6A"))


def reversed_bytes(digits: Column) -> Column:
    """Hex digits with the order of their bytes turned round."""
    return F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")


def little_endian(value: Column) -> Column:
    """Eight bytes of a non-negative long, least significant first."""
    return F.unhex(reversed_bytes(F.lpad(F.hex(value), 16, "0")))


def double_sha256(data: Column) -> Column:
    return F.sha2(F.unhex(F.sha2(data, 256)), 256)


def display_hash(data: Column) -> Column:
    """Transaction and block identifiers: double SHA-256, shown back to front."""
    return reversed_bytes(double_sha256(data))


def framed(*fields: Column) -> Column:
    """Fields as UTF-8, each after its length as eight little-endian bytes."""
    return F.concat(*(part for f in fields for part in (little_endian(F.octet_length(f).cast("long")), f.cast("binary"))))


def epoch_id(domain: str, source: Column, txid: Column, epoch: Column) -> Column:
    """Identity of a membership epoch: SHA-256 over domain, framed source, transaction hash bytes and epoch number."""
    return F.sha2(F.concat(F.lit(domain).cast("binary"), little_endian(F.octet_length(source).cast("long")), source.cast("binary"), F.unhex(txid), little_endian(epoch)), 256)


def outpoint(txid: Column, vout: Column) -> Column:
    """36 bytes: the hash in wire order, then the index, least significant byte first."""
    return F.concat(F.unhex(reversed_bytes(txid)), F.unhex(reversed_bytes(F.lpad(F.hex(vout), 8, "0"))))


def parse_quantity(text: Column) -> Column:
    """0x-prefixed hex without leading zeros as decimal(20,0); null for anything else or beyond 64 bits."""
    good = text.rlike("^0x(0|[1-9a-fA-F][0-9a-fA-F]{0,15})$")
    return F.when(good, F.conv(F.substring(text, 3, 16), 16, 10).cast("decimal(20,0)"))


def to_quantity(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def is_lower_hex(text: Column, digits: int) -> Column:
    return text.rlike(f"^[0-9a-f]{{{digits}}}$")


def checked_add(a: Column, b: Column) -> Column:
    """Sum of two unsigned 64-bit decimals; null when it does not fit."""
    total = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    return F.when(total <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def u256(text: Column) -> Column:
    """Canonical decimal digits of an unsigned 256-bit number; null for anything else. Compare by u256_key."""
    limit = str(2**256 - 1)
    plain = F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", ""))
    return F.when((F.length(plain) < len(limit)) | ((F.length(plain) == len(limit)) & (plain <= limit)), plain)


def hex_add(a: Column, b: Column) -> Column:
    """Sum of two unsigned 256-bit numbers of 64 hex digits, as 64 digits; null when it does not fit.

    Five parts of at most 15 digits are added as longs, the carry goes from part to part.
    """
    carry, parts = F.lit(0).cast("long"), []
    for start, size in ((50, 15), (35, 15), (20, 15), (5, 15), (1, 4)):
        total = sum((F.conv(F.substring(x, start, size), 16, 10).cast("long") for x in (a, b)), carry)
        parts.insert(0, F.lpad(F.lower(F.hex(total % F.lit(16**size))), size, "0"))
        carry = F.floor(F.shiftright(total, 4 * size))
    return F.when((carry == 0) & a.rlike("^[0-9a-f]{64}$") & b.rlike("^[0-9a-f]{64}$"), F.concat(*parts))


def u256_key(text: Column) -> Column:
    return F.lpad(text, 78, "0")


def script_class(script: Column) -> Column:
    digits, out = F.hex(script), F.lit("other")
    for name, pattern in reversed(SCRIPTS):
        out = F.when(digits.rlike(pattern), name).otherwise(out)
    return out


def signals_replacement(sequences: Column) -> Column:
    return F.exists(sequences, lambda s: s < 4294967294)


def json_has_only(text: Column, allowed: list[str]) -> Column:
    """Whether a JSON object has no key but the allowed ones: what from_json alone does not refuse."""
    keys = F.json_object_keys(text)
    return keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0)


def archive_hour(ns: Column) -> Column:
    """date and hour (UTC) of a time in nanoseconds."""
    at = F.timestamp_micros(F.floor(ns / 1000).cast("long"))
    return F.struct(F.date_format(at, "yyyy-MM-dd").alias("date"), F.hour(at).alias("hour"))


def clock_is_trusted(offset: Column, most: int) -> Column:
    return offset.between(-most, most)


def backoff(initial: int, most: int, attempt: Column) -> Column:
    return F.least(F.lit(float(initial)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most))).cast("long")


def nullable_index(index: Column) -> Column:
    """Sort key that puts an absent index apart from 0."""
    return F.struct(index.isNull().alias("absent"), F.coalesce(index, F.lit(0)).alias("value"))


def truth_is_consistent(chain: str, canonicality: Column, finality: Column) -> Column:
    """Whether a pair of statuses belongs together on a chain."""
    if chain == "bitcoin":
        return ((canonicality == "non_canonical") & (finality == "reorged")) | ((canonicality == "canonical") & finality.isin("included", "confirmed")) | ((canonicality == "candidate") & finality.isin("pending", "included"))
    if chain == "solana":
        return ((canonicality == "non_canonical") & (finality == "dead")) | ((canonicality == "candidate") & finality.isin("received", "processed")) | ((canonicality == "canonical") & finality.isin("processed", "confirmed", "finalized"))
    known = {"ethereum": ("safe", "finalized"), "bsc": ("fast_finalized",)}[chain]
    return canonicality.isin("candidate", "canonical", "non_canonical") & finality.isin("pending", "included", "canonical_head", "reorged", *known) & ((canonicality == "non_canonical") == (finality == "reorged"))
