"""Protocol-buffer wire format for the three record types, by declared fields; unknown fields are skipped."""

from __future__ import annotations

from functools import cache

# Fixed values of the format: field number, name, kind. Kinds: uint, int, bytes, string, strings, map; "?" marks a field that may be absent.
OBSERVATION = (
    (1, "schema_version", "uint"), (2, "observation_id", "bytes"), (3, "source_id", "string"), (4, "source_session_id", "bytes"),
    (5, "collector_sequence", "uint"), (6, "chain", "string"), (7, "network", "string"), (8, "channel", "string"),
    (9, "source_message_type", "string"), (10, "source_sequence", "uint?"), (11, "source_cursor", "bytes?"),
    (12, "observed_at_unix_ns", "int"), (13, "observed_at_monotonic_ns", "uint"), (14, "source_time_unix_ns", "int?"),
    (15, "payload_hash", "bytes"), (16, "payload", "bytes"), (17, "attributes", "map"), (18, "quality_flags", "strings"),
)
COMMIT = (
    (1, "source_session_id", "bytes"), (2, "first_collector_sequence", "uint"), (3, "last_collector_sequence", "uint"),
    (4, "first_wal_offset", "uint"), (5, "last_wal_offset", "uint"), (6, "durable_at_unix_ns", "int"), (7, "commit_hash", "bytes"),
)
COMMITTED = ((1, "observation", "bytes"), (2, "durable_at_unix_ns", "int"), (3, "wal_commit_hash", "bytes"))
_PAIR = ((1, "key", "string"), (2, "value", "string"))
_EMPTY = {"uint": 0, "int": 0, "bytes": b"", "string": ""}


def put_varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def take_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("bad varint")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at


_NUMBER, _BYTES, _STRING, _STRINGS, _MAP = range(5)
_HOW = {"uint": _NUMBER, "int": _NUMBER, "bytes": _BYTES, "string": _STRING, "strings": _STRINGS, "map": _MAP}
_ONE = [bytes([n]) for n in range(128)]
_ALWAYS = object()


@cache
def _plan(fields: tuple) -> tuple[list, dict, dict, list]:
    """What encode and decode need of the fields: (tag, name, how, default that is left out), by tag, defaults, fields that are lists or maps."""
    kinds = [(number, name, kind, _HOW[kind.rstrip("?")]) for number, name, kind in fields]
    write = [(put_varint(number << 3 | 2 * (how > 0)), name, how, _ALWAYS if kind.endswith("?") else _EMPTY.get(kind)) for number, name, kind, how in kinds]
    read = {number: (name, how, kind.startswith("int")) for number, name, kind, how in kinds}
    return write, read, {name: _EMPTY.get(kind) for _, name, kind, _ in kinds}, [(name, how) for _, name, _, how in kinds if how >= _STRINGS]


def _sized(body: bytes) -> bytes:
    return (_ONE[len(body)] if len(body) < 128 else put_varint(len(body))) + body


def encode(fields: tuple, row: dict) -> bytes:
    """Fields in order of number; plain fields that hold their default are left out, map entries go by key."""
    out, get = [], row.get
    for tag, name, how, empty in _plan(fields)[0]:
        value = get(name)
        if how == _MAP:
            for k in sorted(value or {}):
                out.append(tag + _sized(encode(_PAIR, {"key": k, "value": value[k]})))
        elif how == _STRINGS:
            for s in value or ():
                out.append(tag + _sized(s.encode()))
        elif value is None or value == empty:
            continue
        elif how == _NUMBER:
            out.append(tag + (_ONE[value] if 0 <= value < 128 else put_varint(value)))
        else:
            out.append(tag + _sized(value.encode() if how == _STRING else bytes(value)))
    return b"".join(out)


def decode(fields: tuple, data: bytes) -> dict:
    """The row; ValueError for anything that is not well formed."""
    _, known, defaults, several = _plan(fields)
    row = defaults.copy()
    for name, how in several:
        row[name] = {} if how == _MAP else []
    at, end = 0, len(data)
    while at < end:
        tag = data[at]
        tag, at = (tag, at + 1) if tag < 128 else take_varint(data, at)
        wire = tag & 7
        if wire == 0 or wire == 2:
            value = data[at] if at < end else 128
            value, at = (value, at + 1) if value < 128 else take_varint(data, at)
        if wire != 0:
            size = value if wire == 2 else {1: 8, 5: 4}.get(wire, -1)
            if size < 0 or at + size > end:
                raise ValueError("bad field")
            value, at = data[at : at + size], at + size
        field = known.get(tag >> 3)
        if field is None:
            continue
        name, how, signed = field
        if wire != (0 if how == _NUMBER else 2):
            raise ValueError(f"wrong wire type for {name}")
        if how == _NUMBER:
            row[name] = value - (1 << 64) if signed and value >> 63 else value
        elif how == _BYTES:
            row[name] = value
        elif how == _STRING:
            row[name] = value.decode()
        elif how == _STRINGS:
            row[name].append(value.decode())
        else:
            pair = decode(_PAIR, value)
            row[name][pair["key"]] = pair["value"]
    return row
