"""Deterministic identities: BLAKE3 in plain Python and, for many values, in numpy; and the digests built on it."""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the BLAKE3 specification: initial state, message order, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
START, END, PARENT, ROOT = 1, 2, 4, 8
LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(chain: tuple, block: bytes, counter: int, length: int, flags: int) -> list[int]:
    v = [*chain, *IV[:4], counter & 0xFFFFFFFF, counter >> 32, length, flags]
    m = struct.unpack("<16I", block.ljust(64, b"\0"))
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(LANES):
            for x, r, s in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + x) & 0xFFFFFFFF
                t = v[d] ^ v[a]
                v[d] = (t >> r | t << (32 - r)) & 0xFFFFFFFF
                v[c] = (v[c] + v[d]) & 0xFFFFFFFF
                t = v[b] ^ v[c]
                v[b] = (t >> s | t << (32 - s)) & 0xFFFFFFFF
        m = tuple(m[i] for i in ORDER)
    return [v[i] ^ v[i + 8] for i in range(8)]


def _node(data: bytes, first: int, root: int) -> list[int]:
    if len(data) <= 1024:
        chain: tuple | list = IV
        blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
        for i, b in enumerate(blocks):
            last = i == len(blocks) - 1
            chain = _compress(tuple(chain), b, first, len(b), START * (i == 0) | (END | root) * last)
        return list(chain)
    left = 1 << ((len(data) - 1) // 1024).bit_length() - 1
    both = _node(data[: left * 1024], first, 0) + _node(data[left * 1024 :], first + left, 0)
    return _compress(IV, struct.pack("<16I", *both), 0, 64, PARENT | root)


def _lanes(chain: np.ndarray, words: np.ndarray, counter: np.ndarray | int, length: np.ndarray | int, flags: np.ndarray | int) -> np.ndarray:
    """_compress of many blocks at once: chain has 8 rows, words 16, each with a column a block; so has the result 8."""
    n = words.shape[1]
    low = np.broadcast_to(np.asarray(counter, np.uint64), n)
    a, b, c, d = chain[:4].copy(), chain[4:].copy(), np.repeat(np.array(IV[:4], np.uint32)[:, None], n, 1), np.empty((4, n), np.uint32)
    d[0], d[1], d[2], d[3] = low.astype(np.uint32), low >> np.uint64(32), length, flags
    t, at = np.empty((4, n), np.uint32), np.arange(16)

    def turn(x: np.ndarray, y: np.ndarray, by: int) -> None:
        """x ^= y, then x rotates to the right."""
        np.bitwise_xor(x, y, out=x)
        np.left_shift(x, 32 - by, out=t)
        np.right_shift(x, by, out=x)
        np.bitwise_or(x, t, out=x)

    def mix(x: np.ndarray, y: np.ndarray) -> None:
        """The four columns, or, once rows are turned, the four diagonals."""
        nonlocal a, c
        for m, r, s in ((x, 16, 12), (y, 8, 7)):
            a += b
            a += m
            turn(d, a, r)
            c += d
            turn(b, c, s)

    for _ in range(7):
        mix(words[at[0:8:2]], words[at[1:8:2]])
        b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]
        mix(words[at[8:16:2]], words[at[9:16:2]])
        b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
        at = at[list(ORDER)]
    return np.concatenate([a ^ c, b ^ d])


def _start(n: int) -> np.ndarray:
    return np.repeat(np.array(IV, np.uint32)[:, None], n, 1)


def _large(data: bytes) -> list[int]:
    """The root of over one chunk: all whole chunks side by side, then the tree level by level, an odd node moving up."""
    whole = (len(data) - 1) // 1024
    level = []
    for first in range(0, whole, 4096):
        n = min(4096, whole - first)
        words = np.frombuffer(data, "<u4", n * 256, first * 1024).reshape(n, 16, 16)
        chain = _start(n)
        at = np.arange(first, first + n, dtype=np.uint64)
        for i in range(16):
            chain = _lanes(chain, words[:, i].T, at, 64, START * (i == 0) | END * (i == 15))
        level.append(chain.T)
    nodes = np.concatenate([*level, np.array([_node(data[whole * 1024 :], whole, 0)], np.uint32)])
    while len(nodes) > 2:
        pairs, odd = nodes[: len(nodes) // 2 * 2].reshape(-1, 16), nodes[len(nodes) // 2 * 2 :]
        nodes = np.concatenate([_lanes(_start(len(pairs)), pairs.T, 0, 64, PARENT).T, odd])
    return _compress(IV, nodes.astype("<u4").tobytes(), 0, 64, PARENT | ROOT)


def blake3(data: bytes) -> bytes:
    return struct.pack("<8I", *(_large(data) if len(data) > 8192 else _node(data, 0, ROOT)))


#: Chunks that go side by side.
WIDE = 4096


def blake3_many(values: Sequence[bytes]) -> list[bytes]:
    """blake3 of each value. Chunks of equally many blocks go side by side, then the trees level by level; long values go one by one."""
    short = [i for i, v in enumerate(values) if len(v) <= 8192]
    alike, spans, n = defaultdict(list), [], 0
    for i in short:
        v = values[i]
        chunks = (len(v) + 1023) // 1024 or 1
        for k in range(chunks):
            piece = v if chunks == 1 else v[1024 * k : 1024 * k + 1024]
            alike[(len(piece) + 63) // 64 or 1].append((n + k, k, ROOT * (chunks == 1), len(piece), piece))
        spans.append((n, n + chunks))
        n += chunks
    nodes = np.empty((n, 8), np.uint32)
    for blocks, group in alike.items():
        for first in range(0, len(group), WIDE):
            place, counter, root, size, pieces = zip(*group[first : first + WIDE], strict=True)
            words = np.ascontiguousarray(np.frombuffer(b"".join(p.ljust(64 * blocks, b"\0") for p in pieces), "<u4").reshape(len(pieces), blocks, 16).transpose(1, 2, 0))
            chain, root, size = _start(len(pieces)), np.array(root), np.array(size)
            for i in range(blocks):
                last = i == blocks - 1
                chain = _lanes(chain, words[i], np.array(counter), size - 64 * i if last else 64, START * (i == 0) | (END | root if last else 0))
            nodes[list(place)] = chain.T
    whole = {i: nodes[a:b] for i, (a, b) in zip(short, spans, strict=True)}
    while tall := {i: x for i, x in whole.items() if len(x) > 1}:
        pairs = np.concatenate([x[: len(x) // 2 * 2].reshape(-1, 16) for x in tall.values()])
        root = np.concatenate([np.full(len(x) // 2, PARENT | ROOT * (len(x) == 2)) for x in tall.values()])
        up, at = _lanes(_start(len(pairs)), pairs.T, 0, 64, root).T, 0
        for i, x in tall.items():
            half = len(x) // 2
            whole[i] = np.concatenate([up[at : at + half], x[2 * half :]])
            at += half
    return [whole[i].astype("<u4").tobytes() if i in whole else blake3(v) for i, v in enumerate(values)]


def blake3_known(values: Iterable[bytes | None]) -> list[bytes | None]:
    """blake3_many of what is not null; null stays null."""
    values = list(values)
    made = iter(blake3_many([bytes(v) for v in values if v is not None]))
    return [None if v is None else next(made) for v in values]


def _observation(source: str, session: bytes, sequence: int, payload: bytes) -> bytes:
    return b"observation/v1" + source.encode() + session + struct.pack(">Q", sequence) + hashlib.sha256(payload).digest()


def observation_id(source: str, session: bytes, sequence: int, payload: bytes) -> bytes:
    return blake3(_observation(source, session, sequence, payload))


def fact_key(fixture: str) -> bytes:
    return blake3(b"fixture/v1" + fixture.encode())


def fact_id(key: bytes, revision: int, observation: bytes) -> bytes:
    return blake3(b"fact/v1" + key + struct.pack(">Q", revision) + observation)


def cursor(payload: bytes) -> str:
    return f"{payload.hex()}.{blake3(payload)[:16].hex()}"


def read_cursor(text: str) -> bytes:
    """The payload; raises ValueError unless the checksum is right."""
    body, _, check = text.partition(".")
    payload = bytes.fromhex(body)
    if check != blake3(payload)[:16].hex():
        raise ValueError("bad cursor")
    return payload


def cursors(payloads: Sequence[bytes]) -> list[str]:
    """cursor of each payload."""
    return [f"{p.hex()}.{d[:16].hex()}" for p, d in zip(payloads, blake3_many(payloads), strict=True)]


def good_cursors(texts: Sequence[str]) -> list[bool]:
    """Whether read_cursor would take each text."""
    held = []
    for t in texts:
        body, _, check = t.partition(".")
        try:
            held.append((bytes.fromhex(body), check))
        except ValueError:
            held.append((None, check))
    return [d is not None and check == d[:16].hex() for (_, check), d in zip(held, blake3_known(p for p, _ in held), strict=True)]


def _crc_entry(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ 0x82F63B78 * (n & 1)
    return n


_CRC = [_crc_entry(i) for i in range(256)]
#: Bytes that are looked up at once, and what each byte value adds when so many others follow, the most first.
SPAN = 1024


def _crc_spans() -> np.ndarray:
    rows = [np.array(_CRC, np.uint32)]
    for _ in range(SPAN - 1):
        rows.append(rows[-1] >> 8 ^ rows[0][rows[-1] & 255])
    return np.concatenate(rows[::-1])


_SPANS, _PLACES = _crc_spans(), np.arange(SPAN) * 256


def crc32c(data: bytes) -> int:
    """Castagnoli polynomial, reflected; its table follows from the polynomial."""
    c = 0xFFFFFFFF
    for at in range(0, len(data), SPAN):
        part = np.frombuffer(data, np.uint8, min(SPAN, len(data) - at), at)
        if len(part) < 4:
            for b in part.tolist():
                c = _CRC[(c ^ b) & 255] ^ c >> 8
            continue
        index = _PLACES[SPAN - len(part) :] + part
        index[:4] ^= (c & 255, c >> 8 & 255, c >> 16 & 255, c >> 24)
        c = int(np.bitwise_xor.reduce(_SPANS.take(index)))
    return c ^ 0xFFFFFFFF


def block_work(bits: int) -> int:
    """Expected hashes of a compact target: 2**256 / (target + 1)."""
    size, mantissa = bits >> 24, bits & 0x7FFFFF
    target = mantissa << 8 * (size - 3) if size >= 3 else mantissa >> 8 * (3 - size)
    return (1 << 256) // (target + 1) if target else 0


def observation_ids(source: Column, session: Column, sequence: Column, payload: Column) -> Column:
    """observation_id of each row, lowercase hex, an Arrow batch at a time. Null in any input gives null."""

    @F.pandas_udf("string")
    def run(s: pd.Series, z: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        whole = (None if a is None or b is None or c != c or d is None else _observation(a, bytes(b), int(c), bytes(d)) for a, b, c, d in zip(s, z, n, p, strict=True))
        return pd.Series([None if d is None else d.hex() for d in blake3_known(whole)], dtype=object)

    return run(source, session, sequence, payload)


def blake3_hex(data: Column) -> Column:
    """BLAKE3 of binary values, lowercase hex, an Arrow batch at a time; null stays null."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else d.hex() for d in blake3_known(values)], dtype=object)

    return run(data)
