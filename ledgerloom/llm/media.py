"""Media columns: AVI with motion-JPEG frames, read through the RIFF index.

Frames are lossless JPEG (ITU T.81, process 14: predictor 1, 8-bit samples, 64 samples a line). Its Huffman table gives
a difference of c magnitude bits a code of 9 - c bits, the longest left unused, so every sample takes exactly 9 bits: a
line is 72 bytes and both directions are plain array arithmetic. Shots are cut where the histogram distance of two
neighbouring frames exceeds the mean of the distances around it by a factor, which adapts to how much a clip moves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table

WIDTH, LINES, MICROSECONDS = 64, 64, 40_000
#: Histogram bins; frames on either side that the threshold adapts to; factor over their mean; least distance of a cut.
BINS, AROUND, FACTOR, FLOOR = 16, 4, 2.0, 0.2

# Differences of -255 to 255: category c has code 1...10 of 9 - c bits, then c bits; nine bits in all, by difference + 255.
_CODE = np.zeros(511, np.uint16)
_DIFF = np.zeros(512, np.int16)
for _d in range(-255, 256):
    _c = abs(_d).bit_length()
    _CODE[_d + 255] = (((1 << (9 - _c)) - 2) << _c) | (_d if _d > 0 else _d + (1 << _c) - 1 if _d else 0)
    _DIFF[_CODE[_d + 255]] = _d


def _header(lines: int, width: int = WIDTH) -> bytes:
    """Markers before the scan: DHT (one code of each length 1 to 9, category 8 the shortest), SOF3, SOS."""
    huffman = bytes([0, *([1] * 9), *([0] * 7), *range(8, -1, -1)])
    frame = struct.pack(">BHHBBBB", 8, lines, width, 1, 1, 0x11, 0)
    scan = bytes([1, 1, 0, 1, 0, 0])
    return b"\xff\xd8" + b"".join(m + struct.pack(">H", len(x) + 2) + x for m, x in ((b"\xff\xc4", huffman), (b"\xff\xc3", frame), (b"\xff\xda", scan)))


def pack_lines(samples: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(n, WIDTH) samples to (n, 72) bytes; first[i]: line i begins a frame."""
    s = samples.astype(np.int16)
    d = np.empty_like(s)
    d[:, 1:] = s[:, 1:] - s[:, :-1]
    d[1:, 0] = s[1:, 0] - s[:-1, 0]
    d[first, 0] = s[first, 0] - 128
    c = _CODE[d + 255].reshape(len(s), -1, 8)
    out = np.empty((len(s), c.shape[1], 9), np.uint8)
    out[..., 0] = c[..., 0] >> 1
    for k in range(1, 8):
        out[..., k] = ((c[..., k - 1] & ((1 << k) - 1)) << (8 - k)) | (c[..., k] >> (k + 1))
    out[..., 8] = c[..., 7] & 255
    return out.reshape(len(s), -1)


def unpack_lines(packed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The inverse of pack_lines."""
    b = packed.reshape(len(packed), -1, 9).astype(np.uint16)
    c = np.empty((*b.shape[:2], 8), np.uint16)
    for k in range(8):
        c[..., k] = ((b[..., k] & (255 >> k)) << (k + 1)) | (b[..., k + 1] >> (7 - k))
    d = _DIFF[c].reshape(len(packed), -1).astype(np.int64)
    starts = np.nonzero(first)[0]
    column = np.cumsum(d[:, 0])
    column -= np.repeat(column[starts] - d[starts, 0], np.diff([*starts, len(d)]))
    d[:, 0] = column + 128
    return np.cumsum(d, axis=1).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(scans: list[bytes], heights: list[int]) -> bytes:
    """RIFF AVI from entropy-coded scans, one a frame, with the idx1 index. The last frame may have fewer lines."""
    frames = [_header(h) + s + b"\xff\xd9" for s, h in zip(scans, heights, strict=True)]
    height, largest = max(heights), max(map(len, frames))
    main = struct.pack("<10I16x", MICROSECONDS, largest * 1_000_000 // MICROSECONDS, 0, 0x10, len(frames), 0, 1, largest, WIDTH, height)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, MICROSECONDS, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    chunks, index, at = [], [], 4
    for f in frames:
        chunks.append(c := _chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index)))


def encode_avi(payloads: list[bytes]) -> list[bytes]:
    """An AVI of each payload (multiples of 64 bytes); all lines of a batch are packed at once."""
    counts = [len(p) // WIDTH for p in payloads]
    first = np.concatenate([np.arange(n) % LINES == 0 for n in counts]) if counts else np.empty(0, bool)
    packed = pack_lines(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH), first)
    out, line = [], 0
    for n in counts:
        ends = [*range(0, n, LINES), n]
        scans = [packed[line + a : line + b].tobytes().replace(b"\xff", b"\xff\0") for a, b in zip(ends, ends[1:])]  # noqa: B905
        out.append(write_avi(scans, [b - a for a, b in zip(ends, ends[1:])]))  # noqa: B905
        line += n
    return out


def read_frames(avi: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """(lines, scan bytes) of each frame that the index lists, and microseconds a frame."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index, pace = 12, 0, b"", MICROSECONDS
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"hdrl":
            pace = struct.unpack_from("<I", avi, at + 20)[0]
        elif name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = avi[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name == b"00dc":
            jpeg = avi[movi + offset + 8 : movi + offset + 8 + size]
            at, lines = 2, 0
            while jpeg[at : at + 2] != b"\xff\xda":
                if jpeg[at : at + 2] == b"\xff\xc3":
                    lines = struct.unpack_from(">H", jpeg, at + 5)[0]
                at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
            at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
            frames.append((lines, jpeg[at:-2].replace(b"\xff\0", b"\xff")))
    return frames, pace


def decode_avi(files: list[bytes]) -> list[tuple[np.ndarray, list[int], int]]:
    """Samples (lines, WIDTH), lines of each frame, microseconds a frame; all lines of a batch are unpacked at once."""
    read = [read_frames(f) for f in files]
    first = np.concatenate([np.arange(n) == 0 for frames, _ in read for n, _ in frames]) if read else np.empty(0, bool)
    packed = np.frombuffer(b"".join(s for frames, _ in read for _, s in frames), np.uint8).reshape(-1, WIDTH * 9 // 8)
    samples, out, line = unpack_lines(packed, first), [], 0
    for frames, pace in read:
        n = sum(x for x, _ in frames)
        out.append((samples[line : line + n], [x for x, _ in frames], pace))
        line += n
    return out


def shots(samples: np.ndarray, heights: list[int]) -> list[tuple[int, int]]:
    """(first frame, end frame) of each shot, by adaptive histogram differences."""
    frame = np.repeat(np.arange(len(heights)), heights)
    h = np.bincount((frame[:, None] * BINS + (samples >> 4)).ravel(), minlength=len(heights) * BINS).reshape(-1, BINS).astype(float)
    h /= h.sum(axis=1, keepdims=True)
    d = np.abs(h[1:] - h[:-1]).sum(axis=1) / 2
    total = np.concatenate([[0], np.cumsum(d)])
    i = np.arange(len(d))
    a, b = np.maximum(i - AROUND, 0), np.minimum(i + AROUND + 1, len(d))
    others = (total[b] - total[a] - d) / np.maximum(b - a - 1, 1)
    cuts = [0, *(np.nonzero((d > FLOOR) & (d > FACTOR * others))[0] + 1).tolist(), len(heights)]
    return list(zip(cuts, cuts[1:]))  # noqa: B905


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and `media` (binary): each text as UTF-8, padded by zero bytes to a positive multiple of 64, as an AVI.

    A null text counts as empty: one line of zeros. Repeated rows stay; equal texts have equal media. Other columns are
    ignored; an empty df gives no rows.
    """

    def make():
        def work(texts: list) -> list[list]:
            raw = [(t or "").encode() for t in texts]
            return [[len(r) for r in raw], encode_avi([r + b"\0" * (-len(r) % WIDTH if r else WIDTH) for r in raw])]

        return work

    return per_row(df, [id_col], text_col, {"n_bytes": "long", "media": "binary"}, make)


def media_clips(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, clip, start_ms, end_ms, frames, mean: a row for each shot of a `media` column. Null media have none, and
    other columns are ignored."""

    def make():
        def work(files: list) -> list[list]:
            got = iter(decode_avi([f for f in files if f is not None]))
            rows = []
            for f in files:
                rows.append([])
                if f is not None:
                    samples, heights, pace = next(got)
                    ends = np.cumsum([0, *heights])
                    rows[-1] = [(k, a * pace // 1000, b * pace // 1000, b - a, float(samples[ends[a] : ends[b]].mean())) for k, (a, b) in enumerate(shots(samples, heights))]
            return [[[r[0] for r in x] for x in rows], [[r[1] for r in x] for x in rows], [[r[2] for r in x] for x in rows], [[r[3] for r in x] for x in rows], [[round(1000 * r[4]) for r in x] for x in rows]]

        return work

    names = ("clip", "start_ms", "end_ms", "frames", "mean")
    lists = per_row(media, [id_col], "media", dict.fromkeys((f"{n}_" for n in names), "array<long>"), make)
    return lists.select(id_col, F.explode(F.arrays_zip(*(F.col(f"{n}_").alias(n) for n in names))).alias("c")).select(id_col, "c.clip", "c.start_ms", "c.end_ms", "c.frames", (F.col("c.mean") / 1000).alias("mean"))


def media_features(media: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, and what is read back from a `media` column without nulls: sizes, digests and a feature
    (frames, shot ends in ms, mean, spread). An empty table gives no rows."""

    def make():
        def work(files: list) -> list[list]:
            size, sha, crc, n, own, feature = [], [], [], [], [], []
            for f, (samples, heights, pace) in zip(files, decode_avi(files), strict=True):
                payload = samples.tobytes()
                size.append(len(payload))
                sha.append(hashlib.sha256(payload).hexdigest())
                crc.append(zlib.crc32(payload[-64:]))
                n.append(len(f))
                own.append(hashlib.sha256(f).hexdigest())
                ends = " ".join(str(b * pace // 1000) for _, b in shots(samples, heights))
                feature.append(f"frames={len(heights)};shots={ends};mean={samples.mean():.4f};spread={samples.std():.4f}")
            return [size, sha, crc, n, own, feature]

        return work

    return per_row(media, keep, "media", {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}, make)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(media_column(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])


SQL: dict[str, str] = {}
QUERIES = {"op8_media": op8_media}
