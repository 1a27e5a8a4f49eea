"""Pieces of SQL for digests that databases lack, so that queries over them can be compared."""

from __future__ import annotations

from ..functions.identity import IV, LANES, ORDER


def _rotated(x: str, by: int) -> str:
    return f"((({x}) >> {by}) | (({x}) << {32 - by})) & 4294967295"


def blake3_sql(source: str, key: str, digits: str, name: str = "b3") -> str:
    """CTEs that end in `name`(key, digest): BLAKE3 of hex digits (at most 1024 bytes) of each row of a source.

    One recursion step mixes one column or diagonal of the state; after 56 of them a block is done and the next begins.
    Needs WITH RECURSIVE. The chaining value, the message and the state travel as lists.
    """
    iv, flags = list(IV), "(CASE WHEN {b} = 0 THEN 1 ELSE 0 END) + (CASE WHEN {b} = blocks - 1 THEN 10 ELSE 0 END)"

    def state(chain: str, b: str) -> str:
        size = f"CASE WHEN {b} = blocks - 1 THEN n - 64 * {b} ELSE 64 END"
        return f"list_concat(list_concat({chain}, {iv[:4]}::BIGINT[]), [0, 0, {size}, {flags.format(b=b)}]::BIGINT[])"

    lanes = ", ".join(f"({k}, {a + 1}, {b + 1}, {c + 1}, {d + 1})" for k, (a, b, c, d) in enumerate(LANES))
    turned = ", ".join(f"m[{i + 1}]" for i in ORDER)
    word = "('0x' || substr(p, i * 8 + 7, 2) || substr(p, i * 8 + 5, 2) || substr(p, i * 8 + 3, 2) || substr(p, i * 8 + 1, 2))::BIGINT"
    shown = "list_transform(c, lambda x: substr(printf('%08x', x), 7, 2) || substr(printf('%08x', x), 5, 2) || substr(printf('%08x', x), 3, 2) || substr(printf('%08x', x), 1, 2))"
    return f"""{name}_in AS (SELECT {key} AS key, {digits} AS h, length({digits}) // 2 AS n FROM {source}),
{name}_p AS (SELECT key, n, greatest((n + 63) // 64, 1) AS blocks, rpad(h, (greatest((n + 63) // 64, 1) * 128)::INT, '0') AS p FROM {name}_in),
{name}_w AS (SELECT key, n, blocks, list_transform(range(blocks * 16), lambda i: {word}) AS w FROM {name}_p),
{name}_lane(k, la, lb, lc, ld) AS (VALUES {lanes}),
{name}_s(key, n, blocks, w, step, m, v, c) AS (SELECT key, n, blocks, w, 0::BIGINT, w[1:16], {state(f"{iv}::BIGINT[]", "0")}, {iv}::BIGINT[] FROM {name}_w
UNION ALL SELECT key, n, blocks, w, step + 1, CASE WHEN step % 57 = 56 THEN w[64 // 4 * (step // 57 + 1) + 1:64 // 4 * (step // 57 + 2)] WHEN step % 57 % 8 = 7 THEN [{turned}] ELSE m END,
CASE WHEN step % 57 = 56 THEN {state("done", "(step // 57 + 1)")} ELSE list_transform(range(1, 17), lambda i: CASE i WHEN la THEN a2 WHEN lb THEN b2 WHEN lc THEN c2 WHEN ld THEN d2 ELSE v[i] END) END,
CASE WHEN step % 57 = 56 THEN done ELSE c END FROM (
SELECT *, (v[la] + v[lb] + m[2 * k + 1]) & 4294967295 AS a1, {_rotated("xor(v[ld], a1)", 16)} AS d1, (v[lc] + d1) & 4294967295 AS c1, {_rotated("xor(v[lb], c1)", 12)} AS b1,
(a1 + b1 + m[2 * k + 2]) & 4294967295 AS a2, {_rotated("xor(d1, a2)", 8)} AS d2, (c1 + d2) & 4294967295 AS c2, {_rotated("xor(b1, c2)", 7)} AS b2,
list_transform(range(1, 9), lambda i: xor(v[i], v[i + 8])) AS done FROM {name}_s JOIN {name}_lane ON k = step % 57 % 8 WHERE step < 57 * blocks)),
{name} AS (SELECT key, array_to_string({shown}, '') AS digest FROM {name}_s WHERE step = 57 * blocks)"""


def little(number: str, digits: int = 16) -> str:
    """Hex of the low bytes of a number, least significant first."""
    return f"array_to_string(list_reverse(regexp_extract_all(printf('%0{digits}x', {number}), '..')), '')"


def text_hex(text: str) -> str:
    return f"lower(hex({text}))"


def framed_hex(text: str) -> str:
    """UTF-8 after its length as eight bytes."""
    return f"{little(f'strlen({text})')} || {text_hex(text)}"
