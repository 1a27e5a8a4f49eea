"""The queries of this subpackage and their SQL."""

from . import bpe, exact_dedup, line_dedup, media, mixing, pii, quality, simhash, url_filter, warc

_MODULES = (exact_dedup, line_dedup, simhash, mixing, url_filter, bpe, pii, media, warc, quality)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
