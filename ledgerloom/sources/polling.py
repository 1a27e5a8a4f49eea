"""Polling of HTTP endpoints: requests as rows, a cyclic plan, bounded bodies, faults that tell whether to try again."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FETCHED = "tick long, channel string, message_type string, status int, body binary, fault string"
#: Statuses beside those of 500 and more after which the same request may succeed (fixed values).
RETRYABLE = (408, 425, 429)


def json_rpc(method: Column, params: Column, number: Column) -> Column:
    """Body of a JSON-RPC call; params is JSON text."""
    return F.concat(F.lit('{"id":'), number.cast("string"), F.lit(',"jsonrpc":"2.0","method":'), F.to_json(F.array(method)).substr(F.lit(2), F.length(F.to_json(F.array(method))) - 2), F.lit(',"params":'), params, F.lit("}"))


def request_rules() -> dict[str, Column]:
    """Rules of a request row (channel, message_type, url): a web address with a host and without credentials, both names given."""
    return {
        "url": F.col("url").rlike(r"(?i)\Ahttps?://[^/?#\s]+([/?#]\S*)?\z"),
        "credentials": ~F.col("url").rlike(r"\A[^:]*://[^/?#]*@"),
        "channel": F.trim("channel") != "",
        "message_type": F.trim("message_type") != "",
    }


def turns(ticks: DataFrame, plan: DataFrame, size: int) -> DataFrame:
    """The request whose turn it is at each tick (column `tick`), and `cycle_complete` at the last of the plan.

    plan has `position` 0 to size - 1 and is small by nature, a few rows an endpoint; ticks may be a stream of Spark's
    rate source. Every tick has one request as long as positions are unique and complete.
    """
    at = ticks.withColumn("position", F.pmod(F.col("tick"), F.lit(size)))
    return at.join(plan, "position").withColumn("cycle_complete", F.col("position") == size - 1)


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        return None


def _fetch(url: str, body: str | None, most: int, timeout: float) -> tuple[int | None, bytes | None, str | None]:
    request = urllib.request.Request(url, None if body is None else body.encode(), {} if body is None else {"Content-Type": "application/json"})  # noqa: S310 - request_rules allows http(s) only
    try:
        with urllib.request.build_opener(_Stay()).open(request, timeout=timeout) as reply:
            status, data = reply.status, reply.read(most + 1)
    except urllib.error.HTTPError as error:
        with error:
            status, data = error.code, error.read(most + 1)
    except (OSError, ValueError):
        return None, None, "unreachable"
    if len(data) > most:
        return status, None, "too_large"
    if 200 <= status < 300:
        return status, data, None
    return status, data, "retryable" if status >= 500 or status in RETRYABLE else "permanent"


def fetch(requests: DataFrame, most: int, timeout: float = 30.0) -> DataFrame:
    """The replies of requests (tick, channel, message_type, url, body), with `fault` for what is none.

    A request without body is a GET, one with a body a POST. A body above `most` bytes is not kept, redirects are not
    followed, an endpoint that does not answer in time is unreachable. A task holds one reply at a time; a task that
    runs again asks again, so requests must be repeatable.
    """
    asked = requests.select("tick", "channel", "message_type", "url", "body")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string()]
        names = ["tick", "channel", "message_type", "status", "body", "fault"]
        for batch in parts:
            for row in batch.to_pylist():
                values = (row["tick"], row["channel"], row["message_type"], *_fetch(row["url"], row["body"], most, timeout))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    return asked.mapInArrow(run, FETCHED)
