"""Guards, feeds, fact tables, alert identities and wide sums on small cases."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import codecs
from ledgerloom.functions.identity import blake3
from ledgerloom.operators import control, guards, normalize
from ledgerloom.sources import feeds, polling, tables


def told(spark, rule, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(rule(F.col("t"))).collect()]


def test_identities_are_visible_ascii(spark):
    assert told(spark, guards.is_graphic, "a-1", "", "a b", "é", "a\n", "x" * 128, "x" * 129, None) == [True, False, False, False, False, True, False, None]


def test_private_endpoints(spark):
    good = ["tcp://127.0.0.1:28332", "10.1.2.3:80", "172.16.0.1", "172.31.255.1:1", "http://192.168.7.9:8332", "[::1]:80", "tcp://[fd00::1]:9", "[fe80::1]:9", "[fc00:1:2:3:4:5:6:7]:9"]
    bad = ["tcp://8.8.8.8:1", "172.32.0.1:1", "127.0.0.256:1", "127.0.0:1", "node.local:80", "[2001:db8::1]:80", "[::2]:80", "", "010.0.0.1:1", "[fd00::1::2]:9", "127.0.0.1.example:80"]
    assert told(spark, guards.endpoint_is_private, *good) == [True] * len(good)
    assert told(spark, guards.endpoint_is_private, *bad) == [False] * len(bad)


def test_secure_endpoints(spark):
    assert told(spark, guards.endpoint_is_secure, "https://a.example", "HTTPS://a.example:10/x") == [True, True]
    assert not any(told(spark, guards.endpoint_is_secure, "http://a.example", "https://", "https://u@a.example", "https://a.example/?k=1", "https://a.example/#f", "https://a.example/ b"))


OBSERVER = "deployment int, environment string, source_id string, network string, log_path string, endpoint string"


def test_deployments(spark):
    one = lambda d, s, p, e="127.0.0.1:1", n="mainnet": (d, "production", s, n, p, e)
    rows = [one(1, "a", "/a"), one(1, "b", "/b"), one(1, "c", "/c"), one(2, "a", "/a"), one(2, "a", "/b", "x:1"), one(3, "a", "/a", n="testnet"), one(4, None, None, None, None)]
    found = guards.deployment_faults(spark.createDataFrame(rows, OBSERVER)).select("deployment", "log_path", "faults").collect()
    by = {(r[0], r[1]): r[2] for r in found}
    assert all(by[1, p] == [] for p in ("/a", "/b", "/c")) and by[3, "/a"] == []
    assert by[2, "/a"] == ["duplicate_source", "too_few_observers"] and by[2, "/b"] == ["duplicate_source", "unsafe_endpoint", "too_few_observers"]
    assert by[4, None] == ["source_identity", "shared_log_path", "unsafe_endpoint"]
    assert guards.deployment_faults(spark.createDataFrame([], OBSERVER)).count() == 0


def test_independent_providers(spark):
    df = spark.createDataFrame([(("a", "p", "e"), ("b", "q", "f")), (("a", "p", "e"), ("b", "p", "f")), (("a", None, "e"), ("b", "q", "f"))], "x struct<source_id:string,provider_id:string,endpoint:string>, y struct<source_id:string,provider_id:string,endpoint:string>")
    assert [r[0] for r in df.select(guards.independent("x", "y")).collect()] == [True, False, False]


SNAPSHOT = "network string, revision long, observed_at long, quorum int, eligible array<string>, unavailable array<string>, completeness string"


def test_snapshot_rules(spark):
    rows = [
        ("m", 1, 0, 1, ["a", "a"], [], "complete"), ("m", 0, -1, 0, [], [], "complete"), ("m", 1, 0, 1, ["a"], ["a"], "known_incomplete"),
        ("m", 1, 0, 1, ["a"], ["b"], "complete"), ("m", 1, 0, 1, [f"s{i}" for i in range(33)], [], "recovered"), (None, None, None, None, [None], [], None),
    ]
    good, bad = normalize.split(spark.createDataFrame(rows, SNAPSHOT), **guards.snapshot_rules())
    assert good.count() == 1
    assert sorted(",".join(r.faults) for r in bad.select("faults").collect()) == sorted([
        "revision,observed_at,quorum,missing_sources", "overlapping_sources", "contradictory_completeness", "too_many_sources",
        "network,revision,observed_at,quorum,source_identity,completeness",
    ])


def test_evaluation_identity(spark):
    row = ("al", "main", 7, 9, 3, 500, 2, 400, 3, 60, ["b", "a", "b"], ["c"], "suppress", "corrected", "recovered", "correction")
    schema = "alert_id string, network string, revision long, observed_at long, fee_rate long, vbytes long, quorum int, threshold long, for_evaluations int, cooldown long, eligible array<string>, unavailable array<string>, policy string, transition string, completeness string, cause string"
    df = spark.createDataFrame([row, (*row[:13], "nonsense", *row[14:])], schema).withColumn("id", control.evaluation_id("d/v1"))
    got = df.select("id", control.outbox_key("o/v1", F.col("id"), F.col("transition"))).collect()
    le = lambda n, size=8: n.to_bytes(size, "little")
    fields = [b"d/v1", b"al", b"main", le(7), le(9), le(3), le(500), le(2, 2), le(400), le(3, 2), le(60), b"\0", b"\3", b"a", b"b", b"unavailable", b"c", b"\2", b"\2"]
    framed = lambda parts: blake3(b"".join(le(len(p)) + p for p in parts)).hex()
    assert got[0][0] == framed(fields) and got[0][1] == framed([b"o/v1", got[0][0].encode()])
    assert list(got[1]) == [None, None]


def test_wide_sums(spark):
    pairs = [(0, 0), (2**256 - 1, 0), (2**256 - 1, 1), (2**255, 2**255), (2**64 - 1, 1), (16**15 - 1, 16**60 - 1), (3**160, 5**100)]
    df = spark.createDataFrame([(f"{a:064x}", f"{b:064x}") for a, b in pairs] + [(None, "0" * 64), ("x" * 64, "0" * 64)], "a string, b string")
    got = [r[0] for r in df.select(codecs.hex_add(F.col("a"), F.col("b"))).collect()]
    assert got == [f"{a + b:064x}" if a + b < 2**256 else None for a, b in pairs] + [None, None]


def test_frames(spark):
    rows = [([b"rawtx", b"", b"\1\0\0\x80"],), ([b"rawtx", b"b"],), (None,), ([b"x", b"b", b"\0\0\0\0"],), ([b"sequence", b"12345", b"\0\0\0\0"],), ([b"rawblock", b"b", b"\0"],), ([None, None, None],), ([b"rawtx", None, b"\0\0\0\0"],)]
    got = feeds.notifications(spark.createDataFrame(rows, "p array<binary>"), "p", 4).collect()
    assert [r.fault for r in got] == [None, "part_count", "part_count", "topic", "body_too_large", "sequence", "topic", "body_too_large"]
    assert (got[0].topic, bytes(got[0].body), got[0].transport_sequence) == ("rawtx", b"", 2**31 + 1)
    assert all(r.topic is None and r.body is None and r.transport_sequence is None for r in got[1:])


def test_backfill_takes_every_height_and_checks_hashes(spark):
    header = bytes(range(80))
    named = spark.createDataFrame([(header,)], "b binary").select(codecs.display_hash(F.col("b"))).first()[0]
    heights = spark.createDataFrame([(1, named), (2, "00"), (3, "11")], "height long, block_hash string")
    raw = spark.createDataFrame([(named, header + b"body"), ("00", header)], "block_hash string, raw_block binary")
    ranges = spark.createDataFrame([("s", 1, 4), ("t", 5, 4)], "source_id string, start long, end long")
    got = sorted((r.height, r.fault) for r in feeds.backfill(ranges, heights, raw).collect())
    assert got == [(1, None), (2, "hash_mismatch"), (3, "missing_block"), (4, "unknown_height")]


def test_recovery_ends_at_a_known_block(spark):
    blocks = spark.createDataFrame([("a", "0"), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "b")], "h string, p string")
    tips, known = (spark.createDataFrame([(v,)], "h string") for v in ("d", "b"))
    assert sorted(tuple(r) for r in feeds.recovered(blocks, "h", "p", known, tips).select("h", "anchored").collect()) == [("c", True), ("d", False)]
    assert {r.h for r in feeds.recovered(blocks, "h", "p", known.filter("false"), tips).collect()} == set("abcd")
    assert feeds.recovered(blocks, "h", "p", tips, tips).count() == 0


def test_publishing_again_changes_nothing(spark):
    o = spark.createDataFrame([("s", "1", b"x"), ("s", "1", b"x"), ("t", "2", b"y")], "source_id string, observation_id string, payload binary")
    sent = feeds.broker_records(o)
    assert sent.count() == 2 and feeds.new_events(sent, sent).count() == 0 and feeds.new_events(sent, sent.filter("false")).count() == 2
    payload = json.loads(o.select(feeds.fixture_observation("s", F.lit(3), F.lit("f"), F.lit("v"))).first()[0])
    assert payload == {"fixture_id": "f", "value": "v", "source_sequence": 3, "source_id": "s"}


def test_fact_tables(spark, tmp_path):
    root = tmp_path / "rows"
    root.mkdir()
    (root / "a.json").write_text('{"fact_id":"f1","source_id":"s","source_session_id":"z","observation_id":"o","parser_version":"p","extra":1}\n')
    columns = "fact_id string, source_id string, source_session_id string, observation_id string, parser_version string"
    try:
        for _ in range(2):
            tables.install(spark, "ledger_test", {"facts": columns})
        for _ in range(2):
            tables.append(tables.json_rows(spark, str(root), columns), "ledger_test.facts")
        stored = spark.table("ledger_test.facts")
        assert stored.count() == 2 and tables.fact(stored, "fact_id", "f2").count() == 0
        page = tables.with_lineage(tables.fact(stored, "fact_id", "f1"), ["fact_id"]).first()
        assert page.fact_id == "f1" and page.lineage.asDict() == {"source_id": "s", "source_session_id": "z", "observation_id": "o", "parser_version": "p"}
        assert tables.without(stored, stored.limit(1), "fact_id").count() == 0
    finally:
        spark.sql("DROP DATABASE IF EXISTS ledger_test CASCADE")
    (root / "b.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.json_rows(spark, str(root), columns).collect()


def test_manifests_join_the_chain(spark):
    schema = "s string, a long, z long, own string, prev string"
    there = spark.createDataFrame([("x", 0, 4, "h1", None), ("x", 5, 9, "h2", "h1")], schema)
    offered = spark.createDataFrame([("x", 0, 4, "h1", None), ("x", 10, 12, "h3", "h2"), ("x", 9, 12, "h4", "h2"), ("x", 10, 12, "h5", "h1"), ("y", 0, 1, "h6", None), ("y", 0, 1, "h7", "h0")], schema)
    got = {r.own: r.outcome for r in tables.offered_manifests(there, offered, "s", "a", "z", "own", "prev").collect()}
    assert got == {"h1": "duplicate", "h3": "committed", "h4": "overlap", "h5": "chain_mismatch", "h6": "committed", "h7": "chain_mismatch"}


def test_replay_digest_ignores_order_but_not_repeats(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    digest = lambda d: sorted(tuple(r) for r in tables.replay_digest(d, ["k"], F.col("v")).collect())
    assert digest(df) == digest(df.repartition(7).orderBy(F.desc("v")))
    assert digest(df) != digest(df.unionByName(df.limit(1))) and digest(df.filter("false")) == []


class Node(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self.answer({"/ok": 200, "/busy": 429, "/down": 503, "/moved": 302, "/long": 200}.get(self.path, 404), b"x" * (100 if self.path == "/long" else 3))

    def do_POST(self):
        self.answer(200, self.rfile.read(int(self.headers["Content-Length"])))

    def answer(self, status, body):
        self.send_response(status)
        self.send_header("Location", "/ok")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_polling(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Node)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        plan = [(k, "json_rpc", f"m{k}", base + path, body) for k, (path, body) in enumerate([("/ok", None), ("/busy", None), ("/down", None), ("/moved", None), ("/none", None), ("/long", None), ("/rpc", '{"a":1}')])]
        plan.append((7, "json_rpc", "m7", "http://127.0.0.1:1/", None))
        plan = spark.createDataFrame(plan, "position long, channel string, message_type string, url string, body string")
        assert normalize.split(plan, **polling.request_rules())[1].count() == 0
        due = polling.turns(spark.range(16).withColumnRenamed("id", "tick"), plan, 8)
        got = sorted((r.tick, r.status, r.body and bytes(r.body), r.fault) for r in polling.fetch(due, 50, 5).collect())
        once = [(200, b"xxx", None), (429, b"xxx", "retryable"), (503, b"xxx", "retryable"), (302, b"xxx", "permanent"), (404, b"xxx", "permanent"), (200, None, "too_large"), (200, b'{"a":1}', None), (None, None, "unreachable")]
        assert got == [(t, *once[t % 8]) for t in range(16)]
        assert polling.fetch(due.filter("false"), 50).count() == 0
    finally:
        server.shutdown()


def test_requests_are_safe(spark):
    rows = [("c", "m", "http://a.example/x"), ("c", "m", "ftp://a"), ("c", "m", "https://u:p@a/"), (" ", None, "https://a?x=@"), ("c", "m", None)]
    good, bad = normalize.split(spark.createDataFrame(rows, "channel string, message_type string, url string"), **polling.request_rules())
    assert good.count() == 1
    assert sorted(",".join(r.faults) for r in bad.select("faults").collect()) == ["channel,message_type", "credentials", "url", "url,credentials"]
