"""Answers of the service, capture, the way to the archive, and sequences of sessions that are cut into parts."""

import random

import pytest

from ledgerloom.operators import sequences, serving
from ledgerloom.sources import capture


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_parts_of_a_session_change_nothing(spark, width):
    chance = random.Random(3)
    rows = [(k, n) for k in ("a", "b", None) for n in chance.sample(range(300), 90)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(5)
    def highest(df, keys, order, width):
        return sequences.regressions(df.withColumn("v", df.n * 37 % 101), keys, order, "v", width)

    for f in (sequences.collector_sequence, sequences.gaps, highest):
        whole, parts = (sorted(map(str, f(df, ["k"], "n", w).collect())) for w in (None, width))
        assert whole == parts
    twice = df.unionByName(df)
    assert sorted(map(str, sequences.gaps(twice, ["k"], "n", width).collect())) == sorted(map(str, sequences.gaps(df, ["k"], "n").collect()))
    assert sequences.gaps(df.limit(0), ["k"], "n", width).count() == 0


EVM = "source_ids array<string>, revision long, canonicality string, finality string, completeness string, full_history boolean, archive_state boolean, traces boolean, as_of_unix_ns long"


def test_truth_of_account_chains(spark):
    row = lambda *status, sources=("b", "a", "b"), revision=1: (list(sources), revision, *status, "complete", True, False, False, 5)
    df = spark.createDataFrame([row("canonical", "safe"), row("canonical", "fast_finalized"), row("non_canonical", "safe"), row("candidate", "pending", sources=()), row("candidate", "pending", sources=["é"]), row(None, "safe")], EVM)
    good, bad = serving.envelopes(df, "ethereum")
    (told,) = good.select("truth.*").collect()
    assert told.asDict(True) == {
        "chain_id": 1, "network": "ethereum-mainnet", "source_ids": ["a", "b"], "revision": 1, "canonicality": "canonical", "finality": "safe", "completeness": "complete",
        "coverage": {"full_history": True, "archive_state": False, "traces": False}, "as_of_unix_ns": 5,
    }
    assert sorted(map(tuple, (r.faults for r in bad.collect()))) == [("source_identity",), ("sources",), ("status",), ("status",), ("status",)]
    assert [r.truth.finality for r in serving.envelopes(df, "bsc")[0].collect()] == ["fast_finalized"]


SNAPSHOT = "r string, position long, network string, revision long, observed_at long, fee_rate long, vbytes long, quorum long, eligible array<string>, unavailable array<string>, completeness string, cause string"


def test_previews_are_answered_in_whole(spark):
    snap = lambda r, p, revision, vbytes, at=None, cause="observed": (r, p, "main", revision, revision if at is None else at, 1, vbytes, 1, ["a"], [], "complete", cause)
    rows = [snap("good", 0, 1, 50), snap("good", 1, 2, 200), snap("good", 2, 2, 200), snap("good", 3, 3, 10, cause="correction")]
    rows += [snap("back", 0, 5, 50), snap("back", 1, 4, 50), snap("none", 0, 1, 1), snap("time", 0, 1, 1, at=-1), snap("rule", 0, 1, 1)]
    rows += [snap("many", k, k + 1, 1) for k in range(serving.MOST_SNAPSHOTS + 1)] + [snap("most", k, k + 1, 1) for k in range(serving.MOST_SNAPSHOTS)]
    rule = lambda r, quorum=1: (r, "a", 1, 100, quorum, 1, 0, True)
    d = spark.createDataFrame([*map(rule, ("good", "back", "time", "many", "most")), rule("rule", 0)], "r string, alert_id string, fee_rate long, threshold long, quorum long, for_evaluations long, cooldown long, suppress boolean")
    got = serving.preview(spark.createDataFrame(rows, SNAPSHOT), d, "r").collect()
    assert sorted((r.revision, r.transition, r.final_active) for r in got if r.r == "good") == [(1, "below_threshold", False), (2, "duplicate_revision", False), (2, "triggered", False), (3, "corrected", False)]
    assert {r.r: r.fault for r in got if r.fault} == {"back": "revision or time went back", "none": "definition", "rule": "definition", "time": "snapshot", "many": "too_many_snapshots"}
    assert sum(r.r == "most" for r in got) == serving.MOST_SNAPSHOTS and sum(r.r == "many" for r in got) == 1


def test_readiness_needs_stores_and_both_checkpoints(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "source_id string, source_session_id string")
    c = spark.createDataFrame([("broker", "a", "1"), ("archive", "a", "1"), ("broker", "b", "1"), ("archive", "b", "2"), (None, "b", "2")], "kind string, source_id string, source_session_id string")
    assert sorted(tuple(r) for r in serving.readiness(s, c, facts=True).select("source_id", "source_session_id", "ready").collect()) == [("a", "1", True), ("b", "1", False), ("b", "2", False)]
    assert not serving.readiness(s, c, facts=True, broker=False).filter("ready").count()


def observations(spark, *numbers, source="s", mark=b"m"):
    rows = [(source, b"z" * 16, n, mark + str(n).encode(), b"p") for n in numbers]
    return spark.createDataFrame(rows, "source_id string, source_session_id binary, collector_sequence long, observation_id binary, payload binary")


def test_archive_goes_step_by_step(spark, tmp_path):
    root, sent = str(tmp_path), []
    run = lambda name, df: capture.publish_and_archive(df, name, root, lambda records: sent.append(records.count()))
    schema = observations(spark, 0).schema
    run("0", observations(spark, 0, 1, 2).unionByName(observations(spark, 7, 8, source="t")))
    run("1", observations(spark, 0, 1, 2))
    run("0", observations(spark, 0, 1, 2).unionByName(observations(spark, 7, 8, source="t")))  # as after a loss before its checkpoint
    assert capture.archived(spark, root, schema).count() == 5
    with pytest.raises(ValueError, match="gap or repeat"):
        run("2", observations(spark, 3, 5))
    for numbers, mark in (((2, 3), b"m"), ((5, 6), b"m"), ((0, 1, 2), b"other")):
        with pytest.raises(ValueError, match="overlaps"):
            run("3", observations(spark, *numbers, mark=mark))

    def fails(records):
        raise RuntimeError("no broker")

    with pytest.raises(RuntimeError):
        capture.publish_and_archive(observations(spark, 3, 4), "4", root, fails)
    assert capture.manifests(spark, root).count() == 2
    observations(spark, 3).write.parquet(f"{root}/objects/batch=5")  # staged by a batch that stopped before its manifest
    assert capture.archived(spark, root, schema).count() == 5
    run("5", observations(spark, 3, 4))
    assert sorted(r[0] for r in capture.archived(spark, root, schema).filter("source_id = 's'").select("collector_sequence").collect()) == [0, 1, 2, 3, 4]
    first, second = capture.manifests(spark, root).filter("source_id = 's'").orderBy("first_collector_sequence").collect()
    assert first.previous_manifest_hash is None and second.previous_manifest_hash == first.manifest_hash
    at = {(r.consumer, r.source_id): r.last_collector_sequence for r in capture.checkpoints(spark, root).collect()}
    assert at == {("broker", "s"): 6, ("archive", "s"): 4, ("broker", "t"): 8, ("archive", "t"): 8}


def test_capture_numbers_only_what_it_takes(spark):
    m = spark.createDataFrame(
        [("s", b"z" * 16, "c", "main", ch, "t", p, cur, n) for n, (ch, p, cur) in enumerate([("rpc", b"a", None), ("x", b"toolong", None), ("x", b"b", b"y" * 1025), ("x", None, None), ("x", b"", b"y" * 1024)])]
        + [("s", b"short", "c", "main", "x", "t", b"a", None, 9)],
        "source_id string, source_session_id binary, chain string, network string, channel string, source_message_type string, payload binary, source_cursor binary, arrival long",
    )
    taken = spark.createDataFrame([("s", b"z" * 16, 40)], "source_id string, source_session_id binary, next long")
    good, bad = capture.captured(m, taken, "arrival", 2, 4)
    assert [(r.collector_sequence, bytes(r.payload), r.quality_flags, len(r.observation_id)) for r in good.orderBy("collector_sequence").collect()] == [(40, b"a", ["recovered_by_rpc"], 32), (41, b"", [], 32)]
    assert sorted(r.faults[0] for r in bad.collect()) == ["cursor_too_large", "payload_too_large", "payload_too_large", "session"]
