"""The stateful operators over the driver's events, one sequence a user, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming import folds, slots
from .driver_queries import query, table

_EV = "ev AS (SELECT user_id, event_id AS id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, id, event_type, value, and n, the number of the event among its user's."""
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), "event_type", "value")
    return e.withColumn("n", (F.row_number().over(Window.partitionBy("user_id").orderBy("id")) - 1).cast("long"))


def _before(back: int, column: str = "id") -> Column:
    return F.lag(column, back).over(Window.partitionBy("user_id").orderBy("id"))


def _name(c: Column) -> Column:
    return c.cast("string")


@query(f"""WITH {_EV}, t AS (SELECT *, event_type = 'error' AS up FROM ev WHERE event_type IN ('error', 'click')), m AS (SELECT *, coalesce(lag(up) OVER w, false) AS was FROM t WINDOW w AS (PARTITION BY user_id ORDER BY id)),
k AS (SELECT *, lag(id) OVER (PARTITION BY user_id ORDER BY id) AS before FROM m WHERE up <> was)
SELECT user_id, CASE WHEN up THEN id ELSE before END AS range_start, CASE WHEN NOT up THEN id END AS range_end, CASE WHEN up THEN 'known_incomplete' ELSE 'recovered' END AS completeness, id + 1 AS revision FROM k""")
def coverage_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Errors open gaps, clicks close them."""
    from ..operators.sequences import toggles

    e = _events(spark, sf).filter("event_type IN ('error', 'click')")
    rows = toggles(e, ["user_id"], "id", F.col("event_type") == "error")
    rows = rows.select("user_id", F.when(F.col("event_type") == "error", "open").otherwise("close").alias("action"), F.col("id").alias("at"), (F.col("id") + 1).alias("revision"), F.array(_name(F.col("id"))).alias("evidence"))
    return folds.fold_batch(rows, ["user_id"], "revision", folds.coverage_step, "user_id long, range_start long, range_end long, completeness string, revision long, evidence array<string>").drop("evidence")


@query(f"""WITH {_EV}, k AS (SELECT *, event_type = 'error' OR n % 5 = 4 AS degraded FROM ev), u AS (SELECT *, value > 40 AS above, lag(value > 40) OVER (PARTITION BY user_id ORDER BY id) AS was FROM k WHERE NOT degraded),
t AS (SELECT user_id, id, CASE WHEN above AND was THEN 'confirmed' WHEN above THEN 'triggered' WHEN was THEN CASE WHEN n % 3 = 0 THEN 'corrected' ELSE 'retracted' END ELSE 'below_threshold' END AS transition FROM u
UNION ALL SELECT user_id, id, 'degraded_source' FROM k WHERE degraded) SELECT user_id, id + 1 AS revision, transition, transition IN ('triggered', 'corrected', 'retracted') AS delivery FROM t""")
def alert_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """A quorum alert a user: errors have an unavailable source, every fifth snapshot is known to be incomplete."""
    down = F.col("event_type") == "error"
    sources = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    rows = _events(spark, sf).select(
        "user_id", (F.col("id") + 1).alias("revision"), F.col("id").alias("at"), F.col("value").alias("vbytes"), F.array(F.lit("a"), F.lit("b")).alias("eligible"), sources(down, "c").alias("unavailable"),
        (F.col("n") % 3 == 0).alias("correction"), F.when(down | (F.col("n") % 5 == 4), "known_incomplete").otherwise("complete").alias("completeness"),
    )
    step = folds.alert_step({"quorum": 2, "threshold": 40, "needed": 1, "cooldown": 0, "suppress": True})
    return folds.fold_batch(rows, ["user_id"], "revision", step, "user_id long, revision long, transition string, active boolean, delivery boolean").drop("active")


_ROLES = f"""WITH {_EV}, e AS (SELECT user_id, id::VARCHAR AS h, n, (n - 1) // 3 AS g, (n - 1) % 3 AS r, lag(id::VARCHAR) OVER w AS b1, lag(id::VARCHAR, 2) OVER w AS b2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY id)),
m AS (SELECT user_id, CASE WHEN n = 0 THEN 0 ELSE g END AS g, unnest(CASE WHEN n = 0 THEN [{{'k': 1, 'a': 'connect', 'h': h, 'd': 0}}] WHEN r = 0 THEN [{{'k': 2, 'a': 'connect', 'h': h, 'd': 1}}]
WHEN r = 1 THEN [{{'k': 3, 'a': 'disconnect', 'h': b1, 'd': 1}}, {{'k': 4, 'a': 'connect', 'h': h, 'd': 1}}]
ELSE [{{'k': 5, 'a': 'disconnect', 'h': b1, 'd': 1}}, {{'k': 6, 'a': 'connect', 'h': b2, 'd': 1}}, {{'k': 7, 'a': 'connect', 'h': h, 'd': 2}}] END) AS x FROM e)"""


def _fork_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A root, then threes of blocks: one, a heavier sibling, and a child of the first that outweighs it, on which the next stand."""
    r = (F.col("n") - 1) % 3
    e = _events(spark, sf).withColumn("p", F.when(r == 0, _before(1)).otherwise(_before(2)))
    return e.select("user_id", "n", _name(F.col("id")).alias("hash"), _name(F.col("p")).alias("parent"), F.when(F.col("n") == 0, 1).otherwise(r + 1).alias("work"))


@query(f"{_ROLES} SELECT user_id, 6 * g + x.k AS revision, x.a AS action, x.h AS hash, 2 * g + x.d AS height FROM m")
def fork_choice_moves(spark: SparkSession, sf: str) -> DataFrame:
    return folds.fold_batch(_fork_rows(spark, sf), ["user_id"], "n", folds.fork_choice_step, "user_id long, revision long, action string, hash string, height long")


@query(f"""WITH RECURSIVE {_EV}, e AS (SELECT user_id, n, lpad(id::VARCHAR, 12, '0') AS h, lag(lpad(id::VARCHAR, 12, '0'), 2) OVER w AS h2 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY id)),
live(user_id, n, base, now) AS (SELECT user_id, n, [h], [h] FROM e WHERE n = 0 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.n % 3 = 1 THEN l.now ELSE l.base END,
CASE e.n % 3 WHEN 1 THEN list_append(l.now, e.h) WHEN 2 THEN list_append(l.base, e.h) ELSE list_append(list_append(l.base, e.h2), e.h) END FROM live l JOIN e ON e.user_id = l.user_id AND e.n = l.n + 1)
SELECT user_id, n AS "offset", CASE WHEN n = 0 THEN 1 ELSE 6 * ((n - 1) // 3) + CASE n % 3 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 7 END END AS revision, sha256(array_to_string(list_transform(list_sort(now), lambda x: x || ':0=5;'), '')) AS state_hash,
CASE WHEN n = 0 OR n % 3 = 1 THEN 1 WHEN n % 3 = 2 THEN 2 ELSE 3 END::BIGINT AS events FROM live""")
def chain_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Fork choice and unspent outputs as one: each block makes one output."""
    pad = lambda c: F.lpad(c, 12, "0")
    rows = _fork_rows(spark, sf).withColumns({"hash": pad(F.col("hash")), "parent": pad(F.col("parent")), "offset": F.col("n")})
    rows = rows.withColumn("txs", F.array(F.struct(F.col("hash").alias("txid"), F.array().cast("array<string>").alias("inputs"), F.array(F.lit(5)).alias("outputs"))))
    out = folds.fold_batch(rows, ["user_id"], "n", folds.chain_step(), "user_id long, offset long, tip string, revision long, state_hash string, events long")
    return out.drop("tip")


@query(f"""WITH {_EV}, e AS (SELECT user_id, n, n % 4 AS r, id::VARCHAR AS h, lag(id::VARCHAR) OVER w AS b1, lag(id::VARCHAR, 2) OVER w AS b2, lag(id::VARCHAR, 3) OVER w AS b3 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY id)),
p AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN r = 0 THEN b1 WHEN r = 1 THEN b1 WHEN r = 2 THEN b2 ELSE b3 END AS parent FROM e),
x AS (SELECT user_id, n, unnest(CASE WHEN r = 2 THEN [{{'k': 0, 'event': 'creation_reverted', 'point': 's' || b1 || ':0'}}, {{'k': 1, 'event': 'spend_reverted', 'point': 'c' || b2 || ':0'}}, {{'k': 2, 'event': 'creation_reverted', 'point': 'c' || b1 || ':0'}}]
WHEN parent IS NULL THEN [{{'k': 0, 'event': 'created', 'point': 'c' || h || ':0'}}] ELSE [{{'k': 0, 'event': 'created', 'point': 'c' || h || ':0'}}, {{'k': 1, 'event': 'spent', 'point': 'c' || parent || ':0'}}, {{'k': 2, 'event': 'created', 'point': 's' || h || ':0'}}] END) AS z FROM p)
SELECT user_id, z.event AS event, z.point AS outpoint, count(*) AS times FROM x GROUP BY ALL""")
def unspent_events(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that each make an output and spend the one of their parent; every third of four takes its forerunner back."""
    r = F.col("n") % 4
    parent = F.when(F.col("n") == 0, None).when(r == 0, _before(1)).when(r == 1, _before(1)).when(r == 3, _before(3))
    e = _events(spark, sf).withColumns({"p": parent, "tip": _before(1)})
    made = F.struct(F.concat(F.lit("c"), _name(F.col("id"))).alias("txid"), F.array().cast("array<string>").alias("inputs"), F.array(F.lit(50)).alias("outputs"))
    moved = F.struct(F.concat(F.lit("s"), _name(F.col("id"))).alias("txid"), F.array(F.concat(F.lit("c"), _name(F.col("p")), F.lit(":0"))).alias("inputs"), F.array(F.lit(49)).alias("outputs"))
    rows = e.select(
        "user_id", "n", F.when(r == 2, "revert").otherwise("apply").alias("action"), _name(F.when(r == 2, F.col("tip")).otherwise(F.col("id"))).alias("hash"), _name(F.col("p")).alias("parent"),
        F.when(F.col("p").isNull(), F.array(made)).otherwise(F.array(made, moved)).alias("txs"),
    )
    out = folds.fold_batch(rows, ["user_id"], "n", folds.utxo_step, "user_id long, event string, outpoint string, by string")
    return out.groupBy("user_id", "event", "outpoint").agg(F.count(F.lit(1)).alias("times"))


@query(f"""WITH {_EV}, t AS (SELECT *, event_type = 'signup' AS up FROM ev WHERE event_type IN ('signup', 'error', 'purchase')), l AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY user_id ORDER BY id), false) AS was FROM t)
SELECT user_id, sum(up::INT) OVER (PARTITION BY user_id ORDER BY id)::BIGINT AS epoch, CASE WHEN up THEN 1 ELSE 2 END::BIGINT AS epoch_revision, CASE WHEN event_type = 'purchase' THEN 'reconciled' ELSE 'direct' END AS cause FROM l WHERE up <> was""")
def membership_changes(spark: SparkSession, sf: str) -> DataFrame:
    """One transaction a user: signups add it, errors remove it, purchases are snapshots without it."""
    e = _events(spark, sf).filter("event_type IN ('signup', 'error', 'purchase')")
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").otherwise("snapshot")
    rows = e.select("user_id", F.col("id").alias("sequence"), kind.alias("action"), F.lit("t").alias("txid"), F.array().cast("array<string>").alias("members"))
    return folds.fold_batch(rows, ["user_id"], "sequence", folds.membership_step, "user_id long, txid string, epoch long, epoch_revision long, cause string").drop("txid")


@query(f"""WITH {_EV}, e AS (SELECT user_id, n // 5 AS g, n % 5 AS r, id::VARCHAR AS h, lag(id::VARCHAR, 1) OVER w AS b1, lag(id::VARCHAR, 2) OVER w AS b2, lag(id::VARCHAR, 4) OVER w AS b4 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY id)),
m AS (SELECT user_id, g, unnest(CASE r WHEN 0 THEN [{{'k': 1, 'h': h, 'f': 'canonical_head'}}] WHEN 1 THEN [{{'k': 2, 'h': h, 'f': 'canonical_head'}}] WHEN 3 THEN [{{'k': 3, 'h': b2, 'f': 'reorged'}}, {{'k': 4, 'h': h, 'f': 'canonical_head'}}]
WHEN 4 THEN [{{'k': 5, 'h': b1, 'f': 'safe'}}, {{'k': 6, 'h': b4, 'f': 'finalized'}}] END) AS x FROM e WHERE r <> 2) SELECT user_id, 6 * g + x.k AS revision, x.h AS hash, x.f AS finality FROM m""")
def account_chain_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Fives of events: two commits, a replay of both, a reorg of the second, a checkpoint."""
    r = F.col("n") % 5
    one = lambda c: F.array(_name(c))
    e = _events(spark, sf).withColumns({f"b{k}": _before(k) for k in (1, 2, 3, 4)}).withColumn("base", F.when(F.col("n") >= 5, F.lag("id", 2).over(Window.partitionBy("user_id").orderBy("id"))))
    blocks = F.when(r == 2, F.array(_name(F.col("b2")), _name(F.col("b1")))).otherwise(one(F.col("id")))
    parent = F.when((r == 0) & (F.col("n") > 0), F.col("b2")).when(r == 1, F.col("b1")).when(r == 3, F.col("b3"))
    rows = e.select(
        "user_id", "n", F.when(r == 3, "reorg").when(r == 4, "checkpoint").otherwise("commit").alias("action"), blocks.alias("blocks"), _name(parent).alias("parent"), F.when(r == 3, one(F.col("b2"))).alias("old"),
        _name(F.col("b1")).alias("head"), _name(F.col("b1")).alias("safe"), _name(F.col("b4")).alias("finalized"),
    )
    return folds.fold_batch(rows, ["user_id"], "n", folds.canonical_step, "user_id long, revision long, hash string, finality string")


@query(f"""WITH {_EV}, e AS (SELECT user_id, n // 4 AS g, n % 4 AS r, lag(id, 1) OVER w AS b1, lag(id, 2) OVER w AS b2, lag(id, 3) OVER w AS b3 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY id))
SELECT user_id, 2 * g + CASE r WHEN 1 THEN 1 ELSE 2 END AS revision, (CASE r WHEN 1 THEN b1 ELSE b2 END)::VARCHAR AS fork, CASE r WHEN 1 THEN 'received' ELSE 'processed' END AS before, CASE r WHEN 1 THEN 'processed' ELSE 'confirmed' END AS after FROM e WHERE r IN (1, 2)""")
def slot_commitments(spark: SparkSession, sf: str) -> DataFrame:
    """Fours of events: a fork on the last one, two commitments, and the fork becomes the active tip."""
    r = F.col("n") % 4
    fork = F.when(r == 0, F.col("id")).when(r == 1, _before(1)).when(r == 2, _before(2)).otherwise(_before(3))
    e = _events(spark, sf)
    rows = e.select(
        "user_id", "n", F.when(r == 0, "slot").when(r == 3, "activate").otherwise("commitment").alias("action"), _name(fork).alias("fork"), F.col("n").alias("slot"), _name(F.when(F.col("n") > 0, _before(4))).alias("parent"),
        F.when(r == 1, "processed").when(r == 2, "confirmed").alias("status"),
    )
    return folds.fold_batch(rows, ["user_id"], "n", slots.slot_step, "user_id long, revision long, fork string, before string, after string")


@query(f"""WITH {_EV}, k AS (SELECT *, n % 6 AS r FROM ev) SELECT user_id, CASE r WHEN 2 THEN 'gap' ELSE 'reconciled' END AS event, CASE r WHEN 2 THEN n - 0 END AS expected, CASE r WHEN 2 THEN n + 100 ELSE n END AS sequence,
CASE r WHEN 2 THEN id ELSE lag(id) OVER (PARTITION BY user_id ORDER BY id) END AS gap_from, CASE r WHEN 4 THEN id END AS gap_until FROM k WHERE r IN (2, 4)""")
def feed_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Sixes of numbers: the third jumps, the fourth is a snapshot, the fifth aligns the feed anew."""
    r = F.col("n") % 6
    rows = _events(spark, sf).select("user_id", F.col("id").alias("at"), F.when(r == 3, "snapshot").otherwise("sequence").alias("action"), (F.col("n") + F.when(r == 2, 100).otherwise(0)).alias("sequence"))
    return folds.fold_batch(rows, ["user_id"], "at", folds.align_step, "user_id long, event string, expected long, sequence long, gap_from long, gap_until long")
