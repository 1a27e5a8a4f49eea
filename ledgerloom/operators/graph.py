"""Paths, roots and components, by pointer doubling and star contraction, a logarithmic number of joins; marks above and below by ranges of nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut


def paths_to_root(nodes: DataFrame, node: str, parent: str, weight: str | None = None, limit: int = 64) -> DataFrame:
    """node, root, depth, work: the last node reached over parents, the steps to it, and the sum of weights on the path,
    both ends included.

    A parent that is null, the node itself or unknown ends the path. Each round doubles the distance, so a chain of n
    blocks takes log2(n) joins; a cycle never ends and raises an error.
    """
    w = F.col(weight).cast("decimal(38,0)") if weight else F.lit(1).cast("decimal(38,0)")
    known = nodes.select(F.col(node).alias("_known"))
    jump = nodes.select(F.col(node).alias("node"), F.col(parent).alias("p"), w.alias("own")).join(known, F.col("p") == F.col("_known"), "left")
    jump = cut(jump.select("node", F.when(F.col("_known") != F.col("node"), F.col("_known")).alias("next"), F.col("own").alias("work")).select("node", "next", "work", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.when(F.col("next").isNull(), F.col("node")).alias("root")))
    for _ in range(limit):
        if jump.filter("next IS NOT NULL").isEmpty():
            return jump.select("node", "root", "depth", F.col("work").cast("long").alias("work"))
        b = jump.select(F.col("node").alias("_at"), F.col("next").alias("_next"), F.col("work").alias("_work"), F.col("depth").alias("_depth"), F.col("root").alias("_root"))
        far = jump.join(b, F.col("next") == F.col("_at"), "left")
        there = F.col("next").isNotNull()
        jump = cut(far.select("node", F.when(there, F.col("_next")).alias("next"), (F.col("work") + F.when(there, F.col("_work")).otherwise(0)).cast("decimal(38,0)").alias("work"), (F.col("depth") + F.when(there, F.col("_depth")).otherwise(0)).alias("depth"), F.coalesce("root", "_root").alias("root")))
    raise ValueError("parents form a cycle")


def ancestors(nodes: DataFrame, node: str, parent: str, limit: int = 64) -> DataFrame:
    """(node, ancestor, steps) for every proper ancestor; the closure itself doubles each round."""
    step = nodes.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).filter("ancestor IS NOT NULL AND ancestor != node")
    step = step.join(nodes.select(F.col(node).alias("ancestor")), "ancestor", "left_semi").select("node", "ancestor", F.lit(1).cast("long").alias("steps"))
    closure, reach = cut(step), 1
    for _ in range(limit):
        edge = closure.filter(F.col("steps") == reach).select(F.col("node").alias("_n"), F.col("ancestor").alias("_mid"))
        more = cut(edge.join(closure.select(F.col("node").alias("_mid"), "ancestor", "steps"), "_mid").select(F.col("_n").alias("node"), "ancestor", (F.col("steps") + reach).alias("steps")))
        if more.isEmpty():
            return closure
        closure, reach = closure.unionByName(more), 2 * reach
    raise ValueError("parents form a cycle")


def descendants(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, descendants, for nodes with any: doubled pointers carry sums upward, and no pairs are made.

    A round adds to each node's count the counts of the nodes whose jump ends there, then doubles the jumps.
    """
    jump = cut(_jumps(nodes, node, parent))
    count = cut(jump.select("node", F.lit(1).cast("long").alias("n")))
    limit = jump.count().bit_length() + 1
    for _ in range(limit):
        if jump.filter("next IS NOT NULL").isEmpty():
            return count.filter("n > 1").select("node", (F.col("n") - 1).alias("descendants"))
        given = jump.filter("next IS NOT NULL").join(count, "node").groupBy(F.col("next").alias("node")).agg(F.sum("n").alias("more"))
        count = cut(count.join(given, "node", "left").select("node", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        step = jump.select(F.col("node").alias("_at"), F.col("next").alias("_next"))
        jump = cut(jump.join(step, F.col("next") == F.col("_at"), "left").select("node", F.col("_next").alias("next")))
    raise ValueError("parents form a cycle")


def _jumps(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, next: the parent; null where it is null, the node itself or unknown."""
    known = nodes.select(F.col(node).alias("_known"))
    at = nodes.select(F.col(node).alias("node"), F.col(parent).alias("p")).join(known, F.col("p") == F.col("_known"), "left")
    return at.select("node", F.when(F.col("_known") != F.col("node"), F.col("_known")).alias("next"))


#: Nodes that one task resolves in memory.
PART = 1 << 19


def above(nodes: DataFrame, node: str, parent: str, tips: DataFrame) -> DataFrame:
    """node: the tips (one column) that are nodes, and every ancestor of one; unlike `ancestors` no pairs are made."""
    return _marked(_with_marks(nodes, node, parent, tips), down=False).filter("hit").select("node").distinct()


def below(nodes: DataFrame, node: str, parent: str, roots: DataFrame) -> DataFrame:
    """node: the roots (one column) that are nodes, and every descendant of one."""
    return _marked(_with_marks(nodes, node, parent, roots), down=True).filter("hit").select("node")


def _with_marks(nodes: DataFrame, node: str, parent: str, marks: DataFrame) -> DataFrame:
    """node, next (null for a node that is its own parent), hit."""
    kind = nodes.schema[node].dataType
    at = nodes.select(F.col(node).alias("node"), F.when(F.col(parent) != F.col(node), F.col(parent)).cast(kind).alias("next"))
    met = at.join(marks.toDF("_mark").distinct(), F.col("node") == F.col("_mark"), "left")
    return met.select("node", "next", F.col("_mark").isNotNull().alias("hit"))


def _marked(marks: DataFrame, down: bool) -> DataFrame:
    """node, hit: whether a node or an ancestor of it (down), or a descendant of it (else), is marked.

    Nodes are dealt by ranges, and each task follows its own as far as they go. What is left are the nodes that others
    outside their range stand on: these make a smaller tree, which is marked alike, and its marks go back into the ranges.
    So nodes cross the network a few times, not once a doubling. Where ranges hold no paths (most nodes are such nodes), or
    a node has several parents, pointers are doubled over all nodes instead.
    """
    marks = cut(marks)
    n = marks.count()
    parts = max(-(-n // PART), 1)
    kind = marks.schema["node"].dataType.simpleString()
    schema = f"node {kind}, next {kind}, exit {kind}, hit boolean, part int, twice boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        own, following, hit = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
        at = pc.fill_null(pc.index_in(following, value_set=own, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
        here, hit = np.arange(len(own)), hit.to_numpy(zero_copy_only=False).copy()
        ends = at < 0
        jump = np.where(ends, here, at)
        for _ in range(len(own).bit_length() + 1):
            if down:
                hit |= hit[jump]
            else:
                hit[jump[hit]] = True
            further = jump[jump]
            if (further == jump).all():
                break
            jump = further
        exits = following.take(pa.array(np.where(ends[jump], jump, here)))  # a node on a cycle keeps its own parent
        part, twice = np.full(len(own), TaskContext.get().partitionId(), np.int32), np.full(len(own), len(own.unique()) < len(own))
        for first in range(0, len(own), 65_536):
            yield pa.RecordBatch.from_arrays([c[first : first + 65_536] for c in (own, following, exits, pa.array(hit), pa.array(part), pa.array(twice))], ["node", "next", "exit", "hit", "part", "twice"])

    dealt = marks.repartitionByRange(parts, "node") if parts > 1 else marks.coalesce(1)
    told = cut(dealt.mapInArrow(run, schema))
    given = told.filter("exit IS NOT NULL").groupBy(F.col("exit").alias("_exit")).agg(F.bool_or("hit").alias("_given"))
    ports = cut(told.join(given, F.col("node") == F.col("_exit")).select("node", F.col("exit").alias("next"), F.col("hit" if down else "_given").alias("hit")))
    left = ports.count()
    if left > n // 2 or not told.filter("twice").isEmpty():
        return _doubled(marks, down)
    if not left:
        return told.select("node", "hit")
    if parts == 1:
        raise ValueError("parents form a cycle")
    found = _marked(ports, down).filter("hit").select(F.col("node").alias("_port"))
    more = F.col("hit") | F.col("_port").isNotNull()
    if down:
        return told.join(found, F.col("exit") == F.col("_port"), "left").select("node", more.alias("hit"))
    met = told.join(found, F.col("node") == F.col("_port"), "left").select("node", "next", more.alias("hit"), "part")
    return met.repartition(parts, "part").select("node", "next", "hit").mapInArrow(run, schema).select("node", "hit")


def _doubled(marks: DataFrame, down: bool) -> DataFrame:
    """The same by pointer doubling: log2(depth) joins of all nodes."""
    jump = cut(_jumps(marks, "node", "next").join(marks.select(F.col("node").alias("_node"), "hit").filter("hit").distinct(), F.col("node") == F.col("_node"), "left").select("node", "next", F.col("_node").isNotNull().alias("hit")))
    limit = jump.count().bit_length() + 1
    found = None if down else cut(jump.filter("hit").select("node").distinct())
    for _ in range(limit):
        if jump.filter("next IS NOT NULL").isEmpty():
            return jump.select("node", "hit") if down else found.select("node", F.lit(True).alias("hit"))
        if not down:
            new = found.join(jump.filter("next IS NOT NULL"), "node").select(F.col("next").alias("node")).distinct().join(found, "node", "left_anti")
            found = cut(found.unionByName(new))
        step = jump.select(F.col("node").alias("_at"), F.col("next").alias("_next"), F.col("hit").alias("_hit"))
        far = jump.join(step, F.col("next") == F.col("_at"), "left")
        jump = cut(far.select("node", F.col("_next").alias("next"), (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit")))
    raise ValueError("parents form a cycle")


def path_moves(nodes: DataFrame, node: str, parent: str, old, new) -> DataFrame:
    """action (disconnect or connect) and node: what leaves and what enters the chain when its tip moves from old to new.

    Only the two paths are walked, each by doubling; a caller that applies them takes disconnects from the old tip down
    and connects up to the new one, in the order of heights.
    """
    one = lambda tip: nodes.filter(F.col(node) == F.lit(tip)).select(node)
    a, b = above(nodes, node, parent, one(old)), above(nodes, node, parent, one(new))
    off = a.join(b, "node", "left_anti").select(F.lit("disconnect").alias("action"), "node")
    return off.unionByName(b.join(a, "node", "left_anti").select(F.lit("connect").alias("action"), "node"))


def ancestor_at(nodes: DataFrame, node: str, parent: str, height: int) -> DataFrame:
    """node, ancestor: of every node at least so high, its ancestor (or itself) at that height over its root.

    Distances double: a node jumps while the jump does not pass the height, so the work is log2(depth) joins.
    """
    depth = paths_to_root(nodes, node, parent).select("node", "depth")
    jump, jumps, most = cut(_jumps(nodes, node, parent)), [], depth.agg(F.max("depth")).first()[0] or 0
    while 1 << len(jumps) <= most:
        jumps.append(jump)
        step = jump.select(F.col("node").alias("_at"), F.col("next").alias("_next"))
        jump = cut(jump.join(step, F.col("next") == F.col("_at"), "left").select("node", F.col("_next").alias("next")))
    at = cut(depth.filter(F.col("depth") >= height).select("node", F.col("node").alias("ancestor"), (F.col("depth") - height).alias("left")))
    for k in reversed(range(len(jumps))):
        step = jumps[k].select(F.col("node").alias("_at"), F.col("next").alias("_next"))
        far = F.col("left") >= (1 << k)
        met = at.join(step, F.col("ancestor") == F.col("_at"), "left")
        at = cut(met.select("node", F.when(far, F.col("_next")).otherwise(F.col("ancestor")).alias("ancestor"), F.when(far, F.col("left") - (1 << k)).otherwise(F.col("left")).alias("left")))
    return at.select("node", "ancestor")


def lineage(roots: DataFrame, nodes: DataFrame, edges: DataFrame, *, max_depth: int, max_nodes: int) -> DataFrame:
    """root, nodes, depth, fault: how far each fact (`root`) leads back to observations, within bounds.

    nodes has node and observed, edges node and parent. One join a step of depth, so at most max_depth joins; a root that
    passes a bound, meets an unknown node or ends in something that is no observation has the name of that as its fault.
    """
    seen = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).cast("long").alias("depth")))
    front, known = seen, nodes.select("node", "observed", F.lit(True).alias("_known"))
    passed = None
    for depth in range(1, max_depth + 2):
        step = front.select("root", "node").join(edges, "node").select("root", F.col("parent").alias("node")).distinct()
        front = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).cast("long").alias("depth")))
        if depth > max_depth:
            passed = front.select("root", F.lit(True).alias("_deep")).distinct()
            break
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    ends = seen.join(known, "node", "left").join(edges.select("node", F.lit(True).alias("_on")).distinct(), "node", "left")
    told = ends.groupBy("root").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), F.count_if(F.col("_known").isNull()).alias("_unknown"), F.count_if(F.col("observed")).alias("_observed"),
        F.count_if(~F.coalesce("observed", F.lit(False)) & F.col("_on").isNull()).alias("_loose"),
    )
    told = told.join(passed, "root", "left") if passed is not None else told.withColumn("_deep", F.lit(None).cast("boolean"))
    fault = F.when(F.col("_unknown") > 0, "unknown_node").when(F.col("_deep"), "too_deep").when(F.col("nodes") > max_nodes, "too_many_nodes").when((F.col("_loose") > 0) | (F.col("_observed") == 0), "no_observation")
    return told.select("root", "nodes", "depth", fault.alias("fault"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for every node of the undirected edges (a, b).

    Alternating large-star and small-star contractions; each round is cut off in the shared folder.
    """

    def sums(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).withColumn("m", F.least("c", "m"))
        met = both.join(least, F.col("a") == F.col("c"))
        if large:
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    had = sums(e)
    while had[0]:
        e = cut(star(star(e, True), False))
        now = sums(e)
        if now == had:
            break
        had = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def packages(nodes: DataFrame, node: str, edges: DataFrame, fee: str, size: str) -> DataFrame:
    """root, members, total_fee, total_vsize, fee_rate of each component of present nodes; single nodes are their own."""
    roots = components(edges)
    each = nodes.join(roots, F.col(node) == F.col("node"), "left").withColumn("root", F.coalesce("root", F.col(node)))
    return each.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum(fee).cast("long").alias("total_fee"), F.sum(size).cast("long").alias("total_vsize")).withColumn("fee_rate", F.expr("total_fee div total_vsize"))
