"""Reachability, shortest paths, cycles and strong components: set-at-a-time loops of joins and grouped minima.

Each level is one plan over all starts together, whose result is held (see scratch.Steps), so neither lineage nor the
driver grows with the depth. Paths are the least in (hops, ids), which makes results repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Steps

#: Levels that a reader of all of them unites one by one; more are drawn together.
MOST_PARTS = 16


def reachable(edges: DataFrame, starts: DataFrame, reverse: bool = False) -> DataFrame:
    """start, id, hops, path of all nodes that each start reaches over one edge or more; a start itself if on a cycle.

    reverse: over incoming edges; the path still runs in the direction of calls, and ends at the start.
    """
    near, far = ("target", "source") if reverse else ("source", "target")
    e = edges.select(F.col(near).alias("_from"), F.col(far).alias("_to")).distinct()
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path")).distinct()
    done, level, steps, every = None, 0, Steps(), Steps()
    while True:
        level += 1
        longer = F.concat(F.array("_to"), "path") if reverse else F.array_append("path", F.col("_to"))
        found = frontier.join(e, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("id"), longer.alias("path"))
        found = found.groupBy("start", "id").agg(F.min("path").alias("path"))
        if done is not None:
            found = found.join(done.select("start", "id"), ["start", "id"], "left_anti")
        found = steps.hold(found.select("start", "id", F.lit(level).alias("hops"), "path"))
        if not steps.rows:
            return found if done is None else done
        done = found if done is None else done.unionByName(found)
        if level % MOST_PARTS == 0:
            done = every.hold(done)
        frontier = found.where("start <> id").select("start", F.col("id").alias("node"), "path")


def reach_depths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, id, hops as reachable() has them, without the paths."""
    e = edges.select(F.col("source").alias("node"), F.col("target").alias("id")).distinct()
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    done, level, steps, every = None, 0, Steps(), Steps()
    while True:
        level += 1
        found = frontier.join(e, "node").select("start", "id").distinct()
        if done is not None:
            found = found.join(done, ["start", "id"], "left_anti")
        found = steps.hold(found.select("start", "id", F.lit(level).alias("hops")))
        if not steps.rows:
            return found if done is None else done
        done = found if done is None else done.unionByName(found)
        if level % MOST_PARTS == 0:
            done = every.hold(done)
        frontier = found.where("start <> id").select("start", F.col("id").alias("node"))


def shortest_paths(edges: DataFrame, starts: DataFrame, target: str | None = None) -> DataFrame:
    """start, id, distance, hops, path: the lowest sum of average latencies, summed from the start on; ties to fewer hops, then the lesser path.

    With a target, nodes farther than the best way to it are not followed.
    """
    e = edges.select(F.col("source").alias("_from"), F.col("target").alias("_to"), F.col("rolling_avg_latency_ms").alias("_w"))
    best = starts.select(F.col("id").alias("start"), "id", F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("h"), F.array("id").alias("p")).alias("b")).distinct()
    every, steps = Steps(), Steps()
    best = frontier = every.hold(best)
    while True:
        step = frontier.join(e, F.col("id") == F.col("_from")).select("start", F.col("_to").alias("id"), F.struct((F.col("b.d") + F.col("_w")).alias("d"), (F.col("b.h") + 1).alias("h"), F.array_append("b.p", F.col("_to")).alias("p")).alias("b"))
        step = step.groupBy("start", "id").agg(F.min("b").alias("new"))
        if target is not None:
            bound = best.where(F.col("id") == target).select("start", F.col("b.d").alias("_bound"))
            step = step.join(bound, "start", "left").where("_bound is null or new.d <= _bound").drop("_bound")
        better = steps.hold(step.join(best, ["start", "id"], "left").where("b is null or new < b").select("start", "id", F.col("new").alias("b")))
        if not steps.rows:
            return best.select("start", "id", F.col("b.d").alias("distance"), F.col("b.h").alias("hops"), F.col("b.p").alias("path"))
        best = every.hold(best.join(better, ["start", "id"], "left_anti").unionByName(better))
        frontier = better


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without incoming or outgoing edges are taken away again and again; no self-loops."""
    steps = Steps()
    core = steps.hold(edges.where("source <> target").select("source", "target").distinct())
    n = steps.rows
    while n:
        core = steps.hold(core.join(core.select(F.col("source").alias("target")).distinct(), "target", "left_semi").join(core.select(F.col("target").alias("source")).distinct(), "source", "left_semi"))
        n, before = steps.rows, n
        if n == before:
            break
    return core


def cycles(edges: DataFrame) -> DataFrame:
    """cycle: every elementary cycle once, closed, from its least node on; self-loops as [v, v].

    A cycle lies within one strong component, so edges between components go first. Then open paths grow by one edge a
    step, from each node over greater ones only; a step is held once, its closed paths are cycles, its open ones grow on.
    """
    found = edges.where("source = target").select(F.array("source", "target").alias("cycle")).distinct()
    core = cyclic_core(edges)
    part = strong_components(core, core.select(F.col("source").alias("id")).distinct())
    core = core.join(part.toDF("source", "cs"), "source").join(part.toDF("target", "ct"), "target").where("cs = ct").select("source", "target")
    steps = Steps()
    core = steps.hold(core)
    e = core.toDF("_from", "_to")
    open_ = core.where("target > source").select(F.col("source").alias("start"), F.col("target").alias("node"), F.array("source", "target").alias("path"))
    while steps.rows:
        step = open_.join(e, F.col("node") == F.col("_from")).where((F.col("_to") == F.col("start")) | ((F.col("_to") > F.col("start")) & ~F.array_contains("path", F.col("_to"))))
        step = steps.hold(step.select("start", F.col("_to").alias("node"), F.array_append("path", F.col("_to")).alias("path")))
        if not steps.rows:
            break
        found = found.unionByName(step.where("node = start").select(F.col("path").alias("cycle")))
        open_ = step.where("node <> start")
    return found


def ordered_cycles(found: DataFrame) -> DataFrame:
    return found.orderBy(F.size("cycle"), "cycle")


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, component (the least id of its strongly connected component), by forward and backward colouring of the cyclic core."""
    left = cyclic_core(edges)
    done, steps = None, Steps()
    while not left.isEmpty():
        members = left.select(F.col("source").alias("id")).union(left.select("target")).distinct()
        colour = _least(left, members.select("id", F.col("id").alias("c")))
        # within a colour, what reaches the colour's own node is its component
        same = left.join(colour.toDF("source", "cs"), "source").join(colour.toDF("target", "ct"), "target").where("cs = ct").select(F.col("target").alias("source"), F.col("source").alias("target"))
        back = _spread(same, colour.where("id = c"))
        done = steps.hold(back if done is None else done.unionByName(back))
        rest = left.join(back.select(F.col("id").alias("source")), "source", "left_anti").join(back.select(F.col("id").alias("target")), "target", "left_anti")
        left = cyclic_core(rest)
    alone = nodes.select("id", F.col("id").alias("component"))
    return alone if done is None else alone.join(done, "id", "left").select("id", F.coalesce("c", "component").alias("component"))


def _least(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """The least colour that reaches each node along the edges."""
    steps = Steps()
    while True:
        came = edges.join(colour.toDF("source", "c"), "source").groupBy(F.col("target").alias("id")).agg(F.min("c").alias("n"))
        new = steps.hold(colour.join(came, "id", "left").select("id", F.least("c", "n").alias("c"), F.coalesce(F.col("n") < F.col("c"), F.lit(False)).alias("moved")), "moved")
        colour = new.select("id", "c")
        if not steps.flagged:
            return colour


def _spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, c of all nodes that the seeds (id, c) reach along the edges, themselves included."""
    steps, every = Steps(), Steps()
    done = frontier = every.hold(seeds.select("id", "c"))
    while True:
        found = edges.join(frontier.toDF("source", "c"), "source").select(F.col("target").alias("id"), "c").distinct()
        frontier = steps.hold(found.join(done, "id", "left_anti"))
        if not steps.rows:
            return done
        done = every.hold(done.unionByName(frontier))


def hop_histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("start", "hops").agg(F.count(F.lit(1)).alias("n"))

