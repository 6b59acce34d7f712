"""LOG-11: jobs on a cycle of nested jobs, without the transitive closure.

A job is on a cycle if its strongly connected component has another job, or if
it runs itself.  Every step works on the edges that are left, which only get
fewer:

* trim: an edge out of a job that nothing leads into, or into a job that leads
  nowhere, is on no cycle;
* contract: a job with one way in and one way out stands for the edge between
  its neighbours; an independent set of such jobs (picked by a hash) is taken out
  at once, so a chain or a long cycle shrinks by a constant factor a round;
* colour: what is left is coloured by the greatest job that reaches each job; the
  jobs of a colour that reach its greatest job are one component and go.

Contracted jobs are put back in reverse order: a job between two neighbours of
one component belongs to it.  Rounds are logarithmic for chains, cycles and the
trees that hang on them, and otherwise bounded by the longest path of what is
left; work is linear in the edges of a round.  Rounds are written and read
again, and only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.session import cut


def trim(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` without those whose start has no way in or whose end has no way out."""
    return edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")


def contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The edges without an independent set of pass-through jobs, and these as ``v, u, w`` (between u and w)."""
    into = edges.groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("u")).filter("n = 1")
    out = edges.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("w")).filter("n = 1")
    through = into.drop("n").join(out.drop("n"), "v")
    picked = through.filter(F.xxhash64("v", F.lit(turn)).bitwiseAND(F.lit(1)) == 1)
    # of two neighbours that are both picked, the one behind stays
    taken = cut(picked.join(picked.select(F.col("v").alias("u")), "u", "left_anti").select("v", "u", "w"))
    gone = taken.select(F.col("v").alias("x"))
    kept = edges.join(gone.withColumnRenamed("x", "a"), "a", "left_anti").join(gone.withColumnRenamed("x", "b"), "b", "left_anti").select("a", "b")
    return cut(kept.union(taken.select("u", "w")).distinct()), taken


def _spread(edges: DataFrame, state: DataFrame) -> DataFrame:
    """Colours ``node, colour`` once every job has the greatest colour that reaches it."""
    while True:
        sent = edges.join(state.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("more"))
        after = cut(state.join(sent, "node", "left").select("node", F.greatest("colour", F.coalesce("more", "colour")).alias("colour"), (F.col("more") > F.col("colour")).alias("moved")))
        moved = not after.filter("moved").isEmpty()
        state = after.select("node", "colour")
        if not moved:
            return state


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of the jobs on cycles among ``edges`` (no loops of one job)."""
    labels = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        colours = cut(_spread(edges, nodes.select("node", F.col("node").alias("colour"))))
        near = cut(edges.join(colours.toDF("a", "c"), "a").join(colours.toDF("b", "d"), "b").filter("c = d").select("a", "b", "c"))
        found = colours.filter("node = colour")
        while True:  # backwards from the greatest job of each colour
            more = near.join(found.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), F.col("c").alias("colour")).distinct()
            more = cut(more.join(found, "node", "left_anti"))
            if more.isEmpty():
                break
            found = cut(found.union(more))
        labels = found if labels is None else labels.union(found)
        gone = found.select(F.col("node").alias("x"))
        left = edges.join(gone.withColumnRenamed("x", "a"), "a", "left_anti").join(gone.withColumnRenamed("x", "b"), "b", "left_anti")
        edges = cut(trim(left.select("a", "b")))
    return labels


def find_cycles(edges: DataFrame) -> DataFrame:
    """``job_id`` of the jobs that reach themselves through the edges ``job_id, child_id``."""
    given = cut(edges.select(F.col("job_id").alias("a"), F.col("child_id").alias("b")).dropna().distinct())
    own = given.filter("a = b").select(F.col("a").alias("node"))
    left, contracted, turn = given.filter("a <> b"), [], 0
    size = left.count()
    while size:
        turn += 1
        fewer, taken = contract(cut(trim(left)), turn)
        contracted.append(taken)
        loops = fewer.filter("a = b")  # a cycle that has shrunk to one job
        own = cut(own.union(loops.select("a")))
        left = cut(fewer.filter("a <> b"))
        size, before = left.count(), size
        if size > 0.999 * before:
            break
    kind = given.schema["a"].dataType.simpleString()
    labels = components(left) if size else None
    labels = edges.sparkSession.createDataFrame([], f"node {kind}, colour {kind}") if labels is None else labels
    for taken in reversed(contracted):
        ends = taken.join(labels.toDF("u", "lu"), "u", "left").join(labels.toDF("w", "lw"), "w", "left")
        same = (F.col("u") == F.col("w")) | (F.col("lu") == F.col("lw"))
        back = ends.filter(same).select(F.col("v").alias("node"), F.coalesce("lu", "u").alias("colour"))
        # a job that its own shrunken cycle leads back to is labelled from then on
        anchors = ends.filter("u = w AND lu IS NULL").select(F.col("u").alias("node"), F.col("u").alias("colour")).distinct()
        labels = cut(labels.union(anchors).union(back))
    several = labels.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("colour")
    on = labels.join(several, "colour", "left_semi").select("node").union(own)
    return on.select(F.col("node").alias("job_id")).distinct()
