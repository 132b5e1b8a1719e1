"""Chains through ordered groups, by pointer doubling: what a fold does whose next step is known for every row.

Greedy packing, and gates that compare a row with the last one kept, both follow a chain: from each row one can say which row comes next *if*
this one begins a chunk, or is kept. All these pointers are found at once, and the chain from a group's first row is followed in
doubling jumps, a logarithm of its length in rounds of joins. Nothing here needs the rows of a group in one task: places are those of
a range sort, sums are carried from task to task, pointers are searched among neighbours in value, and joins have unique keys.

Groups of up to SMALL rows are walked in one expression each instead: their rows as an array, folded in the JVM.

A group is named by a struct of its value, so that null is a group like others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.text import bound
from framelake.shared import kept

TASK_BITS = 33
#: How many times the width of a search fits into one range of values.
RANGE_WIDTHS = 64
#: Rows under one node of the tree of extremes.
FAN = 64
#: Most rows of a group that is walked as an array.
SMALL = 1024


def by_size(rows: DataFrame, group: str, walk: Callable[[DataFrame], DataFrame], follow: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """walk(rows) of the groups that are small, and follow(rows) of the others."""
    most = SMALL if most is None else most
    counts = rows.groupBy(F.col(group).alias("large")).agg(F.count("*").alias("many"))
    largest = counts.agg(F.max("many")).first()[0] or 0
    if largest <= most:
        return walk(rows)
    large = kept(counts.where(F.col("many") > most).select("large"))
    mine = rows[group].eqNullSafe(large["large"])
    return walk(rows.join(large, mine, "left_anti")).unionByName(follow(rows.join(large, mine, "left_semi")))


def walked(rows: DataFrame, group: str, order: list[str], begin: Column, step: Callable[[Column, Column], Column], made: str) -> DataFrame:
    """rows, and `made`: what step(state, row) gives as `made` of the next state, a struct like begin, going through a group in order."""
    others = [c for c in rows.columns if c != group]
    arrays = rows.groupBy(F.struct(F.col(group)).alias("g")).agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in others if c not in order)))).alias("rows"))
    start = F.struct(begin.alias("now"), F.expr("cast(array() as array<int>)").alias("out"))
    merge = lambda acc, row: bound(step(acc["now"], row), lambda now: F.struct(now.alias("now"), F.array_append(acc["out"], now[made]).alias("out")))
    done = arrays.select("g", "rows", F.aggregate("rows", start, merge, lambda acc: acc["out"]).alias("out"))
    return done.select("g", F.explode(F.arrays_zip("rows", "out")).alias("z")).select("g.*", "z.rows.*", F.col("z.out").alias(made)).select(*rows.columns, made)


def placed(rows: DataFrame, group: str, order: list[str], cost: str | None = None) -> DataFrame:
    """g, the group's struct, row, the columns of rows, pos, the place in the group's order from 0, n, the group's rows, and, if a cost is named, upto, its
    sum up to this row.

    Rows that tie in `order` stand as they were read.
    """
    keys = [F.col("row")[c] for c in (group, *order)]
    ranged = rows.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_no")).repartitionByRange(*keys, "row_no").sortWithinPartitions(*keys, "row_no")
    stood = kept(ranged.select(F.struct(F.col("row")[group]).alias("g"), "row", F.monotonically_increasing_id().alias("place")).withColumn("task", F.shiftright("place", TASK_BITS)))
    spans = stood.groupBy("g", "task").agg(F.min("place").alias("begin"), F.count("*").alias("here"), *([F.sum(F.col("row")[cost]).alias("cost_here")] if cost else []))
    earlier = Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    carried = spans.select("g", "task", "begin", before("here").alias("before"), F.sum("here").over(Window.partitionBy("g")).alias("n"), *([before("cost_here").alias("cost_before")] if cost else []))
    found = stood.join(carried, ["g", "task"]).withColumn("pos", F.col("before") + F.col("place") - F.col("begin"))
    if cost:
        # A window over what one task held of a group.
        found = found.withColumn("upto", F.col("cost_before") + F.sum(F.col("row")[cost]).over(Window.partitionBy("g", "task").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    return kept(found.select("g", "row", "pos", "n", *(["upto"] if cost else [])))


def beyond(rows: DataFrame, value: Column, limit: Column, width: float, reached: bool = False) -> DataFrame:
    """rows (g, pos, ...) with next: the place of the first row after this one whose value is over this one's limit (or has reached it).

    Values do not fall along a group, and limits are at most `width` above a row's own value; a group's last rows get the place after its end.
    """
    step = F.lit(max(width, 1) * RANGE_WIDTHS)
    known = rows.withColumns({"at_value": value, "limit": limit})
    part = lambda x: F.floor(x / step)
    last = known.groupBy("g", "at_value").agg(F.max("pos").alias("last"))
    # What stands within a width of the next range's beginning belongs to this range as well.
    own = part(F.col("at_value"))
    points = last.select("g", F.explode(F.when(F.col("at_value") - own * step <= width, F.array(own, own - 1)).otherwise(F.array(own))).alias("range"), F.col("at_value").alias("x"), F.lit(1 if reached else 0).alias("turn"), "last")
    probes = known.select("g", "limit").distinct().select("g", part(F.col("limit") - width).alias("range"), F.col("limit").alias("x"), F.lit(0 if reached else 1).alias("turn"), F.lit(None).cast("long").alias("last"))
    run = Window.partitionBy("g", "range").orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, 0)
    answered = points.unionByName(probes).withColumn("found", F.max("last").over(run)).where(F.col("turn") == (0 if reached else 1)).select("g", F.col("x").alias("limit"), "found")
    return known.join(answered, ["g", "limit"]).withColumn("next", F.greatest(F.coalesce(F.col("found"), F.lit(0)), F.col("pos")) + 1).drop("at_value", "limit", "found")


def changed(rows: DataFrame, start: str, signal: Column, change: float) -> DataFrame:
    """rows (g, pos, start, ...) with turned: the first place from `start` on whose signal differs from this row's by at least `change`; null if none does.

    Places are leaves of a tree with FAN children a node, which know their smallest and largest signal: a row climbs until a later child can hold
    what it looks for, and goes down into the first that does. A missing signal is no change, and changes to nothing.
    """
    x = F.nanvl(signal.cast("double"), F.lit(None).cast("double"))
    last = rows.agg(F.max("pos")).first()[0] or 0
    nodes, levels = rows.select("g", F.col("pos").alias("child"), x.alias("least"), x.alias("most")), []
    while True:
        # The children of each node, in order; a child without any signal is left out.
        own = nodes.where("least IS NOT NULL").groupBy("g", F.expr(f"child div {FAN}").alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "least", "most"))).alias("children"), F.min("least").alias("node_least"), F.max("most").alias("node_most"))
        levels.append(kept(own))
        if last < FAN ** len(levels):
            break
        nodes = levels[-1].select("g", F.col("node").alias("child"), F.col("node_least").alias("least"), F.col("node_most").alias("most"))
    fits = lambda c: (c["most"] - F.col("x") >= change) | (F.col("x") - c["least"] >= change)
    asked = rows.select("g", "pos", x.alias("x"), F.col(start).alias("from")).where("x IS NOT NULL AND from IS NOT NULL")

    def looked(probes: DataFrame, level: int) -> DataFrame:
        """probes (g, pos, x, from) with the first child from `from` on, in its node, that fits."""
        keyed = probes.withColumn("node", F.expr(f"from div {FAN}"))
        first = F.get(F.filter("children", lambda c: (c["child"] >= F.col("from")) & fits(c)), F.lit(0))["child"]
        return kept(keyed.join(levels[level].select("g", "node", "children"), ["g", "node"], "left").select("g", "pos", "x", "from", first.alias("child")))

    up, down = asked, []
    for level in range(len(levels)):
        done = looked(up, level)
        down.append(done.where("child IS NOT NULL").select("g", "pos", "x", "child"))
        # What follows the node, a level higher.
        up = done.where("child IS NULL").select("g", "pos", "x", (F.expr(f"from div {FAN}") + 1).alias("from"))
    found = down.pop()
    while down:
        within = found.select("g", "pos", "x", (F.col("child") * FAN).alias("from"))
        found = looked(within, len(down) - 1).select("g", "pos", "x", "child").unionByName(down.pop())
    return rows.join(found.select("g", "pos", F.col("child").alias("turned")), ["g", "pos"], "left")


def chain(nexts: DataFrame) -> DataFrame:
    """g, pos, nth (from 0) of the chain from each group's first row, where nexts says (g, pos, next), next being null or past the end where nothing follows."""
    jump = kept(nexts.where("next < n").select("g", "pos", "next"))
    found, ahead = [nexts.where("pos = 0").select("g", "pos", F.lit(0).cast("long").alias("nth"))], 1
    while True:
        here = reduce(DataFrame.unionByName, found)
        more = kept(here.join(jump, ["g", "pos"]).select("g", F.col("next").alias("pos"), (F.col("nth") + ahead).alias("nth")))
        if more.isEmpty():
            return here
        found.append(more)
        onward = jump.select("g", F.col("pos").alias("next"), F.col("next").alias("beyond"))
        jump, ahead = kept(jump.join(onward, ["g", "next"]).select("g", "pos", F.col("beyond").alias("next"))), ahead * 2


def stretches(nexts: DataFrame) -> DataFrame:
    """g, pos, nth for every row: the number of the link of the chain that it belongs to."""
    ends = nexts.select("g", "pos", F.least(F.coalesce("next", "n"), F.col("n")).alias("end"))
    return chain(nexts).join(ends, ["g", "pos"]).select("g", F.explode(F.sequence(F.col("pos"), F.col("end") - 1)).alias("pos"), "nth")
