"""Packing ordered texts into budgets: greedy chunks, batches, samples, blocks of text.

A greedy sum restarts with every chunk, so no running-sum window gives it: where a chunk would end is searched for every unit as its first, and
the chunks from a group's first unit are followed (`jumps`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import text
from framelake.operators import jumps
from framelake.shared import kept

#: Fixed value: the mark of a text that was cut.
CUT_MARK = "[... additional frames truncated for context limit ...]"


def packed(units: DataFrame, group: str, order: list[str], cost: str, budget: int, most: int | None = None, joint: int = 0) -> DataFrame:
    """units with chunk_id. A unit opens a chunk if the chunk's cost would pass the budget, or it has `most` units.

    joint: added to a chunk's cost after each unit, but not to the unit's own when it is tested.
    """
    rows = units.select(group, *order, F.col(cost).cast("long").alias(cost))
    whole = F.lit(0).cast("long")
    begin = F.struct(whole.alias("spent"), whole.alias("n"), F.lit(0).alias("chunk_id"))

    def step(now: Column, row: Column) -> Column:
        full = (now["n"] > 0) & ((now["spent"] + row[cost] > budget) | (F.lit(False) if most is None else now["n"] >= most))
        spent = F.when(full, whole).otherwise(now["spent"]) + row[cost] + joint
        return F.struct(spent.alias("spent"), (F.when(full, whole).otherwise(now["n"]) + 1).alias("n"), (now["chunk_id"] + full.cast("int")).alias("chunk_id"))

    def follow(large: DataFrame) -> DataFrame:
        stood = jumps.placed(large, group, [*order, cost], cost)
        spent = F.col("upto") + joint * F.col("pos")
        nexts = jumps.beyond(stood, spent, spent - F.col("row")[cost] + budget, budget)
        nexts = kept(nexts if most is None else nexts.withColumn("next", F.least("next", F.col("pos") + most)))
        return nexts.join(jumps.stretches(nexts), ["g", "pos"]).select("row.*", F.col("nth").cast("int").alias("chunk_id"))

    return jumps.by_size(rows, group, lambda small: jumps.walked(small, group, [*order, cost], begin, step, "chunk_id"), follow)


def caption_units(captions: DataFrame, keys: list[str], stamp: str, caption: str, budget: int) -> DataFrame:
    """Captions with their estimate; one over the budget is split by characters (piece counts from 0)."""
    room = F.greatest(F.lit(1), F.lit((budget - 50) * 2) - F.length(F.concat(F.lit("["), F.col(stamp), F.lit("]\n"))))
    parts = captions.select(*keys, stamp, F.posexplode(text.pieces(F.col(caption), room)).alias("piece", caption))
    return parts.withColumn("tokens", text.caption_tokens(F.col(stamp), F.col(caption)))


def note_units(notes: DataFrame, keys: list[str], note: str, budget: int) -> DataFrame:
    parts = notes.select(*keys, F.posexplode(text.pieces(F.col(note), (budget - 50) * 2)).alias("piece", note))
    return parts.withColumn("tokens", text.note_tokens(F.col(note)))


def paragraph_units(documents: DataFrame, keys: list[str], body: str) -> DataFrame:
    parts = documents.select(*keys, F.posexplode(F.split(F.col(body), "\n\n")).alias("piece", "paragraph"))
    return parts.withColumn("chars", F.length("paragraph").cast("long"))


def batches(rows: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size).cast("int"))


def stratified(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows spread evenly over each group, first and last included; the middle one if n is 1; all if there are no more."""
    own = Window.partitionBy(group)
    at = rows.withColumns({"at": F.row_number().over(own.orderBy(*order)) - 1, "total": F.count("*").over(own)})
    wanted = F.when(F.lit(n <= 1), F.array(F.floor(F.col("total") / 2))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 1))), lambda i: F.bround(i * ((F.col("total") - 1) / max(n - 1, 1)), 0).cast("long")))
    return at.where((F.col("total") <= n) | F.array_contains(wanted, F.col("at").cast("long"))).drop("at", "total")


def block(captions: DataFrame, group: str, order: list[str], stamp: str, caption: str, most: int | None = None) -> DataFrame:
    """One text a group: entries in order with separators; cut before the entry that passes `most`, with a mark."""
    entry = F.concat(F.lit("["), F.col(stamp), F.lit("]\n"), F.col(caption))
    rows = captions.select(group, *order, entry.alias("entry"))
    if most is not None:
        w = Window.partitionBy(group).orderBy(*order)
        rows = rows.withColumn("fits", F.sum(F.length("entry")).over(w.rowsBetween(Window.unboundedPreceding, 0)) <= most)
    else:
        rows = rows.withColumn("fits", F.lit(True))
    whole = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct(*order, "entry")))).alias("rows"), F.bool_and("fits").alias("all"))
    mark = F.when(F.col("all"), F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit(CUT_MARK)))
    return whole.select(group, F.array_join(F.concat(F.transform("rows", lambda r: r["entry"]), mark), "\n\n---\n\n").alias("block"))


def statistics(units: DataFrame, group: str, tokens: str) -> DataFrame:
    return units.groupBy(group).agg(F.sum(tokens).alias("total"), F.avg(tokens).alias("mean"), F.max(tokens).alias("largest"), F.count("*").alias("n"))


def latest(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last writer's value for each key."""
    return rows.groupBy(*keys).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def latest_iteration(rows: DataFrame, k: int, fallback: int, order: str, iteration: str = "iteration") -> DataFrame:
    """Rows of iteration k; the last `fallback` rows if it has none. One plan: a subquery of one value decides."""
    now = rows.where(F.col(iteration) == k)
    last = rows.orderBy(F.desc(order)).limit(fallback).where(~now.exists())
    return now.unionByName(last)
