"""Vector search over collections: one plan for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import vectors


def ranked(rows: DataFrame, query: list[float], collection: str = "collection", ident: str = "id", vector: str = "embedding") -> DataFrame:
    """Every row with distance and score to one query vector, which is a literal: nothing is joined."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = vectors.cosine_distance(F.col(vector), q)
    return rows.select(F.col(collection).alias("collection"), F.col(ident).alias("id"), d.alias("distance")).select("*", vectors.score(F.col("distance")).alias("score"))


def top(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy("distance", "id").limit(k)


def top_per_collection(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("collection").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def balanced(found: DataFrame, k: int, sources: int) -> DataFrame:
    """k rows of each collection's top k: first max(2, k // sources) of each by score, in the collections' order, then by score."""
    per = max(2, k // max(sources, 1))
    best = top_per_collection(found, k).drop("rank")
    w = Window.partitionBy("collection").orderBy(F.desc("score"), "distance", "id")
    placed = best.withColumn("place", F.row_number().over(w)).withColumn("second", F.col("place") > per)
    order = [F.col("second"), F.when(~F.col("second"), F.col("collection")), F.desc("score"), F.col("distance"), F.col("id")]
    cut = placed.orderBy(*order).limit(k)
    return cut.withColumn("position", F.row_number().over(Window.orderBy(*order))).drop("place", "second")


def by_score(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(F.desc("score"), "distance", "id").limit(k)


def token_overlap(rows: DataFrame, query: str, text: str, k: int, ident: str = "id") -> DataFrame:
    """Search by text without an embedder: share of the query's words that a text has."""
    words = F.array_distinct(F.split(F.lower(F.lit(query)), r"\W+"))
    mine = F.array_distinct(F.split(F.lower(F.col(text)), r"\W+"))
    return rows.withColumn("score", F.size(F.array_intersect(words, mine)) / F.size(words)).orderBy(F.desc("score"), ident).limit(k)


def resolve_collection(sizes: DataFrame, wanted: str | None, default: str) -> DataFrame:
    """The wanted collection if it is there, else the default if it holds rows, else the largest (ties to the first name)."""
    name = F.col("collection").cast("string")
    pick = F.when(name == F.lit(wanted), 3).when((name == F.lit(default)) & (F.col("n") > 0), 2).otherwise(1)
    return sizes.withColumn("pick", pick).orderBy(F.desc("pick"), F.desc("n"), "collection").limit(1).drop("pick")
