"""Jobs and what they report: listings, retention, progress, text boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Jobs that are kept and listed, and events of a live view.
MOST_JOBS, LIVE_EVENTS = 25, 120


def newest_first(jobs: DataFrame, started: str, ident: str, limit: int = MOST_JOBS) -> DataFrame:
    return jobs.orderBy(F.desc_nulls_last(started), ident).limit(limit)


def retained(jobs: DataFrame, started: str, ident: str, running: Column, most: int = MOST_JOBS) -> DataFrame:
    """The newest jobs and those that run. Only the newest are ranked, by a bounded top; the others are a filter."""
    newest = newest_first(jobs, started, ident, most)
    others = jobs.where(running).join(F.broadcast(newest.select(ident)), ident, "left_anti")
    return newest.unionByName(others.select(newest.columns))


def without_secrets(params: DataFrame, *names: str) -> DataFrame:
    """The columns but those that no listing may show."""
    return params.drop(*(names or ("api_key",)))


def progress_changes(reports: DataFrame, job: str, order: list[str], *step: str) -> DataFrame:
    """Reports but those that repeat the step of the report before: a bar is drawn many times for a step."""
    at = Window.partitionBy(job).orderBy(*order)
    now = F.struct(*step)
    before, first = F.lag(now).over(at), F.row_number().over(at) == 1
    return reports.withColumn("again", ~first & now.eqNullSafe(before)).where(~F.col("again")).drop("again")


def live_tail(events: DataFrame, order: list[str], limit: int = LIVE_EVENTS) -> DataFrame:
    """The last events, in their order."""
    return events.orderBy(*(F.desc(c) for c in order)).limit(limit).orderBy(*order)


def boxes_in_order(boxes: DataFrame, image: str, x: str, y: str, text: str) -> DataFrame:
    """Boxes of text from top to bottom and left to right (y grows upwards), with their position; places are rounded, so that a line's boxes are level."""
    placed = boxes.withColumns({"top": F.bround(1 - F.col(y), 4), "left": F.bround(F.col(x), 4)})
    return placed.withColumn("position", F.row_number().over(Window.partitionBy(image).orderBy("top", "left", text)) - 1)


def listed(files: DataFrame, folder: str, path: str, *ids: str) -> DataFrame:
    """Files with their place in the sorted listing of their folder, those of one path by their ids."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(folder).orderBy(path, *ids)) - 1)


def first_of_each(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """At most so many rows of each group, as samples in a report show them."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= most).drop("nth")
