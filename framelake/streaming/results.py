"""Results of a stream, batch by batch, so that a batch that is repeated adds nothing.

A batch writes its rows into a folder of its own, in place of what an attempt before it may have left there, and then a record that it is done. Readers
see the batches that are recorded only: neither half of one nor one of them twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framelake.operators import packing


def _data(path: str, batch: int) -> str:
    return f"{path.rstrip('/')}/data/batch_id={batch}"


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Rows of one batch. A batch that is recorded already is not computed again."""
    spark = rows.sparkSession
    if batch in recorded(spark, path):
        return
    rows.write.mode("overwrite").parquet(_data(path, batch))
    _record(spark, path, batch)


def _record(spark: SparkSession, path: str, batch: int) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/done/{batch}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True).close()


def recorded(spark: SparkSession, path: str) -> set[int]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/done")
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {int(f.getPath().getName()) for f in store.listStatus(where)} if store.exists(where) else set()


def persisted(stream: DataFrame, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Starts writing what the stream has now: make(batch) of each batch, such as calls of a model. After a failure a restart goes on with the batch that failed."""
    return stream.writeStream.foreachBatch(lambda rows, batch: write_batch(make(rows) if make else rows, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """The rows of all batches that are done, with batch_id; of rows with equal keys those of the last batch, in whatever order results came."""
    done = sorted(recorded(spark, path))
    try:
        rows = spark.read.schema(f"{schema}, batch_id long").option("basePath", f"{path.rstrip('/')}/data").parquet(*(_data(path, b) for b in done)) if done else spark.createDataFrame([], f"{schema}, batch_id long")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"a batch that {path} records is missing") from missing
    if keys is None:
        return rows
    value = F.struct(*(c for c in rows.columns if c not in (*keys, "batch_id")))
    return packing.latest(rows.select(*keys, "batch_id", value.alias("value")), keys, "batch_id", "value").select(*keys, "value.*", "batch_id")
