"""Models are injected. A caller gives functions from rows to answers; calls must be idempotent, as tasks may be repeated."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions import text


class TextModel(Protocol):
    def __call__(self, system: str, user: str, max_tokens: int, temperature: float) -> str: ...


class VisionModel(Protocol):
    def __call__(self, path: str, max_tokens: int, temperature: float) -> str: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Truncated(Exception):
    """The answer reached its ceiling."""


def captioned(frames: DataFrame, model: VisionModel, max_tokens: int = 32_768, retry_tokens: int = 2_048, retries: int = 1, tasks: int | None = None, at_once: int = 1) -> DataFrame:
    """frames with caption. A frame is tried again at temperature 0 with fewer tokens; what still fails is an error marker.

    tasks: how many tasks share the frames; at_once: calls that a task has under way. Rows keep their own columns, so order is not lost.
    """
    schema = T.StructType([*frames.schema.fields, T.StructField("caption", T.StringType())])

    def one(path: str) -> str:
        try:
            return model(path, max_tokens, 0.1)
        except Exception as failed:  # noqa: BLE001  a model may raise anything; failures are rows
            last = failed
        for _ in range(retries):
            try:
                return model(path, min(max_tokens, retry_tokens), 0.0)
            except Exception as failed:  # noqa: BLE001
                last = failed
        return f"[Error captioning frame: {last}]"

    return _mapped(frames.repartition(tasks) if tasks else frames, schema, "caption", one, at_once)


def read(frames: DataFrame, model: VisionModel, max_tokens: int = 4_096, probe: str | None = None, at_once: int = 1) -> DataFrame:
    """frames with ocr: fences and empty markers removed; a frame that fails reads as empty.

    probe: an image that is read first, on the driver; a model that fails on it, or has not seen it, is an error before any frame is tried.
    """
    if probe is not None and re.search("|".join(text.REFUSALS), said := model(probe, max_tokens, 0.0), re.IGNORECASE | re.DOTALL):
        raise ValueError(f"the model takes no images: {said[:200]}")
    schema = T.StructType([*frames.schema.fields, T.StructField("ocr", T.StringType())])

    def one(path: str) -> str:
        try:
            return model(path, max_tokens, 0.0)
        except Exception:  # noqa: BLE001
            return ""

    answer = text.reading(text.unfenced(F.col("ocr")))
    return _mapped(frames, schema, "ocr", one, at_once).withColumn("ocr", F.when(text.refuses(answer), F.lit("")).otherwise(answer))


def _mapped(frames: DataFrame, schema: T.StructType, column: str, one: Callable[[str], str], at_once: int = 1) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            for batch in batches:
                yield batch.assign(**{column: list(pool.map(one, batch["path"]))})

    return frames.mapInPandas(run, schema)


def embedded(rows: DataFrame, embedder: Embedder, body: str) -> DataFrame:
    """rows with embedding, of unit length."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(x: pd.Series) -> pd.Series:
        v = np.asarray(embedder(x.fillna("").tolist()), dtype=np.float64)
        return pd.Series((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32).tolist())

    return rows.withColumn("embedding", embed(F.col(body)))


def require_vision(model: str) -> None:
    """Refuses ids that are known to take no images."""
    name = "-".join(re.findall("[a-z0-9]+", model.lower()))
    if any(x in name for x in text.TEXT_FAMILIES) and not any(x in name for x in text.VISION_MARKS + text.VISION_FAMILIES):
        raise ValueError(f"{model} takes no images; choose a model with vision")
