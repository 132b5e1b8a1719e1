"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted in Spark.

A word is removed if a window over it also starts in a document with a smaller id.

Each window is known by the least hash among its `gram`-word grams, so equal windows are always known by the same
one, and a document falls into runs of consecutive windows known by one gram. First the grams are counted: a run whose
gram occurs in one document alone can't repeat. What remains is counted as whole runs, by a Rabin-Karp hash of
all their words. Where a gram heads several different runs, their windows are hashed and counted one by one, from one
copy of each run. So each repeated window is found, and the unique ones (nearly all) never leave their task.

Groups are never gathered: counts are partial sums of minima, and rows meet them in joins that adaptive execution can
split. What is collected belongs to a single document or run. Two Rabin-Karp hashes modulo 2 ** 61 - 1, 122 bits, decide which
windows are equal. Long texts are hashed in pieces that overlap by a window; runs end with a piece, and since a run that differs
from another of its gram has its windows counted one by one, results do not depend on where pieces end.

Runs that cannot repeat are told by their gram alone because sending out every window would cost 24 bytes for each word
of the corpus (7 bytes of text): more than three times the input in one shuffle.

Defined cases: null and empty texts have no words; texts under one window lose nothing; rows sharing an id are no smaller
than each other; rows without id lose nothing, and take nothing from others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import BASE_61, SPACED, WORD_BASE, Rolling, Rolling61, column, find_words, hash_words, keep, mix, rolling_min, signed, slices, table, text_key, word_slices

WINDOW = 50
GRAM = 16

RUNS = "gram long, doc_id long, text_key long, start int, n int, run_a long, run_b long"
WINDOWS = "win_a long, win_b long, run_a long, run_b long, at int, least long"


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = column(batch, "doc_id"), column(batch, "text_key")
            for rows, numbers, data, _, starts, ends, first in word_slices(column(batch, "text"), window - 1):
                if len(starts) < window:
                    continue
                words = hash_words(data, starts, ends)
                i = np.arange(len(words) - gram + 1)
                least = rolling_min(mix(Rolling(words, WORD_BASE).of(i, i + gram)), window - gram + 1)
                doc = np.repeat(np.arange(len(rows)), np.diff(first))
                valid = doc[: len(least)] == doc[window - 1 :]
                same = np.zeros(len(least), dtype=bool)
                same[1:] = valid[1:] & valid[:-1] & (least[1:] == least[:-1]) & (doc[1 : len(least)] == doc[: len(least) - 1])
                heads = np.flatnonzero(valid & ~same)
                tails = np.flatnonzero(valid & ~np.append(same[1:], False))
                if not len(heads):
                    continue
                a, b = (Rolling61(words, base).of(heads, tails + window) for base in BASE_61[1:])
                places = pa.array(rows[doc[heads]])
                start = heads - first[doc[heads]] + numbers[doc[heads]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(least[heads])), ids.take(places), keys.take(places), pa.array(start.astype(np.int32)), pa.array((tails - heads + 1).astype(np.int32)), pa.array(signed(mix(a))), pa.array(signed(mix(b)))],
                    ["gram", "doc_id", "text_key", "start", "n", "run_a", "run_b"],
                )

    return run


def _windows(window: int):
    """Hashes of the windows in the runs listed with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = column(batch, "runs")
            for rows, numbers, data, _, starts, ends, first in word_slices(column(batch, "text"), window - 1):
                mine = lists.take(pa.array(rows))
                flat = mine.flatten()
                if not len(flat):
                    continue
                field = lambda k: flat.field(k).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                place_of = np.repeat(np.arange(len(rows)), mine.value_lengths().to_numpy())
                # A run's windows that begin in this piece; those of its last words begin in the next one.
                begin = field(0).astype(np.int64) - numbers[place_of]
                here = np.diff(first)[place_of] - window + 1
                skip = np.maximum(0, -begin)
                n = np.maximum(0, np.minimum(field(1), here - begin) - skip)
                run_of = np.repeat(np.arange(len(n)), n)
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + skip[run_of]
                place = (first[place_of] + begin)[run_of] + off
                words = hash_words(data, starts, ends)
                a, b = (Rolling61(words, base).of(place, place + window) for base in BASE_61[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(mix(a))), pa.array(signed(mix(b))), *(pa.array(field(k)[run_of]) for k in (2, 3)), pa.array(off.astype(np.int32)), pa.array(field(4)[run_of])],
                    ["win_a", "win_b", "run_a", "run_b", "at", "least"],
                )

    return run


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Of docs (doc_id, text_key, text): doc_id, text_key and spans, an array of (start, end) of removed words, unmerged."""
    runs = docs.where("doc_id IS NOT NULL").mapInArrow(_runs(window, gram), RUNS)
    shared = runs.groupBy("gram").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("gram")
    found = keep(runs.join(keep(shared), "gram", "left_semi"))
    distinct = keep(found.groupBy("gram", "run_a", "run_b").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key", "start", "n")).alias("copy")))
    several = distinct.groupBy("gram").count().where("count > 1").select("gram")
    listed = distinct.join(keep(several), "gram", "left_semi").groupBy(F.col("copy.doc_id").alias("doc_id"), F.col("copy.text_key").alias("text_key"))
    listed = listed.agg(F.collect_list(F.struct("copy.start", "copy.n", "run_a", "run_b", "least")).alias("runs"))
    windows = keep(docs.dropDuplicates(["doc_id", "text_key"]).join(listed, ["doc_id", "text_key"]).select("text", "runs").mapInArrow(_windows(window), WINDOWS))
    minima = windows.groupBy("win_a", "win_b").agg(F.min("least").alias("first_doc"), F.max("least").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")
    earlier = windows.join(keep(minima), ["win_a", "win_b"]).where("first_doc < least").groupBy("run_a", "run_b").agg(F.collect_list(F.struct("at", "first_doc")).alias("earlier"))
    known = keep(distinct.select("run_a", "run_b", "least").join(earlier, ["run_a", "run_b"], "left"))
    spans = F.expr(f"""CASE WHEN doc_id > least THEN array(named_struct('a', start, 'b', start + n + {window - 1}))
        ELSE transform(filter(earlier, e -> e.first_doc < doc_id), e -> named_struct('a', start + e.at, 'b', start + e.at + {window})) END""")
    per_run = found.join(known, ["run_a", "run_b"]).select("doc_id", "text_key", spans.alias("spans")).where("size(spans) > 0")
    return per_run.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, out: str = "dedup") -> DataFrame:
    """docs' rows and columns (but for those named as `out`, dedup_key, dedup_spans, dedup_id or dedup_text) with `out` = struct(n_words, n_removed, kept_sha256, kept_text).

    kept_sha256: of the kept words joined by one space; kept_text: the text without the removed words and what stands between
    them and the next word, the text itself if nothing is removed, null if not keep_text.
    """
    docs = docs.drop(out, "dedup_key", "dedup_spans", "dedup_id", "dedup_text")
    keyed = docs.withColumn("dedup_key", text_key(text_col))
    ids = F.col(f"`{id_col}`").cast("long")
    spans = removals(keyed.select(ids.alias("doc_id"), F.col("dedup_key").alias("text_key"), F.coalesce(text_col, F.lit("")).alias("text")), window, gram)
    spans = spans.select(F.col("doc_id").alias("dedup_id"), F.col("text_key").alias("dedup_text"), F.col("spans").alias("dedup_spans"))
    joined = keyed.join(spans, (ids == F.col("dedup_id")) & (F.col("dedup_key") == F.col("dedup_text")), "left").drop("dedup_id", "dedup_text", "dedup_key")
    names = docs.columns
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])
    fields = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = column(batch, text_col), column(batch, "dedup_spans")
            results: list[tuple] = []
            for at, to, data, offsets in slices(texts):
                raw = data.tobytes()
                starts, ends, first = find_words(data, offsets)
                for i in range(to - at):
                    lo, hi = first[i], first[i + 1]
                    edge = np.zeros(hi - lo + 1, dtype=np.int32)
                    if lists[at + i].is_valid and len(pairs := lists[at + i].values):
                        np.add.at(edge, pairs.field(0).to_numpy(), 1)
                        np.add.at(edge, pairs.field(1).to_numpy(), -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    n = int(gone.sum())
                    s, whole = starts[lo:hi], raw[offsets[i] : offsets[i + 1]]
                    kept = _kept_words(data[offsets[i] : offsets[i + 1]], s - offsets[i], ends[lo:hi] - offsets[i], gone)
                    clean = None
                    if keep_text and texts[at + i].is_valid:
                        clean = whole if not n else _without(raw, s, gone, int(offsets[i]), int(offsets[i + 1]))
                    results.append((hi - lo, n, hashlib.sha256(kept).hexdigest(), clean.decode() if clean is not None else None))
            parts = [[r[k] for r in results] for k in range(4)]
            more = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], fields)
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in names), more], [*names, out])

    return joined.mapInArrow(run, schema)


def _kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The words not gone, joined by one space: each with the byte after it, which becomes the space, but for the last."""
    stay = np.flatnonzero(~gone)
    if not len(stay):
        return b""
    s, e = starts[stay], ends[stay] + 1
    e[-1] -= 1
    edge = np.zeros(len(data) + 2, dtype=np.int8)
    edge[s] += 1
    edge[e] -= 1
    mask = np.cumsum(edge, dtype=np.int8)[: len(data)].astype(bool)
    return np.where(SPACED[data], data, np.uint8(0x20))[mask].tobytes()


def _without(raw: bytes, starts: np.ndarray, gone: np.ndarray, begin: int, end: int) -> bytes:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    parts, at = [], begin
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        parts.append(raw[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else end
    return b"".join([*parts, raw[at:end]])


def op1_substring(spark, sf_dir: str) -> DataFrame:
    found = remove(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_sha256")


OP1_SQL = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, s, list_slice(words, s, s + {WINDOW - 1}) AS win FROM w, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 1))) r(s) WHERE len(words) >= {WINDOW}),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY md5(array_to_string(win, ' '))) AS lo FROM win) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM hit, unnest(range(s, s + {WINDOW})) r(p)),
kept AS (
    SELECT w.doc_id, sha256(string_agg(w.word, ' ' ORDER BY w.p)) AS kept_sha256 FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) w
    ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id
)
SELECT w.doc_id, coalesce(len(words), 0)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON w.doc_id = g.doc_id LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
