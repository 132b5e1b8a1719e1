"""Benchmark decontamination: an FM-index over each shard of documents, searched backwards.

A task gathers documents into shards of about `shard_words` words. A shard is indexed as words: its suffixes are sorted,
the Burrows-Wheeler sequence of that order stands in a wavelet matrix, and the places of every `sample`-th word and of
the documents' begins are kept. Each window of the benchmark is sought by backward search (two ranks a word),
its occurrences are located by stepping to a kept place, and overlapping occurrences merge into removal spans.

Documents are not shuffled: a task holds one shard and one block of the benchmark's windows, which go out as flat arrays: 8 bytes a
word and 20 a window at most, and the items. A block has at most `block_words` words of windows (100 MB), a bound that does not depend on
the corpus. A shard is indexed once and searched for one block after another. A document longer than a shard is indexed in pieces that
overlap by a window, so its index is no larger than others'.

Words are compared by 64-bit hashes (polynomials modulo 2 ** 61 - 1), so a false hit takes a collision within an otherwise equal window.

Defined cases: null and empty texts have no words and no hits; an item without words is no pattern; a null item_id is the empty
string; repeated items all count; rows that share a doc_id are judged each by itself; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import column, find_words, hash_words, table, word_slices

WINDOW = 10
SHARD_WORDS = 600_000
SHARD_DOCS = 20_000
#: Words of distinct benchmark windows in one block.
BLOCK_WORDS = 10_000_000
SAMPLE = 8

LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class WaveletMatrix:
    """Ranks over a sequence of small integers: a bit vector for each binary digit, highest first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.bits, self.levels, self.zeros = len(values), bits, [], []
        for shift in range(bits - 1, -1, -1):
            bit = ((values >> shift) & 1).astype(bool)
            ones = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often each symbol comes before `at`; start: begin() of the symbol."""
        return self._walk(symbol, at) - start

    def begin(self, symbol: np.ndarray) -> np.ndarray:
        return self._walk(symbol, np.zeros(len(symbol), dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for ones, zeros, shift in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            before = ones[at]
            at = np.where((symbol >> shift) & 1, zeros + before, at - before)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and the places they reach on the last level."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            before = ones[at]
            bit = ones[at + 1] > before
            symbol = (symbol << 1) | bit
            at = np.where(bit, zeros + before, at - before)
        return symbol, at


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Places of the text in the order of their suffixes, by doubling; each 0 is a symbol of its own, in order of place.

    After three rounds over all places only those that are not yet told apart are sorted again.
    """
    ends = np.flatnonzero(words == 0)
    rank = words.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    n, reach = len(words), 1
    for _ in range(3):
        key = rank * (n + len(ends) + int(words.max(initial=0)) + 2)
        key[: max(n - reach, 0)] += rank[reach:] + 1
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - counts)[inverse]
        reach *= 2
    left = np.flatnonzero(counts[inverse] > 1)
    while len(left):
        key = rank[left] * (n + 1) + rank[left + reach]
        o = np.argsort(key, kind="stable")
        left, key = left[o], key[o]
        old = rank[left]
        at = np.arange(len(left))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        cell = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.maximum.accumulate(np.where(cell, at, 0))
        rank[left] = old + begin - np.maximum.accumulate(np.where(group, at, 0))
        alone = cell & np.append(cell[1:], True)
        left = left[~alone]
        reach *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """words: symbols from 1; 0 ends a document, and the last one is 0."""

    def __init__(self, words: np.ndarray, symbols: int, sample: int = SAMPLE):
        order = suffix_order(words)
        self.n, bits = len(words), max(1, int(symbols).bit_length())
        self.tree = WaveletMatrix(words[order - 1].astype(np.int64), bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=symbols + 1))])
        # Kept places: every sample-th, and the begins of documents, so that no step crosses an end.
        self.marked = (order % sample == 0) | (words[order - 1] == 0)
        self.marks = np.flatnonzero(self.marked)
        self.places = order[self.marks]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows of each pattern (a row of `patterns`, as long as `lengths` says)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (hi > lo))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - back]
            start = self.tree.begin(symbol)
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live], start)
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live], start)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of these rows: step back to a kept place, then add the steps."""
        place, live, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        begins: np.ndarray | None = None
        while len(live):
            kept = self.marked[at]
            place[live[kept]] = (self.places[np.searchsorted(self.marks, at[kept])] + steps) % self.n
            live, at = live[~kept], at[~kept]
            if len(live):
                symbol, end = self.tree.access(at)
                distinct, back = np.unique(symbol, return_inverse=True)
                begins = self.tree.begin(distinct)
                at = self.first[symbol] + end - begins[back]
                steps += 1
        return place


RAW_LETTERS = LETTERS.copy()
RAW_LETTERS[0x41:0x5B] = True


class Windows:
    """A block of distinct windows: `flat` holds their words one after another, `lengths` how many each has; window k belongs to the items owners[ends[k - 1]:ends[k]]."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        names: dict[str, int] = {}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            starts, ends, _ = find_words(data, np.array([0, len(data)]), RAW_LETTERS)
            words = hash_words(LOWER[data], starts, ends)
            if size := min(window, len(words)):
                number = names.setdefault("" if item is None else str(item), len(names))
                by_length.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(words, size), number))
        self.items = list(names)
        flat, lengths, owners, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for size, found in sorted(by_length.items()):
            rows = np.concatenate([w for w, _ in found])
            item = np.repeat(np.array([k for _, k in found]), [len(w) for w, _ in found])
            distinct, which = np.unique(rows.view(np.dtype((np.void, 8 * size))).ravel(), return_inverse=True)
            pairs = np.unique(which * len(names) + item)
            flat.append(np.frombuffer(distinct.tobytes(), dtype=np.uint64))
            lengths.append(np.full(len(distinct), size, np.int32))
            owners.append((pairs % len(names)).astype(np.int32))
            counts.append(np.bincount(pairs // len(names), minlength=len(distinct)))
        self.flat, self.lengths, self.owners = np.concatenate(flat), np.concatenate(lengths), np.concatenate(owners)
        self.ends = np.cumsum(np.concatenate(counts))

    def __len__(self) -> int:
        return len(self.lengths)

    def owners_of(self, k: int) -> np.ndarray:
        return self.owners[self.ends[k - 1] if k else 0 : self.ends[k]]


class Shard:
    """The index of some documents, each an array of word hashes."""

    def __init__(self, words: list[np.ndarray], sample: int):
        self.sizes = np.array([len(w) for w in words])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.index: FMIndex | None = None
        if not self.sizes.sum():
            return
        self.vocabulary, symbols = np.unique(np.concatenate(words), return_inverse=True)
        self.text = np.zeros(self.starts[-1], dtype=np.int64)
        inside = np.ones(len(self.text), dtype=bool)
        inside[self.starts[1:] - 1] = False
        self.text[inside] = symbols + 1
        self.sample = sample

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The occurrences: document, first word and window."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(windows) or not self.sizes.sum():
            return none
        ids = np.minimum(np.searchsorted(self.vocabulary, windows.flat), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == windows.flat
        lengths = windows.lengths.astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        use = np.flatnonzero(np.minimum.reduceat(known, begin))
        if not len(use):
            return none
        if self.index is None:
            self.index = FMIndex(self.text, len(self.vocabulary), self.sample)
        size = lengths[use]
        columns = np.arange(int(size.max()))
        patterns = np.where(columns < size[:, None], ids[np.minimum(begin[use][:, None] + columns, len(ids) - 1)] + 1, 0)
        lo, hi = self.index.search(patterns, size)
        counts = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(use)), counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
        places = self.index.locate(rows)
        document = np.searchsorted(self.starts, places, side="right") - 1
        return document, places - self.starts[document], use[which]


def search_shard(pieces: list[tuple[int, int, np.ndarray]], n_rows: int, blocks, sample: int, shard_words: int = SHARD_WORDS) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each row the hit spans of words, merged, and the ids of items that occur. pieces: row, number of the first word, words.

    blocks() yields the blocks of windows. Pieces beyond shard_words form a further index, so that a long document has several.
    """
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_rows)]
    items: list[set[str]] = [set() for _ in range(n_rows)]
    number = (np.cumsum([len(p[2]) for p in pieces]) - 1) // max(2 * shard_words, 1)
    for k in np.unique(number):
        _search_index([p for p, n in zip(pieces, number, strict=True) if n == k], blocks(), sample, spans, items)
    return [(_united(s), i) for s, i in zip(spans, items, strict=True)]


def _search_index(pieces: list[tuple[int, int, np.ndarray]], blocks: Iterator[Windows], sample: int, spans: list, items: list) -> None:
    """Adds what one index finds."""
    shard = Shard([w for _, _, w in pieces], sample)
    row_of, number_of = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
    for windows in blocks:
        document, place, which = shard.search(windows)
        if not len(document):
            continue
        row, start = row_of[document], number_of[document] + place
        order = np.lexsort((start, row))
        for r, a, b in zip(row[order].tolist(), start[order].tolist(), (start + windows.lengths[which])[order].tolist(), strict=True):
            mine = spans[r]
            if mine and a <= mine[-1][1]:
                mine[-1] = (mine[-1][0], max(mine[-1][1], b))
            else:
                mine.append((a, b))
        for r, k in np.unique(np.stack([row, which]), axis=1).T.tolist():
            items[r].update(windows.items[x] for x in windows.owners_of(k))


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merged again, as several blocks have added to them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _block_values(shared: list) -> Iterator[Windows]:
    """The blocks one after another; where there are several, each leaves memory before the next one."""
    for block in shared:
        yield block.value
        if len(shared) > 1 and hasattr(block, "_value"):
            del block._value


def _clean(value: pa.Scalar, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of these spans and what stands between them and the next word."""
    if not value.is_valid:
        return None
    if not spans:
        return value.as_py()
    text = value.as_buffer().to_pybytes()
    data = np.frombuffer(text, dtype=np.uint8)
    starts, _, _ = find_words(data, np.array([0, len(data)]), RAW_LETTERS)
    keep, at = [], 0
    for a, b in spans:
        keep.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
    return b"".join([*keep, text[at:]]).decode()


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, sample: int = SAMPLE, block_words: int = BLOCK_WORDS, keep_text: bool = True, out: str = "hit") -> DataFrame:
    """Every row of docs (its columns stay, but for one named as `out`) with `out` = struct(n_words, n_hit, items, spans, clean_text).

    items: sorted ids, as strings, of the benchmark items with a window in the row; spans: word numbers, start and end in
    turn, of the merged removal spans; clean_text: the text without them (the text itself where nothing was hit;
    null if not keep_text). The benchmark goes out in blocks of about block_words words of windows.
    """
    shared, pending, room = [], [], block_words
    context = docs.sparkSession.sparkContext
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        cost = window * (len(text or "") // 2 + 1)
        if pending and cost > room:
            shared.append(context.broadcast(Windows(pending, window)))
            pending, room = [], block_words
        pending.append((item, text))
        room -= cost
    shared.append(context.broadcast(Windows(pending, window)))
    docs = docs.drop(out)
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("clean_text", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])

    def finish(held: list, pieces: list[tuple[int, int, np.ndarray]], n_rows: int) -> Iterator[pa.RecordBatch]:
        found, at = search_shard(pieces, n_rows, lambda: _block_values(shared), sample, shard_words), 0
        for part, counts in held:
            mine = found[at : at + part.num_rows]
            at += part.num_rows
            clean = [None] * part.num_rows
            if keep_text:
                texts = column(part, text_col)
                clean = [_clean(texts[k], spans) for k, (spans, _) in enumerate(mine)]
            hit = pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array([sum(b - a for a, b in s) for s, _ in mine], pa.int64()), pa.array([sorted(i) for _, i in mine], pa.list_(pa.string())), pa.array([[x for span in s for x in span] for s, _ in mine], pa.list_(pa.int32())), pa.array(clean, pa.string())],
                kind.names,
            )
            yield pa.RecordBatch.from_arrays([*part.columns, hit], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        pieces: list[tuple[int, int, np.ndarray]] = []
        size = n_rows = 0
        for batch in batches:
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            # Where a shard is full, what comes of the batch so far goes on: a row is held with the shard that has its last piece.
            begun = 0
            for rows, numbers, data, _, starts, ends, first in word_slices(column(batch, text_col), window - 1, RAW_LETTERS):
                hashes = hash_words(LOWER[data], starts, ends)
                for k, (row, number) in enumerate(zip(rows.tolist(), numbers.tolist(), strict=True)):
                    words = hashes[first[k] : first[k + 1]]
                    counts[row] = number + len(words)
                    pieces.append((n_rows + row - begun, number, words))
                size += len(hashes)
                done = int(rows[-1]) + 1
                if (size >= shard_words and len(rows) > 1) or len(pieces) >= SHARD_DOCS:
                    held.append((batch.slice(begun, done - begun), counts[begun:done]))
                    yield from finish(held, pieces, n_rows + done - begun)
                    held, pieces, size, n_rows, begun = [], [], 0, 0, done
            if begun < batch.num_rows:
                held.append((batch.slice(begun), counts[begun:]))
                n_rows += batch.num_rows - begun
            if size >= shard_words:
                yield from finish(held, pieces, n_rows)
                held, pieces, size, n_rows = [], [], 0, 0
        if held:
            yield from finish(held, pieces, n_rows)

    return docs.mapInArrow(run, schema)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id",
        F.col("hit.n_words").alias("n_words"),
        F.col("hit.n_hit").alias("n_hit"),
        F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"),
        (F.col("hit.n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, len(w) AS size, array_to_string(w, ' ') AS win FROM item WHERE len(w) BETWEEN 1 AND 9
    UNION SELECT item_id, 10, array_to_string(list_slice(w, s, s + 9), ' ') FROM item, unnest(range(1, greatest(len(w) - 8, 1))) r(s) WHERE len(w) >= 10),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
place AS (SELECT r, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS win FROM d, sizes, unnest(range(1, greatest(len(w) - size + 2, 1))) p(s)),
hit AS (SELECT r, s, size, item_id FROM place JOIN win USING (size, win)),
gone AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + size)) q(p) GROUP BY 1),
ids AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN gone USING (r) LEFT JOIN ids USING (r)
"""
