"""Suffix-array dedup over bytes: strings of `length` bytes that occur more than once anywhere are removed.

Only suffixes that can matter are sorted. Each string of `length` bytes is anchored at the least, by hash, of the `width` grams
in it (the first one of equal ones), so a document falls into entries: strings at consecutive places with one anchor. The grams of
the anchors are counted; an entry whose gram occurs once is unique and goes no further. That is all that hashes decide: what
they leave is compared by its bytes.

An entry is two strings: the suffix from its anchor on, and the reversed prefix up to there. Each task sorts the entries of all
its batches (in runs of `run_bytes`), settles equal ones among themselves, and sends what is left to ranges. The ranges'
bounds are quantiles of a bounded sample of the suffixes, cut so that the entries of one gram meet. What goes to a range is front-coded:
for each string the length of the prefix it shares with the one before, and the rest. A range merges the runs it gets by
a loser tree in which each entry carries the prefix length it is known to share with the last winner: only entries with equal
lengths are compared, and from that length on. The merge yields the suffix array of the range with its common prefix lengths, one
order to the right of the anchors and one to the left; a repeated string is a pair of entries of one gram whose shared
lengths to both sides add up to `length`.

A gram with more than `most` different entries is not gathered in one range. Its entries are halved by the place of the anchor in
the string, which makes the part that all strings of an entry share, and with it the key, longer: two keys in place of the gram,
each counted anew. Where an entry's strings are all repeated, halves become equal to others and are settled within their tasks;
where they are not, halves become unique and end; the others are halved again, down to single strings.

Defined cases: null is the empty text; texts under `length` bytes lose nothing; rows sharing an id, and rows without id, count as
documents of their own; cut texts are bytes and may split a character.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import BYTE_BASE, BYTE_VALUES, U, Rolling, byte_slices, column, discard, keep, mix, rolling_min, signed, table, text_key

LENGTH = 200
#: Places that an anchor can have in a string, a power of two: a first key is a gram of LENGTH - WIDTH + 1 bytes.
WIDTH = 128
#: Different entries of a key that one range compares.
MOST = 20_000
#: Entries that a range merges, about; bytes of strings that a task sorts at a time; suffixes drawn for the bounds of ranges.
BUCKET = 20_000
RUN_BYTES = 64 << 20
SAMPLE = 20_000

#: An entry: its strings begin from `hi` down to `lo` bytes before the anchor's place `at`. run: hash of all its bytes, for counts only.
ENTRIES = "key long, run long, row_id long, text_key long, at int, lo int, hi int"
NO_ID = -(1 << 63)
PLACE_BITS = 24


def _entries(length: int, width: int):
    gram, places = length - width + 1, U((1 << PLACE_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = column(batch, "row_id"), column(batch, "text_key")
            for rows, numbers, data, offsets in byte_slices(column(batch, "text"), length - 1):
                if len(data) < length:
                    continue
                rolling = Rolling(BYTE_VALUES[data], BYTE_BASE)
                i = np.arange(len(data) - gram + 1)
                grams = mix(rolling.of(i, i + gram))
                anchor = (rolling_min((grams & ~places) | i.astype(U), width) & places).astype(np.int64)
                doc = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(offsets))
                valid = doc[: len(anchor)] == doc[length - 1 :]
                same = np.zeros(len(anchor), dtype=bool)
                same[1:] = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1])
                heads, tails = np.flatnonzero(valid & ~same), np.flatnonzero(valid & ~np.append(same[1:], False))
                if not len(heads):
                    continue
                at = anchor[heads]
                of = pa.array(rows[doc[heads]])
                lo, hi = at - tails, at - heads
                whole = mix(rolling.of(heads, tails + length) + (lo * width + hi).astype(U))
                place = at - offsets[doc[heads]] + numbers[doc[heads]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(grams[at])), pa.array(signed(whole)), ids.take(of), keys.take(of), *(pa.array(x.astype(np.int32)) for x in (place, lo, hi))],
                    ["key", "run", "row_id", "text_key", "at", "lo", "hi"],
                )

    return run


def shared_length(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        x, y = a[known : known + step], b[known : known + step]
        if x[: n - known] == y[: n - known]:
            known = min(n, known + step)
            step *= 2
            continue
        while x[0] == y[0]:
            half = len(x) // 2
            if half and x[:half] == y[:half]:
                x, y, known = x[half:], y[half:], known + half
            else:
                x, y = x[: max(half, 1)], y[: max(half, 1)]
        return known
    return n


def front_coded(strings: list[bytes], names: Iterable[int]) -> bytes:
    """Sorted strings as (length shared with the one before, length of the rest, name, rest)."""
    out, last = [], b""
    for s, name in zip(strings, names, strict=True):
        k = shared_length(last, s)
        out.append(struct.pack("<HHI", k, len(s) - k, name) + s[k:])
        last = s
    return b"".join(out)


def decoded(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(length shared with the one before, string, name)"""
    at, last = 0, b""
    while at < len(data):
        k, rest, name = struct.unpack_from("<HHI", data, at)
        last = last[:k] + data[at + 8 : at + 8 + rest]
        at += 8 + rest
        yield k, last, name


class LoserTree:
    """Merges sorted runs. Each head carries the prefix length it shares with the string last taken out.

    Of two heads the one that shares more is the smaller; only equal lengths are compared, from there on, and the loser keeps
    what it is then known to share with the winner.
    """

    def __init__(self, runs: list[bytes]):
        self.sources = [decoded(r) for r in runs]
        self.k = 1
        while self.k < max(1, len(runs)):
            self.k *= 2
        self.heads: list[tuple[int, bytes, int] | None] = [next(s, None) for s in self.sources] + [None] * (self.k - len(runs))
        self.lcp = [0] * self.k
        self.losers = [0] * self.k
        self.winner = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = self.heads[a], self.heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        n = shared_length(x[1], y[1], self.lcp[a])
        first = x[1][n : n + 1] <= y[1][n : n + 1]
        win, lose = (a, b) if first else (b, a)
        self.lcp[lose] = n
        return win, lose

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        win, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, int, int]]:
        """(length shared with the one before, string, source, name)"""
        while (head := self.heads[self.winner]) is not None:
            source = self.winner
            yield self.lcp[source], head[1], source, head[2]
            self.heads[source] = new = next(self.sources[source], None)
            self.lcp[source] = new[0] if new is not None else 0
            win, node = source, (source + self.k) // 2
            while node:
                win, self.losers[node] = self._play(win, self.losers[node])
                node //= 2
            self.winner = win


def _listed(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """Row number, text and entries (at, lo, hi) of the rows of a batch."""
    texts, lists = column(batch, "text"), column(batch, "entries")
    flat = lists.flatten()
    found = list(zip(*(flat.field(k).to_pylist() for k in range(3)), strict=True))
    ends = np.cumsum(lists.value_lengths().to_numpy())
    for k, end in enumerate(ends.tolist()):
        yield k, texts[k].as_buffer().to_pybytes(), found[int(ends[k - 1]) if k else 0 : end]


def suffix_of(data: bytes, at: int, lo: int, hi: int, length: int, width: int) -> tuple[bytes, bytes]:
    """The string to the right of the anchor and the one to the left, reversed. Both begin with the bytes that all strings of the cell share.

    A cell is `width` neighbouring places of the anchor in a string; its number stands first.
    """
    cell = lo // width
    first, last = cell * width, cell * width + width - 1
    mark = bytes((cell,))
    return mark + data[at - first : at][::-1] + data[at : at + length - lo], mark + data[at : at + length - last] + data[at - hi : at][::-1]


def _refined(length: int, width: int):
    """The parts of listed entries in cells of `width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda *parts: int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)
        for batch in batches:
            ids, keys, out = column(batch, "row_id").to_pylist(), column(batch, "text_key").to_pylist(), []
            for k, data, entries in _listed(batch):
                for at, lo, hi in entries:
                    for cell in range(lo // width, hi // width + 1):
                        a, b = max(lo, cell * width), min(hi, cell * width + width - 1)
                        shared = data[at - cell * width : at + length - (cell * width + width - 1)]
                        out.append((digest(bytes((cell,)), shared), digest(bytes((cell, a, b)), data[at - b : at + length - a]), ids[k], keys[k], at, a, b))
            kinds = (*(pa.int64(),) * 4, *(pa.int32(),) * 3)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["key", "run", "row_id", "text_key", "at", "lo", "hi"])

    return run


def _sampled(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {suffix_of(data, *e, length, width)[0][: length - width + 2] for _, data, entries in _listed(batch) for e in entries}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["suffix"])

    return run


CODED = "range long, right binary, left binary, row_ids array<long>, text_keys array<long>, ats array<int>, los array<int>, his array<int>, gone array<boolean>"


def _sorted_runs(length: int, width: int, bounds: list[bytes], run_bytes: int):
    """Two front-coded sorted runs for each range that a task's entries fall into, and whose they are.

    Of equal entries of one run the first is sent in both orders; all of them are marked as gone.
    """
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
    names = [x.split()[0] for x in CODED.split(", ")]

    def flush(entries: list[tuple]) -> pa.RecordBatch:
        entries.sort()
        sent: list[tuple] = []
        gone: list[tuple] = []
        for e in entries:
            if sent and e[:2] == sent[-1][:2]:
                if not sent[-1][7]:
                    sent[-1] = (*sent[-1][:7], True)
                gone.append(e)
            else:
                sent.append(e)
        rows = []
        edges = [0, *(bisect_left(sent, (b,)) for b in bounds), len(sent)]
        spare = [0, *(bisect_left(gone, (b,)) for b in bounds), len(gone)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            mine, others = sent[a:b], gone[spare[k] : spare[k + 1]]
            if not mine:
                continue
            order = sorted(range(len(mine)), key=lambda i: mine[i][1])  # noqa: B023
            both = mine + others
            rows.append((k, front_coded([e[0] for e in mine], range(len(mine))), front_coded([mine[i][1] for i in order], order), *([e[c] for e in both] for c in range(2, 7)), [e[7] for e in mine] + [True] * len(others)))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple] = []
        size = 0
        for batch in batches:
            ids, keys, twice = column(batch, "row_id").to_pylist(), column(batch, "text_key").to_pylist(), column(batch, "twice").to_pylist()
            for k, data, listed in _listed(batch):
                for at, lo, hi in listed:
                    right, left = suffix_of(data, at, lo, hi, length, width)
                    entries.append((right, left, ids[k], keys[k], at, lo, hi, twice[k]))
                    size += len(right) + len(left) + 200
                if size >= run_bytes:
                    yield flush(entries)
                    entries, size = [], 0
        if entries:
            yield flush(entries)

    return run


def reaches(right: list[int], left: list[int], place: np.ndarray, sizes_r: np.ndarray, sizes_l: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the entries of one key, in right order: how far repeated strings reach to the left and right of the anchor, 0 if there are none.

    right, left: lengths shared with the one before in either order; place: of the left order's entries in the right one.
    """
    m = len(place)
    if m == 2:
        good = right[1] + left[1] >= length
        return np.full(2, left[1] * good), np.full(2, right[1] * good)
    go_l, go_r = np.zeros(m, np.int64), np.zeros(m, np.int64)
    if m <= 64:
        shared = []
        for lcp in (right, left):
            grid = np.zeros((m, m), np.int64)
            for i in range(m - 1):
                grid[i, i + 1 :] = np.minimum.accumulate(lcp[i + 1 :])
            shared.append(np.maximum(grid, grid.T))
        r, l = shared[0], np.zeros((m, m), np.int64)
        l[np.ix_(place, place)] = shared[1]
        good = (r + l >= length) & ~np.eye(m, dtype=bool)
        return np.where(good, l, 0).max(axis=1, initial=0), np.where(good, r, 0).max(axis=1, initial=0)
    lcp_r, lcp_l = np.array(right), np.array(left)
    for a in range(max(0, length - int(sizes_r.max())), int(sizes_l.max()) + 1):
        fits = (sizes_l >= a) & (sizes_r >= length - a)
        if fits.sum() < 2:
            continue
        class_r = np.cumsum(lcp_r < length - a)
        class_l = np.empty(m, np.int64)
        class_l[place] = np.cumsum(lcp_l < a) if a else 0
        _, back, count = np.unique((class_r * (m + 1) + class_l)[fits], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(fits)[count[back] > 1]
        go_l[twice] = np.maximum(go_l[twice], a)
        go_r[twice] = np.maximum(go_r[twice], length - a)
    return go_l, go_r


def _merge(length: int, width: int):
    key_bytes = length - width + 2

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        meta = [np.concatenate([np.array(r[c]) for r in rows]) for c in ("row_ids", "text_keys", "ats", "los", "his", "gone")]
        base = np.cumsum([0, *(len(r["ats"]) for r in rows)]).tolist()
        right, left = ([(lcp, s, base[source] + name) for lcp, s, source, name in LoserTree([r[side] for r in rows])] for side in ("right", "left"))
        out: list[tuple] = [(int(ids), int(key), int(at - hi), int(at + length - lo)) for ids, key, at, lo, hi, gone in zip(*meta, strict=True) if gone]
        at = 0
        # Where the left order is in its own sequence of keys, each key's entries stand together in it too.
        place_left = {x[2]: k for k, x in enumerate(left)}
        while at < len(right):
            to = at + 1
            while to < len(right) and right[to][0] >= key_bytes:
                to += 1
            if to - at > 1:
                mine = right[at:to]
                begin = min(place_left[x[2]] for x in mine)
                others = left[begin : begin + to - at]
                where = {x[2]: k for k, x in enumerate(mine)}
                place = np.array([where[x[2]] for x in others])
                first = mine[0][1][0] * width
                extra_r, extra_l = 1 + first, 1 + length - (first + width - 1)
                sizes_l = np.zeros(to - at, np.int64)
                sizes_l[place] = [len(x[1]) - extra_l for x in others]
                go_l, go_r = reaches([x[0] - extra_r for x in mine], [x[0] - extra_l for x in others], place, np.array([len(x[1]) - extra_r for x in mine]), sizes_l, length)
                for k in np.flatnonzero(go_r):
                    x = mine[k][2]
                    out.append((int(meta[0][x]), int(meta[1][x]), int(meta[2][x] - go_l[k]), int(meta[2][x] + go_r[k])))
            at = to
        return pa.table({c: pa.array([x[k] for x in out], t) for k, (c, t) in enumerate((("row_id", pa.int64()), ("text_key", pa.int64()), ("a", pa.int32()), ("b", pa.int32())))})

    return run


def removals(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, most: int = MOST, bucket: int = BUCKET, run_bytes: int = RUN_BYTES, sample: int = SAMPLE) -> DataFrame:
    """Of docs (row_id, text_key, text): row_id, text_key and spans, an array of (a, b) of removed bytes, unmerged."""
    entries, texts, spans = keep(docs.mapInArrow(_entries(length, width), ENTRIES)), None, None
    while True:
        counts = entries.groupBy("key").agg(F.count("*").alias("times"), (F.min("run") != F.max("run")).alias("differ")).where("times > 1")
        shared = keep(counts.select("key", (F.col("differ") & (F.col("times") > most)).alias("crowded")))
        found = keep(entries.join(shared, "key"))
        crowd = found.where("crowded").groupBy("key", "run").count().groupBy("key").count().where(F.col("count") > most)
        crowd = keep(crowd.select("key", F.lit(True).alias("hot")))
        listed = found.join(crowd, "key", "left").select("row_id", "text_key", "at", "lo", "hi", F.coalesce("hot", F.lit(False)).alias("hot"))
        listed = listed.groupBy("row_id", "text_key", "hot").agg(F.collect_set(F.struct("at", "lo", "hi")).alias("entries"))
        if texts is None:
            # Rows with one id and text stand as one; all their strings are repeated.
            source = docs.groupBy("row_id", "text_key").agg(F.first("text").alias("text"), (F.count("*") > 1).alias("twice"))
        else:
            source = texts.where("hot").drop("hot", "entries")
        texts = keep(source.join(listed, ["row_id", "text_key"]))
        discard(entries)
        discard(found)
        n, hot = texts.agg(F.sum(F.when(~F.col("hot"), F.size("entries"))), F.count_if("hot")).first()
        some = texts.where("NOT hot")
        bounds: list[bytes] = []
        if (ranges := -(-(n or 0) // bucket)) > 1:
            drawn = some.where(F.pmod(F.xxhash64("row_id", "text_key", F.lit("bounds")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, sample / n)))
            suffixes = sorted({r[0] for r in drawn.select("text", "entries").mapInArrow(_sampled(length, width), "suffix binary").limit(4 * sample).collect()})
            bounds = sorted({bytes(suffixes[len(suffixes) * k // ranges]) for k in range(1, ranges)}) if suffixes else []
        coded = some.select("row_id", "text_key", "text", "twice", "entries").mapInArrow(_sorted_runs(length, width, bounds, run_bytes), CODED)
        mine = coded.groupBy("range").applyInArrow(_merge(length, width), "row_id long, text_key long, a int, b int")
        spans = mine if spans is None else spans.union(mine)
        if not hot:
            return spans.groupBy("row_id", "text_key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
        width //= 2
        entries = keep(texts.where("hot").select("row_id", "text_key", "text", "entries").mapInArrow(_refined(length, width), ENTRIES))


def remove(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, most: int = MOST, bucket: int = BUCKET, run_bytes: int = RUN_BYTES, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, out: str = "dedup") -> DataFrame:
    """docs' rows and columns (but for those named as `out`, suffix_id, suffix_key or suffix_spans) with `out` = struct(n_bytes, n_removed, n_spans, kept_sha256, kept)."""
    docs = docs.drop(out, "suffix_id", "suffix_key", "suffix_spans")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    keyed = docs.withColumns({"suffix_id": ident, "suffix_key": text_key(text_col)})
    spans = removals(keyed.select(F.col("suffix_id").alias("row_id"), F.col("suffix_key").alias("text_key"), F.coalesce(text_col, F.lit("")).alias("text")), length, width, most, bucket, run_bytes)
    spans = spans.select(F.col("row_id").alias("suffix_id"), F.col("text_key").alias("suffix_key"), F.col("spans").alias("suffix_spans"))
    joined = keyed.join(spans, ["suffix_id", "suffix_key"], "left").drop("suffix_id", "suffix_key")
    kind = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])
    schema, names, fields = T.StructType([*docs.schema.fields, T.StructField(out, kind)]), docs.columns, kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists, rows = column(batch, text_col), column(batch, "suffix_spans"), []
            for k in range(batch.num_rows):
                data = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
                parts, at, cuts = [], 0, 0
                if lists[k].is_valid:
                    pairs = lists[k].values
                    a, b = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                    order = np.argsort(a, kind="stable")
                    far = -1
                    for lo, hi in zip(a[order].tolist(), b[order].tolist(), strict=True):
                        if lo > far:
                            parts.append(data[at:lo])
                            cuts += 1
                        far = max(far, hi)
                        at = far
                parts.append(data[at:])
                kept = b"".join(parts)
                rows.append((len(data), len(data) - len(kept), cuts, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            more = pa.StructArray.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], fields)
            yield pa.RecordBatch.from_arrays([*(column(batch, x) for x in names), more], [*names, out])

    return joined.mapInArrow(run, schema)


def op2_suffix(spark, sf_dir: str) -> DataFrame:
    found = remove(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", "dedup.kept_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, unnest(range(0, greatest(strlen(h) // 2 - 199, 0))) AS pos, h FROM d),
k AS (SELECT r, pos, md5(substr(h, (2 * pos + 1)::BIGINT, 400)) AS key FROM s),
hit AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY key) AS n FROM k) WHERE n > 1),
runs AS (SELECT r, pos, CASE WHEN pos <= max(pos) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200 THEN 0 ELSE 1 END AS head FROM hit),
numbered AS (SELECT r, pos, sum(head) OVER (PARTITION BY r ORDER BY pos) AS span FROM runs),
spans AS (SELECT r, span, min(pos) AS a, max(pos) + 200 AS b FROM numbered GROUP BY 1, 2),
gaps AS (SELECT r, span, b AS a, lead(a) OVER (PARTITION BY r ORDER BY a) AS b FROM spans UNION ALL SELECT r, 0, 0, min(a) FROM spans GROUP BY 1),
kept AS (SELECT d.r, string_agg(substr(h, (2 * g.a + 1)::BIGINT, (2 * (coalesce(g.b, strlen(h) // 2) - g.a))::BIGINT), '' ORDER BY g.a) AS h FROM d JOIN gaps g USING (r) GROUP BY 1),
sums AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT doc_id, (strlen(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept k USING (r)
"""
