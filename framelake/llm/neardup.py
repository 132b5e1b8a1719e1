"""Near-duplicates by Order MinHash, verified by banded alignment.

A document is its sequence of five-word shingles, each labelled with its occurrence number. Each hash function of a family
picks the least few labelled shingles, kept in text order; their hash is a key. Documents that share a
key are candidates. `picks` shingles by each of `tables` functions serve documents of LONG or more shingles; documents of under
SHORT shingles are picked from `short_picks` at a time, as six of few seldom agree. Both families serve the lengths in between, which are so many that any two
similar documents are in one family together. Two documents at exactly the wanted similarity share no key with a probability of 1e-4
at 24 shingles, 5e-6 at 4 and at hundreds. Texts so short that one shingle more or less is too much have only equal ones.

Candidates are verified by aligning the shingle sequences: with L the longest common subsequence, L / (a + b - L) must
reach `similarity`. No pair that reaches it has a match further off the diagonal than max(a, b) less the L needed, so only
that band is computed, bit-parallel, a machine word for 64 of its cells.

Equal documents meet first, by the SHA-256 digest of their words; only one of them gives keys. Within a key no pairs of all members
are made: each member is compared with a hub, the member with the most company. The members of keys that this leaves in
several classes are the rest, and have an exact way: a prefix filter over their shingles, rarest first, with positions: two of them meet
where the shingles from there on could still be enough, which texts with a frequent passage alone, and far copies
of one text, do not reach. Rounds of up to HUBS members a key outside its largest class are compared with the members of
other classes and leave the key, until no key is open.
Classes are the connected components of the verified links.

Defined cases: rows without id or words form no class (class_id is the row's own id); texts under five words are one shingle;
rows that share an id are told apart by their texts; ties go to the smaller id.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import SPACED, U, WORD_BASE, WORD_BASE_2, Rolling, column, cut, hash_words, keep, mix, signed, table, text_key, word_slices

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 40
PICKS = 6
SHORT_TABLES, SHORT_PICKS = 24, 3
#: Shingles below which the family of fewer picks serves, and from which the other one does.
SHORT, LONG = 32, 24
#: Members of a key that are compared with its other classes in one round.
HUBS = 512

SKETCH = "doc_id long, text_key long, words binary, n int, keys array<long>"


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one document; all its words if they are fewer."""
    if not len(words):
        return words
    i = np.arange(max(1, len(words) - size + 1))
    return mix(Rolling(words, WORD_BASE).of(i, np.minimum(i + size, len(words))))


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its earlier occurrences."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    if head.all():
        return mix(hashes)
    at = np.arange(len(s))
    count = np.empty(len(s), dtype=U)
    count[order] = (at - np.maximum.accumulate(np.where(head, at, 0))).astype(U)
    return mix(hashes + count * U(WORD_BASE_2))


MULTIPLIERS = (mix(np.arange(1, 4097, dtype=U) * U(WORD_BASE)) | U(1)).reshape(-1, 1)


def order_minhash(h: np.ndarray, tables: int = TABLES, picks: int = PICKS) -> np.ndarray:
    """One key for each table: the hash of the least labelled shingles in text order."""
    n, bits = len(h), U(max(20, len(h).bit_length()))
    places = np.arange(n, dtype=U)
    low = (U(1) << bits) - U(1)
    keys = np.empty(tables, dtype=U)
    step = max(1, (1 << 18) // n)
    for t in range(0, tables, step):
        drawn = h * MULTIPLIERS[t : min(t + step, tables)]
        drawn &= ~low
        drawn |= places
        if n > picks:
            drawn.partition(picks - 1, axis=1)
            drawn = drawn[:, :picks]
        at = np.sort(drawn & low, axis=1)
        key = np.zeros(len(at), dtype=U)
        for k in range(at.shape[1]):
            key = mix(key * U(WORD_BASE) + h[at[:, k]])
        keys[t : t + len(at)] = key + np.arange(t, t + len(at), dtype=U)
    return mix(keys)


def sketch_keys(h: np.ndarray, similarity: float, tables: int, picks: int) -> np.ndarray:
    """The keys of a document's labelled shingles. Below similarity / (1 - similarity) shingles only equal documents are similar."""
    if len(h) < similarity / (1 - similarity) - 1e-9:
        return np.zeros(0, dtype=U)
    short = mix(order_minhash(h, SHORT_TABLES, SHORT_PICKS) ^ U(WORD_BASE_2)) if len(h) < SHORT else np.zeros(0, dtype=U)
    return np.concatenate([short, order_minhash(h, tables, picks)]) if len(h) >= LONG else short


def words_joined(data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """The words of each text, joined by one space."""
    inside = SPACED[data]
    stay = inside.copy()
    stay[1:] |= inside[:-1]
    kept = np.where(inside, data, np.uint8(0x20))[stay].tobytes()
    ends = np.concatenate([[0], np.cumsum(stay)])[offsets].tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        yield kept[a:b].strip(b" ")


def documents_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """Of each text its words' hashes and the digest of its words; long texts are read in pieces."""
    row, parts, digest = 0, [np.zeros(0, dtype=U)], hashlib.sha256()
    for rows, _, data, offsets, starts, ends, first in word_slices(texts, 0):
        hashes = hash_words(data, starts, ends)
        for k, (this, text) in enumerate(zip(rows.tolist(), words_joined(data, offsets), strict=True)):
            if this != row:
                yield np.concatenate(parts), digest.digest()
                row, parts, digest = this, [np.zeros(0, dtype=U)], hashlib.sha256()
            if first[k + 1] > first[k]:
                digest.update(b" " + text if len(parts) > 1 else text)
                parts.append(hashes[first[k] : first[k + 1]])
    if len(texts):
        yield np.concatenate(parts), digest.digest()


def sketch(size: int, similarity: float, tables: int, picks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys, n = [], [np.zeros(0, dtype=U)], []
            for words, digest in documents_of(column(batch, "text")):
                s = shingles(words, size)
                keys.append(sketch_keys(labelled(s), similarity, tables, picks) if len(s) else np.zeros(0, dtype=U))
                digests.append(digest)
                n.append(len(s))
            ends = np.cumsum([len(x) for x in keys])
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "text_key"), pa.array(digests, pa.binary()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(keys))))],
                ["doc_id", "text_key", "words", "n", "keys"],
            )

    return run


def common_length(a: list[int], b: list[int], need: int) -> int:
    """Length of the longest common subsequence within the band that `need` allows, or some number below need."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    band = max(len(a), len(b)) - need
    if band < 0:
        return 0
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    done = head + tail
    if done + min(len(a), len(b)) < need or not a or not b:
        return done
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    # Bits of the places from j - band to j + band of a. What leaves below is final; above, nothing has matched yet.
    width = 2 * band + 1
    top, full = 1 << (width - 1), (1 << width) - 1
    row, misses = full, 0
    for j, y in enumerate(b):
        if j:
            done += not row & 1
            row = (row >> 1) | top
        found = places.get(y)
        if found is None:
            misses += 1
            if misses > band:
                return 0
            continue
        match, low = 0, j - band
        for p in found if len(found) == 1 else found[bisect_left(found, low) : bisect_right(found, j + band)]:
            if 0 <= p - low < width:
                match |= 1 << (p - low)
        match &= row
        row = ((row + match) | (row - match)) & full
    return done + width - row.bit_count()


def alike(a: list[int], b: list[int], similarity: float = SIMILARITY) -> bool:
    if not a or not b:
        return False
    need = ceil(similarity * (len(a) + len(b)) / (1 + similarity) - 1e-9)
    return common_length(a, b, need) >= need


def _sequence(text: str, size: int) -> list[int]:
    words, _ = next(documents_of(pa.array([text])))
    return shingles(words, size).tolist()


def _verify(size: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple[str | None, list[int]] = (None, [])
        for batch in batches:
            good = []
            texts_a, texts_b = column(batch, "text_a"), column(batch, "text_b")
            for k in range(batch.num_rows):
                text = texts_a[k].as_py()
                if text != hub[0]:
                    hub = (text, _sequence(text, size))
                if alike(hub[1], _sequence(texts_b[k].as_py(), size), similarity):
                    good.append(k)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return run


def _shingle_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labelled(shingles(words, size)) for words, _ in documents_of(column(batch, "text"))]
            rows = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([column(batch, "node").take(pa.array(rows)), pa.array(signed(np.concatenate([np.zeros(0, dtype=U), *found])))], ["node", "h"])

    return run


def rare_keys(nodes: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """key, node, n, at: of each node (of n shingles) the rarest shingles by their place, one more than a similar one may lack."""
    some = texts.join(nodes, "node", "left_semi")
    kind = T.StructType([texts.schema["node"], T.StructField("h", T.LongType())])
    rows = keep(some.mapInArrow(_shingle_rows(size), kind))
    often = keep(rows.groupBy("h").agg(F.count("*").alias("often")))
    each = rows.join(often, "h").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("all"))
    take = F.size("all") - F.ceil(F.lit(similarity) * F.size("all") - 1e-9).cast("int") + 1
    placed = each.select("node", F.size("all").alias("n"), F.posexplode(F.slice("all", 1, take)).alias("at", "x"))
    return placed.where("x.often > 1").select(F.col("x.h").alias("key"), "node", "n", "at")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node of each connected component, for the nodes of links (a, b)."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")).select("node", F.least("node", "comp").alias("comp")))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        least = labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        new = cut(least.join(jump, least["comp"] == jump["via"]).select("node", F.least("comp", "far").alias("comp"), (F.least("comp", "far") != F.col("old")).alias("moved")))
        labels = new.select("node", "comp")
        if not new.where("moved").limit(1).count():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after these verified links (a, b)."""
    a = labels.select(F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    b = labels.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    between = keep(links.join(a, "a").join(b, "b").where("comp_a != comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct())
    if between.isEmpty():
        return labels
    moves = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return keep(labels.join(moves, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """The members, with comp, of keys in which more than one class is left; None if there are none."""
    at = members.join(labels, "node")
    keys = keep(at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key"))
    return None if keys.isEmpty() else keep(at.join(keys, "key").select(*members.columns, "comp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, tables: int = TABLES, picks: int = PICKS, hubs_a_round: int = HUBS) -> DataFrame:
    """One row a row of docs: doc_id, text_key (of the text), and class_id and class_key, those of its class's first member: of the least id, and of its texts the one of least key."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.coalesce(text_col, F.lit("")).alias("text"))
    sketched = keep(rows.mapInArrow(sketch(size, similarity, tables, picks), SKETCH))
    known = sketched.where("doc_id IS NOT NULL AND n > 0")
    classes = keep(known.groupBy("words").agg(F.min(F.struct("doc_id", "text_key")).alias("node"), F.first("keys").alias("keys")))
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("company")).where("company > 1")
    members = keep(keyed.join(keep(shared), "key").distinct())
    weights = members.groupBy("node").agg(F.sum("company").alias("weight"))
    members = keep(members.join(weights, "node").select("key", "node", "weight"))
    wanted = weights.select(F.col("node.doc_id").alias("doc_id"), F.col("node.text_key").alias("text_key"))
    texts = keep(rows.join(wanted, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]).select(F.struct("doc_id", "text_key").alias("node"), "text"))

    def verified(pairs: DataFrame) -> DataFrame:
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
        return keep(both.mapInArrow(_verify(size, similarity), pairs.select("a", "b").schema))

    hubs = members.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("a"))
    pairs = keep(members.join(keep(hubs), "key").where("a != node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
    labels = merged(weights.select("node", F.col("node").alias("comp")), verified(pairs))
    tested = pairs
    members, left = None, _open(members.select("key", "node"), labels)
    while left is not None:
        if members is None:
            members = keep(rare_keys(left.select("node").distinct(), texts, size, similarity))
            left = _open(members, labels)
            continue
        sizes = keep(left.groupBy("key", "comp").agg(F.count("*").alias("many")))
        largest = keep(sizes.groupBy("key").agg(F.max_by("comp", F.struct("many", "comp")).alias("largest")))
        minor = keep(sizes.join(largest, "key").where("comp != largest").select("key", "comp"))
        deal = F.pmod(F.xxhash64("node"), F.lit(hubs_a_round))
        hubs = left.join(minor, ["key", "comp"]).groupBy("key", deal).agg(F.min(F.struct("node", "comp", "n", "at")).alias("hub"))
        hubs = keep(hubs.select("key", F.col("hub.node").alias("a"), F.col("hub.comp").alias("comp_a"), F.col("hub.n").alias("n_a"), F.col("hub.at").alias("at_a")))
        reach = F.expr(f"comp != comp_a AND least(n - at, n_a - at_a) >= {similarity / (1 + similarity)!r} * (n + n_a) - 1e-9")
        fresh = left.join(hubs, "key").where(reach).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        pairs = keep(fresh.join(tested, ["a", "b"], "left_anti"))
        members = keep(left.join(hubs, (left["key"] == hubs["key"]) & (left["node"] == hubs["a"]), "left_anti").select("key", "node", "n", "at"))
        if not pairs.isEmpty():
            tested = tested.union(pairs)
            labels = merged(labels, verified(pairs))
        left = _open(members, labels)
    named = classes.join(labels, "node", "left").select("words", F.coalesce("comp", "node").alias("first"))
    found = known.select("doc_id", "text_key", "words").join(named, "words").select("doc_id", "text_key", F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("class_key"))
    rest = sketched.where("doc_id IS NULL OR n = 0").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.col("text_key").alias("class_key"))
    return found.union(rest)


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("stays"))
