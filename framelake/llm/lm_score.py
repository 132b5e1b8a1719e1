"""LM scoring by cross-entropy difference.

Two interpolated bigram models, of the target texts and of a background that is disjoint from them, share one vocabulary: every word and pair of words
of all texts, each known by 63 bits of its hash. Nothing is capped or folded, so the models grow with the corpus; they are never gathered in one place.

The models are matched: of the larger side, target or the rest, each text takes part with an even share of its rows, so that both have
the same number of tokens. Of r rows of a text floor(r * share + u) do, u being a number from 0 up to 1 that the text's digest says. And a
text is scored without itself: what its own rows have added to either model is taken away, so a score tells what a text is like, not
on which list it stands.

Equal texts have equal scores, so each distinct text (by SHA-256) is counted with its number of rows and of target rows. A task sends
a text it meets again as a number only, so a text with a third of the rows arrives once a task. Texts are dealt into groups of about
`group_bytes` by their digest, and so are the ids of target rows, by way of the digests of their texts: neither ids nor texts that come
often make a hot group. A group counts its words and pairs and sends them, sorted and packed, in one block for each range of keys, of
which there is one for `range_bytes` of text. A range adds up its blocks and answers each with what the other groups have counted of the same
keys; with these a group scores its texts, and rows get their text's score by its digest. A key comes at most once a block, so a
range holds its even share of keys, and of a frequent word a count a group.

Blocks are as many as groups times ranges: 5 million at 30 GB. For many terabytes raise both sizes with the memory of a task, so that
a block still holds many keys; results stay the same.

P(w | v) = a * c(v w) / c(v) + b * c(w) / n + c / N, with c() and n, the tokens, of the model's texts but the one that is scored, and N those of all
texts; where a model has no tokens, P = 1 / N. A text's
score is the mean over its tokens of the loss under the target model less the loss under the background model, in
nats; the lower, the closer to the target.

Defined cases: null and empty texts have no tokens and a null score; without target texts, or with no others, both models are uniform over
the vocabulary and scores are 0; rows that share an id are scored each by itself and are target texts together; rows without an id are
never target texts; an empty table gives an empty table; columns named like the results, lm_digest or lm_scored, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import U, WORD_BASE, column, hash_words, keep, mix, table, word_slices

GROUP_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
#: Weights of the pair, the word and the uniform distribution.
WEIGHTS = (0.6, 0.35, 0.05)
WORD = r"[^\x20\x09-\x0D]+"
#: Keys of words are odd, those of pairs even. Two odd ones are set aside: the begin of a text, and the number of tokens.
BEGIN, TOKENS = U(1), U(3)
#: Rows of a group: a text with its rows so far (null: it has come before in its task), or a number of target rows of a text.
TEXTS = "lm_group long, digest binary, text string, n long, t long"
#: A block holds `m` keys and counts.
BLOCKS = "lm_group long, lm_range long, m long, block binary"
SCORES = "digest binary, n_tokens long, loss_target double, loss_background double, score double"
RESULTS = ("n_tokens", "loss_target", "loss_background", "score")


class Group:
    """The words and pairs of a group's texts: sorted keys, their counts here in the target and the background rows, and each token's places."""

    def __init__(self, texts: pa.Array, in_target: np.ndarray, in_background: np.ndarray):
        words, pairs = [np.zeros(0, U)], [np.zeros(0, U)]
        self.lengths = np.zeros(len(texts), np.int64)
        for rows, numbers, data, _, starts, ends, first in word_slices(texts, 1):
            word = hash_words(data, starts, ends) | U(1)
            before = np.empty_like(word)
            before[1:] = word[:-1]
            before[first[:-1][first[:-1] < first[1:]]] = BEGIN
            pair = mix(before * U(WORD_BASE) + word) & ~U(1)
            again = int(numbers[0] > 0)
            # A further piece of a long text begins with the last word of the piece before, which is counted there.
            words.append(word[again:])
            pairs.append(pair[again:])
            np.add.at(self.lengths, rows, np.diff(first))
            self.lengths[rows[0]] -= again
        self.ends = np.cumsum(self.lengths)
        self.heads = (self.ends - self.lengths)[self.lengths > 0]
        word, pair = np.concatenate(words), np.concatenate(pairs)
        self.keys, at = np.unique(np.concatenate([word, pair, [BEGIN, TOKENS]]), return_inverse=True)
        self.word, self.pair, (self.begin, self.tokens) = at[: len(word)], at[len(word) : -2], at[-2:]
        self.rows = (in_target, in_background)
        self.counts = [self._counted(r) for r in self.rows]

    def _counted(self, rows: np.ndarray) -> np.ndarray:
        each, m = np.repeat(rows, self.lengths), len(self.keys)
        found = np.bincount(self.word, weights=each, minlength=m).astype(np.int64) + np.bincount(self.pair, weights=each, minlength=m).astype(np.int64)
        found[[self.begin, self.tokens]] = int(rows[self.lengths > 0].sum()), int(each.sum())
        return found

    def add(self, *others: np.ndarray) -> None:
        """Add what other groups have counted, a number for each key in order."""
        self.counts = [mine + other for mine, other in zip(self.counts, others, strict=True)]

    def _own(self, key: np.ndarray, text: np.ndarray) -> np.ndarray:
        """How often each token's key comes in its own text."""
        _, at, n = np.unique(text * len(self.keys) + key, return_inverse=True, return_counts=True)
        return n[at] if len(key) else key

    def losses(self, weights: tuple[float, float, float], n_tokens: int) -> list[np.ndarray]:
        """Mean loss of each text under either model without itself; not a number for texts without tokens."""
        text = np.repeat(np.arange(len(self.lengths)), self.lengths)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.heads] = self.begin
        own_word, own_pair = self._own(self.word, text), self._own(self.pair, text)
        own_before = np.empty_like(own_word)
        own_before[1:] = own_word[:-1]
        own_before[self.heads] = 1
        flat, out = 1 / max(n_tokens, 1), []
        for counts, rows in zip(self.counts, self.rows, strict=True):
            r = rows[text]
            total = counts[self.tokens] - r * self.lengths[text]
            likely = weights[0] * (counts[self.pair] - r * own_pair) / np.maximum(counts[before] - r * own_before, 1) + weights[1] * (counts[self.word] - r * own_word) / np.maximum(total, 1) + weights[2] * flat
            sums = np.concatenate([[0.0], np.cumsum(-np.log(np.where(total > 0, likely, flat)))])
            with np.errstate(invalid="ignore", divide="ignore"):
                out.append((sums[self.ends] - sums[self.ends - self.lengths]) / self.lengths)
        return out


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    import zstandard

    planes = (np.ascontiguousarray(c.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(block: bytes, m: int) -> np.ndarray:
    """The packed columns, one a row."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(-1, 8, m)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(U).reshape(-1, m)


def _blocks(group, ranges, sizes, blocks) -> pa.Table:
    return pa.table({"lm_group": pa.array(group, pa.int64()), "lm_range": pa.array(ranges, pa.int64()), "m": pa.array(sizes, pa.int64()), "block": pa.array(blocks, pa.binary())})


def _send(number: int, group: Group, n_ranges: int) -> pa.Table:
    """The group's counts, in a block for each range that has any."""
    of = ((group.keys >> U(32)) * U(n_ranges)) >> U(32)
    cuts = np.concatenate([np.flatnonzero(np.diff(of, prepend=of[:1] + U(1))), [len(of)]])
    steps = [pack(np.diff(group.keys[a:b], prepend=U(0)), *(c[a:b] for c in group.counts)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return _blocks(np.full(len(steps), number), of[cuts[:-1]].astype(np.int64), np.diff(cuts), steps)


def _answer(sent: pa.Table) -> pa.Table:
    """For each block of a range, what other blocks have counted of its keys."""
    sizes = sent.column("m").to_numpy()
    found = np.concatenate([unpack(b.as_py(), m) for b, m in zip(sent.column("block"), sizes, strict=True)], axis=1)
    ends = np.cumsum(sizes)
    keys = found[0]
    for a, b in zip(ends - sizes, ends, strict=True):
        keys[a:b] = np.cumsum(keys[a:b])
    _, at = np.unique(keys, return_inverse=True)
    others = []
    for own in found[1:]:
        sums = np.zeros(at.max() + 1, U)
        np.add.at(sums, at, own)
        others.append(sums[at] - own)
    answers = [pack(others[0][a:b], others[1][a:b]) for a, b in zip(ends - sizes, ends, strict=True)]
    return _blocks(sent.column("lm_group"), sent.column("lm_range"), sent.column("m"), answers)


def _once(n_groups: int):
    """Each text of a task once, later rows of it as a number at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again: dict[bytes, int] = {}
        group = lambda d: int.from_bytes(d[:7], "big") % n_groups
        for batch in batches:
            digests, new = column(batch, "digest").to_pylist(), []
            for k, d in enumerate(digests):
                if d in again:
                    again[d] += 1
                else:
                    again[d] = 0
                    new.append(k)
            mine = [digests[k] for k in new]
            yield _text_rows([group(d) for d in mine], mine, column(batch, "text").take(pa.array(new, pa.int64())), [1] * len(new))
        rest = [(d, n) for d, n in again.items() if n]
        for at in range(0, len(rest), 10_000):
            mine = [d for d, _ in rest[at : at + 10_000]]
            yield _text_rows([group(d) for d in mine], mine, pa.nulls(len(mine), pa.string()), [n for _, n in rest[at : at + 10_000]])

    return run


def _text_rows(groups: list[int], digests: list[bytes], texts: pa.Array, n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(digests, pa.binary()), texts.cast(pa.string()), pa.array(n, pa.int64()), pa.array([0] * len(groups), pa.int64())], ["lm_group", "digest", "text", "n", "t"])


def _part(rows: np.ndarray, share: float, digests: list[bytes]) -> np.ndarray:
    """How many of each text's rows take part."""
    u = np.array([int.from_bytes(d[-6:], "big") for d in digests], np.float64) / (1 << 48)
    return np.floor(rows * share + u).astype(np.int64) if share < 1 else rows


def _gathered(rows: pa.Table, shares: tuple[float, float]) -> tuple[list[bytes], Group]:
    """The distinct texts of a group, in the order of their digests, and their counts; shares: of the target rows and of the others that take part."""
    digests = rows.column("digest").to_pylist()
    known = {d: k for k, d in enumerate(sorted(set(digests)))}
    at = np.array([known[d] for d in digests], np.int64)
    n, t, place = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    np.add.at(n, at, rows.column("n").to_numpy())
    np.add.at(t, at, rows.column("t").to_numpy())
    has = np.flatnonzero(rows.column("text").is_valid().to_numpy())
    place[at[has]] = has
    texts = rows.column("text").cast(pa.large_string()).combine_chunks()
    return list(known), Group(texts.take(pa.array(place)), _part(t, shares[0], list(known)), _part(n - t, shares[1], list(known)))


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, float, float] = WEIGHTS, group_bytes: int = GROUP_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs with n_tokens, loss_target, loss_background (means, in nats) and score, their difference. `target` holds the ids of the target texts."""
    docs = docs.drop(*RESULTS, "lm_digest", "lm_scored")
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    # A row of some bytes for each text, of which ids meet the target's.
    narrow = keep(docs.select(ident.alias("lm_id"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens")).where("size > 0"))
    wanted = target.where(ident.isNotNull()).select(ident.alias("lm_id")).distinct()
    mine = keep(narrow.join(wanted, "lm_id", "left_semi").groupBy("digest").agg(F.count("*").alias("t"), F.sum("tokens").alias("tokens")))
    size, n_tokens = (x or 0 for x in narrow.agg(F.sum("size"), F.sum("tokens")).first())
    n_target = mine.agg(F.sum("tokens")).first()[0] or 0
    n_others = n_tokens - n_target
    shares = (min(1.0, n_others / max(n_target, 1)), min(1.0, n_target / max(n_others, 1)))
    n_groups, n_ranges = -(-size // group_bytes) or 1, -(-size // range_bytes) or 1
    own = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(*own, digest.alias("lm_digest"))
    found = docs.where(text != "").select(digest.alias("digest"), text.alias("text")).mapInArrow(_once(n_groups), TEXTS)
    group = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 14), 16, 10).cast("long"), F.lit(n_groups))
    marks = mine.select(group.alias("lm_group"), "digest", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "t")
    grouped = found.unionByName(marks)

    def count(rows: pa.Table) -> pa.Table:
        return _send(rows.column("lm_group")[0].as_py(), _gathered(rows, shares)[1], n_ranges)

    def judge(rows: pa.Table, answers: pa.Table) -> pa.Table:
        digests, group = _gathered(rows, shares)
        back = answers.sort_by("lm_range")
        others = np.concatenate([unpack(b.as_py(), m.as_py()) for b, m in zip(back.column("block"), back.column("m"), strict=True)], axis=1)
        group.add(*others.astype(np.int64))
        a, b = group.losses(weights, n_tokens)
        none = group.lengths == 0
        return pa.table([pa.array(digests, pa.binary()), pa.array(group.lengths), *(pa.array(x, mask=none) for x in (a, b, a - b))], names=["digest", *RESULTS])

    answered = grouped.groupBy("lm_group").applyInArrow(count, BLOCKS).groupBy("lm_range").applyInArrow(_answer, BLOCKS)
    scores = grouped.groupBy("lm_group").cogroup(answered.groupBy("lm_group")).applyInArrow(judge, SCORES)
    joined = named.join(scores.withColumnRenamed("digest", "lm_scored"), F.col("lm_digest") == F.col("lm_scored"), "left")
    return joined.select(*own, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), *RESULTS[1:])


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    """Target: the documents labelled quality 1. Background: the others, matched. The labels grow with them, so they are never broadcast."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(docs, good).drop("text")
