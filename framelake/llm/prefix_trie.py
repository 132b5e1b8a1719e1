"""Prefix trie of conversations by prefix doubling.

Turns get dense names, equal ones the same. In each round neighbouring blocks of 2 ** k turns are joined in pairs, and distinct pairs of names get
dense names in turn, so that after a logarithm of the longest conversation's rounds every aligned block of a power of two turns is known
by one number. A prefix of d turns is put together from the blocks of d's binary decomposition, the longest first: in round r all
prefixes whose length has r bits set join the prefix without their last block, and (length, prefix, block) is named again. Equal
names are equal prefixes: the nodes. Sums over subtrees double as well: in round k a node passes what it holds of its
descendants closer than 2 ** k to its ancestor 2 ** k above, which is named by a member's shorter prefix.

Groups do not grow into one task: the order of turns is a range sort whose places are counted on from task to task; names are
joined to members by joins, which split; counts are summed before their exchange. The ids of the conversations that end at a node are put
into strings range by range, and one SHA-256 reads a node's strings in order, a stream of constant memory.

Defined cases: rows without conv_id take no part; null turns stand first; rows of one turn stand by the SHA-256 of role and text (with the
role's length in bytes before it); repeated rows are turns of their own; a null role or text is the empty one; a conversation of one's own
base (conv_id % 20 = 0) stays as it is, as conv_id - conv_id % 20, towards zero for negative ids; without rows there is no node, not
even a root; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import column, discard, keep, table

WORD_GAPS = r"[\x20\x09-\x0D]+"
BASE = 20
HEADS = 4
#: Ids of one string of a node's ends.
CHUNK_IDS = 8192
TASK_BITS = 33
EMPTY = hashlib.sha256(b"").hexdigest()


def positioned(turns: DataFrame) -> DataFrame:
    """conv, pos (from 0), turn_key and words, for the rows with a conv_id."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_key"), F.size(F.filter(F.split(text, WORD_GAPS), lambda w: w != "")).cast("long").alias("words"))
    order = ["conv", F.asc_nulls_first("turn"), "turn_key"]
    # Equal rows may stand in any order: the number of a row spreads them over tasks.
    ranged = named.select("*", F.monotonically_increasing_id().alias("row_no")).repartitionByRange(*order, "row_no").sortWithinPartitions(*order)
    placed = keep(ranged.select("conv", "turn_key", "words", F.monotonically_increasing_id().alias("place")).select("*", F.shiftright("place", TASK_BITS).alias("task")))
    spans = placed.groupBy("conv", "task").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select("conv", "task", "begin", before.alias("before"))
    return placed.join(starts, ["conv", "task"]).select("conv", (F.col("before") + F.col("place") - F.col("begin")).alias("pos"), "turn_key", "words")


def dense(keys: DataFrame, name: str, first: int = 0) -> tuple[DataFrame, int]:
    """The distinct rows of keys, numbered from `first` without gaps in a kept table, and the number after the last."""
    placed = keep(keys.distinct().select("*", F.monotonically_increasing_id().alias("place")))
    # One count a task.
    sizes = dict(placed.groupBy(F.shiftright("place", TASK_BITS).alias("task")).count().collect())
    begins, at = [], first
    for task in range(max(sizes, default=-1) + 1):
        begins.append(at)
        at += sizes.get(task, 0)
    begin = F.element_at(F.from_json(F.lit(json.dumps(begins)), "array<long>"), F.shiftright("place", TASK_BITS).cast("int") + 1)
    return placed.select(*keys.columns, (begin + F.col("place").bitwiseAND((1 << TASK_BITS) - 1)).alias(name)), at


def rebuilt(turns: DataFrame, base: int = BASE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv, d from 1, name of the turn, words) of the rebuilt conversations, and (conv, m) their lengths, none left out."""
    placed = positioned(turns)
    names, _ = dense(placed.select("turn_key"), "name")
    own = keep(placed.join(names, "turn_key").select("conv", "pos", "name", "words"))
    lengths = own.groupBy("conv").agg(F.count("*").alias("n"))
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(heads))
    asked = lengths.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % base).alias("base_conv"))
    bases = lengths.select(F.col("conv").alias("base_conv"), F.col("n").alias("base_n"))
    taken = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = keep(asked.join(bases, "base_conv", "left").select("conv", "base_conv", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m")))
    tails = own.join(convs, "conv").where("pos >= h").select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("d"), "name", "words")
    starts = own.where(F.col("pos") < heads - 1).select(F.col("conv").alias("base_conv"), "pos", "name", "words")
    fronts = convs.join(starts, "base_conv").where("pos < h").select("conv", (F.col("pos") + 1).alias("d"), "name", "words")
    return keep(tails.unionByName(fronts)), convs.select("conv", "m")


def blocks(turns: DataFrame, longest: int) -> DataFrame:
    """conv, d, block: for each prefix length the name of the last block of its binary decomposition."""
    level = turns.select("conv", (F.col("d") - 1).alias("j"), "name")
    out, k = [], 0
    while True:
        # Block j of this level ends at turn (j + 1) << k; the even ones are the last of a decomposition.
        out.append(level.where(F.col("j") % 2 == 0).select("conv", F.expr(f"shiftleft(j + 1, {k})").alias("d"), F.col("name").alias("block")))
        if 2 << k > longest:
            return reduce(DataFrame.unionByName, out)
        even = F.col("j") % 2 == 0
        pairs = level.groupBy("conv", F.shiftright("j", 1).alias("half")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        names, _ = dense(pairs.select("a", "b"), "name")
        level = keep(pairs.join(names, ["a", "b"]).select("conv", F.col("half").alias("j"), "name"))
        k += 1


def prefixes(turns: DataFrame, convs: DataFrame, longest: int) -> DataFrame:
    """conv, d, node: the name of each prefix, that of no turns included (0)."""
    last = blocks(turns, longest).select("*", F.bit_count("d").alias("bits"))
    known = convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("node"))
    out, free = [known], 1
    for bits in range(1, longest.bit_length() + 1):
        mine = last.where(F.col("bits") == bits).select("conv", "d", "block", F.expr("d - (d & -d)").alias("shorter_d"))
        shorter = known.select("conv", F.col("d").alias("shorter_d"), F.col("node").alias("shorter"))
        whole = mine.select("conv", "d", "block", F.lit(0).cast("long").alias("shorter")) if bits == 1 else mine.join(shorter, ["conv", "shorter_d"]).select("conv", "d", "block", "shorter")
        names, free = dense(whole.select("d", "shorter", "block"), "node", free)
        known = keep(whole.join(names, ["d", "shorter", "block"]).select("conv", "d", "node"))
        out.append(known)
    return reduce(DataFrame.unionByName, out)


def ends(members: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """node and ends_sha256 of the conversations (node, conv) that end there."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []
        done: list[tuple[int, int, str]] = []

        def close() -> None:
            if held:
                done.append((node, held[0], ",".join(map(str, held))))
                held.clear()

        for batch in batches:
            for n, c in zip(column(batch, "node").to_pylist(), column(batch, "conv").to_pylist(), strict=True):
                if n != node or len(held) == chunk_ids:
                    close()
                    node = n
                held.append(c)
            yield _rows(done)
            done.clear()
        close()
        yield _rows(done)

    def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["node", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            found: list[tuple[int, str]] = []
            for n, ids in zip(column(batch, "node").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                if n == node:
                    state.update(b",")
                else:
                    if node is not None:
                        found.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                state.update(ids.encode())
            yield _digests(found)
        yield _digests([] if node is None else [(node, state.hexdigest())])

    def _digests(found: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["node", "ends_sha256"])

    chunks = members.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(strings, "node long, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node long, ends_sha256 string")


def trie(turns: DataFrame, base: int = BASE, heads: int = HEADS, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """One row a node, as the contract of the query names them. heads - 1 turns at most are taken from the conversation conv_id - conv_id % base."""
    whole, convs = rebuilt(turns, base, heads)
    longest = convs.agg(F.max("m")).first()[0] or 0
    named = keep(prefixes(whole, convs, longest))
    firsts = keep(named.groupBy("node", "d").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")))
    above = named.select("conv", (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
    last = whole.select("conv", "d", "words")
    nodes = keep(firsts.join(above, ["conv", "d"], "left").join(last, ["conv", "d"], "left").select("node", "d", "conv", "n_convs", "parent", ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("saved")))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    counted = keep(nodes.join(children, "node", "left").select("node", "d", "conv", "n_convs", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), "saved"))
    sums = counted.select("node", "d", "conv", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    step = 1
    while step <= longest:
        higher = named.select("conv", (F.col("d") + step).alias("d"), F.col("node").alias("above"))
        passed = sums.join(higher, ["conv", "d"]).groupBy("above").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        added = sums.join(passed, F.col("node") == F.col("above"), "left").select("node", "d", "conv", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
        older, sums = sums, keep(added)
        if step > 1:
            discard(older)
        step *= 2
    ended = ends(named.join(convs, ["conv"]).where("d = m").select("node", "conv"), chunk_ids)
    parents = firsts.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    found = counted.join(sums.select("node", "n_leaves", "saved_tokens"), "node").join(ended, "node", "left").join(parents, "parent", "left")
    return found.select(F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH turns AS (
    SELECT conv_id AS c, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
    FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (SELECT c, key, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM turns),
ids AS (
    SELECT c, xor(list_reduce(flatten(list_prepend([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1),
                  lambda k: [ord(substr(c::VARCHAR, k, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                  lambda x, e: xor(xor(x, e) >> 1, CASE WHEN xor(x, e) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) % 4 AS h
    FROM (SELECT DISTINCT c FROM turns)
),
front AS (SELECT i.c, p.pos AS d, p.key, p.words FROM ids i JOIN placed p ON p.c = i.c - i.c % 20 AND p.pos < i.h),
taken AS (SELECT i.c, i.h, count(f.c) AS b FROM ids i LEFT JOIN front f ON f.c = i.c GROUP BY i.c, i.h),
whole AS (
    SELECT c, d + 1 AS d, key, words FROM front
    UNION ALL SELECT t.c, t.b + p.pos - t.h + 1, p.key, p.words FROM taken t JOIN placed p ON p.c = t.c AND p.pos >= t.h
),
prefix AS (
    SELECT c, d, sha256(string_agg(key, ' ') OVER (PARTITION BY c ORDER BY d)) AS node, words FROM whole
    UNION ALL SELECT c, 0, 'root', 0 FROM ids
),
lengths AS (SELECT c, max(d) AS m FROM prefix GROUP BY c),
nodes AS (
    SELECT node, any_value(d) AS d, min(p.c) AS c, count(*) AS n, max(words) AS words,
           coalesce(string_agg(p.c::VARCHAR, ',' ORDER BY p.c) FILTER (d = m), '') AS ends
    FROM prefix p JOIN lengths l ON p.c = l.c GROUP BY node
),
linked AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN prefix p ON p.c = n.c AND p.d = n.d - 1),
children AS (SELECT parent, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children k ON l.node = k.parent),
sums AS (
    SELECT a.node, sum((x.n_children = 0)::INT)::BIGINT AS n_leaves, sum((x.n - 1) * x.words)::BIGINT AS saved_tokens
    FROM counted x JOIN prefix a ON a.c = x.c AND a.d <= x.d GROUP BY a.node
)
SELECT x.c AS conv_id, x.d AS depth, p.c AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
FROM counted x JOIN sums USING (node) LEFT JOIN nodes p ON p.node = x.parent
"""
