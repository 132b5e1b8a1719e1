"""Filter interaction audit: what each of several filters removes in every order, alone and on average.

Every document gets one failure flag a filter. Documents are counted by part and flags, and a CUBE over the flags and the part
sums these counts: the row of a grouping set whose selected flags are all false counts what survives that subset of the filters. A
step of an order lies between two subsets, so a join of the pairs of subsets with the survivors, before and after, gives every step.

Flags of a document depend on its own text but for the copies: a text is known by its SHA-256 and its smallest doc_id is counted before
the exchange, so a text with a third of the rows leaves one row a task; the flag is then joined, which splits over tasks.

Defined cases: a null text is the empty one, which copies and is copied like others; a null source is the empty name; a row
without id has no labels and is no copy, and makes no copies; rows that share an id and a text are no copies of each other, and share the
labels; a document with several labels is good or toxic if one of them says so; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import keep, table

#: The least number of words, the least percentage of distinct words, and the largest percentage of capitals.
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
WORD_GAPS = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
FILTERS = "ABCDE"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The flags that a text alone decides: few words, repeated words, many capitals, marks."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the flags A to E, good and toxic, of each row of docs, whose texts are read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    split = named.select("*", F.filter(F.split("text", WORD_GAPS), lambda w: w != "").alias("words"))
    narrow = keep(split.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), *(c.alias(f) for f, c in failures(F.col("text"), F.col("words")).items())))
    copied = narrow.groupBy(F.col("text_key").alias("first_key")).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    # Kept, so that the join exchanges both sides and can split a text that many rows share.
    firsts = keep(copied.where("last_id > first_id").select("first_key", "first_id"))
    known = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # A key for rows without id that no label has, different from text to text.
    ident = F.coalesce(F.col("doc_id").cast("string"), F.hex("text_key"))
    joined = narrow.join(firsts, F.col("text_key") == F.col("first_key"), "left").join(known.where("label_id IS NOT NULL AND (good OR toxic)"), ident == F.col("label_id").cast("string"), "left")
    no = F.lit(False)
    return joined.select("part", *FILTERS[:-1], F.coalesce(F.col("doc_id") > F.col("first_id"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def survivors(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, mask and the counts n, n_good, n_toxic of documents that pass all filters of the mask; bit k is filter k. Masks that
    nothing passes have no row."""
    counted = keep(flags.groupBy("part", *filters).agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("n_good"), F.sum(F.col("toxic").cast("long")).alias("n_toxic")))
    total = counted.cube("part", *filters).agg(*(F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")), F.grouping("part").alias("any_part"), *(F.grouping(f).alias(f"any_{f}") for f in filters))
    passed = F.lit(True)
    for f in filters:
        passed = passed & ((F.col(f"any_{f}") == 1) | ~F.col(f))
    mask = sum((F.when(F.col(f"any_{f}") == 0, 1 << k).otherwise(0) for k, f in enumerate(filters)), F.lit(0))
    return total.where((F.col("any_part") == 0) & passed).select("part", mask.alias("mask"), "n", "n_good", "n_toxic")


def steps(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """One row for each order and step: its filter, and the masks before and after it."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    rows = []
    for order in permutations(filters):
        before = 0
        for k, f in enumerate(order):
            rows.append(("".join(order), k + 1, f, bit[f], before, before | bit[f], sum(bit.values()) & ~bit[f]))
            before |= bit[f]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, own int, before int, after int, others int")


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order and step, with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    filters: which of the five, in which letters' orders.
    """
    spark = docs.sparkSession
    found = survivors(flagged(docs, labels), filters)
    # 32 masks a part, zeros included: a map from the mask to what survives it.
    masks = found.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "n_good", "n_toxic").alias("s")))).alias("by_mask"))
    whole = masks.select("part", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1)), lambda m: F.coalesce(F.col("by_mask")[m], F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "n_good", "n_toxic")))))).alias("mask", "s"))

    def side(name: str) -> DataFrame:
        return whole.select("part", F.col("mask").alias(name), F.col("s").alias(f"{name}_s"))

    # Of each filter and part: all that fail it, and those that fail it only.
    every = (1 << len(filters)) - 1
    single = whole.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", "s.n"))).alias("n_by_mask"))
    stepped = side("before").join(F.broadcast(steps(spark, filters)), "before").join(side("after"), ["part", "after"]).join(single, "part")
    n = F.col("n_by_mask")
    counted = stepped.select(
        "part",
        "filter_order",
        "step",
        "filter",
        F.col("after_s.n").alias("kept"),
        (F.col("before_s.n") - F.col("after_s.n")).alias("removed"),
        (n[F.lit(0)] - n[F.col("own")]).alias("fails"),
        (n[F.col("others")] - n[F.lit(every)]).alias("unique_fails"),
        (F.col("before_s.n_good") - F.col("after_s.n_good")).alias("good_lost"),
        (F.col("before_s.n_toxic") - F.col("after_s.n_toxic")).alias("toxic_lost"),
    )
    shares = counted.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return counted.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
smallest AS (SELECT text, min(doc_id) AS first_id FROM doc GROUP BY text),
fails AS (
    SELECT part, doc.doc_id, map {
        'A': len(words) < 200,
        'B': 100 * len(list_distinct(words)) < 50 * len(words),
        'C': 100 * length(regexp_replace(doc.text, '[^A-Z]', '', 'g')) > 2 * length(doc.text),
        'D': regexp_matches(doc.text, '[#$%&*|]'),
        'E': coalesce(doc.doc_id > first_id, false)
    } AS f, good.doc_id IS NOT NULL AS good, toxic.doc_id IS NOT NULL AS toxic
    FROM doc JOIN smallest USING (text) LEFT JOIN good ON doc.doc_id = good.doc_id LEFT JOIN toxic ON doc.doc_id = toxic.doc_id
),
kinds AS (SELECT part, f, count(*) AS n, sum(good::INT) AS n_good, sum(toxic::INT) AS n_toxic FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
orders AS (
    SELECT '' AS done
    UNION ALL
    SELECT done || letter FROM orders, letters WHERE NOT contains(done, letter)
),
steps AS (SELECT done AS filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders WHERE length(done) = 5),
cases AS (
    SELECT part, filter_order, step, n, n_good, n_toxic, f[filter_order[step]] AS failed,
           coalesce(list_bool_or(list_transform(range(1, step), lambda k: f[filter_order[k]])), false) AS gone,
           len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[x])) AS n_failed
    FROM kinds, steps
),
counted AS (
    SELECT part, filter_order, step,
           sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN gone AND failed THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN failed AND n_failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN NOT gone AND failed THEN n_good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN NOT gone AND failed THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM cases GROUP BY part, filter_order, step
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counted
"""
