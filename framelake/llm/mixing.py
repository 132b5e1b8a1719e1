"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of `size` bytes and target weight w among all sources is repeated at the mean rate w * total / size. Each
document draws a uniform number from a hash of its row, inverts the Poisson distribution of its source's rate and
is exploded into that many copies. Draws follow id, text and source; rows that share all three draw by their other columns as well, and equal
rows by their number among them, so no two rows draw alike. A rate over `split` is drawn as the sum of equal parts, each of a lower mean, which
has the same distribution. The copies are dealt out by a second hash and sorted by it, a global shuffle.

Nothing is gathered by source but one sum, aggregated before its shuffle, so a source with most of the rows is no hot
key. The sources' distributions, some 1,100 bytes each, are broadcast only if they take at most `most_broadcast` bytes; otherwise
they are joined by source and one of `salts` salts, so that a source with a third of the rows is not one task's.

Defined cases: null is a source of its own and so is the empty name; without weights all sources present weigh the same; a
source without a weight is left out if weights are given; null texts count 0 bytes; a source without any byte has
rate 1; rows that share an id, or have none, are rows of their own; an empty table gives an empty table; columns of any name come
through but n_copies, copy_id and mix_key, which the results replace.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import cut, table

SEED = 17
SPLIT = 32.0
MOST_BROADCAST = 16 << 20
SALTS = 64


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total_bytes: float | None = None, source_col: str = "source", text_col: str = "text", split: float = SPLIT) -> DataFrame:
    """One row a source: rate, parts and cdf, the distribution of a part up to where its tail is below 2 ** -52."""
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("double").alias("size"))
    weight = F.lit(1.0) if weights is None else F.coalesce(F.from_json(F.lit(json.dumps(weights)), "map<string,double>")[F.col("mix_source")], F.lit(0.0))
    sizes = cut(sizes.select("*", weight.alias("weight")).where("weight > 0"))
    all_bytes, all_weights = sizes.agg(F.sum("size"), F.sum("weight")).first()
    budget = F.lit(float(all_bytes or 0) if total_bytes is None else float(total_bytes))
    rate = F.when(F.col("size") > 0, F.col("weight") / F.lit(float(all_weights or 1)) * budget / F.col("size")).otherwise(1.0)
    parts = F.greatest(F.ceil(F.col("rate") / split), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    cdf = F.expr(f"""aggregate(sequence(1, cast(ceil({split} + 12 * sqrt({split}) + 30) as int)),
        named_struct('p', exp(-mean), 'c', exp(-mean), 'out', array(exp(-mean))),
        (s, k) -> named_struct('p', s.p * mean / k, 'c', s.c + s.p * mean / k, 'out', array_append(s.out, s.c + s.p * mean / k)),
        s -> s.out)""")
    return sizes.select("mix_source", rate.alias("rate")).select("*", parts.alias("parts")).select("*", mean.alias("mean")).select("mix_source", "parts", cdf.alias("cdf"))


def uniform(*parts) -> object:
    """From 0 up to 1, of the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def key_of(columns: list) -> object:
    """SHA-256 of columns as text, null set apart."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(c.cast("string"), F.lit("\1")) for c in columns)), 256)


def named(rows: DataFrame, own: list) -> DataFrame:
    """Rows (row, source_of, key) with `ident`, which no other row has: the key where it is the row's own; else with a key of the whole row,
    and the number among equal rows. Equal rows are counted before their exchange and one of them is repeated: they may be a third of the table."""
    repeats = cut(rows.groupBy("key").count().where("count > 1").select("key"))
    if repeats.isEmpty():
        return rows.withColumn("ident", F.col("key"))
    single = rows.join(repeats, "key", "left_anti").withColumn("ident", F.col("key"))
    counted = rows.join(repeats, "key", "left_semi").withColumn("row_key", key_of([F.col("row")[c] for c in own])).groupBy("key", "row_key").agg(F.count("*").alias("n"), F.first("row").alias("row"), F.first("source_of").alias("source_of"))
    many = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")).select("row", "source_of", "key", F.concat_ws(":", "key", "row_key", F.col("nth").cast("string")).alias("ident"))
    return single.select(*many.columns).unionByName(many)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total_bytes: float | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", split: float = SPLIT, most_broadcast: int = MOST_BROADCAST, salts: int = SALTS) -> DataFrame:
    """The copies, with docs' columns, n_copies, copy_id (part * 1000000 + number, from 1) and mix_key, their random order."""
    own = [c for c in docs.columns if c.lower() not in ("n_copies", "copy_id", "mix_key")]
    known = cut(rates(docs, weights, total_bytes, source_col, text_col, split))
    takes = known.agg(F.sum(F.coalesce(F.octet_length("mix_source"), F.lit(0)) + 8 * F.size("cdf") + 64)).first()[0] or 0
    # The columns of docs travel in one, so that none of them meets a name used here.
    key = key_of([F.col(f"`{c}`") for c in (id_col, text_col, source_col)])
    rows = named(docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(f"`{source_col}`").alias("source_of"), key.alias("key")), own)
    if takes <= most_broadcast:
        drawn = rows.join(F.broadcast(known), F.col("source_of").eqNullSafe(F.col("mix_source")))
    else:
        salted = known.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = rows.withColumn("row_salt", F.pmod(F.xxhash64("ident"), F.lit(salts)).cast("int"))
        drawn = dealt.join(salted, F.col("source_of").eqNullSafe(F.col("mix_source")) & (F.col("row_salt") == F.col("mix_salt")))
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda p: F.struct((p - 1).alias("part"), uniform(F.lit(seed), F.col("ident"), p.cast("string")).alias("u")))
    copies = F.flatten(F.transform(draws, lambda d: F.transform(F.filter(F.sequence(F.lit(1), F.size("cdf")), lambda k: F.get(F.col("cdf"), k - 1) <= d["u"]), lambda k: d["part"] * 1000000 + k)))
    counted = drawn.select("row", "ident", copies.alias("copies")).where(F.size("copies") > 0)
    each = counted.select("row", "ident", F.size("copies").alias("n_copies"), F.explode(F.col("copies").cast("array<long>")).alias("copy_id"))
    keyed = each.select("row", "n_copies", "copy_id", F.md5(F.concat_ws(":", F.lit("order"), F.lit(seed), "ident", F.col("copy_id").cast("string"))).alias("mix_key"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key").select("row.*", "n_copies", "copy_id", "mix_key")


def op4_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH sizes AS (SELECT source, coalesce(sum(strlen(text)), 0)::DOUBLE AS size FROM documents GROUP BY source),
whole AS (SELECT sum(size) AS all_bytes, count(*)::DOUBLE AS n FROM sizes),
rate AS (SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE / n * all_bytes / size ELSE 1.0 END AS rate FROM sizes, whole),
part AS (SELECT source, rate, greatest(ceil(rate / {SPLIT}), 1)::INT AS parts FROM rate),
pmf AS (
    SELECT source, parts, k, exp(-(rate / parts) + CASE WHEN k > 0 THEN k * ln(rate / parts) - lgamma(k + 1) ELSE 0 END) AS p
    FROM part, range(0, 131) r(k)
),
cdf AS (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
keyed AS (
    SELECT *, sha256(concat_ws(chr(0), coalesce(doc_id::VARCHAR, chr(1)), coalesce(text, chr(1)), coalesce(source, chr(1)))) AS key,
           sha256(concat_ws(chr(0), coalesce(doc_id::VARCHAR, chr(1)), coalesce(text, chr(1)), coalesce(lang, chr(1)), coalesce(source, chr(1)), coalesce(n_chars::VARCHAR, chr(1)))) AS row_key
    FROM documents
),
named AS (
    SELECT * EXCLUDE (key, row_key), CASE WHEN count(*) OVER (PARTITION BY key) = 1 THEN key
           ELSE key || ':' || row_key || ':' || (row_number() OVER (PARTITION BY row_key))::VARCHAR END AS ident FROM keyed
),
draw AS (
    SELECT d.*, p.part, ('0x' || substr(md5('{SEED}:' || d.ident || ':' || (p.part + 1)::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
    FROM named d JOIN part s ON d.source IS NOT DISTINCT FROM s.source, unnest(range(0, s.parts)) p(part)
),
copies AS (
    SELECT d.*, d.part * 1000000 + c.k + 1 AS copy_id FROM draw d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source WHERE c.c <= d.u
)
SELECT doc_id, text, lang, source, n_chars, (count(*) OVER (PARTITION BY ident))::INT AS n_copies, copy_id::BIGINT AS copy_id,
       md5('order:{SEED}:' || ident || ':' || copy_id::VARCHAR) AS mix_key
FROM copies
"""
