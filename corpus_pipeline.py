"""The corpus pipeline: five stages over `documents`, each written and reread as the next one's input.

A stage returns the columns of documents; the last adds the copies' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import decontaminate, language, mixing, neardup, substring
from framelake.llm.common import mark, new_folder, release, remove, table, text_key

#: Python models and searches decide in most stages: their results are tested against brute force instead.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A name that docs have no column of, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"own_{name}"
    return name


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names, which an operator uses itself, under others; and what they are called meanwhile."""
    moved = {}
    for c in docs.columns:
        # Arrow functions resolve a name with a dot as a field.
        if c.lower() in names or "." in c:
            moved[c] = _free(docs, f"own_{c.replace('.', '_')}")
            docs = docs.withColumnRenamed(c, moved[c])
    return docs, moved


def _back(found: DataFrame, columns: list[str], moved: dict[str, str], **made) -> DataFrame:
    """The columns as they were called and in their order; those in `made` with these values."""
    return found.select(*(made.get(c, F.col(f"`{moved.get(c, c)}`")).alias(c) for c in columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects: texts without a letter, null ones, and narrow margins; lang stays as it was labelled."""
    model = language.learn(docs.where(~language.in_fold()))
    held, moved = _aside(docs, "lang_pred", "score", "rejected")
    return _back(language.identify(held, model).where(~F.col("rejected")), docs.columns, moved)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, the first by id and then by a hash of the text, once. Rows without id are of no class and stay;
    of rows without words that share an id one of each text stays."""
    classes = neardup.near_duplicates(docs.select("doc_id", "text"))
    stay_id, stay_key, row_key = (_free(docs, x) for x in ("stay_id", "stay_key", "row_key"))
    first = classes.where("doc_id = class_id AND text_key = class_key").select(F.col("doc_id").alias(stay_id), F.col("text_key").alias(stay_key)).distinct()
    keyed = docs.where("doc_id IS NOT NULL").withColumn(row_key, text_key())
    kept = keyed.join(first, (F.col("doc_id") == F.col(stay_id)) & (F.col(row_key) == F.col(stay_key)), "left_semi").dropDuplicates(["doc_id", row_key])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.where("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated windows out of all but their first document; a text of which nothing is left goes. n_chars follows the text."""
    held, moved = _aside(docs, "dedup_key", "dedup_spans", "dedup_id", "dedup_text")
    out = _free(held, "repeats")
    found = substring.remove(held, out=out)
    cut = F.col(f"{out}.n_removed") > 0
    left = found.where(~cut | (F.col(f"{out}.n_removed") < F.col(f"{out}.n_words")))
    return _with_text(left, docs.columns, moved, cut, F.when(cut, F.col(f"{out}.kept_text")).otherwise(F.col("text")))


def _with_text(found: DataFrame, columns: list[str], moved: dict[str, str], changed, text) -> DataFrame:
    """The columns, with this text and its length where it has changed."""
    made = {"text": text, "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in columns else {"text": text}
    return _back(found, columns, moved, **made)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the removal spans out of texts; a text of which nothing is left goes. n_chars follows the text."""
    held, moved = _aside(docs)
    out = _free(held, "decontaminated")
    found = decontaminate.scan(held, table(spark, sf_dir, "benchmark"), out=out)
    hit = F.col(f"{out}.n_hit") > 0
    text = F.when(hit, F.col(f"{out}.clean_text")).otherwise(F.col("text"))
    left = found.where(~hit | (F.length(F.trim(f"{out}.clean_text")) > 0))
    return _with_text(left, docs.columns, moved, hit, text)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies: the columns of documents, and n_copies, copy_id and mix_key, which replace columns of these names."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("decontaminate", remove_benchmark),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each result kept as Parquet in the shared folder; what a stage kept for itself goes with it,
    and a stage's result once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        where = new_folder(spark, f"pipeline-{k}-{name}")
        since = mark()
        stage(spark, docs, sf_dir).write.parquet(where)
        release(since)
        docs = spark.read.parquet(where)
        if last is not None:
            remove(last)
        last = where
    return docs
