"""Each stage of the pipeline, against brute force on small fixtures with awkward rows."""


import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from framelake.llm import language
from framelake.llm.mixing import mix
from tests.llm.test_ops import classes_by_hand, texts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], COLUMNS)


def listed(df):
    return sorted((repr((r.doc_id, r.text, r.n_chars)) for r in df.collect()))


def test_language_drops_exactly_what_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = docs.union(frame(spark, [(None, None), (7, "123 !!"), (7, "qzjx vkwq " * 40), (7, "")]))
    judge = language.Classifier(language.learn(odd.where(~language.in_fold())))
    stays = [r for r in odd.collect() if (p := judge.predict(r.text))[0] != "und" and p[2] >= language.MARGIN]
    assert listed(pipeline.identify_language(spark, odd, None)) == sorted(repr((r.doc_id, r.text, r.n_chars)) for r in stays)


def test_near_duplicates_keep_one_of_each_class(spark):
    rows = list(enumerate(texts()))
    of = classes_by_hand([t for _, t in rows])
    wanted = [(k, t) for k, t in rows if of[k] == k]
    again = rows + [(k, t) for k, t in rows if t][:5]
    extra = [(None, "of no class at all"), (None, None)]
    found = pipeline.drop_near_duplicates(spark, frame(spark, again + extra), None)
    assert listed(found) == sorted(repr((k, t, len(t or ""))) for k, t in wanted + extra)


def test_near_duplicates_keep_one_of_two_that_share_an_id(spark):
    words = [f"word{k}" for k in range(120)]
    found = pipeline.drop_near_duplicates(spark, frame(spark, [(4, " ".join(words)), (4, " ".join(words[:-1])), (9, " ".join(words[1:]))]), None)
    assert found.count() == 1


def test_repeats_are_cut_from_all_but_the_first(spark):
    rows = list(enumerate(texts()))
    first = {}
    for k, t in rows:
        w = (t or "").split()
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), k)
    wanted = {}
    for k, t in rows:
        w = (t or "").split()
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < k for p in range(s, s + 50)}
        if not gone or len(gone) < len(w):
            wanted[k] = [x for p, x in enumerate(w) if p not in gone]
    found = pipeline.cut_repeats(spark, frame(spark, rows), None).collect()
    assert {r.doc_id: (r.text or "").split() for r in found} == wanted and len(found) == len(wanted)
    assert all(r.n_chars == len(r.text or "") for r in found)


def test_benchmark_spans_are_cut(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"before it {item} after it"), (1, "clean text"), (2, item), (3, None), (4, ""), (None, f"x {item}")]
    found = pipeline.remove_benchmark(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id or 0, " ".join((r.text or "").split())) for r in found)) == [(0, "x"), (1, "before it after it"), (1, "clean text"), (3, ""), (4, "")]
    assert all(r.n_chars == len(r.text or "") for r in found)


def test_mix_stage_is_the_operator(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found, wanted = pipeline.mix_sources(spark, docs, None), mix(docs)
    assert found.columns == wanted.columns and sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))


CLASHES = ["score", "lang_pred", "rejected", "repeats", "dedup_key", "dedup_spans", "span_id", "span_key", "decontaminated", "hit", "stay_id", "stay_key", "row_key", "row_id", "text_key", "parts", "cdf", "copies", "mix_source", "mix_salt", "row_salt", "SCORE_2", "a.b"]


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, tmp_path, name):
    """Columns that are called as an operator's own come out as they went in; empty tables stay empty."""
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(pipeline.STAGES)[name]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(40)
    clashing = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))
    found = stage(spark, clashing, str(tmp_path))
    assert found.columns[: len(clashing.columns)] == clashing.columns
    rows = found.collect()
    assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHES)
    plain = stage(spark, docs, str(tmp_path)).select("doc_id", "text", "n_chars").collect()
    assert sorted(map(repr, plain)) == sorted(repr(r) for r in found.select("doc_id", "text", "n_chars").collect())
    assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0


def test_run_leaves_only_its_result(spark):
    import glob

    from framelake.llm import common

    since = common.mark()
    done = pipeline.run(spark, "/root/testdata/sf0.001")
    assert 100 < done.count() < 400
    folders = [where for _, where in common._HELD[since:]]
    assert len(folders) == 1 and glob.glob(folders[0].removeprefix("file://") + "/*.parquet")
    common.release(since)
