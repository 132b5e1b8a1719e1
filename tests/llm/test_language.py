"""Language ID on junk and prose, and what it learns from."""

import random

from pyspark.sql import functions as F

from framelake.llm import language


def test_language_rejects_junk_of_any_length_and_keeps_prose(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(rows.where(~language.in_fold()))
    draw = random.Random(3)
    junk = [("".join(draw.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)), n) for n in (40, 100, 200, 300, 512, 2000, 8000) for _ in range(40)]
    found = language.identify(spark.createDataFrame(junk, "text string, n int"), model).groupBy("n").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()
    assert all(r.share >= 0.75 for r in found), found
    clean = language.identify(rows.where(language.in_fold() & F.col("lang").isNotNull() & F.col("text").rlike("[a-z]")), model)
    assert clean.select(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.02


def test_language_learns_from_every_sampled_document_and_from_any_place(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    texts = [" ".join([f"mark{chr(97 + k // 26)}{chr(97 + k % 26)}"] * 30 + [word() for _ in range(30)] * 9 + [f"last{chr(97 + k // 26)}{chr(97 + k % 26)}"] * 300) for k in range(100)]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.learn(rows, sample_docs=100, dict_bytes=20_000)["x"].decode()
    assert 18_000 <= len(model.encode()) <= 20_000 and model.count("\n") == 99
    assert 10 < sum(f"last{chr(97 + k // 26)}{chr(97 + k % 26)}" in model for k in range(100)) <= 100
    assert language._shared_out([b"a" * 50, b"b", "é".encode() * 40], 41) == b"a" * 18 + b"\nb\n" + "é".encode() * 9
