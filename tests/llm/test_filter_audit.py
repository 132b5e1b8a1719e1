"""The filter audit against a loop over all orders, on documents with every awkward case."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from framelake.llm import filter_audit
from tests.oracle import same

DOCS = "doc_id long, text string, source string, E int, part string, `text key` int"
LABELS = "doc_id long, quality int, toxic int, good string"


def documents(seed):
    draw = random.Random(seed)
    texts = [None, "", " \t\n", "A$", "\x0b".join(["One"] * 250), " ".join(f"w{k}" for k in range(220)), "é日本😀 " * 3, "X\x1cY " * 201, "nbsp\xa0word " * 210]
    texts += [" ".join(draw.choice(["Aa", "bb", "cc|", "DD"] + [f"v{k}" for k in range(300)]) for _ in range(draw.choice([5, 199, 200, 260]))) for _ in range(12)]
    texts.append("long " * 400_000)
    rows = []
    for k in range(150):
        text = texts[5] if k % 3 == 0 else draw.choice(texts)
        rows.append((draw.choice([k, k, k // 2, None, -k]), text, draw.choice(["s", "s", "t", "", None, "only" if k == 7 else "s"])))
    rows += [(4, texts[5], "s")] * 30
    marks = [(draw.choice([*range(-20, 90), None]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(90)]
    return rows, marks


def by_hand(rows, marks):
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = defaultdict(list)
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts[source or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*x[:-1], shapley[x[-1]]) for x in found]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_loop(spark, seed):
    rows, marks = documents(seed)
    docs = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], DOCS)
    labels = spark.createDataFrame([(*m, "clash") for m in marks], LABELS)
    found = filter_audit.audit(docs, labels)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in found.collect()) == by_hand(rows, marks)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(None, None, None, 1, "x", 1)], DOCS)
    assert sorted(tuple(r) for r in filter_audit.audit(one, labels).collect()) == by_hand([(None, None, None)], [])


def test_fewer_filters(spark):
    rows, marks = documents(3)
    found = filter_audit.audit(spark.createDataFrame([(*r, 1, "c", 2) for r in rows], DOCS), spark.createDataFrame([(*m, "c") for m in marks], LABELS), "DA")
    whole = {(r[0], r[1]): r for r in by_hand(rows, marks) if r[1] in ("DABCE", "ADBCE") and r[2] == 2}
    for r in found.where(F.col("step") == 2).collect():
        assert r.kept == whole[r.part, r.filter_order + "BCE"][3]


def test_sql_gives_the_same_rows(spark):
    same(spark, filter_audit.op13_filter_audit, filter_audit.OP13_SQL, "/root/testdata/sf0.001")
