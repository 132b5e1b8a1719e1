"""Chains by pointer doubling, and small groups as arrays, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import frames, jumps, packing


def pack_by_hand(rows, budget, most, joint):
    out, groups = [], {}
    for g, pos, cost in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        spent, n, chunk = groups.get(g, (0, 0, 0))
        if n and (spent + cost > budget or (most is not None and n >= most)):
            spent, n, chunk = 0, 0, chunk + 1
        groups[g] = (spent + cost + joint, n + 1, chunk)
        out.append((g, pos, cost, chunk))
    return sorted(out, key=repr)


def python_nodes(df):
    return [x for x in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups") if x in df._jdf.queryExecution().executedPlan().toString()]


@pytest.mark.parametrize(("small", "budget", "most", "joint"), [(0, 37, 3, 0), (40, 60, None, 2), (0, 0, None, 0), (1024, 10, 1, 5), (1024, 100, None, 2), (0, 10**6, None, 0)])
def test_packing(spark, monkeypatch, small, budget, most, joint):
    monkeypatch.setattr(jumps, "SMALL", small)
    draw = random.Random(budget + joint)
    rows = [(g, k // 2, draw.choice([0, 0, 1, 5, 20, 30, 99, 250])) for g, n in ((1, 1), (2, 30), (None, 70), (3, 300)) for k in range(n)]
    draw.shuffle(rows)
    done = packing.packed(spark.createDataFrame(rows, "g long, pos long, cost int").repartition(7), "g", ["pos"], "cost", budget, most, joint)
    assert done.columns == ["g", "pos", "cost", "chunk_id"] and not python_nodes(done)
    assert sorted((tuple(r) for r in done.collect()), key=repr) == pack_by_hand(rows, budget, most, joint)


def gate_by_hand(rows, keep):
    out, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        held, n = last.get(r[0], (None, 0))
        if held is None or keep(held, r):
            last[r[0]] = (r, n + 1)
            out.append((r[0], n, *r[1:]))
    return sorted(out, key=repr)


def differs(a, b, least):
    return a is not None and b is not None and a == a and b == b and abs(a - b) >= least


def shots(seed, n=260):
    draw = random.Random(seed)
    rows, at = [], 0
    for v, many in ((1, n), (2, 1), (None, 90)):
        at = 0
        for k in range(many):
            at += draw.choice([0, 0, 3, 10, 45])
            x = draw.choice([None, float("nan"), draw.random() * 10, draw.random() * 10, 5.0])
            rows.append((v, at, k, x))
    draw.shuffle(rows)
    return rows


SHOTS = "video long, ms long, frame long, signal double"


@pytest.mark.parametrize(("small", "change", "least", "most"), [(100, None, 50, 50), (0, 3.0, 20, 200), (1024, 3.0, 20, 200), (0, 0.0, 0, 30), (0, 100.0, 5, 10**6)])
def test_gates(spark, monkeypatch, small, change, least, most):
    monkeypatch.setattr(jumps, "SMALL", small)
    monkeypatch.setattr(jumps, "FAN", 4)
    rows = shots(int(least))
    df = spark.createDataFrame(rows, SHOTS).repartition(5)
    found = frames.keyframes(df, "video", ("ms", "frame"), "ms", "signal" if change is not None else None, change or 0.0, least, most)
    assert not python_nodes(found)

    def keep(a, b):
        gap = b[1] - a[1]
        return gap >= most or (gap >= least and (change is None or differs(a[3], b[3], change)))

    wanted = gate_by_hand(rows, keep)
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(repr(w if change is not None else w[:4]) for w in wanted)


@pytest.mark.parametrize(("small", "least"), [(0, 1.0), (1024, 1.0), (0, 50.0)])
def test_static_rows(spark, monkeypatch, small, least):
    monkeypatch.setattr(jumps, "SMALL", small)
    monkeypatch.setattr(jumps, "FAN", 3)
    rows = shots(9)
    found = frames.without_static(spark.createDataFrame(rows, SHOTS), "video", ("ms", "frame"), "signal", least)
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(map(repr, gate_by_hand(rows, lambda a, b: differs(a[3], b[3], least))))


def test_a_large_group_is_spread_over_tasks(spark, monkeypatch):
    """All rows in one group: its places are counted on from task to task."""
    rows = spark.range(0, 5000, 1, 8).select(F.lit("one").alias("g"), F.col("id").alias("pos"), (F.col("id") % 7).alias("cost"))
    stood = jumps.placed(rows, "g", ["pos"], "cost")
    assert stood.select("row.*").columns == rows.columns
    got = [(r.pos, r.row.pos, r.n, r.upto) for r in stood.orderBy("pos").collect()]
    total, wanted = 0, []
    for k in range(5000):
        total += k % 7
        wanted.append((k, k, 5000, total))
    assert got == wanted
    monkeypatch.setattr(jumps, "SMALL", 100)
    done = packing.packed(rows, "g", ["pos"], "cost", 50).collect()
    assert sorted(tuple(r) for r in done) == [tuple(r) for r in sorted(pack_by_hand([("one", k, k % 7) for k in range(5000)], 50, None, 0))]


def test_without_rows(spark):
    assert packing.packed(spark.createDataFrame([], "g long, pos long, cost int"), "g", ["pos"], "cost", 5).count() == 0
    assert frames.keyframes(spark.createDataFrame([], SHOTS), "video", ("ms", "frame"), "ms").count() == 0
    assert frames.without_static(spark.createDataFrame([], SHOTS), "video", ("ms", "frame"), "signal", 1.0).count() == 0
