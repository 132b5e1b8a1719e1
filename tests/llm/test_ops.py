"""Each operator against a brute-force version, on small tables with the awkward cases in them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import ann, decontaminate, language, lm_score, mixing, neardup, registry, substring, suffix, tokens, warc
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def texts(seed=1, n=40):
    """Documents with copies, near copies, shared passages, periodic text, nulls, empty and one long text."""
    draw = random.Random(seed)
    vocabulary = ["w" + "".join(draw.choice("abcdefgh") for _ in range(4)) + str(k) for k in range(3000)] + ["été", "naïve", "日本"]
    fresh = lambda k: [draw.choice(vocabulary) for _ in range(k)]
    passage = fresh(70)
    out = [None, "", "   ", "one", "two words", " ".join(["aa bb"] * 150)]
    for k in range(n):
        words = fresh(draw.randrange(20, 160))
        if k % 4 == 0:
            at = draw.randrange(len(words))
            words[at:at] = passage
        out.append((" " if k % 2 else "\n").join(words))
    out += out[8:12] + [out[9] + " tail"]
    for k in range(8):
        near = out[10 + k].split()
        near[len(near) // 2] = "edited"
        out.append(" ".join(near))
    out.append(" ".join(fresh(4000)))
    return out


def table(spark, rows, more=""):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("dedup", F.lit("clash")).withColumn("hit", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, texts()).cache()


EMPTY = "doc_id long, text string, source string, lang string"


def test_substring(spark, docs):
    rows = texts()
    words = {k: (t or "").split() for k, t in enumerate(rows)}
    first = {}
    for k, w in words.items():
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), k)
    for r in substring.remove(docs).select("doc_id", "text", "dedup.*").collect():
        w = words[r.doc_id]
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < r.doc_id for p in range(s, s + 50)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
        assert r.kept_text == r.text if not gone else r.kept_text.split() == kept
    assert substring.remove(spark.createDataFrame([], EMPTY)).count() == 0


def test_substring_ids(spark):
    long = " ".join(f"x{k}" for k in range(60))
    rows = spark.createDataFrame([(1, long), (1, long), (1, long + " y"), (2, long), (None, long)], "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.dedup.n_removed) for r in substring.remove(rows).collect())
    assert found == [(-1, 0), (1, 0), (1, 0), (1, 0), (2, 60)]


@pytest.mark.parametrize("settings", [{}, {"most": 1}, {"most": 3, "bucket": 200}, {"bucket": 3, "run_bytes": 3000}])
def test_suffix(docs, settings):
    data = [(t or "").encode() for t in texts()]
    seen = Counter(d[s : s + 200] for d in data for s in range(len(d) - 199))
    for r in suffix.remove(docs, **settings).select("doc_id", "dedup.*").collect():
        d = data[r.doc_id]
        edge = np.zeros(len(d) + 1, int)
        for s in range(len(d) - 199):
            if seen[d[s : s + 200]] > 1:
                edge[s] += 1
                edge[s + 200] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == (len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)


def test_suffix_empty_and_repeated(spark):
    assert suffix.remove(spark.createDataFrame([], EMPTY)).count() == 0
    long = "".join(f"{k:05d}" for k in range(100))
    rows = spark.createDataFrame([(1, long), (1, long), (None, long[:300])], "doc_id long, text string")
    assert sorted(r.dedup.n_removed for r in suffix.remove(rows).collect()) == [300, 500, 500]


def test_loser_tree():
    draw = random.Random(4)
    lists = [sorted("".join(draw.choice("ab") for _ in range(draw.randrange(0, 12))).encode() for _ in range(draw.randrange(0, 30))) for _ in range(7)]
    merged = list(suffix.LoserTree([suffix.front_coded(x, list(range(len(x)))) for x in lists]))
    assert [m[1] for m in merged] == sorted(s for x in lists for s in x)
    assert [m[0] for m in merged] == [0 if k == 0 else suffix.shared_length(merged[k - 1][1], m[1]) for k, m in enumerate(merged)]
    assert all(lists[m[2]][m[3]] == m[1] for m in merged)


def test_tokens(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    whole = Tokenizer.from_file(path)
    rows = [*texts(), "a<|endoftext|>b  c\n\n d 's"]
    found = table(spark, rows).select("doc_id", tokens.count_tokens(F.coalesce("text", F.lit("")), path, 50, 200).alias("n")).collect()
    assert {r.doc_id: r.n for r in found} == {k: len(whole.encode(t or "", add_special_tokens=False)) for k, t in enumerate(rows)}
    for t in rows:
        assert "".join(tokens.pieces(t or "", 20)) == (t or "")


def test_other_tokenizer(spark):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = ["hello there world", "", "x" * 50]
    found = table(spark, rows).select("doc_id", tokens.count_tokens(F.col("text"), path).alias("n")).collect()
    assert {r.doc_id: r.n for r in found} == {k: len(model.encode(t)) for k, t in enumerate(rows)}


def test_mixing_rates(spark):
    rows = [(k, "x" * 10, "big" if k % 10 else "small", 1) for k in range(4000)] + [(9000, "y" * 10, None, 1), (9001, None, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    mixed = mixing.mix(df, {"big": 1.0, "small": 3.0})
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(n) == {"big", "small"} and abs(n["small"] / (n["small"] + n["big"]) - 0.75) < 0.03 and abs(sum(n.values()) - 4000) < 250
    assert mixed.select("doc_id", "copy_id").distinct().count() == mixed.count()
    even = mixing.mix(df)
    assert {r.source for r in even.select("source").distinct().collect()} >= {"big", "small"}
    assert mixing.mix(df.limit(0)).count() == 0


def within(n, mean):
    return abs(n - mean) <= 3 * max(mean, 1) ** 0.5


@pytest.mark.parametrize("seed", [3, 17])
def test_mixing_draws_for_each_row(spark, seed):
    """Two sources of equal weight: all rows of one lack an id, share an id, or are equal, and it keeps its share."""
    for one in (lambda k: (None, f"t{k % 900:04d}"), lambda k: (7, f"t{k:04d}"), lambda k: (None, "same "), lambda k: (7, "same ")):
        rows = [(*one(k), "a") for k in range(2000)] + [(k, f"u{k:04d}", "b") for k in range(2000)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        mixed = mixing.mix(df, seed=seed)
        n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
        assert within(n["a"], 2000) and within(n["b"], 2000), n
        # Copies are Poisson distributed over rows: each row's number is its own.
        none = 2000 - mixed.where("source = 'a' AND copy_id = 1").count()
        assert within(none, 2000 / np.e)
        assert mixed.where("source = 'b'").select("doc_id", "copy_id").distinct().count() == n["b"]
    shared = [(7, f"t{k:04d}", "a") for k in range(1000)]
    assert within(mixing.mix(spark.createDataFrame(shared, "doc_id long, text string, source string"), {"a": 1.0}, total_bytes=20_000).count(), 4000)


def test_mixing_keeps_columns(spark):
    more = ["parts", "cdf", "copies", "row_salt", "mix_salt", "mix_source", "row", "row_key", "nth", "source_of", "ident", "one", "count", "size", "a.b", "Rate"]
    df = spark.createDataFrame([(k, f"t{k}", "s", *(f"{c}{k}" for c in more), {"x": k}, [1.5, None], bytearray(b"\xff")) for k in range(60)], ", ".join(["doc_id long", "text string", "source string", *(f"`{c}` string" for c in more), "m map<string,int>", "l array<double>", "raw binary"]))
    for most in (0, 1 << 20):
        mixed = mixing.mix(df.withColumn("n_copies", F.lit("mine")).union(df.withColumn("n_copies", F.lit("mine")).where("doc_id < 9")), most_broadcast=most)
        assert mixed.columns == [*df.columns, "n_copies", "copy_id", "mix_key"]
        assert all(r[c] == f"{c}{r.doc_id}" for r in mixed.collect() for c in more) and mixed.count() > 30
        assert {n for (n,) in mixed.groupBy("doc_id", "mix_key").count().select("count").collect()} == {1}


def test_mixing_splits_high_rates(spark):
    df = spark.createDataFrame([(1, "x", "rare")] + [(k, "x" * 40, "often") for k in range(2, 202)], "doc_id long, text string, source string")
    n = mixing.mix(df).where("source = 'rare'").count()
    assert 3700 < n < 4300


def neighbours_by_hand(ids, x):
    """The scores and ids of the nearest of each query, from all rows."""
    x, ids = np.asarray(x, dtype=np.float64), np.asarray(ids)
    out = {}
    for k in np.flatnonzero(ids % 20 == 0):
        s = (x * x[k]).sum(axis=1)
        others = np.flatnonzero(ids != ids[k])
        out[int(ids[k])] = [(float(s[j]), int(ids[j])) for j in others[np.lexsort((ids[others], -s[others]))][:20]]
    return out


@pytest.mark.parametrize("settings, least", [({"cover": 1.1}, 1.0), ({}, 0.9), ({"part_rows": 100, "least_parts": 4, "fan": 6, "block_rows": 40}, 0.9)])
def test_neighbours(spark, settings, least):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 16)).astype(np.float32)
    x[100:1100] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [1.0]), (5020, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, **settings).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    wanted = neighbours_by_hand(np.arange(3000), x)
    assert set(got) == set(wanted)
    hit = 0
    for q, mine in got.items():
        assert len(mine) == 20 and mine == sorted(mine, key=lambda z: (-z[0], z[1])) and q not in {v for _, v in mine}
        assert all(s == pytest.approx(float((x[v].astype(np.float64) * x[q].astype(np.float64)).sum()), abs=1e-12) for s, v in mine)
        hit += len({v for _, v in mine} & {v for _, v in wanted[q]})
        if least == 1.0 or 100 <= q < 1100:
            assert [v for _, v in mine] == [v for _, v in wanted[q]]
    assert hit / (20 * len(got)) >= least


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_neighbours_recall(spark, sf):
    where = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{where}/embeddings.parquet").collect()
    wanted = neighbours_by_hand([r.vec_id for r in rows], [r.embedding for r in rows])
    got = {}
    for r in registry.QUERIES["op5_neighbours"](spark, where).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {v for _, v in near}) for q, near in wanted.items()) / sum(map(len, wanted.values())) >= 0.9


def test_neighbours_are_all_rows_but_the_own(spark):
    """Rows that share the query's id, or its id and vector, and rows without id are candidates."""
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (3, [0.5, 0.5]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (None, [0.0, 1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wanted = []
    for k, (q, v) in enumerate(rows):
        if q is not None and q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for j, (i, w) in enumerate(rows) if j != k)[:5]
            wanted += [(q, r, None if unnamed else i, -s) for r, (s, unnamed, i) in enumerate(near, 1)]
    found = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, top=5).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_neighbours_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 2.0]), (4, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 4, 1.0), (0, 2, 20, 1.0), (0, 3, 3, 0.0), (20, 1, 0, 1.0), (20, 2, 4, 1.0), (20, 3, 3, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert ann.search(one, F.col("vec_id") % 20 == 0).count() == 0


def scores_by_hand(rows, targets):
    """(id, text) rows: tokens and losses of each, from the definition."""
    words = [(t or "").split() for _, t in rows]
    digest = lambda t: hashlib.sha256((t or "").encode()).digest()
    n_all = sum(map(len, words))
    sides = [Counter(), Counter()]
    for (i, t), w in zip(rows, words, strict=True):
        if w:
            sides[i not in targets or i is None][t] += 1
    tokens = [sum(n * len(t.split()) for t, n in side.items()) for side in sides]
    models = []
    for k, side in enumerate(sides):
        share = min(1.0, tokens[1 - k] / max(tokens[k], 1))
        models.append({t: n if share == 1 else int(np.floor(n * share + int.from_bytes(digest(t)[-6:], "big") / 2**48)) for t, n in side.items()})
    out = []
    for (_, text), w in zip(rows, words, strict=True):
        losses = []
        for model in models:
            ones, pairs, n = Counter(), Counter(), 0
            for t, times in model.items():
                if t != text:
                    ws = t.split()
                    for x in ws:
                        ones[x] += times
                    for p in zip([None, *ws], ws):
                        pairs[p] += times
                    ones[None] += times
                    n += times * len(ws)
            each = [-np.log(0.6 * pairs[(a, b)] / max(ones[a], 1) + 0.35 * ones[b] / n + 0.05 / n_all) if n else np.log(n_all) for a, b in zip([None, *w], w)]
            losses.append(float(np.mean(each)) if w else None)
        out.append((len(w), *losses))
    return out


@pytest.mark.parametrize("group_bytes", [40, 3000, 1 << 24])
@pytest.mark.parametrize("targets", [[0, 2, 6, 12, 999], [*range(3, 60)]])
def test_lm_score(spark, group_bytes, targets):
    rows = list(enumerate(["the cat sat on the mat " * 30, "zz qq xx yy " * 30, None, "", "the cat sat", "zz qq xx", "the cat sat", *texts()[:20]]))
    rows += [(None, "the cat sat"), (None, "zz qq"), *[(4, "a cat sat")] * 3, *[(7, "zz qq xx yy")] * 9]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    ids = spark.createDataFrame([(k,) for k in [*targets, 0 if 0 in targets else 3, None]], "doc_id long")
    found = sorted(lm_score.score(df, ids, group_bytes=group_bytes).collect(), key=lambda r: repr((r.doc_id, r.text)))
    wanted = sorted(zip(rows, scores_by_hand(rows, set(targets)), strict=True), key=lambda x: repr(x[0]))
    assert len(found) == len(rows)
    for r, (row, (n, target, background)) in zip(found, wanted, strict=True):
        assert (r.doc_id, r.text, r.n_tokens) == (*row, n)
        assert (r.loss_target, r.loss_background) == (pytest.approx(target, rel=1e-9), pytest.approx(background, rel=1e-9)) if n else r.score is None
        assert not n or r.score == pytest.approx(target - background, abs=1e-9)


def test_lm_score_tells_likeness_and_not_the_list(spark):
    """Equal distributions score alike on either side of the label; another one is told by what it is like."""
    draw = random.Random(8)
    plain, other = [f"w{k}" for k in range(200)], [f"w{k}" for k in range(100, 400)]
    rows = [(k, " ".join(draw.choice(plain) for _ in range(60))) for k in range(600)]
    df, half = spark.createDataFrame(rows, "doc_id long, text string"), spark.range(0, 600, 2).withColumnRenamed("id", "doc_id")
    mean = {r.side: r.mean for r in lm_score.score(df, half).groupBy((F.col("doc_id") % 2).alias("side")).agg(F.avg("score").alias("mean")).collect()}
    assert abs(mean[0] - mean[1]) < 0.05 and abs(mean[0]) < 0.05
    # Target: half of the first kind; what is not on the list scores by its kind.
    rows += [(k, " ".join(draw.choice(other) for _ in range(60))) for k in range(600, 1200)]
    scored = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), half)
    by = {(r.a, r.b): r.mean for r in scored.groupBy((F.col("doc_id") < 600).alias("a"), (F.col("doc_id") % 2 == 0).alias("b")).agg(F.avg("score").alias("mean")).collect()}
    assert abs(by[True, True] - by[True, False]) < 0.05 and by[True, False] < -0.3 < 0.3 < by[False, False]


def test_lm_score_without_targets_or_rows(spark):
    df = table(spark, ["a b a", None, "c"])
    none = spark.createDataFrame([], "doc_id long")
    found = {r.doc_id: r for r in lm_score.score(df, none).collect()}
    assert found[0].loss_target == pytest.approx(np.log(4)) and found[0].score == 0 and found[1].loss_target is None
    assert lm_score.score(df.limit(0), none).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert [r.n_tokens for r in lm_score.score(twice, none).orderBy("n_tokens").collect()] == [0, 1, 2, 2]


def common_by_hand(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = list(row)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def classes_by_hand(rows):
    """Connected components of the pairs whose five-word shingles, as words, share a subsequence of 0.8 of their union."""
    words = [(t or "").split() for t in rows]
    seqs = [[tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else [] for w in words]
    counts = [Counter(x) for x in seqs]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            need = 0.8 * (len(seqs[a]) + len(seqs[b])) / 1.8 - 1e-9
            if seqs[a] and seqs[b] and sum((counts[a] & counts[b]).values()) >= need and (seqs[a] == seqs[b] or common_by_hand(seqs[a], seqs[b]) >= need):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: root(k) for k in range(len(rows))}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    draw = random.Random(seed)
    rows = texts(seed)
    base = [f"b{draw.randrange(10**6)}" for _ in range(120)]
    for _ in range(40):
        w = list(base)
        for _ in range(draw.randrange(1, 5)):
            w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
        rows.append(" ".join(w))
    rows += [" ".join(base[k : k + 12]) for k in (0, 1)] + [" ".join(base[:20]), " ".join(base[:19])]
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(table(spark, rows), hubs_a_round=2).collect()}
    assert found == classes_by_hand(rows)


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in neardup.near_duplicates(rows).collect()) == [(-1, -1), (3, 3), (3, 3), (7, 3)]


def test_alignment():
    draw = random.Random(5)
    for k in range(600):
        a = [draw.randrange(3 if k % 5 == 0 else 30) for _ in range(draw.randrange(1, 60))]
        b = [x for x in a if draw.random() > 0.1] + [draw.randrange(30) for _ in range(draw.randrange(3))] or [1]
        best = common_by_hand(a, b)
        assert neardup.alike(a, b) == (best / (len(a) + len(b) - best) >= 0.8 - 1e-12)
    long = list(range(200_000))
    assert neardup.alike(long, long[:100_000] + [-1, -2] + long[100_003:])


def test_short_texts_by_order_minhash():
    """Similar texts of all small lengths share a key, and no text gives keys by other means."""
    draw = random.Random(9)
    for n in range(4, 40):
        for _ in range(40):
            a = [f"w{draw.randrange(10**6)}" for _ in range(n + 4)]
            b = a[1:] if draw.random() < 0.5 else a[:-1]
            keys = []
            for w in (a, b):
                h = neardup.labelled(np.array(neardup._sequence(" ".join(w), 5), dtype=np.uint64))
                keys.append(set(neardup.sketch_keys(h, 0.8, neardup.TABLES, neardup.PICKS).tolist()))
            similar = (len(a) - 5) / (len(a) - 4) >= 0.8
            assert bool(keys[0] & keys[1]) or not similar
            assert len(keys[0]) in (24, 40, 64)


def test_warc(spark):
    big = "é" * 700_000
    rows = [(1, "http://a/ b", "x"), (2, "u", "x"), (3, "u", None), (4, None, ""), (5, "u", big), (6, "u", big), (6, "u", big), (7, "u", "WARC/1.1\r\n\r\n"), (None, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    chunks = warc.read_archives(warc.write_archives(df), 1 << 16)
    found = chunks.where("last").collect()
    assert all(r.stated_digest == r.payload_digest for r in found)
    assert sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to or -1) for r in found) == [(-1, 1, "response", -1), (1, 1, "response", -1), (2, 1, "revisit", 1), (3, 0, "response", -1), (4, 0, "revisit", 3), (5, 1_400_000, "response", -1), (6, 1_400_000, "revisit", 5), (6, 1_400_000, "revisit", 5), (7, 12, "response", -1)]
    assert {r.payload_digest for r in found if r.page_id == 5} == {warc.base32(hashlib.sha1(big.encode()).digest())}
    parts = chunks.where("page_id = 5").orderBy("chunk_no").collect()
    assert len(parts) > 20 and b"".join(bytes(r.data) for r in parts).decode() == big
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    assert warc.read_archives(warc.write_archives(df, least=100)).where("record_type = 'revisit'").select("page_id").distinct().count() == 1


def test_language(spark):
    found = registry.QUERIES["op9_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    right = found.where("held_out AND lang IS NOT NULL").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.9
    odd = table(spark, [None, "", "123 !!", "déjà vu"])
    model = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    assert [(r.lang_pred == "und", r.rejected) for r in language.identify(odd, model).orderBy("doc_id").collect()] == [(True, True)] * 3 + [(False, False)]
    assert language.learn(spark.createDataFrame([], EMPTY)) == {}
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}


@pytest.mark.parametrize("settings", [{}, {"shard_words": 50, "sample": 3}, {"block_words": 400}])
def test_decontaminate(spark, docs, settings):
    rows = texts()
    split = lambda t: [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    items = [(10, rows[6].upper()[:300]), (11, rows[7]), (12, "wabc nothing here at all like it"), (13, None), (14, "two words"), (15, rows[6][:120]), (9, "aa bb aa bb aa bb aa bb aa bb aa")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for k, t in items:
        w = split(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(k))
    for r in decontaminate.scan(docs, bench, **settings).select("doc_id", "text", "hit.*").collect():
        w = split(rows[r.doc_id])
        hit, ids = set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit |= set(range(s, s + size))
                    ids |= windows[tuple(w[s : s + size])]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(ids))
        assert r.clean_text == r.text if not hit else split(r.clean_text) == [x for p, x in enumerate(w) if p not in hit]


def test_decontaminate_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs, none).agg(F.sum("hit.n_hit")).first()[0] == 0
    assert decontaminate.scan(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_gives_the_same_rows(spark, name):
    same(spark, registry.QUERIES[name], registry.SQL[name], SF)


def test_pipeline(spark):
    import corpus_pipeline

    done = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(docs.columns) <= set(done.columns) and 100 < done.count() < 400
    assert done.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
THUE = [bin(i).count("1") % 2 for i in range(1024)]
#: Two words and two texts that collide in any polynomial modulo 2 ** 64.
THUE_WORDS = ["".join("ab"[v] for v in THUE), "".join("ba"[v] for v in THUE)]
THUE_TEXTS = [" ".join(("left", "right")[v] for v in THUE), " ".join(("right", "left")[v] for v in THUE)]


def test_no_collisions_by_power_of_two_modulus(spark):
    rows = [" ".join([*(f"x{k}" for k in range(25)), w, *(f"y{k}" for k in range(25))]) for w in THUE_WORDS]
    df = table(spark, rows)
    assert [r.dedup.n_removed for r in substring.remove(df).collect()] == [0, 0]
    bench = spark.createDataFrame([("it", f"x20 x21 x22 x23 x24 {THUE_WORDS[0]} y0 y1 y2 y3")], "item_id string, text string")
    assert {r.doc_id: r.hit.n_hit for r in decontaminate.scan(df, bench).collect()} == {0: 10, 1: 0}
    long = table(spark, THUE_TEXTS)
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(long).collect()} == {0: 0, 1: 1}
    assert [r.dedup.n_removed for r in substring.remove(spark.createDataFrame([(k, t) for k, t in enumerate(THUE_TEXTS)], "doc_id long, text string"), window=1000).collect()] == [0, 0]


def test_long_texts_in_pieces(spark, monkeypatch):
    """The pieces of a long text give what the whole gives."""
    from framelake.llm import common

    draw = random.Random(8)
    words = [f"v{draw.randrange(10**6)}" for _ in range(6000)]
    rows = [" ".join(words), " ".join(words[1000:1200] + ["new"] * 30 + words[4000:5900]), "z" * 30_000 + " " + " ".join(words[5000:5100])]
    whole = common.word_slices
    monkeypatch.setattr(substring, "word_slices", lambda texts, overlap, kind=None: whole(texts, overlap, kind, 1000))
    df = table(spark, rows)
    found = {r.doc_id: r.dedup.n_removed for r in substring.remove(df).collect()}
    assert found == {0: 0, 1: 200 + 1900, 2: 100}


def test_mixing_joins_where_broadcast_is_too_large(spark):
    df = spark.createDataFrame([(k, "x" * (1 + k % 7), f"s{k % 5}" if k % 11 else None) for k in range(500)], "doc_id long, text string, source string")
    key = lambda r: (r.doc_id, r.copy_id, r.mix_key)
    assert sorted(map(key, mixing.mix(df, most_broadcast=0).collect())) == sorted(map(key, mixing.mix(df).collect()))


def test_language_letters(spark):
    model = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    odd = table(spark, ["²½", "Ⅷ ①", "１２３", "́̂", "नमस्ते दुनिया", "ªword"])
    assert [r.lang_pred == "und" for r in language.identify(odd, model).orderBy("doc_id").collect()] == [True] * 4 + [False] * 2
    assert language.letters("नमस्ते 1 É!") == "नमस्ते é"


def test_language_by_hand(spark):
    """The query's rows, from sizes computed here."""
    import zlib

    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs.where(~language.in_fold()))
    texts_of = {r.doc_id: r.text for r in docs.collect()}
    for r in registry.QUERIES["op9_language"](spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        plain = "".join(c if c.isalpha() or __import__("unicodedata").category(c)[0] == "M" else " " for c in (texts_of[r.doc_id] or "").lower())
        data = " ".join(plain.split()).encode()
        if not data:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        sizes = {}
        for lang, shared in model.items():
            engine = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(shared.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=language.LEVEL, write_content_size=False)
            sizes[lang] = sum(len(engine.compress(data[k : k + language.PIECE_BYTES])) for k in range(0, len(data), language.PIECE_BYTES))
        assert sizes[r.lang_pred] == min(sizes.values())
        first, second = sorted(sizes.values())[:2]
        assert r.score == pytest.approx((second - first) / second)


def test_many_languages(spark):
    draw = random.Random(6)
    rows = [(k, " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(8)), f"l{k:03d}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    assert len(model) == 600
    assert language.identify(df.limit(5), model).where("lang_pred = lang").count() == 5
    assert sum(map(len, language.learn(df, model_bytes=60_000).values())) <= 64_000


def test_tokens_query(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, "中文，没有空格。" * 400), (2, "QUJD123abc/+" * 300), (3, None), (4, ""), (5, "word " * 1024), (6, "word " * 1026), (6, "again"), (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = []
    for k, t in rows:
        n = len(whole.encode(t or "", add_special_tokens=False))
        want.append((k or -1, len((t or "").encode()), n, n > 1024))
    found = [(r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.op3_tokens(spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(want)
    text = "中文，没有空格。QUJD123abc don't  stop\n1st 2nd\t3rd <|endoftext|> é1" * 30
    cut = list(tokens.pieces(text, 7))
    assert len(cut) > 50 and sum(len(whole.encode(p, add_special_tokens=False)) for p in cut) == len(whole.encode(text, add_special_tokens=False))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert tokens.op3_tokens(spark, f"{tmp_path}/none").count() == 0


def test_warc_torn_archives(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(k, "u", f"payload {k} " * 50) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(df, f"file://{tmp_path}/a")
    path = manifest.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    raw = gzip.decompress(data)
    for torn in (data[: len(data) // 2], data[:-3], gzip.compress(raw[: len(raw) // 2])):
        open(path, "wb").write(torn)
        with pytest.raises(Exception, match="ends within|holds"):
            warc.read_archives(manifest).count()
    members = data.split(b"\x1f\x8b\x08")
    open(path, "wb").write(b"\x1f\x8b\x08".join(members[:11]))
    with pytest.raises(Exception, match="holds 10 records of 20"):
        warc.read_archives(manifest).count()
    open(path, "wb").write(data)
    assert warc.read_archives(manifest).where("last").count() == 20


def test_decontaminate_query(spark, tmp_path):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words).upper()), (2, "w3 w4, w5"), (3, None), (4, ""), (4, "w0 " + " ".join(words[5:16]))]
    items = [("b", " ".join(words[4:16])), ("a", "W3-w4"), (None, "w39"), ("a", "w3 w4"), ("c", None), ("d", "...")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    found = sorted(tuple(r) for r in decontaminate.op10_decontaminate(spark, str(tmp_path)).collect())
    assert found == sorted([(1, 40, 14, 3, sha(["", "a", "b"]), True), (2, 3, 2, 1, sha(["a"]), True), (3, 0, 0, 0, sha([]), False), (4, 0, 0, 0, sha([]), False), (4, 12, 11, 1, sha(["b"]), True)])


def test_kept_tables_are_released(spark):
    import glob

    from framelake.llm import common

    since = common.mark()
    assert common.keep(spark.range(3)).count() == 3
    where = common._HELD[-1][1].removeprefix("file://")
    assert glob.glob(f"{where}/*.parquet")
    common.release(since)
    assert not glob.glob(where)


def test_texts_of_many_megabytes(spark):
    """A text far over a piece's size, in the operators that take it in pieces."""
    draw = np.random.default_rng(12)
    words = [f"w{x}" for x in draw.integers(0, 10**9, 950_000).tolist()]
    whole = " ".join(words)
    assert len(whole) > 8 << 20
    # Where the pieces of 4 MB meet, and the end of all.
    near = [len(whole[: k << 22].split()) for k in (1, 2)]
    parts = [words[n - 300 : n + 300] for n in near] + [words[-100:]]
    df = spark.createDataFrame([(0, whole), *((k + 1, " ".join(p)) for k, p in enumerate(parts))], "doc_id long, text string")
    removed = {r.doc_id: (r.dedup.n_words, r.dedup.n_removed) for r in substring.remove(df, keep_text=False).drop("text").collect()}
    assert removed == {0: (950_000, 0), 1: (600, 600), 2: (600, 600), 3: (100, 100)}
    sizes = [len(" ".join(p)) for p in parts]
    found = {r.doc_id: (r.dedup.n_bytes, r.dedup.n_removed, r.dedup.n_spans) for r in suffix.remove(df, keep_text=False).drop("text").collect()}
    # A part's neighbours in the whole may share a byte with its ends.
    assert found[0][0] == len(whole) and found[0][2] == 3 and 0 <= found[0][1] - sum(sizes) <= 0
    assert all(found[k + 1] == (n, n, 1) for k, n in enumerate(sizes))
    bench = spark.createDataFrame([(k, " ".join(p[250:350])) for k, p in enumerate(parts[:2])], "item_id long, text string")
    hit = {r.doc_id: (r.hit.n_words, r.hit.n_hit, r.hit["items"]) for r in decontaminate.scan(df, bench, keep_text=False).drop("text").collect()}
    assert hit == {0: (950_000, 200, ["0", "1"]), 1: (600, 100, ["0"]), 2: (600, 100, ["1"]), 3: (100, 0, [])}
    scored = {r.doc_id: (r.n_tokens, r.loss_background) for r in lm_score.score(df, df.where("doc_id = 1").select("doc_id")).drop("text").collect()}
    ones, pairs, n = Counter(words), Counter(zip([None, *words], words)), 950_000 + sum(map(len, parts))
    for p in parts:
        ones.update(p)
        pairs.update(zip([None, *p], p))
    ones[None] = 4
    loss = [-np.log(0.6 * pairs[a, b] / ones[a] + 0.35 * ones[b] / n + 0.05 / n) for a, b in zip([None, *words], words)]
    assert scored[0] == (950_000, pytest.approx(np.mean(loss), rel=1e-9))


def test_documents_in_pieces(monkeypatch):
    """Words and digests of long texts, read in pieces, are those of the whole."""
    import pyarrow as pa

    from framelake.llm import common

    draw = random.Random(3)
    rows = [None, "", "a b", "".join(draw.choice("abc   \n") for _ in range(5000)), " ", "z" * 900, "x y"]
    whole = list(neardup.documents_of(pa.array(rows)))
    plain = common.word_slices
    monkeypatch.setattr(neardup, "word_slices", lambda texts, overlap: plain(texts, overlap, None, 50))
    pieces = list(neardup.documents_of(pa.array(rows)))
    assert len(whole) == len(pieces) == len(rows)
    for t, (a, b), (c, d) in zip(rows, whole, pieces, strict=True):
        assert (a == c).all() and b == d == hashlib.sha256(" ".join((t or "").split()).encode()).digest() and len(a) == len((t or "").split())
