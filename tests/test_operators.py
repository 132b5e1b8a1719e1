import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import images, likeness, text
from framelake.operators import cache, frames, packing, search, stitching, tree


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("value", "unit"), [("E0" * 150, "E0"), ("ok " * 10 + "z" * 400, "z"), ("a sane text. " * 30, None), ("x" * 199, None), ("", None), (None, None)])
def test_stuck_unit(spark, value, unit):
    def plain(t):
        t = (t or "").strip()
        for u in range(1, 25):
            end, n = t[-u:], 0
            while len(t) >= u * (n + 1) and t[len(t) - u * (n + 1) : len(t) - u * n] == end:
                n += 1
            if len(t) >= 200 and end.strip() and n >= 6 and n * u >= 0.6 * len(t):
                return end
        return None

    assert one(spark, value, text.stuck_unit) == plain(value)
    assert unit is None or plain(value) == unit


@pytest.mark.parametrize(("value", "wanted"), [("<think>a</think> b", "b"), ("a</think>b", "b"), ("a<think>b", "a"), ("plain", "plain"), ("<think>x\ny</think>\n z ", "z")])
def test_without_thinking(spark, value, wanted):
    assert one(spark, value, text.without_thinking) == wanted


@pytest.mark.parametrize(("value", "wanted"), [('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('so {"a": 1} there', '{"a": 1}'), ("the [1, 2] list", "[1, 2]"), ("none", None)])
def test_json_answer(spark, value, wanted):
    assert one(spark, value, text.json_answer) == wanted


def test_lines_and_slug(spark):
    assert one(spark, "a\r\nb\n\nc\n", text.lines) == ["a", "b", "", "c"]
    assert one(spark, "clip_20240131_235959", text.base_slug) == "clip"
    assert one(spark, "30/0", text.frame_rate) == 30.0
    assert one(spark, "import os\nfrom a.b import c\nfrom . import d", text.python_imports) == ["a.b", "os"]
    assert one(spark, "import a.b\nfrom c import (", text.python_imports) == ["a.b", "c"]


ODD_SPACES = "\xa0\u3000 \t\x85\x1f"


def test_white_space_is_that_of_unicode(spark):
    for ends in (ODD_SPACES, "\u2003\u202f", " \x0b", ""):
        x = f"{ends}A\t \u3000b{ends}"
        assert one(spark, x, text.strip) == x.strip() and one(spark, x, text.line_norm) == stitching.plain(x)
        assert one(spark, f"<think>a</think>{ends}b{ends}", text.without_thinking) == "b"
    rows = [(1, 0, 0, "\xa0"), (1, 0, 1, "\u3000\t"), (1, 0, 2, "x\u2009\xa0")]
    found = stitching.blank_runs_collapsed(spark.createDataFrame(rows, "video long, frame_id int, line_no int, line string"), ["video", "frame_id"])
    assert sorted(r.line for r in found.collect()) == ["", "x"]


def test_coverage_by_hand(spark):
    def plain(a, b):
        have = lambda t: {"".join(y.split()) for y in t.splitlines() if y.strip()}
        return sum(x in have(b) for x in have(a)) / len(have(a)) if have(a) else 1.0

    draw = random.Random(5)
    pieces = ["a", "b", " ", "\xa0", "\u3000", "\n", "\x85", "\u2028", "\t", "\x1c", "\x1f", "\r\n", "cd"]
    for _ in range(25):
        a, b = ("".join(draw.choice(pieces) for _ in range(30)) for _ in range(2))
        got = spark.createDataFrame([(a, b)], "a string, b string").select(text.coverage(F.col("a"), F.col("b"))).first()[0]
        assert got == pytest.approx(plain(a, b)), (a, b)


@pytest.mark.parametrize(("path", "kind"), [("a/b.PNG", "png"), ("b.webp", "webp"), ("b.jpg", "jpeg"), ("b.JPEG", "jpeg"), ("b.gif", "jpeg"), ("b", "jpeg"), ("a.png/b", "jpeg"), (".png", "jpeg")])
def test_data_url(spark, path, kind):
    assert one(spark, path, lambda x: text.data_url(F.lit(b"abc"), x)) == f"data:image/{kind};base64,YWJj"


def scroll(doc, view, step, noise=0.0, drop=0.0, seed=0):
    draw, out = random.Random(seed), []
    for at in range(0, max(1, len(doc) - view + step), step):
        part = [x for x in doc[at : at + view] if draw.random() >= drop]
        out.append([x[:-1] + "#" if draw.random() < noise and len(x) > 8 else x for x in part])
    return out


def recovered(lines, found, least):
    return sum(any(SequenceMatcher(None, x, y).ratio() >= least for y in found) for x in lines) / len(lines)


WORDS = [f"{a} {b} {c}" for a in ("amber", "violet", "copper", "silver", "indigo") for b in ("river", "mountain") for c in ("whispers", "thunders", "glimmers", "collapses", "journeys")]


def test_clean_scroll_is_whole():
    found = stitching.stitched(scroll(WORDS, 20, 3))
    assert recovered(WORDS, found, 0.9) == 1 and len(found) <= len(WORDS) + 2


def test_repeated_frames_add_nothing():
    shown = scroll(WORDS, 12, 3)
    shown.insert(3, list(shown[2]))
    found = stitching.stitched(shown)
    assert len(found) <= len(WORDS) + 2


@pytest.mark.parametrize(("noise", "drop", "seed"), [(0.25, 0, 4), (0.15, 0.05, 11), (0.15, 0.05, 3)])
def test_noisy_scroll(noise, drop, seed):
    found = stitching.stitched(scroll(WORDS, 18, 3, noise, drop, seed), 0.8)
    assert recovered(WORDS, found, 0.75) >= 0.9 and len(found) <= 1.3 * len(WORDS)


def test_kinds_equal_the_plain_scan():
    draw = random.Random(2)
    lines = [w if draw.random() < 0.7 else w[:-2] + "zz" for w in WORDS * 2]
    fast, firsts, plain = stitching.Kinds(0.85), [], []
    for x in lines:
        k = next((i for i, y in enumerate(firsts) if SequenceMatcher(None, x, y).ratio() >= 0.85), len(firsts))
        if k == len(firsts):
            firsts.append(x)
        plain.append(k)
    assert [fast.number(x) for x in lines] == plain
    assert fast.compared < len(lines) * len(firsts)


def test_lines_within_reach_are_compared_once(monkeypatch):
    """Frames show a line again and again; old ones are forgotten."""
    draw, seen = random.Random(8), []
    lines = ["".join(draw.choice("aeinrst ") for _ in range(draw.choice([90, 120, 260]))) for _ in range(200)]
    lines[50:53] = [lines[10], lines[11][:-3] + "xyz", ""]
    monkeypatch.setattr(likeness, "ratio", lambda a, b: seen.append((a, b)) or SequenceMatcher(None, a, b).ratio())
    scroll_of = stitching.Scroll(0.85)
    for k in range(0, 192, 4):
        scroll_of.add(lines[k : k + 12])
    assert [x for x, _ in scroll_of.lines()] == lines
    assert len(seen) == len(set(seen)) > 200 and len(scroll_of.likes.near) <= 72


def test_likeness_is_that_of_difflib(monkeypatch):
    draw = random.Random(5)
    letters = ["x", "ab", "abcdefgh ", "".join(map(chr, range(130))), "".join(map(chr, range(97, 300))), "\u6f22\u5b57\0\ud800\U0001f600"]
    pairs = [("", ""), ("", "a"), ("a", ""), ("ab" * 150, "ab" * 150), ("ab" * 150 + "q", "q" + "ab" * 150)]
    for k in range(1200):
        some = letters[k % 6]
        b = [draw.choice(some) for _ in range(draw.choice([1, 3, 10, 50, 150, 199, 200, 201, 450]))]
        a = [draw.choice(some) for _ in range(draw.choice([1, 3, 10, 50, 150, 250]))]
        if k % 4 < 2:
            at = draw.randrange(len(b))
            a = b[at:] + b[:at] if k % 4 else [x if draw.random() < 0.95 else draw.choice(some) for x in b]
        pairs.append(("".join(a), "".join(b)))
    wanted = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [likeness.ratio(a, b) for a, b in pairs] == wanted
    monkeypatch.setattr(likeness, "MOST_BITS", 1 << 12)
    assert [likeness.ratio(a, b) for a, b in pairs] == wanted


def test_document_drops_boilerplate(spark):
    rows = [(1, k, "Running Title\n" + "\n".join(part) + "\nPage 3 of 9") for k, part in enumerate(scroll(WORDS, 15, 3))]
    found = [r.line for r in stitching.document(spark.createDataFrame(rows, "video long, frame_id int, ocr string"), "video").orderBy("line_no").collect()]
    assert "Running Title" not in found and "Page 3 of 9" not in found and recovered(WORDS, found, 0.9) == 1


def test_keyframes_equal_a_plain_loop(spark):
    draw = random.Random(1)
    rows = [(v, round(k * 0.3, 3), k, None if k % 17 == 5 else draw.random() * 10) for v in (0, 1, None) for k in range(60)]
    df = spark.createDataFrame(rows, "video long, seconds double, frame long, signal double")
    found = frames.keyframes(df, "video", ("seconds", "frame"), "seconds", "signal", 4.0)
    wanted, last, n = [], {}, {}
    for v, s, k, x in rows:
        gap = s - last[v][0] if v in last else None
        if v not in last or gap >= 4.0 or (gap >= 0.5 and x is not None and last[v][1] is not None and abs(x - last[v][1]) >= 4.0):
            last[v], n[v] = (s, x), n.get(v, -1) + 1
            wanted.append((v, k, n[v]))
    assert sorted(map(repr, ((r.video, r.frame, r.frame_id) for r in found.collect()))) == sorted(map(repr, wanted))


def test_folds_stream_a_large_group(spark):
    """A million rows of one group pass through one task, with a state of a few numbers."""
    from pyspark.sql import types as T

    from framelake.operators.folds import folded

    rows = spark.range(1_000_000).select(F.lit(1).alias("g"), F.col("id").alias("pos"), F.lit(10).alias("cost"))
    kind = T.StructType([T.StructField("pos", T.LongType()), T.StructField("total", T.LongType())])
    done = folded(rows, "g", ["pos"], lambda: 0, lambda total, row: (total + row[2], (row[1], total + row[2])), kind)
    assert done.agg(F.count("*"), F.max(F.abs(F.col("total") - 10 * (F.col("pos") + 1)))).first()[:] == (1_000_000, 0)


def test_chains_follow_a_large_group(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("g"), F.col("id").alias("pos"), F.lit(10).alias("cost"))
    done = packing.packed(rows, "g", ["pos"], "cost", 100)
    assert done.agg(F.max("chunk_id"), F.count("*"), F.max(F.col("chunk_id") - F.floor(F.col("pos") / 10))).first()[:] == (5_999, 60_000, 0)
    shown = spark.range(30_000).select(F.lit(1).alias("video"), (F.col("id") / 10.0).alias("seconds"), F.col("id").alias("frame"))
    assert frames.keyframes(shown, "video", ("seconds", "frame"), "seconds", least=1.0, most=1.0).count() == 3_000


def picture(k, height=60, width=80):
    """A still with a square that has moved by k pixels."""
    image = np.full((height, width, 3), 30, np.uint8)
    image[10:50, 5 + k : 35 + k] = (200, 120, 40)
    return image


def shots(spark, images_of):
    rows = [("v", k, 10.0, *x.shape, x.tobytes()) for k, x in enumerate(images_of)]
    return spark.createDataFrame(rows, "video string, frame_index long, fps double, height int, width int, channels int, data binary")


def test_keyframes_of_images(spark):
    still, moved = picture(0), picture(30)
    found = frames.keyframes_of_images(shots(spark, [still] * 12 + [moved] * 3 + [still] * 50)).orderBy("frame_id").collect()
    # The first; the move; the move back once half a second has passed; and one for four seconds without a change.
    assert [(r.frame_id, r.frame_index, r.timestamp) for r in found] == [(0, 0, 0.0), (1, 12, 1.2), (2, 17, 1.7), (3, 57, 5.7)]
    assert bytes(found[1].data) == moved.tobytes()


def test_static_images_are_dropped(spark):
    shown = [picture(0), picture(0), picture(20), picture(20), picture(20, 30, 40), picture(0), picture(0)]
    found = frames.without_static_images(shots(spark, shown)).orderBy("frame_id").collect()
    assert [(r.frame_id, r.frame_index) for r in found] == [(0, 0), (1, 2), (2, 4), (3, 5)]
    assert [r.frame_index for r in frames.without_static_images(shots(spark, shown), step_frames=3).collect()] == [0, 3, 6]


def test_frames_are_written_and_read(spark, tmp_path):
    from framelake.sources import readers, sinks

    kept = frames.without_static_images(shots(spark, [picture(0), picture(20)]))
    rows = sinks.frame_images(kept, f"file://{tmp_path}/runs", 40).orderBy("frame_id").collect()
    assert [(r.width, r.height, r.timestamp_str) for r in rows] == [(40, 30, "00:00:00.000"), (40, 30, "00:00:00.100")]
    again = readers.frame_images(spark, f"{tmp_path}/runs").orderBy("frame_index").collect()
    assert [(r.video, r.frame_index, r.height, r.width, r.channels) for r in again] == [("v", 0, 30, 40, 3), ("v", 1, 30, 40, 3)]
    small = np.frombuffer(bytes(again[0].data), np.uint8).reshape(30, 40, 3)
    assert np.abs(small.astype(int) - picture(0)[::2, ::2].astype(int)).mean() < 8
    assert readers.frame_bytes(spark, f"{tmp_path}/runs/v", "frame_000001.png").count() == 1
    assert readers.frame_bytes(spark, f"{tmp_path}/runs/v", "../x").count() == 0


def test_lines_end_as_python_has_it(spark):
    for x in ("a\x0bb\x0cc\x1cd\x1de\x1ef", "a\x85b\u2028c\u2029d", "a\r\n\r\nb\n", "\n", "", "x"):
        assert one(spark, x, text.lines) == x.splitlines()


def test_modules_of_code_that_does_not_parse(spark):
    code = "import a.b, c\nfrom d.e import (\n  import g\nfrom . import h\nfrom .i import j\nfromage k\nimport\nfrom x import\nthis is prose"
    assert one(spark, code, text.python_imports) == ["a.b", "d.e", "g"]


def test_packing_keeps_order_and_budget(spark):
    rows = [(1, k, "00:00", "0123456789" * (1500 if k == 20 else 30)) for k in range(54)]
    df = spark.createDataFrame(rows, "g int, pos int, ts string, caption string")
    units = packing.caption_units(df, ["g", "pos"], "ts", "caption", 1000)
    done = packing.packed(units, "g", ["pos", "piece"], "tokens", 1000, 50).orderBy("pos", "piece").collect()
    chunks = [r.chunk_id for r in done]
    assert chunks == sorted(chunks)
    for c in set(chunks):
        assert sum(r.tokens for r in done if r.chunk_id == c) <= 1000
    assert "".join(r.caption for r in units.where("pos = 20").orderBy("piece").collect()) == "0123456789" * 1500


def test_cache_never_repeats_work(spark):
    shown = spark.createDataFrame([(k, f"f{k}") for k in range(5)], "frame_id long, path string")
    known = spark.createDataFrame([(0, "a"), (1, "[Error captioning frame: x]"), (2, "")], "frame_id long, caption string")
    held = cache.usable(known, "caption")
    assert sorted(r.frame_id for r in cache.pending(shown, held, ["frame_id"]).collect()) == [1, 2, 3, 4]
    done = cache.completed(shown, held, ["frame_id"], "caption", lambda todo: todo.withColumn("caption", F.lit("new")))
    assert {r.frame_id: r.caption for r in done.collect()} == {0: "a", 1: "new", 2: "new", 3: "new", 4: "new"}


def test_tree_paths(spark):
    rows = spark.createDataFrame([("/a/b.py",), ("../x",), ("a/../../y",), ("c",)], "p string")
    assert [r[0] for r in rows.select(tree.safe_path(F.col("p"))).collect()] == ["a/b.py", None, None, "c"]


def test_image_kernels():
    draw = np.random.default_rng(0)
    a = draw.integers(0, 255, (48, 64, 3)).astype(np.uint8)
    assert images.fit(1920, 1080, 1280) == (1280, 720) and images.fit(10, 5, 20) == (10, 5)
    assert images.similarity(images.gray(a), images.gray(a))[0] == pytest.approx(1)
    assert images.histogram_match(images.histogram(a), images.histogram(a)) == pytest.approx(1)
    b = a.copy()
    b[:, 32:] = 255 - b[:, 32:]
    score, cells = images.similarity(images.gray(a), images.gray(b))
    assert score < 0.9 and 0.2 < images.changed_area(cells) < 0.8
    same, other = (images.perceptual_hash(images.gray(x)) for x in (a, b))
    assert images.perceptual_hash(images.gray(a)) == same and same != other
    assert images.shrink(a, 24, 32).mean() == pytest.approx(a.mean())


def test_text_search(spark):
    rows = spark.createDataFrame([(1, "red car"), (2, "blue sky"), (3, "red sky")], "id long, t string")
    assert search.token_overlap(rows, "red sky", "t", 1).first().id == 3
