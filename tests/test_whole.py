"""Queries that read whole texts, on fixtures with cases beyond any prefix."""

import hashlib
import random
from collections import Counter
from difflib import SequenceMatcher

from framelake import catalog, catalog_records
from framelake.functions import text


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_majority_votes_on_every_line(spark, tmp_path):
    rows = [(1, "a\nb\nc\nd\ne", "s"), (2, "a\nB\nc\ndd\nlonger", "s"), (3, "x\nb\nc\ndd", "s"), (4, "1\n2\n3\n4\n5\r\n6\n", "t"), (5, None, "t"), (6, "", "t"), (7, "n\n\n\n\nend", None), (8, "\n".join(f"l{k}" for k in range(500)), "u")]
    ballots = {}
    for doc_id, text, source in rows:
        for k, line in enumerate((text or "").splitlines()):
            ballots.setdefault((source, k), []).append((line, doc_id))
    wanted = set()
    for at, seen in ballots.items():
        times, first = Counter(x for x, _ in seen), {x: d for x, d in reversed(seen)}
        wanted.add((*at, max(times, key=lambda x: (times[x], len(x), -first[x])), len(seen)))
    found = {(r.source, r.line_no, r.line, r.votes) for r in catalog.QUERIES["majority_line"](spark, documents(spark, tmp_path, rows)).collect()}
    assert found == wanted and ("s", 4, "longer", 2) in found and ("u", 499, "l499", 1) in found


def test_stuck_ends_show_in_every_text(spark, tmp_path):
    head = "Some clean words that a model wrote. "
    rows = [(3, head + "xy" * 200, "s"), (6, head * 9, "s"), (9, head * 4 + "ab c" * 300 + "  \n", "s"), (1, head + "E0" * 200, "s"), (12, "z" * 199, "s"), (15, "z" * 200, "s"), (18, head * 40 + "xy" * 20, "s"), (21, None, "s"), (24, " " * 400, "s"), (27, "q" * 100 + head * 3, "s")]
    found = {r.doc_id: r.unit for r in catalog.QUERIES["degenerate_text"](spark, documents(spark, tmp_path, rows)).collect()}
    assert found == {3: "xy", 6: None, 9: "ab c", 1: "E0", 12: None, 15: "z", 18: None, 24: None, 27: None}


def test_markers_and_refusals_show_in_every_text(spark, tmp_path):
    long = "A line of prose.\n" * 400
    rows = [(0, " [No Text]\n", "s"), (4, "kept", "s"), (1, " two \n", "s"), (2, long + "I cannot see the image", "s"), (3, "Please attach one more image", "s"), (5, "no text here", "s"), (6, None, "s"), (8, "No picture\nhas been sent", "s")]
    found = {r.doc_id: (r.reading, r.refused) for r in catalog.QUERIES["empty_markers_and_refusals"](spark, documents(spark, tmp_path, rows)).collect()}
    assert found == {0: ("", False), 4: ("kept", False), 1: ("two", False), 2: (long + "I cannot see the image", True), 3: ("Please attach one more image", True), 5: ("no text here", False), 8: ("No picture\nhas been sent", True)}


def test_queries_without_sql(spark, tmp_path):
    body = "\n".join(hashlib.sha1(str(k).encode()).hexdigest() for k in range(40))
    rows = [(1, body, "en", "a", 1), (2, "A  b\n\na b\nzz", "en", None, 1), (3, None, None, "b", 1), (4, "", "fr", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    norm = lambda x: " ".join(x.lower().split())
    ratio = lambda a, b: float(a == b) if not a or not b else round(SequenceMatcher(None, a, b).ratio(), 9)
    wanted = {(k, n, ratio(norm(a), norm(b))) for k, t, *_ in rows for p in [(t or "").split("\n")] for n, (a, b) in enumerate(zip(p, p[1:]))}
    assert {tuple(r) for r in catalog.QUERIES["line_ratio"](spark, str(tmp_path)).collect()} == wanted
    stitched = catalog.QUERIES["stitch_scroll_frames"](spark, str(tmp_path)).where("video = 1").orderBy("line_no").collect()
    assert [r.line for r in stitched] == body.split("\n")


def test_pages_of_one_url_are_listed_by_their_ids(spark, tmp_path):
    rows = [(k, f"http://{'ab'[k % 2]}.org/{k // 8}", "x") for k in reversed(range(40))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    wanted = {(k, f"{'ab'[k % 2]}.org", k // 2) for k in range(40)}
    assert {tuple(r) for r in catalog_records.sorted_listing(spark, str(tmp_path)).collect()} == wanted


def test_line_ratios_are_of_each_row_and_without_difflib(spark, tmp_path, monkeypatch):
    """Rows that share an id are documents of their own, and no ratio of usual lines is left to difflib."""
    draw = random.Random(4)
    lines = ["".join(draw.choice("aeinrst") for _ in range(n)) for n in (90, 120, 150, 240, 260, 80)]
    rows = [(1, "\n".join(lines[:3]), "s"), (1, "\n".join(lines[3:]), "s"), (None, "a\nb", "s"), (None, "c\nc", "s"), (2, "", "s"), (3, "one", "s")]
    ratio = lambda a, b: round(SequenceMatcher(None, a, b).ratio(), 9)
    wanted = [(k, n, ratio(a, b)) for k, t, _ in rows for p in [t.split("\n")] for n, (a, b) in enumerate(zip(p, p[1:]))]
    found = catalog.QUERIES["line_ratio"](spark, documents(spark, tmp_path, rows))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
    exact = [SequenceMatcher(None, a, b).ratio() for a, b in zip(lines, lines[1:])]
    monkeypatch.setattr(SequenceMatcher, "ratio", None)
    assert [text._ratio(a, b) for a, b in zip(lines, lines[1:])] == exact
