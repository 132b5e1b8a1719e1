import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import vectors
from framelake.plans import flows, models
from framelake.sources import readers, sinks
from framelake.streaming import keyframes as stream


def embedder(texts):
    return np.array([[len(t) + 1, t.count("a"), 1.0] for t in texts])


def test_ingest_and_find(spark):
    shown = spark.createDataFrame([(k, f"p{k}", float(k), "00:00:00.000") for k in range(4)], "frame_id long, path string, timestamp double, timestamp_str string")
    known = spark.createDataFrame([(0, "kept")], "frame_id long, caption string")

    def vision(path, max_tokens, temperature):
        if path == "p3":
            raise RuntimeError("down")
        return f"caption of {path}"

    rows = flows.ingest(shown, known, vision, embedder, "c1")
    found = {r.frame_id: r.document for r in rows.collect()}
    assert found == {0: "kept", 1: "caption of p1", 2: "caption of p2", 3: "[Error captioning frame: down]"}
    assert rows.select(F.round(vectors.norm(F.col("embedding")), 5)).distinct().first()[0] == 1.0
    best = flows.find(rows, "kept", embedder, 2)
    assert best.count() == 2 and best.where("position = 1").first().id == "frame_000000"


def test_summary_is_made_once(spark):
    calls, kept = [], {}
    results = spark.createDataFrame([(1, "c", "f", "text")], "position int, collection string, id string, document string")
    model = lambda *a: calls.append(a) or "sum"
    assert [flows.answer(results, "q", model, kept) for _ in range(2)] == ["sum", "sum"] and len(calls) == 1


def test_transcribe(spark):
    lines = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(36)]
    pages = {f"p{k}": "\n".join(lines[k * 6 : k * 6 + 12]) for k in range(5)}
    shown = spark.createDataFrame([("v", k, f"p{k}") for k in range(5)], "video string, frame_id int, path string")
    known = spark.createDataFrame([("v", "p0", "old", 0), ("v", "p0", pages["p0"], 1)], "video string, path string, ocr string, pos int")
    found = flows.transcribe(shown, known, lambda path, *_: pages[path]).orderBy("line_no").collect()
    assert [r.line for r in found] == lines


def test_cleanup_keeps_what_would_be_lost():
    assert flows.cleaned("a\nb\n\nc", lambda s, u, *_: u) == "a\nb\n\nc\n"
    assert flows.cleaned("a\nb\n\nc", lambda s, u, *_: "a") == "a\nb\n\nc\n"


def test_halving_and_condensing():
    def model(system, user, max_tokens, temperature):
        if user.count("---") > 0:
            raise models.Truncated
        return user.split("\n\n")[0]

    assert flows._halving(["a", "b", "c"], "1", model) == ["Segment 1a", "Segment 1ba", "Segment 1bb"]
    assert flows.condensed(["x" * 900] * 4, lambda *a: "y" * 50, 800) == ["y" * 50] * 4
    with pytest.raises(ValueError):
        flows.condensed(["x" * 900] * 4, lambda s, u, *_: u, 800)


def test_reconstruct_retries_with_feedback(spark):
    caps = spark.createDataFrame([(1, k, "00:00", f"shows {k}") for k in range(3)], "group int, frame_id long, timestamp_str string, caption string")
    verdicts = iter([{"passed": False, "feedback": "more"}, {"passed": True}])
    noted = []

    def model(system, user, max_tokens, temperature):
        if system.startswith("Classify"):
            return '{"type": "python_code"}'
        if system.startswith("Plan"):
            return '```json\n{"files": [{"filename": "a.py", "description": "d"}]}\n```'
        if system.startswith("Note"):
            noted.append(user)
            return "note"
        if system.startswith("Judge"):
            return json.dumps(next(verdicts))
        return f"content {'more' in user}"

    made = flows.reconstruct(caps, model)
    assert [(m["filename"], m["content"], m["iteration"]) for m in made] == [("a.py", "content True", 1)] and len(noted) == 1


def test_judge_sees_whole_files_and_the_whole_recording(spark):
    caps = spark.createDataFrame([(1, k, f"t{k}", f"shows {k}.") for k in range(120)], "group int, frame_id long, timestamp_str string, caption string")
    content = "".join(f"line {k}\n" for k in range(12_000))
    asked = []

    def model(system, user, max_tokens, temperature):
        if system.startswith("Plan"):
            return '{"files": [{"filename": "a.py"}, {"filename": "b.py"}]}'
        if system.startswith("Judge"):
            asked.append(user)
            return json.dumps({"passed": "line 11999\n" not in user, "feedback": "the end is wrong"})
        return "{}" if system.startswith("Classify") else content if system.startswith("Write") else "note"

    made = flows.reconstruct(caps, model, 16_384)
    assert made[0]["iteration"] == flows.ITERATIONS - 1 and all(len(u) <= 2 * 16_384 for u in asked)
    first = asked[: len(asked) // flows.ITERATIONS]
    assert all("[t0]\nshows 0." in u and "[t119]\nshows 119." in u for u in first)
    for name in ("a.py", "b.py"):
        shown = [x.split(" ---\n", 1)[1].split("\n[this part ends here")[0] for u in first for x in u.split("\n\n--- ") if x.startswith(name)]
        assert "".join(shown).rstrip("\n") == content.rstrip("\n")
    assert f"the file has {len(content)} characters" in first[0]


def test_judge_thins_captions_evenly():
    entries = [f"[{k}]\n" + "x" * 100 for k in range(50)]
    assert flows._captions_within(entries, 10_000).count("---") == 49
    thin = flows._captions_within(entries, 2000)
    assert thin.startswith("[0]") and "[49]" in thin and len(thin) <= 2000 and thin.endswith("context limit ...]")


def test_assemble_and_write(spark, tmp_path):
    files = spark.createDataFrame([("r1", "a.py", "import src.b"), ("r1", "b.py", "import os")], "folder string, src_rel string, content string")
    maps = spark.createDataFrame([("r1", "a.py", "/src/a.py", "high", ""), ("r1", "b.py", "src/b.py", "low", ""), ("r1", "c.py", "../c.py", "low", "")], "folder string, src_rel string, dst_rel string, confidence string, reasoning string")
    done = flows.assemble(files, maps, spark.createDataFrame([("src/a.py", "src.b"), ("src/b.py", "src.c")], "dst_rel string, module string"))
    assert [tuple(r) for r in done["unresolved"].collect()] == [("src/b.py", "src.c")]
    assert [r[0] for r in done["orphans"].collect()] == ["src/a.py"]
    sinks.tree(done["files"].withColumn("content", F.col("content").cast("binary")), f"file://{tmp_path}").collect()
    assert (tmp_path / "src/a.py").read_text() == "import src.b"


def test_readers(spark, tmp_path):
    run = tmp_path / "clip_20240101_000000"
    (run / "captions").mkdir(parents=True)
    (run / "output").mkdir()
    (run / "frames").mkdir()
    (run / "captions/caption_000001.json").write_text('{"frame_id": 1, "caption": "x"}')
    (run / "captions/caption_000002.json").write_text("{broken")
    (run / "output/a.md").write_text("hello")
    (run / "frames/frames_meta.json").write_text(json.dumps({"video": "v.mp4", "video_size": 5, "extraction": {"strategy": "keyframe"}, "frames": [{"frame_id": 0, "path": "p"}]}))
    (run / "output/segment_notes.json").write_text(json.dumps({"captions_sha1": "k", "notes": ["n1", "n2"]}))
    (tmp_path / "map.json").write_text('[{"folder": "f", "src_rel": "a", "dst_rel": "b"}, {"folder": "f"}]')
    assert [r.caption for r in readers.captions(spark, str(run)).where("caption IS NOT NULL").collect()] == ["x"]
    assert readers.ocr(spark, str(run)).count() == 0
    assert readers.frames(spark, str(run), "v.mp4", 5, {"strategy": "keyframe"}).count() == 1 and readers.frames(spark, str(run), "v.mp4", 6).count() == 0
    assert readers.notes(spark, str(run), "k").count() == 2 and readers.notes(spark, str(run), "j").count() == 0
    assert [r.run for r in readers.runs(spark, str(tmp_path)).collect()] == ["clip_20240101_000000"]
    assert {r.src_rel: r.snippet for r in readers.artifacts(spark, str(tmp_path)).collect()}["a.md"] == "hello"
    assert [r.confidence for r in readers.mapping_override(spark, str(tmp_path / "map.json")).collect()] == ["manual"]


def test_vector_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "frame_000000", [1.0, 0.0]), ("b", "frame_000000", [0.0, 1.0])], "collection string, id string, embedding array<float>")
    sinks.add_vectors(rows, str(tmp_path / "v"))
    sinks.reset_collection(rows.where("collection = 'a'").withColumn("id", F.lit("new")), str(tmp_path / "v"))
    assert sorted((r.collection, r.id) for r in readers.vectors(spark, str(tmp_path / "v")).collect()) == [("a", "new"), ("b", "frame_000000")]


def test_stream_and_batch_agree(spark, tmp_path):
    from framelake.operators import frames

    rows = [(v, k * 0.4, k, float((k * 7 * (v + 1)) % 11)) for v in range(2) for k in range(40)]
    df = spark.createDataFrame(rows, "video long, seconds double, frame long, signal double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = stream.keyframes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 4.0, 0.5, 4.0)
    stream.persisted(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = frames.keyframes(df, "video", ("seconds", "frame"), "seconds", "signal", 4.0)
    pick = lambda x: sorted((r.video, r.frame, r.frame_id) for r in x.select("video", "frame", "frame_id").collect())
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(batch)
