"""Settings, the chat client, and the flows that loop on a model's answers."""

import json

import pytest
from pyspark.sql import functions as F

from framelake.plans import client, flows, models, settings
from framelake.sources import readers, sinks


def test_settings(tmp_path):
    assert settings.load(None) == settings.Settings() == settings.load(str(tmp_path / "none.json"))
    (tmp_path / "s.json").write_text('{"data": "/d", "workers": 2, "new": [1]}')
    found = settings.load(str(tmp_path / "s.json"))
    assert (found.data, found.workers, found.context, found.options) == ("/d", 2, 32_768, {"new": [1]})


def test_env_files(tmp_path):
    body = "# note\nA=1 # one\nexport B='x # y'\nC=\"q\"\n1D=no\nE\nF=a b\nA=2\nG=#h\nH =  i  \n"
    assert settings.parse_env(body) == {"A": "1", "B": "x # y", "C": "q", "F": "a b", "G": "#h", "H": "i"}
    (tmp_path / "a").write_text("A=1\nB=1")
    (tmp_path / "b").write_text("B=2\nC=2")
    assert settings.with_env_files({"A": "0"}, str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")) == {"A": "0", "B": "1", "C": "2"}


def test_keys_fall_back():
    env = {"X": " your-api-key ", "MLX_API_KEY": "HF_REPLACE_ME", "OMLX_API_KEY": "k", "VLLM_OCR": "v"}
    assert settings.value_of(env, "W", "X") == "your-api-key" and settings.value_of(env, "W", "X", placeholders=False) is None
    assert settings.role_key(env, "own", "vllm") == "own" and settings.role_key(env, None, "vllm") == "local"
    assert settings.role_key(env, None, "vllm", "VLLM_OCR", "X") == "v" and settings.role_key(env, None, "mlx", "VLLM_OCR", "X") == "k"
    assert settings.job_id().startswith("sl-") and len(settings.job_id()) == 11 and len(settings.run_stamp()) == 15


def test_served_models(spark):
    assert [r.id for r in settings.served_models(spark, lambda: {"data": [{"id": "a"}, {}, {"id": "b"}]}).collect()] == ["a", "b"]

    def fails():
        raise OSError

    assert settings.served_models(spark, fails).count() == 0


def answer(content, reason="stop"):
    return {"choices": [{"message": {"content": content}, "finish_reason": reason}]}


def test_chat_sends_and_strips():
    sent = []
    chat = client.Client(lambda p: sent.append(p) or answer("<think>x</think> yes"), "m", 1000)
    assert chat.chat("s", "u", max_tokens=1000, temperature=0.1) == "yes" and "max_tokens" not in sent[0] and sent[0]["temperature"] == 0.1
    assert chat.chat("s", "u", max_tokens=10, extra={"seed": 1}) == "yes" and (sent[1]["max_tokens"], sent[1]["seed"]) == (10, 1)
    assert client.Client(lambda p: answer([{"type": "text", "text": "a"}, {"content": 1}, "b", {"type": "image"}]), "m", 10).chat("s", "u") == "a\n1\nb"
    with pytest.raises(ValueError, match="no images"):
        client.Client(chat.post, "deepseek-v4-pro", 10).chat("s", "u", images=["data:"])
    assert client.Client(chat.post, "deepseek-vl", 10).chat("s", "u", images=["data:"]) == "yes"
    assert sent[-1]["messages"][1]["content"][1]["image_url"]["url"] == "data:"


def test_chat_checks_answers():
    said = []
    cut = client.Client(lambda p: answer("half", "length"), "m", 100, warn=said.append)
    assert cut.chat("s", "u", max_tokens=5) == "half" and "5" in said[0]
    with pytest.raises(models.Truncated):
        cut.chat("s", "u", complete=True)
    stuck = client.Client(lambda p: answer("start " + "E0" * 300), "m", 100, warn=said.append)
    assert stuck.chat("s", "u").endswith("E0") and "repetitions" in said[-1]
    with pytest.raises(client.Stuck):
        stuck.chat("s", "u", complete=True)
    with pytest.raises(RuntimeError, match="no choices"):
        client.Client(lambda p: {}, "m", 100).chat("s", "u")


def test_chat_fits_the_context_once():
    sent = []

    def post(payload):
        sent.append(payload.get("max_tokens"))
        if payload.get("max_tokens", 0) > 40:
            raise client.Refused(400, '{"error": {"param": "input_tokens", "message": "The maximum context length is 100"}}')
        return answer("ok")

    assert client.Client(post, "m", 1000, lambda p: (60, 100)).chat("s", "u", max_tokens=90) == "ok" and sent == [90, 40]
    assert client.Client(post, "m", 1000).chat("s", "u", max_tokens=90) == "ok" and sent[-1] is None
    with pytest.raises(RuntimeError, match="split"):
        client.Client(post, "m", 1000, lambda p: (120, 100)).chat("s", "u", max_tokens=90)
    with pytest.raises(RuntimeError, match="HTTP 400"):
        client.Client(post, "m", 1000, lambda p: (10, 100)).chat("s", "u", max_tokens=80)

    for detail in ("maximum context length is 100", '{"error": {"param": "top_p", "message": "maximum context length"}}', '{"error": {"param": "input_tokens", "message": "bad"}}', "[1]", '{"error": "no"}'):
        def other(payload, detail=detail):
            sent.append("other")
            raise client.Refused(400, detail)

        with pytest.raises(RuntimeError, match="HTTP 400"):
            client.Client(other, "m", 1000, lambda p: (60, 100)).chat("s", "u", max_tokens=90)
    assert sent.count("other") == 5
    assert client.answer_text([{"content": [{"type": "text", "text": "a"}, None]}, {"x": 1}, 2]) == "a\n2" and client.answer_text(None) == ""

    def refuses(payload):
        raise client.Refused(401, "who")

    with pytest.raises(RuntimeError, match="API key"):
        client.Client(refuses, "m", 10).chat("s", "u")

    def raises(what):
        def post(payload):
            raise what
        return post

    with pytest.raises(RuntimeError, match="timed out"):
        client.Client(raises(TimeoutError()), "m", 10).chat("s", "u")
    with pytest.raises(RuntimeError, match="no connection"):
        client.Client(raises(ConnectionError()), "m", 10).chat("s", "u")


def captions(spark, n, size):
    return spark.createDataFrame([(k, f"00:00:{k:02d}.000", f"c{k} " + "x" * size) for k in range(n)], "frame_id long, timestamp_str string, caption string")


def test_summary_in_one_call_and_in_chunks(spark):
    asked = []

    def model(system, user, max_tokens, temperature):
        asked.append((system, user))
        return f"said {len(asked)}"

    kept = {}
    few = captions(spark, 3, 10)
    assert flows.summarise(few, model, 32_768, kept) == "said 1" == flows.summarise(few, model, 32_768, kept) and len(asked) == 1
    assert "[00:00:01.000]\nc1" in asked[0][1] and "3 frames" in asked[0][1]
    many = captions(spark, 20, 3000)
    assert flows.summarise(many, model, 8192, kept) == f"said {len(asked)}" and len(asked) > 4
    segments = [u for s, u in asked[1:-1]]
    assert "".join(segments).count("\nc") == 20 and all(len(u) / 2 < 8192 for u in segments)
    assert "Segment 1 (00:00:00.000 - " in asked[-1][1] and "said 2" in asked[-1][1]
    assert flows.summarise(few.limit(0), model) == "No captions found."


def artifacts(spark):
    rows = [("r1", "a.py", "python_code", "the app", "import src.b", "import src.b\nimport src.lost"), ("r1", "b.py", "python_code", None, "x", "import os"), *((f"r2", f"f{k:02d}.md", "markdown_document", "", "t", "text") for k in range(11))]
    return spark.createDataFrame(rows, "folder string, src_rel string, content_type string, description string, snippet string, source string")


class Assembler:
    """Answers the steps of an assembly; the first verdict is against it."""

    def __init__(self, code=True, verdicts=(False, True)):
        self.code, self.verdicts, self.asked = code, list(verdicts), []

    def __call__(self, system, user, max_tokens, temperature):
        self.asked.append((system.split(" ")[0], user))
        if system.startswith("Is this"):
            return json.dumps({"is_code_project": self.code, "reasoning": "because", "estimated_root_count": 1})
        if system.startswith("Name"):
            return '```json\n{"roots": ["src"]}\n```'
        if system.startswith("Infer"):
            sources = [x.removeprefix("src_rel: ") for x in user.splitlines() if x.startswith("src_rel: ")]
            return json.dumps([{"dst_rel": f"src/{x}", "confidence": "high"} if k else {"dst_rel": f"/src/{x}"} for k, x in enumerate(sources)])
        passed = self.verdicts.pop(0)
        return json.dumps({"passed": passed, "severity": "critical", "feedback": "move it", "specific_remappings": [{"folder": "r1", "from": "a", "to": "b"}]})


def test_assembly(spark, tmp_path):
    model = Assembler()
    done = flows.assembled(artifacts(spark), model)
    assert (done.stage, done.passed, done.iterations) == ("ready", True, 2)
    rows = {(r.folder, r.src_rel): r for r in done.mappings.collect()}
    assert len(rows) == 13 and rows["r1", "a.py"].dst_rel == "/src/a.py" and rows["r1", "a.py"].confidence == "low" and rows["r1", "b.py"].confidence == "high"
    asked = [u for s, u in model.asked if s == "Infer"]
    assert [u.count("---\n") for u in asked] == [10, 3, 10, 3] and "r1: a -> b" in asked[2] and "move it" not in asked[0]
    assert {(r.dst_rel, r.module) for r in done.found["unresolved"].collect()} == {("/src/a.py", "src.lost")}
    body = sinks.report(done.found, done.mappings, "x", done.passed, done.iterations)
    assert "- files: 13" in body and "high 11, medium 0, low 2" in body and "src.lost" in body and "low: r1/a.py as /src/a.py" in body
    sinks.text_file(spark, body, f"file://{tmp_path}/REPORT.md")
    assert (tmp_path / "REPORT.md").read_text() == body
    files = done.found["files"].select("dst_rel", F.col("source").alias("content"))
    assert sinks.tree(files, f"file://{tmp_path}/tree").count() == 13 and (tmp_path / "tree/src/b.py").read_text() == "import os"


def test_assembly_ends_early(spark):
    model = Assembler(code=False)
    assert (flows.assembled(artifacts(spark), model).stage, flows.assembled(artifacts(spark).limit(0), model).stage, len(model.asked)) == ("no_code", "empty", 1)
    dry = flows.assembled(artifacts(spark), Assembler(verdicts=[False]), dry_run=True)
    assert (dry.stage, dry.passed, dry.iterations) == ("dry_run", False, 1)
    last = flows.assembled(artifacts(spark), Assembler(verdicts=[False] * 3))
    assert (last.stage, last.passed, last.iterations) == ("ready", True, 3)


def test_assembly_with_given_mappings(spark):
    given = spark.createDataFrame([("r1", "a.py", "x/a.py", "manual", "")], "folder string, src_rel string, dst_rel string, confidence string, reasoning string")
    model = Assembler(verdicts=[False])
    done = flows.assembled(artifacts(spark), model, given)
    assert (done.stage, done.iterations, [s for s, _ in model.asked]) == ("ready", 1, ["Judge"])
    assert done.found["files"].count() == 1


def test_merged_tree(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "a.py", "1"), ("r1", "b.py", "2"), ("r2", "../c.py", "3")], "folder string, src_rel string, content string")
    given = spark.createDataFrame([("r1", "a.py", "x/a.py")], "folder string, src_rel string, dst_rel string")
    (tmp_path / "t").mkdir()
    (tmp_path / "t/old").write_text("old")
    assert sinks.merged_tree(rows, given, f"file://{tmp_path}/t").count() == 2
    assert sorted(str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").rglob("*") if p.is_file() and not p.name.startswith(".")) == ["b.py", "x/a.py"]


def test_caches_are_put_in_place(spark, tmp_path):
    where = f"file://{tmp_path}/cache"
    put = lambda rows: sinks.put_keyed(spark.createDataFrame(rows, "key string, query string, summary string"), where, "key")
    assert readers.summaries(spark, where).count() == 0
    put([("a", "q", "1"), ("b", "q", "1")])
    put([("b", "q", "2"), ("c", "q", "2")])
    assert sorted((r.key, r.summary) for r in readers.summaries(spark, where).collect()) == [("a", "1"), ("b", "2"), ("c", "2")]
    assert [p.name for p in tmp_path.iterdir()] == ["cache"]
    sinks.notes(["n1", "n2"], "sha", spark, f"{tmp_path}/run/output/segment_notes.json")
    assert [r.note for r in readers.notes(spark, f"{tmp_path}/run", "sha").orderBy("pos").collect()] == ["n1", "n2"]
    assert readers.notes(spark, f"{tmp_path}/run", "other").count() == 0


def test_video_metadata(spark):
    def probe(path):
        if path == "bad":
            raise OSError("no program")
        return {"streams": [{"codec_type": "audio"}, {"codec_type": "video", "r_frame_rate": "30000/1001", "width": 4, "height": 3, "codec_name": "h264", "nb_frames": "90"}], "format": {"duration": "3.0"}} if path == "good" else {}

    rows = {r.path: r.meta for r in readers.video_metadata(spark.createDataFrame([("good",), ("bad",), ("none",)], "path string"), probe).collect()}
    assert rows["bad"] is None and rows["none"] is None and (rows["good"].width, rows["good"].total_frames, round(rows["good"].fps, 2)) == (4, 90, 29.97)


def test_ingest_and_find_store_once(spark, tmp_path):
    import numpy as np

    calls = []
    embed = lambda x: np.array([[len(t), 1.0] for t in x])
    shown = spark.createDataFrame([(k, float(k), str(k), f"p{k}") for k in range(4)], "frame_id long, timestamp double, timestamp_str string, path string")
    known = spark.createDataFrame([(0, "seen")], "frame_id long, caption string")
    log = tmp_path / "calls"

    def vision(path, max_tokens, temperature):
        with open(log, "a") as f:
            f.write("x")
        return f"caption of {path}"

    for _ in range(2):
        found = flows.ingest_and_find(shown, known, vision, embed, "c", f"{tmp_path}/v", "query", 3)
        assert found.count() == 3
        calls.append(log.read_text())
    assert calls[0] == calls[1]


def test_models_are_called_at_once_and_in_their_rows(spark):
    import time

    shown = spark.createDataFrame([(k, f"p{k}") for k in range(30)], "frame_id long, path string").coalesce(1)

    def slow(path, max_tokens, temperature):
        time.sleep(0.1)
        if path == "p7":
            raise OSError("lost")
        return f"of {path}"

    began = time.time()
    rows = {r.frame_id: r.caption for r in models.captioned(shown, slow, tasks=2, at_once=8).collect()}
    assert rows == {k: f"of p{k}" if k != 7 else "[Error captioning frame: lost]" for k in range(30)} and time.time() - began < 20
    assert [r.ocr for r in models.read(shown.limit(1), lambda *a: "```\nx\n```", probe="p").collect()] == ["x"]
    with pytest.raises(ValueError, match="takes no images"):
        models.read(shown, lambda *a: "I cannot see the image", probe="p")


def test_vision_by_id():
    for name in ("Qwen3-VL", "deepseek-ocr", "gemma-3-27b", "unknown", "nemotron-omni"):
        models.require_vision(name)
    for name in ("DeepSeek V3", "org/gpt-oss-20b", "GLM 5.1"):
        with pytest.raises(ValueError):
            models.require_vision(name)


def test_console_table(spark):
    rows = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "x" * 20)], "n int, t string")
    assert sinks.console_table(rows, 3, 10).split("\n") == ["n  t", "1  a b", "2", "3  xxxxxxx..."]
