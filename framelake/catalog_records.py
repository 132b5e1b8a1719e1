"""Further queries: records of runs, jobs and models, and what sources and sinks give back.

Tables stand in as in `catalog`: `conversations` are captions or runs, `events` jobs or reports, `pages` files, `part` the models of a service.
Queries of sinks write a table and read it again, so their SQL is that of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake import schemas
from framelake.catalog import _ENDS, _FILES, _S, _STAMP, _files, _found, _stamped, _table, query
from framelake.functions import text, values
from framelake.operators import cache, frames, jobs, tree
from framelake.shared import folder
from framelake.sources import readers, sinks


# Models and settings.

_MODEL = "CASE p_partkey % 6 WHEN 0 THEN 'Qwen3-VL/' || p_name WHEN 1 THEN 'DeepSeek V3 ' || p_name WHEN 2 THEN 'org/Nemotron-OCR ' || p_name WHEN 3 THEN 'eagle:' || p_type WHEN 4 THEN 'x-MTP ' || p_name ELSE p_brand || '.' || p_type END"
_NORMAL = f"regexp_replace(lower({_MODEL}), '[^a-z0-9]+', '-', 'g')"


@query(f"""SELECT p_partkey, n AS model, CASE WHEN regexp_matches(n, '{"|".join(text.VISION_MARKS + text.VISION_FAMILIES)}') THEN true WHEN regexp_matches(n, '{"|".join(text.TEXT_FAMILIES)}') THEN false END AS vision,
regexp_matches(n, '{"|".join(text.DRAFT_MARKS)}|(^|-)mtp(-|$)') AS draft FROM (SELECT p_partkey, {_NORMAL} AS n FROM part)""")
def model_kinds(spark, sf_dir):
    model = F.expr(_MODEL)
    return _table(spark, sf_dir, "part").select("p_partkey", text.model_id(model).alias("model"), text.takes_images(model).alias("vision"), text.is_draft(model).alias("draft"))


@query("""SELECT o_orderkey, CASE WHEN contains(m, 'deepseek-v4') THEN 'Be brief.' || chr(10) || chr(10) || o_orderpriority ELSE o_orderpriority END AS prompt
FROM (SELECT o_orderkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'deepseek-v4-pro' ELSE 'other' END AS m FROM orders)""")
def folded_prompts(spark, sf_dir):
    model = F.when(F.col("o_orderstatus") == "F", "DeepSeek V4 Pro").otherwise("other")
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.folded_prompt(model, F.lit("Be brief."), F.col("o_orderpriority")).alias("prompt"))


@query("""SELECT o_orderkey, (CASE WHEN c >= 2548 THEN floor((c - 2548) * 0.8) ELSE ceil((c - 2548) * 0.8) END)::INT AS captions, r::INT AS reserve,
greatest(2048, CASE WHEN (c - 2548 - r) >= 0 THEN floor((c - 2548 - r) * 0.85::DOUBLE) ELSE ceil((c - 2548 - r) * 0.85::DOUBLE) END)::INT AS safe, greatest(512, least(4096, floor(t * 0.3::DOUBLE)))::INT AS target
FROM (SELECT o_orderkey, c, t, greatest(256, least(4096, greatest(256, floor(c * 0.25)))) AS r FROM (SELECT o_orderkey, 1000 + o_orderkey % 131072 AS c, o_custkey AS t FROM orders))""")
def context_budgets(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (1000 + F.col("o_orderkey") % 131072).alias("c"), F.col("o_custkey").alias("t"))
    return rows.select("o_orderkey", text.budgets(F.col("c"), F.lit(4096), F.col("t")).alias("b")).select("o_orderkey", "b.*")


# Answers and previews.

@query("SELECT conv_id, turn, role, CASE WHEN text IS NULL THEN '' WHEN role = 'user' THEN text ELSE concat_ws(chr(10), nullif(text, ''), nullif(text, ''), 'end') END AS answer FROM conversations")
def answer_parts(spark, sf_dir):
    """Answers as services send them: a text, or a list of parts."""
    t = F.col("text")
    quoted = F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", "")
    parts = F.concat(F.lit("["), quoted, F.lit(","), F.to_json(F.struct(F.lit("text").alias("type"), t.alias("text"))), F.lit(',{"type":"image"},{"content":"end"}]'))
    content = F.when(t.isNotNull(), F.when(F.col("role") == "user", quoted).otherwise(parts))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.answer_text(content).alias("answer"))


@query("SELECT conv_id, turn, role, text AS body FROM conversations")
def unfenced_answers(spark, sf_dir):
    """Texts of one role within a fence, which goes again."""
    fenced = F.when(F.col("role") == "user", F.concat(F.lit("```python\n"), "text", F.lit("\n```\n"))).otherwise(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.unfenced(fenced).alias("body"))


@query(rf"SELECT doc_id, substr(replace(regexp_replace(text, '^{_S}+|{_S}+$', '', 'g'), chr(10), ' '), 1, 100) AS line FROM documents WHERE text IS NOT NULL")
def summary_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.summary_line(F.col("text")).alias("line"))


@query("SELECT page_id, length(html) AS chars, substr(html, 1, 400) AS preview, list_extract(string_split(url, '/'), -1) AS base FROM pages")
def caption_previews(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("chars"), F.substring("html", 1, 400).alias("preview"), text.basename(F.col("url")).alias("base"))


@query("SELECT doc_id, substr(coalesce(text, ''), 1, 120) AS preview FROM documents")
def result_previews(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 120).alias("preview"))


_IMAGE = "url || CASE page_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' WHEN 3 THEN '.Jpeg' WHEN 4 THEN '.tiff' ELSE '' END"


@query(f"""SELECT page_id, 'data:image/' || CASE WHEN regexp_matches(lower(path), '[^/]\\.png$') THEN 'png' WHEN regexp_matches(lower(path), '[^/]\\.webp$') THEN 'webp' ELSE 'jpeg' END || ';base64,' || to_base64(encode(html)) AS data
FROM (SELECT page_id, html, {_IMAGE} AS path FROM pages WHERE html IS NOT NULL)""")
def data_urls(spark, sf_dir):
    """Pages as images of several suffixes."""
    data = text.data_url(F.col("html").cast("binary"), F.coalesce(F.expr(_IMAGE), F.lit("")))
    return _table(spark, sf_dir, "pages").where("html IS NOT NULL").select("page_id", F.replace(data, F.lit("\r\n"), F.lit("")).alias("data"))


@query(r"""SELECT event_id, regexp_extract(line, '(\d+)/\d+', 1)::INT AS done, regexp_extract(line, '\d+/(\d+)', 1)::INT AS total, regexp_extract(line, '([\d.]+)\s*s/', 1)::DOUBLE AS seconds_each
FROM (SELECT event_id, event_type || ': 5%| ' || (event_id % 20)::VARCHAR || '/20 [00:10, ' || user_id::VARCHAR || '.5s/it]' AS line FROM events)""")
def progress_lines(spark, sf_dir):
    line = F.concat("event_type", F.lit(": 5%| "), (F.col("event_id") % 20).cast("string"), F.lit("/20 [00:10, "), F.col("user_id").cast("string"), F.lit(".5s/it]"))
    return _table(spark, sf_dir, "events").select("event_id", text.progress(line).alias("p")).select("event_id", "p.*")


# Jobs and reports.

@query("""SELECT event_id, user_id, event_type, n FROM (SELECT *, lag(event_type) OVER w AS e, lag(n) OVER w AS b, row_number() OVER w AS r FROM (SELECT event_id, user_id, event_type, ts, floor(value / 100)::BIGINT AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE r = 1 OR event_type IS DISTINCT FROM e OR n IS DISTINCT FROM b""")
def progress_changes(spark, sf_dir):
    reports = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.floor(F.col("value") / 100).alias("n"))
    return jobs.progress_changes(reports, "user_id", ["ts", "event_id"], "event_type", "n").select("event_id", "user_id", "event_type", "n")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def newest_jobs(spark, sf_dir):
    return jobs.newest_first(_table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "user_id")


@query("WITH newest AS (SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25) SELECT event_id, event_type FROM events WHERE event_type = 'error' OR event_id IN (SELECT event_id FROM newest)")
def retained_jobs(spark, sf_dir):
    return jobs.retained(_table(spark, sf_dir, "events"), "ts", "event_id", F.col("event_type") == "error").select("event_id", "event_type")


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 120)")
def live_events(spark, sf_dir):
    return jobs.live_tail(_table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "event_type")


@query("SELECT event_id, user_id, event_type, value FROM events")
def params_without_secrets(spark, sf_dir):
    return jobs.without_secrets(_table(spark, sf_dir, "events").withColumn("api_key", F.col("props"))).select("*").drop("ts", "props")


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY round_even(1 - y, 4), round_even(x, 4), event_type, event_id) - 1)::INT AS position FROM (SELECT event_id, user_id, event_type, (event_id % 97) / 97.0::DOUBLE AS x, (event_id % 13) / 13.0::DOUBLE AS y FROM events)")
def text_boxes(spark, sf_dir):
    boxes = _table(spark, sf_dir, "events").select("event_id", "user_id", ((F.col("event_id") % 97) / 97.0).alias("x"), ((F.col("event_id") % 13) / 13.0).alias("y"), F.struct("event_type", "event_id").alias("t"))
    return jobs.boxes_in_order(boxes, "user_id", "x", "y", "t").select("event_id", "user_id", "position")


@query(f"WITH {_FILES} SELECT page_id, folder, (row_number() OVER (PARTITION BY folder ORDER BY url) - 1)::INT AS place FROM files")
def sorted_listing(spark, sf_dir):
    return jobs.listed(_files(spark, sf_dir), "folder", "url", "page_id").select("page_id", "folder", "place")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def report_samples(spark, sf_dir):
    return jobs.first_of_each(_table(spark, sf_dir, "documents"), "source", ["doc_id"], 5).select("doc_id", "source")


# Arrays, maps, numbers.

@query("SELECT vec_id, coalesce(list_filter(embedding, lambda x: x > 0.2)[1], -1)::FLOAT AS first FROM embeddings")
def first_matches(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", values.first_match(F.col("embedding"), lambda x: x > 0.2, F.lit(-1).cast("float")).alias("first"))


@query("SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT lang, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1) c ON c.lang = d.lang")
def map_lookups(spark, sf_dir):
    """A map of few rows beside each row of a table."""
    docs = _table(spark, sf_dir, "documents")
    held = docs.where("lang IN ('de', 'fr')").groupBy("lang").count()
    counted = held.agg(F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("m"))
    return docs.select("doc_id", "lang", counted.scalar().alias("m")).select("doc_id", values.lookup(F.col("m"), F.coalesce("lang", F.lit("")), F.lit(0).cast("long")).alias("n"))


@query("SELECT c_nationkey, list_sort(list(c_custkey)) AS keys FROM customer GROUP BY 1")
def map_of_lists(spark, sf_dir):
    return _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("keys"))


@query("SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(text, '[ \\n]'), lambda x: x <> ''))::INT AS words FROM conversations WHERE text IS NOT NULL")
def flattened_words(spark, sf_dir):
    nested = F.transform(F.split("text", "\n"), lambda x: x)
    words = F.filter(values.flattened(nested, lambda line: F.split(line, " ")), lambda x: x != "")
    return _table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", F.size(words).alias("words"))


@query("SELECT event_id, 'k:' || sha1('{\"event_type\":\"' || event_type || '\",\"id\":' || event_id::VARCHAR || ',\"user\":' || user_id::VARCHAR || '}') AS key FROM events")
def canonical_json_keys(spark, sf_dir):
    body = values.canonical_json(user=F.col("user_id"), id=F.col("event_id"), event_type=F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k:"), F.sha1(body.cast("binary"))).alias("key"))


@query("SELECT o_orderkey, round(greatest(0.0, least(1.0, o_totalprice / greatest(o_totalprice - 100000, 0.000001))), 9) AS share FROM orders")
def guarded_ratios(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.round(values.guarded_ratio(F.col("o_totalprice"), F.col("o_totalprice") - 100000), 9).alias("share"))


@query("SELECT o_custkey, format('{:,}', count(*) * 1000) AS n, printf('%.0f%%', 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*)) AS done FROM orders GROUP BY 1")
def report_numbers(spark, sf_dir):
    found = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count("*") * 1000).alias("n"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("share"))
    return found.select("o_custkey", values.grouped(F.col("n")).alias("n"), values.percent(F.col("share")).alias("done"))


@query("SELECT user_id, 'click=' || c::VARCHAR || ',view=' || v::VARCHAR AS seconds FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) AS v FROM events GROUP BY 1)")
def merged_times(spark, sf_dir):
    found = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").cast("double").alias("c"), F.count("*").cast("double").alias("v"))
    both = values.merged_times(F.create_map(F.lit("click"), F.col("c"), F.lit("view"), F.lit(0.0)), F.create_map(F.lit("view"), F.col("v")))
    listed = F.transform(F.array_sort(F.map_entries(both)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string")))
    return found.select("user_id", F.array_join(listed, ",").alias("seconds"))


@query(f"SELECT conv_id, min_by(s, (turn, rn)) AS first, max_by(s, (turn, rn)) AS last FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role) AS rn, {_STAMP} AS s FROM conversations) GROUP BY 1")
def timestamp_range(spark, sf_dir):
    pos = F.struct("turn", "rn")
    return _stamped(spark, sf_dir).groupBy("conv_id").agg(F.min_by("stamp", pos).alias("first"), F.max_by("stamp", pos).alias("last"))


# Frames: signals of successive events.

@query("""SELECT event_id, coalesce((s < 0.97 AND a >= 0.02) OR h >= 8 OR c <= 0.9, false) AS moved FROM (SELECT event_id, 1 - abs(value - b) / 1000 AS s, abs(value - b) / 500 AS a, bit_count(xor(event_id, e))::INT AS h, 1 - abs(value - b) / 900 AS c
FROM (SELECT event_id, value, lag(value) OVER w AS b, lag(event_id) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))""")
def change_predicate(spark, sf_dir):
    from pyspark.sql import Window

    from framelake.functions import vectors

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(spark, sf_dir, "events").select("event_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("d"), vectors.hamming(F.col("event_id"), F.lag("event_id").over(w)).alias("h"))
    moved = frames.changed(1 - F.col("d") / 1000, F.col("d") / 500, F.col("h"), 1 - F.col("d") / 900)
    return rows.select("event_id", F.coalesce(moved, F.lit(False)).alias("moved"))


# Results and runs.

@query("SELECT vec_id, 'frame_' || printf('%06d', vec_id) AS id, '' AS timestamp_str, 0 AS width, coalesce(label::VARCHAR, '') AS document FROM embeddings")
def vector_metadata(spark, sf_dir):
    """Metadata of vectors, with defaults for what frames have not."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.format_string("frame_%06d", "vec_id").alias("id"), F.lit(None).cast("string").alias("timestamp_str"), F.lit(None).cast("int").alias("width"), F.col("label").cast("string").alias("document"))
    return rows.select("vec_id", "id", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in (("timestamp_str", ""), ("width", 0), ("document", ""))))


@query("""SELECT label AS collection, vec_id AS id FROM embeddings WHERE embedding IS NOT NULL AND vec_id NOT IN (
    SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1)), 9), vec_id) AS r FROM embeddings WHERE embedding IS NOT NULL) WHERE r <= 10)""")
def results_left(spark, sf_dir):
    from framelake.operators import search

    found = _found(spark, sf_dir)[0]
    return cache.left_over(found, search.top_per_collection(found, 10), ["collection", "id"]).select("collection", "id")


@query("SELECT d.doc_id, coalesce(k, 'unknown') AS content_type, coalesce(q, 0.0)::DOUBLE AS classification_confidence, coalesce(t, '') AS description FROM documents d LEFT JOIN (SELECT doc_id, max('kind' || quality::VARCHAR) AS k, max(quality)::DOUBLE AS q, max('toxic' || toxic::VARCHAR) AS t FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def artifacts_with_metadata(spark, sf_dir):
    meta = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.concat(F.lit("kind"), F.col("quality").cast("string"))).alias("content_type"), F.max("quality").cast("double").alias("classification_confidence"), F.max(F.concat(F.lit("toxic"), F.col("toxic").cast("string"))).alias("description"))
    return tree.described(_table(spark, sf_dir, "documents").select("doc_id"), meta, ["doc_id"])


@query("SELECT conv_id AS folder, turn AS pos, coalesce(nullif(role, 'user'), 'own') AS src_rel, text AS dst_rel, 'low' AS confidence, '' AS reasoning FROM conversations WHERE text IS NOT NULL")
def backfilled_mappings(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn", "role", "text").alias("pos"), "conv_id", "turn", "role", "text")
    answers = rows.select("pos", F.lit(None).cast("long").alias("folder"), F.when(F.col("role") != "user", F.col("role")).alias("src_rel"), F.col("text").alias("dst_rel"), F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("reasoning"))
    batch = rows.select("pos", F.col("conv_id").alias("folder"), F.lit("own").alias("src_rel")).distinct()
    return tree.backfilled(answers, batch).select("folder", F.col("pos.turn").alias("pos"), "src_rel", "dst_rel", "confidence", "reasoning")


@query("SELECT doc_id, confidence FROM (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'medium' ELSE 'low' END AS confidence FROM labels) WHERE confidence <> 'high'")
def unsure_mappings(spark, sf_dir):
    level = F.expr("CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'medium' ELSE 'low' END")
    return tree.unsure(_table(spark, sf_dir, "labels").select("doc_id", level.alias("confidence")))


@query("""SELECT c.c_custkey, CASE WHEN r.o_orderkey IS NOT NULL AND r.size_ok THEN 'run_' || r.o_orderkey::VARCHAR ELSE 'fresh_' || c.c_custkey::VARCHAR END AS path, r.o_orderkey IS NOT NULL AND coalesce(r.size_ok, false) AS reused
FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, max_by(o_totalprice > 50000, o_orderkey) AS size_ok FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) r ON r.o_custkey = c.c_custkey""")
def reused_runs(spark, sf_dir):
    runs = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("name"), F.concat(F.lit("run_"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderstatus") == "F").alias("done"), "o_totalprice")
    videos = _table(spark, sf_dir, "customer").select("c_custkey")
    return cache.reusable(videos, runs, "c_custkey", "done", F.col("o_totalprice") > 50000, F.concat(F.lit("fresh_"), F.col("c_custkey").cast("string")))


@query("SELECT d.doc_id, l.doc_id IS NULL OR (l.quality = 1 AND coalesce(l.toxic = 0, true)) AS accepted FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def guarded_transcripts(spark, sf_dir):
    meta = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = _table(spark, sf_dir, "documents").select("doc_id").join(meta, "doc_id", "left")
    return rows.select("doc_id", cache.transcript_is_of(F.lit(1), F.lit(0), F.col("quality"), F.col("toxic")).alias("accepted"))


# Sinks and sources: what is written comes back.

@query("SELECT conv_id, turn, role, text FROM conversations")
def captions_appended(spark, sf_dir):
    rows, where = _table(spark, sf_dir, "conversations"), folder(spark)
    for part in (F.col("role") == "user", F.col("role") != "user", F.col("role").isNull()):
        sinks.append(rows.where(part), where, "role")
    return spark.read.schema(rows.schema).parquet(where).select("conv_id", "turn", "role", "text")


@query("SELECT label AS collection, vec_id, CASE WHEN label = 0 THEN -vec_id ELSE vec_id END AS frame_id FROM embeddings WHERE label IS NOT NULL")
def vectors_stored_and_reset(spark, sf_dir):
    """All collections are added; then one of them is written anew."""
    rows, where = _table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(F.col("label").alias("collection"), "vec_id", F.col("vec_id").alias("frame_id")), folder(spark)
    sinks.add_vectors(rows, where)
    sinks.reset_collection(rows.where("collection = 0").withColumn("frame_id", -F.col("vec_id")), where)
    return spark.read.schema(rows.schema).parquet(where).select("collection", "vec_id", "frame_id")


@query("SELECT doc_id::VARCHAR AS key, text AS query, CASE WHEN lang = 'de' THEN 'new' ELSE 'old' END AS summary FROM documents WHERE doc_id IS NOT NULL")
def summaries_put(spark, sf_dir):
    """A cache of summaries in which entries of one language are replaced."""
    rows, where = _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("query"), F.lit("old").alias("summary"), "lang"), folder(spark)
    sinks.put_keyed(rows.drop("lang"), where, "key")
    sinks.put_keyed(rows.where("lang = 'de'").drop("lang").withColumn("summary", F.lit("new")), where, "key")
    return readers.summaries(spark, where)


@query(f"WITH {_FILES} SELECT folder, page_id::VARCHAR AS src_rel, path AS dst_rel, 'manual' AS confidence, 'manual' AS reasoning FROM files")
def manifest_roundtrip(spark, sf_dir):
    rows, where = _files(spark, sf_dir).select("folder", F.col("page_id").cast("string").alias("src_rel"), F.col("path").alias("dst_rel"), F.lit("manual").alias("confidence"), F.lit("manual").alias("reasoning")), folder(spark)
    sinks.manifest(rows, where)
    return readers.manifest(spark, where)


@query("SELECT 'run' || (page_id % 7)::VARCHAR AS folder, page_id::VARCHAR || '.html' AS src_rel, octet_length(encode(html)) AS size, substr(html, 1, 400) AS snippet FROM pages WHERE html IS NOT NULL")
def artifacts_roundtrip(spark, sf_dir):
    """Pages written as the artifacts of seven runs, with their metadata, and scanned again."""
    made = _table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.concat(F.lit("run"), (F.col("page_id") % 7).cast("string")).alias("folder"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.col("html").alias("content"), F.lit("gui_demo").alias("content_type"), F.lit("page").alias("description"))
    where = folder(spark)
    sinks.artifacts(made, where).count()
    return readers.artifacts(spark, where)


@query("SELECT 'run' || (page_id % 7)::VARCHAR AS run, count(*) FILTER (page_id % 2 = 0) > 0 AS has_frames, count(*) FILTER (page_id % 2 = 1) > 0 AS has_output FROM pages WHERE html IS NOT NULL GROUP BY 1")
def runs_discovered(spark, sf_dir):
    name = F.concat(F.lit("run"), (F.col("page_id") % 7).cast("string"), F.when(F.col("page_id") % 2 == 0, "/frames/").otherwise("/output/"), F.col("page_id").cast("string"))
    where = folder(spark)
    sinks.tree(_table(spark, sf_dir, "pages").where("html IS NOT NULL").select(name.alias("dst_rel"), F.col("html").alias("content")), where).count()
    return readers.runs(spark, where).select("run", "has_frames", "has_output")


_NAME = "CASE page_id % 5 WHEN 0 THEN page_id::VARCHAR || '.MP4' WHEN 1 THEN page_id::VARCHAR || '.flv' WHEN 2 THEN 'a/' || page_id::VARCHAR || '.mov' WHEN 3 THEN page_id::VARCHAR || '.txt' ELSE page_id::VARCHAR END"


@query(f"SELECT name AS path, octet_length(encode(html)) AS size, name NOT LIKE '%.flv' AS recording FROM (SELECT {_NAME} AS name, html FROM pages WHERE html IS NOT NULL) WHERE regexp_matches(lower(name), '\\.(mov|mp4|mkv|avi|webm|m4v|flv|wmv)$')")
def videos_listed(spark, sf_dir):
    where = folder(spark)
    rows = _table(spark, sf_dir, "pages").where("html IS NOT NULL").select(F.expr(_NAME.replace("::VARCHAR", "::STRING")).alias("dst_rel"), F.col("html").alias("content"))
    sinks.tree(rows, where).count()
    found, narrow = readers.videos(spark, where), readers.recordings(spark, where).select("path", F.lit(True).alias("recording"))
    return found.join(narrow, "path", "left").select("path", "size", F.coalesce("recording", F.lit(False)).alias("recording"))


# The first 3000 bytes in hexadecimal; of a character that they cut nothing is left but a sign for it.
_HEAD = "regexp_replace(substr(hex(encode(html)), 1, 6000), '([C-F][0-9A-F]|[EF][0-9A-F][89AB][0-9A-F]|F[0-9A-F][89AB][0-9A-F][89AB][0-9A-F])$', 'EFBFBD')"


@query(f"""SELECT page_id::VARCHAR || '.html' AS name, CASE WHEN bytes > 3000 THEN decode(unhex({_HEAD})) ELSE html END AS text, bytes > 3000 AS truncated, bytes AS size
FROM (SELECT page_id, html, octet_length(encode(html)) AS bytes FROM pages WHERE html IS NOT NULL)""")
def bounded_texts(spark, sf_dir):
    """A view of text files that shows no more than so many bytes of one, of all pages written as files."""
    where = folder(spark)
    rows = _table(spark, sf_dir, "pages").where("html IS NOT NULL")
    sinks.tree(rows.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("dst_rel"), F.col("html").alias("content")), where).count()
    return readers.bounded_text(readers.heads(spark, where, 3000), (".html",), 3000)


@query("SELECT user_id::VARCHAR AS video, event_id AS frame_id, event_type AS path FROM events")
def frames_meta_roundtrip(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video"), F.col("event_id").alias("frame_id"), F.col("event_id").alias("frame_index"), F.lit(0.0).alias("timestamp"), F.lit("").alias("timestamp_str"), F.col("event_type").alias("path"), F.lit(1).alias("width"), F.lit(1).alias("height"))
    where = folder(spark)
    sinks.frames_meta(rows, where, {"fps": "2"}, 7)
    meta = spark.read.schema(schemas.FRAMES_META).json(where).where((F.col("video_size") == 7) & (F.col("extraction")["fps"] == "2"))
    return meta.select("video", F.explode("frames").alias("f")).select("video", "f.frame_id", "f.path")


@query(rf"SELECT item_id::VARCHAR AS video, trim(array_to_string(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END, chr(10)), ' ') AS text FROM (SELECT item_id, regexp_split_to_array(text, {_ENDS}) AS p FROM benchmark WHERE text IS NOT NULL)")
def transcripts_roundtrip(spark, sf_dir):
    """All items written as the transcripts of videos, one text each, and read whole."""
    rows = _table(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    where = folder(spark)
    sinks.documents(rows.select(F.col("item_id").cast("string").alias("video"), F.posexplode(text.lines(F.col("text"))).alias("line_no", "line")), where)
    return spark.read.schema("value string, video string").text(where, wholetext=True).select("video", F.regexp_replace("value", "\n$", "").alias("text"))


@query("""SELECT user_id::VARCHAR AS video, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS frame_index, event_id % 256 AS light, 8 AS width FROM events""")
def y4m_roundtrip(spark, sf_dir):
    """Events as frames of one gray each, written as uncompressed videos and read by the source of videos."""
    shades = F.unhex(F.repeat(F.lpad(F.hex(F.col("event_id") % 256), 2, "0"), F.lit(8 * 4)))
    rows = frames.indexed(_table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select(F.col("user_id").cast("string").alias("video"), F.col("frame_index").cast("long").alias("frame_index"), F.lit(25.0).alias("fps"), F.lit(4).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), shades.alias("data"))
    where = folder(spark)
    sinks.y4m(rows, where).count()
    return readers.frames_of_videos(spark, where).select("video", "frame_index", F.conv(F.hex(F.substring("data", 32, 1)), 16, 10).cast("long").alias("light"), "width")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 30.0::DOUBLE ELSE p_size::DOUBLE / (p_partkey % 4) END AS fps, p_size::DOUBLE AS whole FROM part")
def frame_rates(spark, sf_dir):
    """Sizes as the rates that a probe tells, as fractions and as whole numbers."""
    size = F.col("p_size").cast("string")
    return _table(spark, sf_dir, "part").select("p_partkey", text.frame_rate(F.concat(size, F.lit("/"), (F.col("p_partkey") % 4).cast("string"))).alias("fps"), text.frame_rate(size).alias("whole"))


_KIND = f"CASE WHEN doc_id % 3 = 0 THEN list_extract({list(tree.CONTENT_TYPES)!r}, doc_id % {len(tree.CONTENT_TYPES)} + 1) ELSE lang END"


@query(f"SELECT doc_id, CASE WHEN kind IN {tree.CONTENT_TYPES!r} THEN kind ELSE 'gui_demo' END AS content_type FROM (SELECT doc_id, {_KIND} AS kind FROM documents)")
def content_types(spark, sf_dir):
    """Answers of a classifier, of which those that name no type count as a demonstration."""
    kind = F.when(F.col("doc_id") % 3 == 0, F.element_at(F.array(*map(F.lit, tree.CONTENT_TYPES)), (F.col("doc_id") % len(tree.CONTENT_TYPES) + 1).cast("int"))).otherwise(F.col("lang"))
    return _table(spark, sf_dir, "documents").select("doc_id", tree.content_type(kind).alias("content_type"))
