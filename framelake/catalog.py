"""Every query by name, with the SQL that gives the same rows.

A query reads whole tables. Where a table stands in for another kind of data: `events` are the frames of a user's recording,
`conversations` the captions of a recording, `documents` its OCR texts, `embeddings` the vectors of collections named by
their label, `pages` the files of a tree, and `labels` earlier results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import text, vectors
from framelake.operators import cache, frames, packing, search, stitching, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Vectors. The query vector is that of the row with the smallest id.

TOP = 10


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = _table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    # The query vector and the number of collections are what a caller knows before a search; here they come from the table, in one pass.
    asked = rows.agg(F.min_by("embedding", "vec_id"), F.count_distinct("label")).first()
    sources = asked[1]
    found = search.ranked(rows, asked[0] if asked else [0.0], "label", "vec_id")
    # Rounded for comparison with other engines, whose sums differ in the last digits.
    rounded = found.withColumn("distance", F.round("distance", 9)).withColumn("score", F.round(vectors.score(F.col("distance")), 9))
    return rounded, sources


_RANKED = """ranked AS (
    SELECT label AS collection, vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1)), 9) AS distance
    FROM embeddings WHERE embedding IS NOT NULL),
found AS (SELECT *, round(CASE WHEN distance <= 1 THEN 1 - distance ELSE 1 / (1 + distance) END, 9) AS score FROM ranked),
best AS (SELECT *, (row_number() OVER (PARTITION BY collection ORDER BY distance, id))::INT AS rank FROM found QUALIFY rank <= 10)"""


@query(f"WITH {_RANKED} SELECT * FROM found ORDER BY distance, id LIMIT 10")
def vector_topk(spark, sf_dir):
    return search.top(_found(spark, sf_dir)[0], TOP)


@query(f"WITH {_RANKED} SELECT * FROM best")
def vector_topk_per_collection(spark, sf_dir):
    return search.top_per_collection(_found(spark, sf_dir)[0], TOP)


@query(f"""WITH {_RANKED}, n AS (SELECT greatest(2, 10 // count(DISTINCT label)) AS per FROM embeddings),
placed AS (SELECT collection, id, distance, score, row_number() OVER (PARTITION BY collection ORDER BY score DESC, distance, id) > per AS second FROM best, n)
SELECT collection, id, distance, score, (row_number() OVER (ORDER BY second, CASE WHEN NOT second THEN collection END, score DESC, distance, id))::INT AS position
FROM placed QUALIFY position <= 10""")
def balanced_search(spark, sf_dir):
    found, sources = _found(spark, sf_dir)
    return search.balanced(found, TOP, sources)


@query(f"WITH {_RANKED} SELECT * FROM found ORDER BY score DESC, distance, id LIMIT 10")
def score_rerank(spark, sf_dir):
    return search.by_score(_found(spark, sf_dir)[0], TOP)


@query("""SELECT vec_id, round(list_sum(u), 6) AS total, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS square FROM (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings WHERE embedding IS NOT NULL)""")
def l2_normalize(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return rows.select("vec_id", F.round(total(F.col("u")), 6).alias("total"), F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("square"))


@query("SELECT label AS collection, count(*) AS n FROM embeddings GROUP BY 1")
def collection_counts(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("collection")).agg(F.count("*").alias("n"))


@query("SELECT label AS collection, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, collection LIMIT 1")
def largest_collection(spark, sf_dir):
    return search.resolve_collection(collection_counts(spark, sf_dir), None, "-")


# Frames: a user's events in order; the value is the signal.

_FRAMES = "frames AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index FROM events)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return _table(spark, sf_dir, "events").select("user_id", "event_id", ms.alias("ms"), "value", "ts")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.indexed(_frames(spark, sf_dir), "user_id", "ts", "event_id")


@query(f"WITH {_FRAMES} SELECT user_id, event_id, frame_index::INT AS frame_index FROM frames WHERE frame_index % 3 = 0")
def stride_fixed(spark, sf_dir):
    return frames.strided(_indexed(spark, sf_dir), frames.fixed_step(30.0, 8.0)).select("user_id", "event_id", "frame_index")


@query(f"WITH {_FRAMES} SELECT user_id, event_id, frame_index::INT AS frame_index FROM frames WHERE frame_index % 4 = 0")
def stride_dense(spark, sf_dir):
    return frames.strided(_indexed(spark, sf_dir), frames.dense_step(30.0, 8.0)).select("user_id", "event_id", "frame_index")


@query(f"WITH {_FRAMES} SELECT user_id, event_id, frame_index::INT AS frame_id, printf('frame_%06d.jpg', frame_index) AS file FROM frames")
def dense_frame_ids(spark, sf_dir):
    rows = _indexed(spark, sf_dir).withColumnRenamed("frame_index", "frame_id").withColumn("seconds", F.col("ms") / 1000)
    return frames.frame_table(rows).select("user_id", "event_id", "frame_id", "file")


def _gate_sql(keep: str) -> str:
    return f"""WITH RECURSIVE {_FRAMES}, walk AS (
    SELECT user_id, event_id, frame_index AS i, ms AS last_ms, value AS last_value, true AS kept FROM frames WHERE frame_index = 0
    UNION ALL
    SELECT f.user_id, f.event_id, f.frame_index, CASE WHEN {keep} THEN f.ms ELSE w.last_ms END, CASE WHEN {keep} THEN f.value ELSE w.last_value END, {keep}
    FROM walk w JOIN frames f ON f.user_id = w.user_id AND f.frame_index = w.i + 1)
SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY i) - 1)::INT AS frame_id FROM walk WHERE kept"""


HOUR = 3_600_000


@query(_gate_sql(f"(f.ms - w.last_ms >= {24 * HOUR})"))
def keyframe_time_gate(spark, sf_dir):
    kept = frames.keyframes(_frames(spark, sf_dir), "user_id", ("ms", "event_id"), "ms", least=24 * HOUR, most=24 * HOUR)
    return kept.select("user_id", "event_id", "frame_id")


@query(_gate_sql(f"((f.ms - w.last_ms >= {6 * HOUR} AND abs(f.value - w.last_value) >= 20) OR f.ms - w.last_ms >= {72 * HOUR})"))
def keyframe_change_gate(spark, sf_dir):
    kept = frames.keyframes(_frames(spark, sf_dir), "user_id", ("ms", "event_id"), "ms", "value", 20, 6 * HOUR, 72 * HOUR)
    return kept.select("user_id", "event_id", "frame_id")


@query(_gate_sql("(abs(f.value - w.last_value) >= 15)"))
def drop_static_duplicates(spark, sf_dir):
    return frames.without_static(_frames(spark, sf_dir), "user_id", ("ms", "event_id"), "value", 15).select("user_id", "event_id", "frame_id")


@query("""SELECT user_id, event_id, printf('%02d:%02d:%06.3f', ms // 3600000, ms % 3600000 // 60000, ms % 60000 / 1000.0) AS timestamp_str
FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS ms FROM events)""")
def format_timestamps(spark, sf_dir):
    rows = _frames(spark, sf_dir)
    began = rows.groupBy("user_id").agg(F.min("ms").alias("began"))
    return rows.join(began, "user_id").select("user_id", "event_id", text.timestamp((F.col("ms") - F.col("began")) / 1000).alias("timestamp_str"))


@query("SELECT event_id, bit_count(xor(event_id * 7919, user_id * 104729))::INT AS distance FROM events")
def hamming_distance(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", vectors.hamming(F.col("event_id") * 7919, F.col("user_id") * 104729).alias("distance"))


# Caches and joins.

_CACHE = "cache AS (SELECT conv_id, turn, max(text) AS caption FROM conversations WHERE role = 'assistant' AND coalesce(text, '') <> '' AND text NOT LIKE '[Error%' GROUP BY 1, 2)"


def _captions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "conversations")
    held = rows.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("caption"))
    return rows, cache.usable(held, "caption").groupBy("conv_id", "turn").agg(F.max("caption").alias("caption"))


@query(f"WITH {_CACHE} SELECT r.conv_id, r.turn, r.role, c.caption FROM conversations r LEFT JOIN cache c ON r.conv_id = c.conv_id AND r.turn = c.turn")
def cached_caption_join(spark, sf_dir):
    rows, held = _captions(spark, sf_dir)
    return cache.attached(rows, held, ["conv_id", "turn"], "caption").select("conv_id", "turn", "role", "caption")


@query(f"WITH {_CACHE} SELECT r.conv_id, r.turn, r.role FROM conversations r ANTI JOIN cache c ON r.conv_id = c.conv_id AND r.turn = c.turn")
def pending_captions(spark, sf_dir):
    rows, held = _captions(spark, sf_dir)
    return cache.pending(rows, held, ["conv_id", "turn"]).select("conv_id", "turn", "role")


@query(f"""WITH {_CACHE} SELECT r.conv_id, r.turn, coalesce(c.caption, '[caption of ' || r.role || ']') AS caption
FROM conversations r LEFT JOIN cache c ON r.conv_id = c.conv_id AND r.turn = c.turn""")
def completed_captions(spark, sf_dir):
    rows, held = _captions(spark, sf_dir)
    make = lambda todo: todo.withColumn("caption", F.concat(F.lit("[caption of "), "role", F.lit("]")))
    return cache.completed(rows, held, ["conv_id", "turn"], "caption", make).select("conv_id", "turn", "caption")


@query("""WITH held AS (SELECT conv_id AS doc_id, text AS ocr FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations WHERE text IS NOT NULL) WHERE r = 1)
SELECT d.doc_id, h.ocr FROM documents d LEFT JOIN held h ON d.doc_id = h.doc_id""")
def cached_ocr_join(spark, sf_dir):
    """Documents are frames, the turns of a conversation the readings of one, of which the last record counts."""
    readings = _table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("ocr"), F.struct("turn", "role", "text").alias("pos"))
    held = cache.last_record(readings, ["doc_id"], "pos")
    return cache.attached(_table(spark, sf_dir, "documents").select("doc_id"), held, ["doc_id"], "ocr")


@query("SELECT conv_id, turn, 'caption:' || sha1(conv_id::VARCHAR || chr(0) || turn::VARCHAR || chr(0) || coalesce(text, '')) AS key FROM conversations")
def summary_cache_key(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", text.cache_key("caption", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.coalesce("text", F.lit(""))).alias("key"))


# Packing: a conversation's turns are captions.

BUDGET = 400
_STAMP = "printf('%02d:%02d:%06.3f', turn // 3600, turn % 3600 // 60, (turn % 60)::DOUBLE)"
_UNITS = f"""pieces AS (
    SELECT conv_id, turn, rn, {_STAMP} AS stamp, unnest(range(0, greatest(length(text), 1), {(BUDGET - 50) * 2 - 15})) // {(BUDGET - 50) * 2 - 15} AS piece, text
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS rn FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations))),
units AS (SELECT conv_id, turn, rn, piece, stamp, substr(text, piece * {(BUDGET - 50) * 2 - 15} + 1, {(BUDGET - 50) * 2 - 15}) AS caption FROM pieces),
sized AS (SELECT *, greatest(1, (length('[' || stamp || ']' || chr(10) || caption) + 1) // 2) + 50 AS tokens FROM units)"""


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("caption"))
    twin = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "caption"))
    return rows.select("conv_id", "turn", twin.alias("rn"), text.timestamp(F.col("turn").cast("double")).alias("stamp"), "caption")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.caption_units(_stamped(spark, sf_dir), ["conv_id", "turn", "rn"], "stamp", "caption", BUDGET)


@query(f"WITH {_UNITS} SELECT conv_id, turn, rn::INT AS rn, piece::INT AS piece, tokens::BIGINT AS tokens FROM sized")
def caption_token_estimate(spark, sf_dir):
    return _units(spark, sf_dir).select("conv_id", "turn", "rn", "piece", "tokens")


@query(f"WITH {_UNITS} SELECT conv_id, sum(tokens)::BIGINT AS total, round(avg(tokens), 6) AS mean, max(tokens)::BIGINT AS largest, count(*) AS n FROM sized GROUP BY 1")
def token_stats(spark, sf_dir):
    return packing.statistics(_units(spark, sf_dir), "conv_id", "tokens").withColumn("mean", F.round("mean", 6))


@query("""SELECT doc_id, piece::INT AS piece, substr(text, (piece * 1000 + 1)::BIGINT, 1000) AS part
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1000)) // 1000 AS piece FROM documents WHERE text IS NOT NULL)""")
def split_oversized(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.posexplode(text.pieces(F.col("text"), 1000)).alias("piece", "part"))


def _pack_sql(units: str, group: str, order: str, cost: str, budget: int, most: int | None, joint: int = 0) -> str:
    full = f"(w.s + u.{cost} > {budget}" + (f" OR w.n >= {most})" if most else ")")
    return f"""WITH RECURSIVE {units}, numbered AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS i FROM sized),
walk AS (
    SELECT {group}, i, ({cost} + {joint})::BIGINT AS s, 1 AS n, 0 AS chunk_id FROM numbered WHERE i = 1
    UNION ALL
    SELECT u.{group}, u.i, (CASE WHEN {full} THEN 0 ELSE w.s END + u.{cost} + {joint})::BIGINT, CASE WHEN {full} THEN 1 ELSE w.n + 1 END, w.chunk_id + CASE WHEN {full} THEN 1 ELSE 0 END
    FROM walk w JOIN numbered u ON u.{group} = w.{group} AND u.i = w.i + 1)
SELECT u.{group}, {", ".join(f"u.{c.strip()}::{'INT' if c.strip() in ('piece', 'rn') else 'BIGINT'} AS {c.strip()}" for c in order.split(","))}, u.{cost}::BIGINT AS {cost}, w.chunk_id::INT AS chunk_id
FROM walk w JOIN numbered u ON u.{group} = w.{group} AND u.i = w.i"""


@query(_pack_sql(_UNITS, "conv_id", "turn, rn, piece", "tokens", BUDGET, 3))
def pack_captions(spark, sf_dir):
    return packing.packed(_units(spark, sf_dir), "conv_id", ["turn", "rn", "piece"], "tokens", BUDGET, 3)


_NOTES = f"""pieces AS (SELECT conv_id, turn, rn, text, unnest(range(0, greatest(length(text), 1), 300)) // 300 AS piece
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS rn FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations))),
sized AS (SELECT *, greatest(1, (length(substr(text, (piece * 300 + 1)::BIGINT, 300)) + 1) // 2) + 50 AS tokens FROM pieces)"""


@query(_pack_sql(_NOTES, "conv_id", "turn, rn, piece", "tokens", 200, None))
def pack_notes(spark, sf_dir):
    units = packing.note_units(_stamped(spark, sf_dir), ["conv_id", "turn", "rn"], "caption", 200)
    return packing.packed(units, "conv_id", ["turn", "rn", "piece"], "tokens", 200)


_PARAGRAPHS = """sized AS (SELECT doc_id, (generate_subscripts(p, 1) - 1) AS piece, length(unnest(p)) AS chars FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"""


@query(_pack_sql(_PARAGRAPHS, "doc_id", "piece", "chars", 2000, None, 2))
def pack_paragraphs(spark, sf_dir):
    """Lines stand in for paragraphs, which these documents have not."""
    rows = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return packing.packed(packing.paragraph_units(rows, ["doc_id"], "text"), "doc_id", ["piece"], "chars", 2000, joint=2)


@query(f"""WITH {_UNITS} SELECT conv_id, sum(tokens)::BIGINT AS total, CASE WHEN sum(tokens) <= {BUDGET} THEN 'single' ELSE 'hierarchical' END AS plan FROM sized GROUP BY 1""")
def single_or_hierarchical(spark, sf_dir):
    total = _units(spark, sf_dir).groupBy("conv_id").agg(F.sum("tokens").alias("total"))
    return total.withColumn("plan", F.when(F.col("total") <= BUDGET, "single").otherwise("hierarchical"))


_ENTRIES = f"entries AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS rn, '[' || {_STAMP} || ']' || chr(10) || text AS entry FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations))"


@query(f"WITH {_ENTRIES} SELECT conv_id, string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, rn) AS block FROM entries GROUP BY 1")
def caption_block(spark, sf_dir):
    return packing.block(_stamped(spark, sf_dir), "conv_id", ["turn", "rn"], "stamp", "caption")


@query(f"""WITH {_ENTRIES}, run AS (SELECT *, sum(length(entry)) OVER (PARTITION BY conv_id ORDER BY turn, rn) <= 500 AS fits FROM entries)
SELECT conv_id, concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), string_agg(entry, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, rn) FILTER (fits),
    CASE WHEN NOT bool_and(fits) THEN '[... additional frames truncated for context limit ...]' END) AS block FROM run GROUP BY 1""")
def truncated_block(spark, sf_dir):
    return packing.block(_stamped(spark, sf_dir), "conv_id", ["turn", "rn"], "stamp", "caption", 500)


@query("""WITH placed AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
want AS (SELECT DISTINCT conv_id, round_even(k * ((n - 1) / 2.0), 0) AS i FROM placed, range(0, 3) r(k) WHERE n > 3)
SELECT a.conv_id, a.turn, a.role FROM placed a LEFT JOIN want w ON a.conv_id = w.conv_id AND a.i = w.i WHERE a.n <= 3 OR w.i IS NOT NULL""")
def stratified_sample(spark, sf_dir):
    return packing.stratified(_table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 10)::INT AS batch FROM conversations")
def batches_of_ten(spark, sf_dir):
    return packing.batches(_table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], 10).select("conv_id", "turn", "role", "batch")


@query("SELECT conv_id, role, max(turn) AS turn, max(length(text)) FILTER (turn = m) AS chars FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id, role) AS m FROM conversations) GROUP BY 1, 2")
def last_writer_values(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id", "role", "turn").agg(F.max(F.length("text")).cast("long").alias("chars"))
    return packing.latest(rows, ["conv_id", "role"], "turn", "chars")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE turn = 1")
def latest_iteration(spark, sf_dir):
    return packing.latest_iteration(_table(spark, sf_dir, "conversations"), 1, 5, "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 7")
def latest_iteration_fallback(spark, sf_dir):
    """No event has this number, so the last ones stand in."""
    return packing.latest_iteration(_table(spark, sf_dir, "events"), -1, 7, "event_id", "event_id").select("event_id", "event_type")


# Lines of documents; a source is a recording and its documents the frames.

# White space as Unicode has it, spelled out here apart from the library's own class.
_S = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORM = rf"lower(regexp_replace(regexp_replace(line, '^{_S}+|{_S}+$', '', 'g'), '[ \t]+', ' ', 'g'))"
_ENDS = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"
_LINES = f"""lined AS (SELECT doc_id, source, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM (SELECT doc_id, source, regexp_split_to_array(text, {_ENDS}) AS p FROM documents WHERE text IS NOT NULL)),
rows AS (SELECT doc_id, source, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line FROM lined)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitching.line_rows(_table(spark, sf_dir, "documents").where("text IS NOT NULL"), ["doc_id", "source"], "text")


@query(f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, line, {_NORM} AS norm FROM rows")
def lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "line_no", "line", text.line_norm(F.col("line")).alias("norm"))


_BOILER = rf"""edges AS (SELECT DISTINCT doc_id, source, {_NORM} AS norm FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM rows) WHERE (line_no < 4 OR line_no > last - 4) AND norm <> ''),
total AS (SELECT source, count(*) AS total FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 4),
boiler AS (SELECT source, norm, count(*) AS frames FROM edges JOIN total USING (source) GROUP BY source, norm, total HAVING count(*) >= greatest(3, floor(total * 0.05)))"""


@query(f"WITH {_LINES}, {_BOILER} SELECT source, norm, frames FROM boiler")
def boilerplate_lines(spark, sf_dir):
    return stitching.boilerplate(_table(spark, sf_dir, "documents").where("text IS NOT NULL"), "source", "text", share=0.05)


@query(rf"""WITH {_LINES}, {_BOILER}, normed AS (SELECT *, {_NORM} AS norm FROM rows)
SELECT doc_id, line_no::INT AS line_no, line FROM normed n ANTI JOIN boiler b ON n.source = b.source AND n.norm = b.norm
WHERE NOT (regexp_matches(norm, '^page\s+\d+\s+of\s+\d+$') OR regexp_matches(norm, '^\d+\s*/\s*\d+$') OR regexp_matches(norm, '^page\s+\d+$') OR regexp_matches(norm, '^-\s*\d+\s*-$'))""")
def strip_boilerplate(spark, sf_dir):
    known = boilerplate_lines(spark, sf_dir)
    return stitching.without_boilerplate(_lines(spark, sf_dir), known, "source").select("doc_id", "line_no", "line")


@query(rf"""WITH {_LINES}, b AS (SELECT doc_id, line_no, line, regexp_full_match(line, '{_S}*') AS blank FROM rows)
SELECT doc_id, line_no::INT AS line_no, regexp_replace(line, '{_S}+$', '') AS line FROM (SELECT *, lag(blank, 1, false) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM b) WHERE NOT (blank AND before)""")
def collapse_blank_runs(spark, sf_dir):
    return stitching.blank_runs_collapsed(_lines(spark, sf_dir), ["doc_id"]).select("doc_id", "line_no", "line")


@query(f"""WITH {_LINES}, c AS (SELECT source, line_no, line, count(*) AS c, min(doc_id) AS first FROM rows GROUP BY 1, 2, 3)
SELECT source, line_no::INT AS line_no, line, votes::BIGINT AS votes FROM (SELECT *, sum(c) OVER (PARTITION BY source, line_no) AS votes, row_number() OVER (PARTITION BY source, line_no ORDER BY c DESC, length(line) DESC, first) AS r FROM c) WHERE r = 1""")
def majority_line(spark, sf_dir):
    """Every line of all documents of a source."""
    return stitching.majority(_lines(spark, sf_dir), ["source", "line_no"], "line", "doc_id")


_HAVE = r"list_distinct(list_filter(list_transform(regexp_split_to_array({0}, " + _ENDS.replace("{", "{{").replace("}", "}}") + r"), lambda y: regexp_replace(y, '" + _S.replace("{", "{{").replace("}", "}}") + r"+', '', 'g')), lambda x: x <> ''))"


@query(f"""WITH l AS (SELECT doc_id, {_HAVE.format("text")} AS a, {_HAVE.format("replace(text, 'e ', 'e')")} AS b, {_HAVE.format("replace(text, 'an', 'na')")} AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(a, b)) / len(a), 9) END AS respaced, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(a, c)) / len(a), 9) END AS changed FROM l""")
def line_coverage(spark, sf_dir):
    """Of each whole text against itself with other blanks, and with some letters changed, as repairs might leave it."""
    t = F.col("text")
    rows = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", F.round(text.coverage(t, F.replace(t, F.lit("e "), F.lit("e"))), 9).alias("respaced"), F.round(text.coverage(t, F.replace(t, F.lit("an"), F.lit("na"))), 9).alias("changed"))


_STUCK = rf"""list_filter(range(1, 25), lambda u: ends_with(t, repeat(right(t, u::BIGINT), greatest(6, ceil(length(t) * 3 / (u * 5))::BIGINT))) AND NOT regexp_full_match(right(t, u::BIGINT), '{_S}*'))[1]"""


@query(rf"""SELECT doc_id, CASE WHEN length(t) >= 200 THEN right(t, ({_STUCK})::BIGINT) END AS unit
FROM (SELECT doc_id, regexp_replace(text, '^{_S}+|{_S}+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)""")
def degenerate_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.stuck_unit(F.col("text")).alias("unit"))


_ANSWER = "CASE conv_id % 4 WHEN 0 THEN '<think>' || left(text, 9) || '</think> ' || text WHEN 1 THEN left(text, 9) || '</think>' || text WHEN 2 THEN text || '<think>' || left(text, 9) ELSE text END"


@query(rf"""SELECT conv_id, turn, role, regexp_replace(CASE WHEN contains(y, '</think>') THEN substr(y, (instr(y, '</think>') + 8)::BIGINT) WHEN contains(y, '<think>') THEN split_part(y, '<think>', 1) ELSE y END, '^{_S}+|{_S}+$', '', 'g') AS answer
FROM (SELECT conv_id, turn, role, regexp_replace({_ANSWER}, '<think>.*?</think>{_S}*', '', 'gs') AS y FROM conversations WHERE text IS NOT NULL)""")
def strip_thinking(spark, sf_dir):
    """Turns dressed up with thinking tags, by their conversation."""
    rows = _table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return rows.select("conv_id", "turn", "role", text.without_thinking(F.expr(_ANSWER)).alias("answer"))


@query(rf"""SELECT doc_id, CASE WHEN lower(s) IN ('[no text]', '[notext]', 'no text', '') THEN '' ELSE s END AS reading,
regexp_matches(x, '\b(no (image|video frame|picture)\b.*(provided|attached|been))|(please (attach|provide|upload).{{0,40}}(image|frame))|(i (cannot|can''t|am unable to) see (an|the|any) image)', 'is') AS refused
FROM (SELECT doc_id, text AS x, regexp_replace(text, '^{_S}+|{_S}+$', '', 'g') AS s FROM documents WHERE text IS NOT NULL)""")
def empty_markers_and_refusals(spark, sf_dir):
    x = F.col("text")
    return _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.reading(x).alias("reading"), text.refuses(x).alias("refused"))


_FENCED = "CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('Here: ```json', chr(10), props, chr(10), '``` done') ELSE concat('Answer ', props, ' ok') END"


@query("SELECT event_id, json_extract_string(props, '$.k')::VARCHAR AS k FROM events WHERE props IS NOT NULL")
def parse_model_json(spark, sf_dir):
    """Properties within the wrappings that models put around JSON."""
    rows = _table(spark, sf_dir, "events").where("props IS NOT NULL")
    return rows.select("event_id", F.get_json_object(text.json_answer(F.expr(_FENCED)), "$.k").alias("k"))


# Trees: a page's path is a file, its host the folder it comes from.

_FILES = r"files AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS folder, regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) AS path, url FROM pages WHERE url IS NOT NULL)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return _table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", part(r"^[a-z]+://([^/?#]*)").alias("folder"), part(r"^[a-z]+://[^/?#]*/?([^?#]*)").alias("path"), "url")


@query(rf"WITH {_FILES} SELECT CASE WHEN contains(p, '/') THEN split_part(p, '/', 1) ELSE '' END AS root, count(*) AS files, list_sort(list(path)) AS paths FROM (SELECT path, regexp_replace(path, '^/+', '') AS p FROM files) GROUP BY 1")
def root_clusters(spark, sf_dir):
    return tree.clusters(_files(spark, sf_dir), "path")


@query(rf"WITH {_FILES} SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS root, count(*) AS files FROM files GROUP BY 1")
def root_distribution(spark, sf_dir):
    return tree.root_distribution(_files(spark, sf_dir), "path")


@query(rf"WITH {_FILES} SELECT path, count(*) AS mappings, list_sort(list(folder)) AS folders FROM files GROUP BY 1 HAVING count(*) > 1")
def path_collisions(spark, sf_dir):
    return tree.collisions(_files(spark, sf_dir), "path")


_LEVEL = "CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'medium' ELSE 'low' END"


@query(f"SELECT c.confidence, count(l.confidence) AS n FROM (VALUES ('high'), ('medium'), ('low')) c(confidence) LEFT JOIN (SELECT {_LEVEL} AS confidence FROM labels) l ON c.confidence = l.confidence GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return tree.confidence_counts(_table(spark, sf_dir, "labels").select(F.expr(_LEVEL).alias("confidence")))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def content_type_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    mappings = _table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("quality").alias("q")).select("page_id", F.concat(F.lit("q"), F.col("q").cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("dst_rel"))
    return _files(spark, sf_dir).select("page_id", F.col("path").alias("src_rel")), mappings


_MAPPED = f"{_FILES}, mappings AS (SELECT doc_id AS page_id, 'q' || max(quality)::VARCHAR || '/' || doc_id::VARCHAR AS dst_rel FROM labels GROUP BY 1)"


@query(f"WITH {_MAPPED} SELECT page_id, dst_rel, path AS src_rel FROM mappings JOIN files USING (page_id)")
def mapping_join(spark, sf_dir):
    return tree.located(*_mapped(spark, sf_dir), ["page_id"])


@query(f"WITH {_MAPPED} SELECT page_id, dst_rel FROM mappings ANTI JOIN files USING (page_id)")
def mapping_missing(spark, sf_dir):
    return tree.missing(*_mapped(spark, sf_dir), ["page_id"])


@query(f"WITH {_MAPPED} SELECT f.page_id, f.path AS src_rel, coalesce(m.dst_rel, f.path) AS dst_rel FROM files f LEFT JOIN mappings m ON f.page_id = m.page_id")
def mapping_fallback(spark, sf_dir):
    return tree.placed(*_mapped(spark, sf_dir), ["page_id"])


@query(rf"WITH {_FILES} SELECT page_id, list_extract(string_split(url, '/'), -1) AS base, regexp_replace(replace(list_extract(string_split(url, '/'), -1), ' ', '_') || '_20240131_235959', '_\d{{8}}_\d{{6}}$', '') AS stem FROM files")
def basename_slug(spark, sf_dir):
    rows = _files(spark, sf_dir).select("page_id", text.basename(F.col("url")).alias("base"))
    run = text.slug(F.col("base"), F.to_timestamp(F.lit("2024-01-31 23:59:59")))
    return rows.select("page_id", "base", text.base_slug(run).alias("stem"))


_MODULE = r"regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '(/|\.html)$', '')"
_TREE_SQL = rf"""tree AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, {_MODULE} AS m, html FROM pages WHERE url IS NOT NULL),
files AS (SELECT DISTINCT m || '.py' AS dst_rel FROM tree),
imports AS (SELECT DISTINCT dst_rel, module FROM (
    SELECT m || '.py' AS dst_rel, replace(lead(m) OVER (PARTITION BY host ORDER BY page_id), '/', '.') AS module FROM tree
    UNION ALL SELECT m || '.py', split_part(m, '/', 1) || '.' || unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) FROM tree) WHERE module IS NOT NULL),
names AS (SELECT DISTINCT array_to_string(p[1:i], '.') AS name FROM (SELECT string_split(replace(regexp_replace(dst_rel, '\.py$', ''), '/', '.'), '.') AS p FROM files), range(1, 20) r(i) WHERE i <= len(p)),
own AS (SELECT * FROM imports),
loose AS (SELECT dst_rel FROM files WHERE NOT regexp_matches(dst_rel, '(^|/)(main|__main__|app|cli|conftest|run|manage|setup|wsgi|asgi)\.py$|(^|/)(test_|run_)[^/]*$|__init__\.py$'))"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages are the files of a tree. A file imports the next page of its host, and by its links names below its own root."""
    from pyspark.sql import Window

    m = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*/?([^?#]*)", 1), r"(/|\.html)$", "")
    pages = _table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), m.alias("m"), "html")
    dst = F.concat("m", F.lit(".py")).alias("dst_rel")
    after = pages.select(dst, F.replace(F.lead("m").over(Window.partitionBy("host").orderBy("page_id")), F.lit("/"), F.lit(".")).alias("module")).where("module IS NOT NULL")
    links = pages.select(dst, F.substring_index("m", "/", 1).alias("root"), F.explode(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))).alias("link"))
    imports = after.union(links.select("dst_rel", F.concat("root", F.lit("."), "link"))).distinct()
    files = pages.select(dst).distinct()
    return files, imports, tree.importable(files)


@query(f"WITH {_TREE_SQL} SELECT name FROM names")
def module_parents(spark, sf_dir):
    return _tree(spark, sf_dir)[2]


@query(f"WITH {_TREE_SQL} SELECT dst_rel, module FROM own WHERE module NOT IN (SELECT name FROM names) AND split_part(module, '.', 1) IN (SELECT split_part(name, '.', 1) FROM names)")
def unresolved_imports(spark, sf_dir):
    _, imports, names = _tree(spark, sf_dir)
    return tree.unresolved(imports, names)


@query(f"WITH {_TREE_SQL} SELECT dst_rel FROM loose WHERE dst_rel NOT IN (SELECT dst_rel FROM own WHERE module IN (SELECT name FROM names))")
def orphans_compat(spark, sf_dir):
    return tree.orphans_compat(*_tree(spark, sf_dir))


@query(rf"WITH {_TREE_SQL} SELECT dst_rel FROM loose WHERE replace(regexp_replace(dst_rel, '\.py$', ''), '/', '.') NOT IN (SELECT module FROM own WHERE module IN (SELECT name FROM names))")
def orphans(spark, sf_dir):
    return tree.orphans(*_tree(spark, sf_dir))


@query(f"WITH {_TREE_SQL} SELECT module, list_sort(list(DISTINCT dst_rel)) AS files FROM own WHERE module IN (SELECT name FROM names) GROUP BY 1")
def import_index(spark, sf_dir):
    _, imports, names = _tree(spark, sf_dir)
    return tree.importers(imports, names)


# Runs: conversations are runs, roles the kinds of results.

@query("SELECT conv_id, count(*) FILTER (role = 'user') AS frames, count(*) FILTER (role = 'assistant') AS captions, list_sort(list(DISTINCT role)) AS outputs, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'captioned' WHEN count(*) FILTER (role = 'user') > 0 THEN 'extracted' ELSE 'empty' END AS stage FROM conversations GROUP BY 1")
def run_summary(spark, sf_dir):
    found = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("frames"), F.count_if(F.col("role") == "assistant").alias("captions"), F.array_sort(F.collect_set("role")).alias("outputs"))
    return found.withColumn("stage", F.when(F.col("captions") > 0, "captioned").when(F.col("frames") > 0, "extracted").otherwise("empty"))


@query("SELECT 'run_' || max(printf('%08d', conv_id)) AS path, max(printf('%08d', conv_id)) AS name FROM conversations WHERE role = 'assistant'")
def newest_run(spark, sf_dir):
    name = F.format_string("%08d", "conv_id")
    runs = _table(spark, sf_dir, "conversations").select(F.lit("run").alias("stem"), name.alias("name"), F.concat(F.lit("run_"), name).alias("path"), (F.col("role") == "assistant").alias("captioned"))
    return cache.newest(runs, "run", "captioned")


@query(r"""SELECT page_id, CASE WHEN path IN ('', '/') OR starts_with(path, '/admin') THEN root || '/v1' ELSE root || regexp_replace(path, '/+$', '') END AS base
FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL)""")
def api_addresses(spark, sf_dir):
    return _table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", text.api_base(F.col("url")).alias("base"))


@query()
def line_ratio(spark, sf_dir):
    """Each line against the next of its document. Documents are dealt out anew, as the work is in the ratios: files and small partitions are too few tasks."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").repartition(tasks, "doc_id", "text").select("doc_id", text.lines(F.col("text")).alias("all"))
    pairs = rows.select("doc_id", F.posexplode(F.arrays_zip(F.col("all").alias("line"), F.slice("all", F.lit(2), F.size("all")).alias("after"))).alias("line_no", "pair"))
    return pairs.where("pair.after IS NOT NULL").select("doc_id", "line_no", F.round(text.line_ratio("pair.line", "pair.after"), 9).alias("ratio"))


@query()
def stitch_scroll_frames(spark, sf_dir):
    """Documents shown as windows of 12 lines that move by 4, put together again."""
    rows = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("video"), text.lines(F.col("text")).alias("all"))
    shown = rows.select("video", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("all") - 9, F.lit(0)), F.lit(4)), lambda i: F.slice(F.col("all"), i + 1, F.lit(12)))).alias("frame_id", "part"))
    return stitching.stitch(shown.select("video", "frame_id", F.posexplode("part").alias("line_no", "line")), "video")


@query(rf"""WITH {_LINES} SELECT DISTINCT doc_id, regexp_extract(line, '[A-Za-z]+') AS module FROM rows WHERE regexp_matches(line, '[A-Za-z]')""")
def extract_imports(spark, sf_dir):
    """Each line of a whole text as an import of its first word: code that mostly does not parse, as much that is read from a screen."""
    rows = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = F.filter(F.transform(text.lines(F.col("text")), lambda x: F.regexp_extract(x, "[A-Za-z]+", 0)), lambda x: x != "")
    code = F.array_join(F.transform(words, lambda x: F.concat(F.lit("import "), x)), "\n")
    return rows.select("doc_id", F.explode(text.python_imports(code)).alias("module"))
