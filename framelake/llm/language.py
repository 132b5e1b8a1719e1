"""Language ID by compression: the language whose dictionary compresses a text smallest.

Learning takes a bounded sample of labelled rows: of each language about `sample_docs` documents, picked by a hash of their
id and text, and of each an excerpt from a place picked by such a hash. Joined, they are the language's raw-content zstandard
dictionary. `dict_bytes` bounds it: excerpts are as short as it takes for every sampled document to reach the dictionary, and
of at most `sample_chars` characters. All dictionaries together hold at most `model_bytes`: with many languages each gets its even share.
A prediction reads the whole text, lower-cased and with all but letters and their combining marks turned into spaces, in pieces of `piece_bytes`; the sizes of all pieces are summed for each language. A narrow margin between the
two smallest sizes is rejected: the best label stands in `lang_pred`, and `rejected` is set. The margin is the difference as a
share of the smallest size beyond `free_bytes`: what a text of some 25 letters comes to by frame and literals alone, where no
dictionary can tell anything. One rule holds for all lengths; a size up to `free_bytes` gives no evidence and is not rejected.

Defined cases: null texts and texts without a letter (digits, numerals such as one half, marks alone) are `und`, score 0 and rejected; ties go to the language with most labelled
rows, then the first by name; with no labelled rows everything is `und`; with one language its score is 1.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import column, table

DICT_BYTES = 112 << 10
SAMPLE_DOCS = 300
SAMPLE_CHARS = 2048
PIECE_BYTES = 1024
LEVEL = 6
#: Difference of the two smallest sizes, as a share of the smallest beyond FREE_BYTES, below which a text is rejected. Both are
#: calibrated on held-out rows of sf0.1 and on texts of random letters; README has the rates.
MARGIN = 0.06
FREE_BYTES = 34
#: The bound of the learning sample: bytes of all dictionaries, and languages, those with most labelled rows.
MODEL_BYTES = 56 << 20
MAX_LANGUAGES = 100_000

NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str | None) -> str:
    """Letters with their marks, and single spaces; empty without any letter."""
    kept = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return kept if any(c.isalpha() for c in kept) else ""


def in_fold(id_col: str = "doc_id"):
    """True for the rows held out: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES, model_bytes: int = MODEL_BYTES, max_languages: int = MAX_LANGUAGES) -> dict[str, bytes]:
    """A raw-content dictionary for each language, those with most labelled rows first. What reaches the driver is bounded by the parameters."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    counts = {r[0]: r[1] for r in found.collect()}
    if not counts:
        return {}
    dict_bytes = max(64, min(dict_bytes, model_bytes // len(counts)))
    sample_docs = max(1, min(sample_docs, dict_bytes // 64))
    by_lang = lambda numbers: F.from_json(F.lit(json.dumps(numbers)), "map<string,long>")[F.col(lang_col)]
    share = by_lang({lang: min(1 << 40, int((1 << 40) * 1.5 * sample_docs / n)) for lang, n in counts.items()})
    # By id and text, and once each, so that an id or a row that comes very often is not gathered as often.
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("language")), F.lit(1 << 40))
    # Twice an even share of the dictionary: what short texts leave goes to the others.
    most = by_lang({lang: min(sample_chars, -(-2 * dict_bytes // max(1, min(n, sample_docs * 3 // 2)))) for lang, n in counts.items()}).cast("int")
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("place")), F.greatest(F.length(text_col) - most, F.lit(0)).cast("long") + 1).cast("int") + 1
    rows = known.where(draw < share).select(F.col(lang_col), draw, F.col(text_col).substr(place, most)).distinct().collect()
    model, drawn = {}, {}
    for r in rows:
        drawn.setdefault(r[0], []).append(r)
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        parts: dict[str, None] = {}
        for _, _, text in sorted(drawn.get(lang, ()), key=lambda r: (r[1], r[2]))[: 2 * sample_docs]:
            if mine := letters(text):
                parts.setdefault(mine)
        model[lang] = _shared_out([p.encode() for p in parts], dict_bytes) or b" "
    return model


def _shared_out(parts: list[bytes], most: int) -> bytes:
    """The parts, joined within `most` bytes: the longest are cut to one length, so that all are in it."""
    left, kept = most, {}
    for done, k in enumerate(sorted(range(len(parts)), key=lambda k: len(parts[k]))):
        kept[k] = parts[k][: max(0, left // (len(parts) - done) - 1)].decode(errors="ignore").encode()
        left -= len(kept[k]) + 1
    return b"\n".join(kept[k] for k in range(len(parts)))


class Classifier:
    def __init__(self, model: dict[str, bytes], level: int = LEVEL, piece_bytes: int = PIECE_BYTES, free_bytes: int = FREE_BYTES):
        import zstandard

        self.langs, self.piece, self.free, self.engines = list(model), piece_bytes, free_bytes, []
        for lang in self.langs:
            shared = zstandard.ZstdCompressionDict(model[lang].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=level)
            self.engines.append(zstandard.ZstdCompressor(dict_data=shared, level=level, write_content_size=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(label, score, margin)"""
        data = letters(text).encode()
        if not data or not self.langs:
            return "und", 0.0, 0.0
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        sizes = [sum(len(e.compress(p)) for p in pieces) for e in self.engines]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        second = min(s for k, s in enumerate(sizes) if k != best)
        beyond = sizes[best] - self.free
        return self.langs[best], (second - sizes[best]) / second, (second - sizes[best]) / beyond if beyond > 0 else float("inf")


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", margin: float = MARGIN, free_bytes: int = FREE_BYTES, level: int = LEVEL, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs with lang_pred, score and rejected; columns of these names that docs had are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(shared.value, level, piece_bytes, free_bytes)
        for batch in batches:
            found = [judge.predict(t.as_py()) for t in column(batch, text_col)]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[0] == "und" or x[2] < margin for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)

    return docs.mapInArrow(run, schema)


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~in_fold()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", in_fold().alias("held_out"), "lang_pred", "score", "rejected")
