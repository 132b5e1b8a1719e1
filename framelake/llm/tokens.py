"""Token counts: texts are encoded in batches inside an Arrow function that returns lengths only.

Batches hold about `batch_bytes` of UTF-8 whatever the number of rows, and longer texts are cut into pieces at places where a
token can't span, because the byte-level pattern of this family of files always starts a new piece there: a space between two
characters that are no white space; the change from a letter to a digit or back; and ideographic punctuation after a letter. So prose of any
script, base64 and numbers are cut; a single run of letters, of signs or of white space stays whole. Pieces of one text are summed. Only files
whose added tokens have none of these places inside are cut.

Defined cases: null and empty texts have no tokens; a special token's string inside a text counts as the library's
default has it; rows are counted each by itself, whatever they share.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import table

PIECE_CHARS = 1 << 15
BATCH_BYTES = 1 << 18
LIMIT = 1024

SAFE = regex.compile(r"(?<=\S) (?=\S)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Consecutive parts of a text, each a little over `most` characters where it has safe places."""
    at = 0
    while len(text) - at > most and (found := SAFE.search(text, at + most)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def can_cut(path: str) -> bool:
    """True for byte-level files without added tokens that a safe place would tear apart."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    split = known.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not known.get("normalizer")
    return bool(plain) and not any(SAFE.search(t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in known.get("added_tokens", ()))


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of a batch by the library that the file's suffix names."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        engine = Tokenizer.from_file(path)
        engine.no_truncation()
        engine.no_padding()
        return lambda texts: [len(e) for e in engine.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    raise ValueError(f"no library for {path}")


def count_tokens(text: Column, path: str, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> Column:
    """Tokens of each text. Texts are cut into pieces only for byte-level files; others see whole texts."""
    cuts = can_cut(path)

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(path)
        for batch in batches:
            totals = [0] * len(batch)
            waiting: list[tuple[int, str]] = []
            size = 0
            for k, (value, n_bytes) in enumerate(zip(batch, pc.binary_length(batch).to_pylist(), strict=True)):
                if not (whole := value.as_py()):
                    continue
                parts = list(pieces(whole, piece_chars)) if cuts and n_bytes > piece_chars else [whole]
                for part in parts:
                    waiting.append((k, part))
                    size += n_bytes if len(parts) == 1 else len(part.encode())
                    if size >= batch_bytes:
                        for (row, _), n in zip(waiting, count([p for _, p in waiting]), strict=True):
                            totals[row] += n
                        waiting, size = [], 0
            for (row, _), n in zip(waiting, count([p for _, p in waiting]), strict=True):
                totals[row] += n
            yield pa.array(totals, pa.int64())

    return lengths(text)


def op3_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    n = count_tokens(F.coalesce("text", F.lit("")), str(public_tokenizers.path("byte_bpe_50k.json")))
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.select("*", (F.col("n_tokens") > LIMIT).alias("over_limit"))
