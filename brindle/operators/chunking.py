"""Chunks of texts, their embeddings, and the ingest of documents into the text store."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import content_hash, source_id
from brindle.session import skipping_empty

TARGET, OVERLAP, LEAST = 1200, 150, 80
DIMENSIONS = 64
_PARAGRAPH = re.compile(r"\n\s*\n+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z(])")
_WORD = re.compile(r"[^\W_]+")


def _packed(parts: list[str], glue: str, target: int, fits=None) -> list[str]:
    """Parts joined greedily; the glue counts even before the first part. A part that is too long stands alone."""
    out, buffer = [], ""
    for part in parts:
        if fits is not None and len(part) > target:
            out += [buffer] * bool(buffer)
            buffer = ""
            out += fits(part)
        elif len(buffer) + len(part) + len(glue) <= target:
            buffer = buffer + glue + part if buffer else part
        else:
            out += [buffer] * bool(buffer)
            buffer = part
    return out + [buffer] * bool(buffer)


def chunk(text: str | None, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of at most ``target`` code points along paragraphs and sentences, each but the first led by the last
    ``overlap`` ones of the chunk before. Chunks below ``least`` go unless all are. Null and blank texts have none."""
    text = (text or "").strip()
    if len(text) <= target:
        return [text] if text else []
    cut = lambda s: [s[i : i + target] for i in range(0, len(s), target)]
    pieces: list[str] = []
    for paragraph in filter(None, (p.strip() for p in _PARAGRAPH.split(text))):
        pieces += [paragraph] if len(paragraph) <= target else _packed(_SENTENCE.split(paragraph), " ", target, cut)
    plain = _packed(pieces, "\n\n", target)
    led = [plain[0]] + [(a[-overlap:] + "\n\n" + b).strip() if overlap else b for a, b in zip(plain, plain[1:], strict=False)]
    return [c for c in led if len(c) >= least] or led


def chunked(documents: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(source_id, position, text, content_hash, chunk_id) of (source_id, text); ids follow from source, place and hash,
    so a task that runs again gives the same rows."""

    def run(batches):
        for pdf in batches:
            rows = [(s, i, c) for s, t in zip(pdf["source_id"], pdf["text"], strict=True) for i, c in enumerate(chunk(t if isinstance(t, str) else None, target, overlap))]
            yield pd.DataFrame(rows, columns=["source_id", "position", "text"])

    out = documents.select("source_id", "text").mapInPandas(skipping_empty(run), "source_id string, position int, text string").withColumn("content_hash", content_hash(F.col("text")))
    return out.withColumn("chunk_id", F.sha2(F.concat_ws("|", "source_id", F.col("position").cast("string"), "content_hash"), 256))


def embed(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Feature-hash embeddings of unit length: signed counts of words and word pairs. The stand-in for an external model;
    null and wordless texts give zeros."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for i, text in enumerate(texts):
        words = [w.lower() for w in _WORD.findall(text or "")]
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]], np.uint64)
        if len(hashes):
            np.add.at(out[i], (hashes % np.uint64(dimensions)).astype(np.int64), np.where(hashes >> np.uint64(63), 1, -1).astype(np.float32))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size == 0, 1, size)


def embedded(chunks: DataFrame, model=embed) -> DataFrame:
    """Chunks with ``embedding``; ``model`` takes a list of texts and gives a matrix, called once per Arrow batch."""
    from pyspark.sql import types as T

    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(embedding=list(model([t if isinstance(t, str) else None for t in pdf["text"]])))

    return chunks.mapInPandas(skipping_empty(run), schema)


def ingested(documents: DataFrame, kind: str, key: str = "location") -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) of documents (location, title, text): the deterministic ids make a second ingest harmless."""
    rows = documents.withColumn("source_id", source_id(kind, F.col(key)))
    return rows.select("source_id", F.lit(kind).alias("type"), "title", "location"), chunked(rows)
