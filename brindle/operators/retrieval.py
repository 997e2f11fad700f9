"""Retrieval: filters before the ranking, the search, texts and sources of the hits, and how far they may be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.chunking import embed
from brindle.operators.store import confidence
from brindle.operators.vectors import nearest


def embedded_questions(questions: DataFrame, model=embed) -> DataFrame:
    """(query_id, embedding) of (query_id, question); a model that treats questions unlike documents is given here."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[["query_id"]].assign(embedding=list(model([q if isinstance(q, str) else None for q in pdf["question"]])))

    return questions.select("query_id", "question").mapInPandas(run, "query_id long, embedding array<float>")


def filtered(vectors: DataFrame, kind: str | None = None, tag: str | None = None) -> DataFrame:
    """Vectors (vec_id, embedding, source_type, tags) of a type and with a tag, both as spelled; None takes all. It comes
    before the ranking, so a search still gives its ``k`` hits, and the type reaches the scan."""
    kept = vectors if kind is None else vectors.where(F.col("source_type") == kind)
    return kept if tag is None else kept.where(F.array_contains("tags", tag))


def search(questions: DataFrame, vectors: DataFrame, k: int = 8, kind: str | None = None, tag: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): hits of (query_id, embedding) among the vectors that ``filtered`` leaves."""
    return nearest(questions, filtered(vectors, kind, tag), k)


def neighbors(hits: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): the hits of ``search`` alone."""
    return hits.select("query_id", "vec_id", "score")


def query(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, sources: DataFrame, k: int = 8, kind: str | None = None, tag: str | None = None) -> DataFrame:
    """(query_id, top_score, confidence, rank, score, chunk_id, text, source_id, title, location, tags): one row per hit.

    chunks: (vec_id, chunk_id, source_id, text), sources: (source_id, title, location, tags). A hit without a chunk or a
    source keeps empty texts and no tags. The confidence is that of the best hit; a question without hits has one row
    with no rank, score 0 and low confidence.
    """
    hits = search(questions, vectors, k, kind, tag)
    own = hits.join(chunks.select("vec_id", "chunk_id", "source_id", "text"), "vec_id", "left").join(sources.select("source_id", "title", "location", "tags"), "source_id", "left")
    top = hits.groupBy("query_id").agg(F.greatest(F.lit(0.0), F.max("score")).alias("top_score")).withColumn("confidence", confidence(F.col("top_score")))
    whole = questions.select("query_id").distinct().join(top, "query_id", "left").join(own, "query_id", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return whole.select(
        "query_id", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("confidence", F.lit("low")).alias("confidence"), "rank", "score", "chunk_id", empty("text"),
        empty("source_id"), empty("title"), empty("location"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def lookup(answers: DataFrame) -> DataFrame:
    """(query_id, top_score, confidence, rank, score, title, location, text, source_id): answers without hits that are tagged
    private. They go after the ranking, so there may be less than ``k`` and the confidence may be that of a private hit."""
    private = F.exists("tags", lambda t: t == "private")
    return answers.where(~private).select("query_id", "top_score", "confidence", "rank", "score", "title", "location", "text", "source_id")


def deep(answers: DataFrame, least: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """(hits, gaps) of a question asked in several forms (topic_id, and the columns of ``query``): each source once with its
    best hit per topic, and the topics whose best score stays below ``least``."""
    best = answers.where("rank is not null").groupBy("topic_id", "source_id").agg(F.max_by(F.struct("score", "chunk_id", "text", "title", "location"), F.struct("score", "chunk_id")).alias("b"))
    gaps = answers.groupBy("topic_id").agg(F.max("top_score").alias("top_score")).where(F.col("top_score") < least)
    return best.select("topic_id", "source_id", "b.*"), gaps
