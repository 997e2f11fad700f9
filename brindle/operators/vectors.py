"""Vector search: exact top-k by cosine of a stated query set, and what is built on it.

One block of queries is broadcast, and a pass over the stored vectors multiplies each Arrow batch with it. More queries are
joined in blocks: queries and vectors are dealt into blocks of a bounded number, and a task multiplies one block of either.
Both keep the best ``k`` per query, or those from a threshold on, before anything is shuffled by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import has_negation
from brindle.operators.store import confidence
from brindle.session import blocks, skipping_empty

#: Queries of one block; with 1,024 dimensions of 4 bytes it is 16 MB at each task.
QUERIES_AT_ONCE = 4096
#: Vectors of one block.
VECTORS_AT_ONCE = 32_768


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1, size)


def _best(ids, matrix, labels, frame: pd.DataFrame, k: int | None, least: float | None, same_label: bool) -> pd.DataFrame:
    """Hits of a block of queries among some vectors: the best ``k`` of each query, or all from ``least`` on."""
    scores = matrix @ _unit(frame["embedding"].tolist()).T
    if same_label:
        scores[labels[:, None] != frame["label"].to_numpy()[None, :]] = -np.inf
    own = frame["vec_id"].to_numpy()
    if k is None:
        q, v = np.nonzero(np.round(scores, 6) >= least)
        return pd.DataFrame({"query_id": ids[q], "vec_id": own[v], "score": scores[q, v]})
    top = min(k, len(own))
    order = np.lexsort((np.broadcast_to(own, scores.shape), -np.round(scores, 9)), axis=1)[:, :top]
    found = pd.DataFrame({"query_id": np.repeat(ids, top), "vec_id": own[order].ravel(), "score": np.take_along_axis(scores, order, axis=1).ravel()})
    return found[np.isfinite(found["score"])]


def _hits(queries: DataFrame, vectors: DataFrame, k: int | None, least: float | None, same_label: bool) -> DataFrame:
    spark = queries.sparkSession
    usable = lambda df: df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    label = "label" if same_label else F.lit(0).alias("label")
    asked, stored = usable(queries).select("query_id", "embedding", label), usable(vectors).select("vec_id", "embedding", label)
    schema = "query_id long, vec_id long, score double"
    rows = asked.limit(QUERIES_AT_ONCE + 1).collect()
    if len(rows) <= QUERIES_AT_ONCE:
        block = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), _unit([r[1] for r in rows]) if rows else None, np.array([r[2] for r in rows])))

        def run(batches):
            ids, matrix, labels = block.value
            for pdf in batches:
                if len(pdf) and matrix is not None:
                    yield _best(ids, matrix, labels, pdf, k, least, same_label)

        return stored.mapInPandas(skipping_empty(run), schema)
    n_queries, n_vectors = -(-asked.count() // QUERIES_AT_ONCE), max(blocks(spark), -(-stored.count() // VECTORS_AT_ONCE))
    dealt = lambda df, key, n, other, m: df.withColumn("_" + key, F.pmod(F.xxhash64(key), F.lit(n))).withColumn("_" + other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    left = dealt(asked, "query_id", n_queries, "vec_id", n_vectors).groupBy("_query_id", "_vec_id")
    # Both may come from one table; names of its own keep the sides apart.
    stored = stored.select("vec_id", F.col("embedding").alias("v_embedding"), F.col("label").alias("v_label"))
    right = dealt(stored, "vec_id", n_vectors, "query_id", n_queries).groupBy("_query_id", "_vec_id")

    def multiply(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        v = v.rename(columns={"v_embedding": "embedding", "v_label": "label"})
        # Half as many queries at a time as one block has bound the scores that are held at once.
        parts = [_best(p["query_id"].to_numpy(), _unit(p["embedding"].tolist()), p["label"].to_numpy(), v, k, least, same_label) for p in (q[i : i + 1024] for i in range(0, len(q), 1024)) if len(v)]
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    return left.cogroup(right).applyInPandas(multiply, schema)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 8, same_label: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` vectors nearest to each query, itself included; ties by vec_id.

    queries: (query_id, embedding[, label]), vectors: (vec_id, embedding[, label]). With ``same_label`` only vectors of
    the query's label are ranked, which is applied before the ranking. Null and empty vectors are left out; a vector of
    zeros has score 0. Rows of one id count once each.
    """
    found = _hits(queries, vectors, k, None, same_label)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def within(queries: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(query_id, vec_id, score): all vectors with at least this score to each query, itself included, however many."""
    return _hits(queries, vectors, None, threshold, False).withColumn("score", F.round("score", 6))


def near_duplicates(hits: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(id_a, id_b, score): unordered pairs of a query and another vector at or above the threshold, among its hits.

    Hits of ``nearest`` bring at most ``k`` pairs a query; those of ``within`` bring all.
    """
    pairs = hits.where((F.col("query_id") != F.col("vec_id")) & (F.col("score") >= threshold))
    return pairs.groupBy(F.least("query_id", "vec_id").alias("id_a"), F.greatest("query_id", "vec_id").alias("id_b")).agg(F.max("score").alias("score"))


def dropped(pairs: DataFrame) -> DataFrame:
    """(id, n_pairs): what a de-duplication drops, the greater id of each pair; n_pairs tells how often it is named."""
    return pairs.groupBy(F.col("id_b").alias("id")).agg(F.count("*").alias("n_pairs"))


def contradictions(hits: DataFrame, texts: DataFrame, threshold: float = 0.78) -> DataFrame:
    """(id_a, id_b, score): near pairs of different sources of which exactly one text has a negation.

    texts: (id, text, source). A null source differs from any other. Ids without a text have no pair.
    """
    pairs = near_duplicates(hits, threshold)
    own = texts.select("id", F.col("source"), has_negation(F.col("text")).alias("negated")).where("id is not null")
    a = own.select(F.col("id").alias("id_a"), F.col("source").alias("source_a"), F.col("negated").alias("negated_a"))
    b = own.select(F.col("id").alias("id_b"), F.col("source").alias("source_b"), F.col("negated").alias("negated_b"))
    both = pairs.join(a, "id_a").join(b, "id_b")
    return both.where(~F.col("source_a").eqNullSafe(F.col("source_b")) & (F.col("negated_a") != F.col("negated_b"))).select("id_a", "id_b", "score")


def answer_confidence(hits: DataFrame) -> DataFrame:
    """(query_id, top_score, confidence) over the hits of each query other than itself; the best score, at least 0."""
    top = hits.where("query_id <> vec_id").groupBy("query_id").agg(F.greatest(F.lit(0.0), F.max("score")).alias("top_score"))
    return top.select("query_id", "top_score", confidence(F.col("top_score")).alias("confidence"))


def retrieve(question: DataFrame, vectors: DataFrame, chunks: DataFrame, sources: DataFrame, k: int = 8) -> DataFrame:
    """Search with the texts and sources of the hits: (query_id, rank, score, chunk_id, text, title, location, private).

    chunks: (vec_id, chunk_id, source_id, text). ``private`` tells hits whose source is tagged so; leaving them out
    after the ranking may give fewer than ``k`` rows.
    """
    hits = nearest(question, vectors, k)
    own = hits.join(chunks, "vec_id", "left").join(sources.select("source_id", "title", "location", "tags"), "source_id", "left")
    private = F.coalesce(F.exists("tags", lambda t: F.lower(F.trim(t)) == "private"), F.lit(False))
    return own.select("query_id", "rank", "score", "chunk_id", "text", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("location", F.lit("")).alias("location"), private.alias("private"))
