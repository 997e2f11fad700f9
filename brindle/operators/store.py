"""The text store's relational operators: hashes, merges, deletes, counts and listings.

Tables are plain DataFrames. A mutation returns the new tables; writing them as a new version and swapping the folder is
left to ``brindle.sources.warehouse``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import content_hash
from brindle.session import numbered


def duplicate_classes(chunks: DataFrame) -> DataFrame:
    """(content_hash, n_chunks, first_chunk_id) of texts that several chunks share; null texts belong to none."""
    hashed = chunks.where(F.col("text").isNotNull()).select("chunk_id", content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk_id")).where("n_chunks > 1")


def outdated_hashes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content_hash, actual_hash) of chunks whose stored hash isn't that of their text, without letter case."""
    actual = content_hash(F.coalesce("text", F.lit("")))
    return chunks.select("chunk_id", "content_hash", actual.alias("actual_hash")).where(~F.lower(F.trim("content_hash")).eqNullSafe(F.col("actual_hash")))


def new_chunks(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming chunks whose text no stored chunk has. Equal texts within the incoming ones are all kept."""
    hashed = incoming.withColumn("_hash", content_hash(F.coalesce("text", F.lit(""))))
    known = stored.select(content_hash(F.coalesce("text", F.lit(""))).alias("_hash")).distinct()
    return hashed.join(known, "_hash", "left_anti").drop("_hash")


def merge_sources(stored: DataFrame, incoming: DataFrame, added: DataFrame, arrived: DataFrame, now: float) -> DataFrame:
    """The sources after an ingest.

    ``arrived``: all incoming chunks, ``added``: those with a new text. An incoming source without any chunk is not
    recorded. Where it is stored already, one with new texts replaces title, location, tags and extra and keeps type and
    first time; one without new texts only moves ``last_verified_at``. A source that comes twice counts by its greatest row.
    """
    columns = ["type", "title", "location", "ingested_at", "last_verified_at", "tags", "extra"]
    once = incoming.groupBy("source_id").agg(F.max(F.struct("ingested_at", "type", "title", "location", "last_verified_at", "tags", "extra")).alias("n"))
    present = arrived.select("source_id").distinct()
    fresh = added.select("source_id").distinct().withColumn("fresh", F.lit(True))
    coming = once.join(present, "source_id", "left_semi").join(fresh, "source_id", "left")
    both = stored.select("source_id", F.struct(*columns).alias("s")).join(coming, "source_id", "full")
    is_fresh, is_new = F.coalesce("fresh", F.lit(False)), F.col("s").isNull()

    def pick(c: str) -> Column:
        if c == "last_verified_at":
            return F.when(F.col("n").isNotNull(), F.lit(now)).otherwise(F.col("s." + c)).alias(c)
        if c in ("type", "ingested_at"):
            return F.when(is_new, F.col("n." + c)).otherwise(F.col("s." + c)).alias(c)
        return F.when(is_new | is_fresh, F.col("n." + c)).otherwise(F.col("s." + c)).alias(c)

    return both.select("source_id", *[pick(c) for c in columns])


def delete_records(sources: DataFrame, chunks: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) without the records of a deletion log (kind, key, deleted_at); a source takes its chunks along.

    A record stored after its deletion was stored again and stays. A source without any chunk isn't deleted. Keys are
    compared without outer white space and letter case.
    """
    clean = lambda c: F.lower(F.trim(c))
    last = deletions.groupBy(clean("kind").alias("_kind"), clean("key").alias("_key")).agg(F.max("deleted_at").alias("_gone"))
    with_chunks = chunks.select(clean("source_id").alias("_key")).distinct()
    gone = last.where("_kind = 'source'").join(with_chunks, "_key", "left_semi")
    dead = sources.join(gone, clean("source_id") == F.col("_key")).where(F.col("ingested_at") <= F.col("_gone")).select("source_id")
    kept_sources = sources.join(dead, "source_id", "left_anti")
    single = last.where("_kind = 'chunk'").select(F.col("_key").alias("_chunk"), F.col("_gone").alias("_chunk_gone"))
    left = chunks.join(dead.select(clean("source_id").alias("_dead")), clean("source_id") == F.col("_dead"), "left_anti")
    kept_chunks = left.join(single, (clean("chunk_id") == F.col("_chunk")) & (F.col("ingested_at") <= F.col("_chunk_gone")), "left_anti")
    return kept_sources, kept_chunks


def chunk_counts(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, type, title, last_verified_at, n_chunks) of each source; 0 where it has none."""
    counted = chunks.groupBy("source_id").agg(F.count("chunk_id").alias("n_chunks"))
    return sources.join(counted, "source_id", "left").select("source_id", "type", "title", "last_verified_at", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def listed(counts: DataFrame, limit: int = 50, kind: str | None = None) -> DataFrame:
    """The last verified sources: a top-k report, ties by source_id."""
    rows = counts if kind is None else counts.where(F.col("type") == kind)
    return rows.orderBy(F.desc("last_verified_at"), "source_id").limit(limit)


def status(sources: DataFrame, chunks: DataFrame, contradictions: DataFrame, gaps: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """One row of counts; those of gaps and vectors only where their tables are given."""
    counts = sources.agg(F.count("*").alias("n_sources"))
    counts = counts.join(chunks.agg(F.count("*").alias("n_chunks")))
    counts = counts.join(contradictions.agg(F.count_if(F.col("resolution").isNull()).alias("n_open_contradictions")))
    if gaps is not None:
        counts = counts.join(gaps.agg(F.count_if(~F.col("resolved")).alias("n_open_gaps")))
    return counts if vectors is None else counts.join(vectors.agg(F.count("*").alias("n_vectors")))


def shown(sources: DataFrame, chunks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Each source, or those of ``ids`` (source_id), with all its columns and ``chunks``: its chunks (position, chunk_id, text)
    in order of position, then id, as positions may collide. A source without chunks has an empty list.

    A list holds the chunks of one source; for reports over sources of any size use ``listed_chunks``.
    """
    kept = sources if ids is None else sources.join(ids.select("source_id").distinct(), "source_id", "left_semi")
    own = chunks.join(kept.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text"))).alias("chunks"))
    return kept.join(own, "source_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<position:int,chunk_id:string,text:string>>")))


def listed_chunks(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, title, position, chunk_id, text): the chunks of all sources, a row each."""
    return chunks.join(sources.select("source_id", "title"), "source_id").select("source_id", "title", "position", "chunk_id", "text")


def fetched(chunks: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk_id, source_id, text, title, location) of the chunks of (chunk_id) ids; unknown ids and chunks without a source
    have no row, repeated ids one."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").join(sources.select("source_id", "title", "location"), "source_id").select("chunk_id", "source_id", "text", "title", "location")


def newest_first(chunks: DataFrame, limit: int) -> DataFrame:
    """The last stored chunks, a top-k report; ties by chunk_id. Seeds of a run over a part of the store are the first
    stored ones: the same with the order turned round."""
    return chunks.orderBy(F.desc("ingested_at"), "chunk_id").limit(limit)


def upsert(sources: DataFrame, chunks: DataFrame, incoming: DataFrame, arrived: DataFrame, now: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, chunks, result) after an ingest of (sources, chunks); result is (source_id, upserted, skipped, note) of each
    incoming source that has chunks: how many of them were new, how many a stored chunk already had, and, where all were
    known, that only its time of verification changed."""
    added = new_chunks(arrived, chunks)
    merged = merge_sources(sources, incoming, added, arrived, now)
    counts = arrived.groupBy("source_id").agg(F.count("*").alias("n")).join(added.groupBy("source_id").agg(F.count("*").alias("fresh")), "source_id", "left")
    fresh = F.coalesce("fresh", F.lit(0))
    result = incoming.select("source_id").distinct().join(counts, "source_id").select("source_id", fresh.alias("upserted"), (F.col("n") - fresh).alias("skipped"), F.when(fresh == 0, "all chunks are known").alias("note"))
    return merged, chunks.unionByName(added.select(*chunks.columns)), result


def ingest_summary(result: DataFrame, advise: float = 0.05) -> DataFrame:
    """(n_sources, n_new, n_skipped, advise_dedup): one row over the results of an ingest; de-duplication is advised if more
    than that share of the chunks were known."""
    total = F.coalesce(F.sum("upserted"), F.lit(0)) + F.coalesce(F.sum("skipped"), F.lit(0))
    skipped = F.coalesce(F.sum("skipped"), F.lit(0))
    return result.agg(F.count("*").alias("n_sources"), F.coalesce(F.sum("upserted"), F.lit(0)).alias("n_new"), skipped.alias("n_skipped"), (skipped > total * advise).alias("advise_dedup"))


def merge_vectors(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Vectors by chunk_id after an upsert: an incoming one replaces the stored one. Of several incoming rows of an id the
    greatest one counts."""
    columns = [c for c in stored.columns if c != "chunk_id"]
    once = incoming.groupBy("chunk_id").agg(F.max(F.struct(*columns)).alias("n")).select("chunk_id", "n.*")
    return stored.join(once.select("chunk_id"), "chunk_id", "left_anti").unionByName(once)


def without(rows: DataFrame, dropped: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose key is in no row of ``dropped``: what a de-duplication leaves when it is applied."""
    return rows.join(dropped.select(key).distinct(), key, "left_anti")


def stale(sources: DataFrame, now: float, days: float = 30) -> DataFrame:
    """Web sources that were last verified more than ``days`` before ``now``."""
    return sources.where((F.col("type") == "url") & (F.col("last_verified_at") < now - days * 86400)).select("source_id", "location", "last_verified_at")


def tagged(sources: DataFrame) -> DataFrame:
    """(tag, n_sources): tags without outer white space and letter case."""
    return sources.select("source_id", F.explode("tags").alias("tag")).select("source_id", F.lower(F.trim("tag")).alias("tag")).where("tag <> ''").distinct().groupBy("tag").agg(F.count("*").alias("n_sources"))


def contradiction_pairs_logged(log: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b, n_times, first_at, resolution): each unordered pair once, with the resolution of its last row."""
    clean = lambda c: F.lower(F.trim(c))
    rows = log.select(clean("chunk_a").alias("a"), clean("chunk_b").alias("b"), "detected_at", "id", clean("resolution").alias("resolution")).where("a <> '' and b <> ''")
    return (
        rows.groupBy(F.least("a", "b").alias("chunk_a"), F.greatest("a", "b").alias("chunk_b"))
        .agg(F.count("*").alias("n_times"), F.min("detected_at").alias("first_at"), F.max(F.struct("detected_at", "id", "resolution")).alias("_last"))
        .select("chunk_a", "chunk_b", "n_times", "first_at", F.col("_last.resolution").alias("resolution"))
    )


def resolve(log: DataFrame, chunks: DataFrame, keep: str, drop: str, now_resolution: str = "superseded") -> tuple[DataFrame, DataFrame]:
    """(log, chunks) after a pair is resolved: its rows in either orientation get the resolution, the dropped chunk goes.

    A ``KeyError`` tells that no such chunk is stored; nothing is changed then. The kept one is not looked up.
    """
    if chunks.where(F.col("chunk_id") == drop).isEmpty():
        raise KeyError(drop)
    pair = ((F.col("chunk_a") == keep) & (F.col("chunk_b") == drop)) | ((F.col("chunk_a") == drop) & (F.col("chunk_b") == keep))
    return log.withColumn("resolution", F.when(pair, F.lit(now_resolution)).otherwise(F.col("resolution"))), chunks.where(F.col("chunk_id") != drop)


def log_gaps(gaps: DataFrame, questions: DataFrame, now: float, reason: str = "manual") -> DataFrame:
    """Gaps with new questions appended; ids go on from the greatest one, in order of the question."""
    start = gaps.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start"))
    placed = numbered(questions.select("question"), ["question"]).join(start)
    added = placed.select((F.col("start") + F.col("place")).cast("long").alias("id"), "question", F.lit(reason).alias("reason"), F.lit(now).alias("logged_at"), F.lit(False).alias("resolved"))
    return gaps.unionByName(added)


def confidence(score: Column) -> Column:
    """high from 0.75, medium from 0.55, else low; no score counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= 0.75, "high").when(s >= 0.55, "medium").otherwise("low")
