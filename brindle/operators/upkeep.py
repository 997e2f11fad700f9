"""Upkeep of the text store: gaps, refreshes, re-embedding, the combined run, notes and draft context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import SENSITIVE_TERMS, any_of, collapsed, source_id
from brindle.operators import chunking, store, threads, vectors
from brindle.session import numbered


def resolve_gaps(gaps: DataFrame, ids: DataFrame) -> DataFrame:
    """Gaps with those of (id) marked as resolved; unknown ids change nothing."""
    known = ids.select("id").distinct().withColumn("_done", F.lit(True))
    return gaps.join(known, "id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("_done", F.lit(False))).drop("_done")


def open_gaps(gaps: DataFrame, limit: int = 50) -> DataFrame:
    """The last logged open gaps: a top-k report, ties by id."""
    return gaps.where(~F.col("resolved")).orderBy(F.desc("logged_at"), "id").limit(limit)


def weak_answers(confidences: DataFrame, questions: DataFrame) -> DataFrame:
    """(question) of (query_id, question) whose search had low confidence, or no hit at all."""
    return questions.join(confidences, "query_id", "left").where(F.coalesce("confidence", F.lit("low")) == "low").select("question").distinct()


def log_contradictions(log: DataFrame, pairs: DataFrame, now: float, note: str = "negation-asymmetry") -> DataFrame:
    """The log with found pairs (id_a, id_b) appended; ids go on from the greatest one, in order of the pair."""
    start = log.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start"))
    rows = numbered(pairs.select(F.col("id_a").cast("string").alias("chunk_a"), F.col("id_b").cast("string").alias("chunk_b")), ["chunk_a", "chunk_b"]).join(start)
    added = rows.select((F.col("start") + F.col("place")).cast("long").alias("id"), "chunk_a", "chunk_b", F.lit(note).alias("note"), F.lit(now).alias("detected_at"), F.lit(None).cast("string").alias("resolution"))
    return log.select(*added.columns).unionByName(added)


def reembedded(chunks: DataFrame, sources: DataFrame, model=chunking.embed) -> DataFrame:
    """(chunk_id, embedding, source_id, source_type, title, location, tags, text_preview) of all chunks, made anew.

    Chunks whose source has no row keep empty metadata. The preview is the first 300 code points: the feature of the column.
    """
    own = chunking.embedded(chunks.select("chunk_id", "source_id", "text"), model)
    about = sources.select("source_id", F.col("type").alias("source_type"), "title", "location", "tags")
    joined = own.join(about, "source_id", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return joined.select("chunk_id", "embedding", "source_id", empty("source_type"), empty("title"), empty("location"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.substring("text", 1, 300).alias("text_preview"))


def refreshed(sources: DataFrame, chunks: DataFrame, pages: DataFrame, now: float, days: float = 30) -> tuple[DataFrame, DataFrame]:
    """(sources, new chunks) after stale web sources were read again from (location, title, text).

    As before, a changed page gets no tags; a page without text, or that was not read, changes nothing.
    """
    due = store.stale(sources, now, days).select("source_id", "location")
    again = pages.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).join(due, "location")
    made = chunking.chunked(again.select("source_id", "text")).withColumn("ingested_at", F.lit(now))
    arrived = made.select("chunk_id", "source_id", "text", "content_hash", "position", "ingested_at")
    added = store.new_chunks(arrived, chunks)
    coming = again.select("source_id", F.lit("url").alias("type"), "title", "location", F.lit(now).alias("ingested_at"), F.lit(now).alias("last_verified_at"), F.array().cast("array<string>").alias("tags"), F.lit("{}").alias("extra"))
    return store.merge_sources(sources, coming, added, arrived, now), added


def healed(hits: DataFrame, texts: DataFrame, sources: DataFrame, now: float, duplicate: float = 0.95, near: float = 0.78, days: float = 30) -> dict[str, DataFrame]:
    """The three reports of a combined run, in its order; nothing is dropped by it."""
    pairs = vectors.near_duplicates(hits, duplicate)
    return {"dedup": pairs, "stale": store.stale(sources, now, days), "contradictions": vectors.contradictions(hits, texts, near)}


def parsed_tags(text: Column) -> Column:
    """Tags of a comma list, without outer white space and empty ones; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda t: t != "")


def note_sources(notes: DataFrame) -> DataFrame:
    """(source_id, type, title, location, text) of (text) notes; blank ones have none. The title is the first 60 code
    points on one line."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    own = notes.select(text.alias("text")).where(F.col("text") != "")
    return own.select(source_id("note", F.col("text")).alias("source_id"), F.lit("note").alias("type"), F.replace(F.substring("text", 1, 60), F.lit("\n"), F.lit(" ")).alias("title"), F.lit("note://inline").alias("location"), "text")


def outcome_notes(outcomes: DataFrame) -> DataFrame:
    """(text, tags) of (channel, thread_id, action, summary, participants) rows with a summary."""
    own = outcomes.where(F.length(F.trim(F.coalesce("summary", F.lit("")))) > 0)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.format_string("[comms-outcome] %s thread=%s action=%s: %s", empty("channel"), empty("thread_id"), empty("action"), F.col("summary"))
    people = F.transform(F.coalesce("participants", F.array().cast("array<string>")), lambda p: F.concat(F.lit("with:"), p))
    return own.select(text.alias("text"), F.array_distinct(F.array_compact(F.concat(F.array(F.lit("comms-outcome"), F.nullif("channel", F.lit(""))), people))).alias("tags"))


def action_notes(items: DataFrame) -> DataFrame:
    """(text, tags) of action items (id, kind, text, owner, deadline)."""
    text = F.concat_ws(" | ", F.col("text"), F.concat(F.lit("owner: "), F.col("owner")), F.concat(F.lit("deadline: "), F.col("deadline")), F.concat(F.lit("thread: "), F.col("id")))
    tags = F.array_compact(F.array(F.lit("action-item"), F.concat(F.lit("kind:"), F.col("kind")), F.concat(F.lit("owner:"), F.col("owner")), F.concat(F.lit("thread:"), F.col("id")), F.when(F.col("deadline").isNotNull(), "has-deadline")))
    return items.select(text.alias("text"), tags.alias("tags"))


def contacts(messages: DataFrame) -> DataFrame:
    """(address, n_messages): senders by address, without letter case and outer white space."""
    address = F.nullif(F.regexp_extract(F.lower(F.coalesce(F.nullif(F.trim("from_id"), F.lit("")), F.col("from"))), r"([^\s<>]+@[^\s<>]+)", 1), F.lit(""))
    return messages.select("id", address.alias("address")).where("address is not null").distinct().groupBy("address").agg(F.count("*").alias("n_messages"))


def draft_context(mail: DataFrame, search: Callable[[DataFrame], DataFrame], least: float = 0.55) -> DataFrame:
    """(id, route, reply_to, n_hits, best_chunk, warnings) of each thread.

    ``search`` takes (query_id, topic) rows and gives (query_id, chunk_id, score). Hits below ``least`` are left out, a
    chunk that several topics find counts once with its best score.
    """
    asked = threads.topics(mail).withColumn("query_id", F.xxhash64("id", "place"))
    hits = asked.select("query_id", "id").join(search(asked.select("query_id", "topic")), "query_id").where(F.col("score") >= least)
    once = hits.groupBy("id", "chunk_id").agg(F.max("score").alias("score"))
    best = once.groupBy("id").agg(F.count("*").alias("n_hits"), F.max_by("chunk_id", F.struct("score", "chunk_id")).alias("best_chunk"))
    body = F.lower(F.coalesce(F.try_element_at("messages", F.lit(-1))["body"], F.lit("")))
    flags = mail.select("id", body.rlike(any_of(SENSITIVE_TERMS)).alias("sensitive"))
    joined = threads.routes(mail).join(flags, "id").join(best, "id", "left")
    warnings = F.array_compact(F.array(F.when(F.col("sensitive"), "sensitive terms in the thread"), F.when(F.col("n_hits").isNull(), "no context found")))
    return joined.select("id", "route", "reply_to", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "best_chunk", warnings.alias("warnings"))


def profile_age(built_at: Column, now: float, days: float = 30) -> Column:
    """Why a voice profile is due again: missing, unparseable, or its age in days from ``days`` on; null if it isn't."""
    at = F.unix_timestamp(F.try_to_timestamp(collapsed(built_at)))
    age = F.floor((F.lit(now) - at) / 86400)
    return F.when(built_at.isNull(), "missing").when(at.isNull(), "unparseable built_at").when(age >= days, F.concat(F.lit("age_days="), age.cast("string")))
