"""Queries of the text store and of message analytics, with their SQL where SQL can express them over whole tables.

Where the tables have no such relation, a query reads one from the ``events`` or ``embeddings`` table by a fixed rule
that its docstring and its SQL state alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.text import CONTRACTIONS, EMOJI, FILLERS, GREETINGS, SIGN_OFFS, SIGNATURE_STARTS, SPACE
from brindle.operators import chunking, messages, patterns, retrieval, store, threads, upkeep, vectors, voice
from brindle.session import checkpointed, table
from brindle.sources import readers

#: The moment that time-dependent queries take as now, in epoch seconds: 2026-10-01.
NOW = 1_790_812_800.0
#: Rows stored from then on count as incoming, in epoch seconds: 2026-01-01.
SPLIT = 1_767_225_600.0


def content_hash_dedup(spark, d):
    return store.duplicate_classes(table(spark, d, "chunks"))


def outdated_hashes(spark, d):
    return store.outdated_hashes(table(spark, d, "chunks"))


def _split(df):
    return df.where(F.col("ingested_at") < SPLIT), df.where(F.col("ingested_at") >= SPLIT)


def new_chunks(spark, d):
    stored, incoming = _split(table(spark, d, "chunks"))
    return store.new_chunks(incoming, stored).select("chunk_id", "source_id", "position")


def upserted_sources(spark, d):
    """Sources stored before SPLIT, after an ingest of every source of the later chunks under a changed title."""
    chunks, sources = table(spark, d, "chunks"), table(spark, d, "sources")
    stored, incoming = _split(chunks)
    arriving = _renamed(sources)
    merged = store.merge_sources(_split(sources)[0], arriving, store.new_chunks(incoming, stored), incoming, NOW)
    return merged.select("source_id", "type", "title", "location", "ingested_at", "last_verified_at", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|").alias("tags"), "extra")


def _renamed(sources):
    """Sources as they arrive: another title, one more tag, other extras."""
    tags = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("again")))
    return sources.withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit(" (new)"))).withColumn("tags", tags).withColumn("extra", F.lit('{"again": true}'))


def _upserted(spark, d):
    chunks, sources = table(spark, d, "chunks"), table(spark, d, "sources")
    stored, incoming = _split(chunks)
    return store.upsert(_split(sources)[0], stored, _renamed(sources), incoming, NOW)


def upsert_results(spark, d):
    return _upserted(spark, d)[2]


def chunks_after_upsert(spark, d):
    return _upserted(spark, d)[1].select("chunk_id", "source_id", "position")


def ingest_summary(spark, d):
    return store.ingest_summary(_upserted(spark, d)[2])


def fetched_chunks(spark, d):
    """The chunks that open contradictions name, by their ids."""
    log = table(spark, d, "contradiction_log").where("resolution is null")
    ids = log.select(F.explode(F.array("chunk_a", "chunk_b")).alias("chunk_id"))
    return store.fetched(table(spark, d, "chunks"), table(spark, d, "sources"), ids).select("chunk_id", "source_id", "title", "location", F.length("text").alias("n_chars"))


def newest_chunks(spark, d):
    return store.newest_first(table(spark, d, "chunks"), 20).select("chunk_id", "ingested_at")


def merged_vectors(spark, d):
    """Vectors with an even id, after all vectors with an id divisible by three came in with their label for a value."""
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return store.merge_vectors(vecs.where("chunk_id % 2 = 0"), vecs.where("chunk_id % 3 = 0").withColumn("label", F.col("label") + 100))


def chunks_after_deletion(spark, d):
    return store.delete_records(table(spark, d, "sources"), table(spark, d, "chunks"), table(spark, d, "deletion_log"))[1].select("chunk_id", "source_id")


def sources_after_deletion(spark, d):
    return store.delete_records(table(spark, d, "sources"), table(spark, d, "chunks"), table(spark, d, "deletion_log"))[0].select("source_id", "type")


def source_chunk_counts(spark, d):
    return store.chunk_counts(table(spark, d, "sources"), table(spark, d, "chunks"))


def listed_sources(spark, d):
    return store.listed(store.chunk_counts(table(spark, d, "sources"), table(spark, d, "chunks")), 50, "url")


def _gaps(spark, d):
    """Gaps of the topics of threads: the question is the topic, resolved where its length is even."""
    asked = threads.topics(_threads(spark, d)).select(F.col("topic").alias("question")).distinct()
    none = spark.createDataFrame([], "id long, question string, reason string, logged_at double, resolved boolean")
    return store.log_gaps(none, asked, NOW, "weak-match").withColumn("resolved", F.length("question") % 2 == 0)


def logged_gaps(spark, d):
    return _gaps(spark, d)


def open_gaps(spark, d):
    return upkeep.open_gaps(_gaps(spark, d)).select("id", "question")


def store_status(spark, d):
    return store.status(table(spark, d, "sources"), table(spark, d, "chunks"), table(spark, d, "contradiction_log"), _gaps(spark, d), table(spark, d, "embeddings"))


def shown_sources(spark, d):
    shown = store.shown(table(spark, d, "sources"), table(spark, d, "chunks"))
    ids = F.array_join(F.transform("chunks", lambda c: c["chunk_id"]), ",")
    return shown.select("source_id", "title", "extra", F.size("chunks").alias("n_chunks"), ids.alias("chunk_ids"), F.coalesce(F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + F.coalesce(F.length(c["text"]), F.lit(0))), F.lit(0)).alias("n_chars"))


def appended_contradictions(spark, d):
    """The log with the pairs of ``contradiction_pairs`` appended."""
    log = table(spark, d, "contradiction_log")
    return upkeep.log_contradictions(log, contradiction_pairs(spark, d), NOW).where(F.col("detected_at") == NOW).select("id", "chunk_a", "chunk_b", "note")


def chunk_metadata(spark, d):
    """Chunks with the metadata of their source that a vector carries."""
    return upkeep.reembedded(table(spark, d, "chunks"), table(spark, d, "sources")).select("chunk_id", "source_type", "title", "location", F.array_join("tags", "|").alias("tags"), "text_preview", F.size("embedding").alias("n_dimensions"))


def note_sources(spark, d):
    notes = upkeep.note_sources(table(spark, d, "documents").where("kind = 'note'").select("text"))
    return notes.select("source_id", "title", "location").distinct()


def contacts(spark, d):
    return upkeep.contacts(table(spark, d, "sample_messages_for_triage"))


def outcome_notes(spark, d):
    """Notes of the threads as outcomes: their intent is the summary."""
    rows = _threads(spark, d).select(F.lit("mail").alias("channel"), F.col("id").alias("thread_id"), F.lit("sent").alias("action"), F.col("user_intent").alias("summary"), "participants")
    return upkeep.outcome_notes(rows).select("text", F.array_join("tags", "|").alias("tags"))


def due_profiles(spark, d):
    """Why a profile would be due that was built at each ``received_at`` written as yyyy-mm-ddThh:mm:ssZ."""
    at = table(spark, d, "sample_messages_for_triage").where(F.col("received_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).select("received_at").distinct()
    return at.select("received_at", upkeep.profile_age(F.col("received_at"), NOW).alias("reason"))


def stale_sources(spark, d):
    return store.stale(table(spark, d, "sources"), NOW, 30)


def source_tags(spark, d):
    return store.tagged(table(spark, d, "sources"))


def logged_contradictions(spark, d):
    return store.contradiction_pairs_logged(table(spark, d, "contradiction_log"))


def chunked_documents(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("source_id"), "text")
    return chunking.chunked(rows).select("chunk_id", "source_id", "position", F.length("text").alias("n_chars"))


def embedded_chunks(spark, d):
    own = chunking.embedded(table(spark, d, "chunks").select("chunk_id", "text"))
    return own.select("chunk_id", F.size("embedding").alias("n_dimensions"))


def _queries(vecs):
    return vecs.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _hits(spark, d, k):
    vecs = table(spark, d, "embeddings")
    return vectors.nearest(_queries(vecs), vecs, k)


def _all_hits(spark, d, k):
    vecs = table(spark, d, "embeddings")
    return vectors.nearest(vecs.select(F.col("vec_id").alias("query_id"), "embedding"), vecs, k)


def knn_topk(spark, d):
    return _hits(spark, d, 8)


def knn_filtered(spark, d):
    vecs = table(spark, d, "embeddings")
    return vectors.nearest(_queries(vecs), vecs, 8, same_label=True)


def near_duplicate_vectors(spark, d):
    """Only pairs with an id divisible by 50, as its SQL; ``near_duplicate_vectors_all`` has all."""
    return vectors.near_duplicates(_hits(spark, d, 5), 0.35)


def dropped_vectors(spark, d):
    """Of the pairs of ``near_duplicate_vectors``; ``dropped_vectors_all`` has all."""
    return vectors.dropped(near_duplicate_vectors(spark, d))


def _contradictions(spark, d, hits):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "source")
    return vectors.contradictions(hits, docs, 0.3)


def contradiction_pairs(spark, d):
    """Near vectors whose documents, by vec_id = doc_id, differ in source and in having a negation. Only pairs with an id
    divisible by 50, as its SQL; ``contradiction_pairs_all`` has all."""
    return _contradictions(spark, d, _hits(spark, d, 5))


def near_duplicate_vectors_all(spark, d):
    """Every vector against all others."""
    return vectors.near_duplicates(_all_hits(spark, d, 5), 0.35)


def dropped_vectors_all(spark, d):
    return vectors.dropped(near_duplicate_vectors_all(spark, d))


def contradiction_pairs_all(spark, d):
    """Near vectors, of all, whose documents, by vec_id = doc_id, differ in source and in having a negation."""
    return _contradictions(spark, d, _all_hits(spark, d, 5))


def _library(spark, d):
    """Vectors with the metadata of the document of the same number: its kind is the type, its language and source are tags,
    and ``private`` is a tag where the number is divisible by 7."""
    docs = table(spark, d, "documents")
    tags = F.array_compact(F.array(F.col("lang"), F.col("source"), F.when(F.col("doc_id") % 7 == 0, F.lit("private"))))
    about = docs.select(F.col("doc_id").alias("vec_id"), F.col("kind").alias("source_type"), tags.alias("tags"))
    return table(spark, d, "embeddings").join(about, "vec_id")


def query_filtered(spark, d):
    """Mails in English only, filtered before the ranking."""
    library = _library(spark, d)
    return retrieval.search(_queries(table(spark, d, "embeddings")), library, 8, kind="email", tag="en")


def _answers(spark, d):
    docs, library = table(spark, d, "documents"), _library(spark, d)
    chunks = docs.select(F.col("doc_id").alias("vec_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("source_id"), "text")
    sources = library.select(F.col("vec_id").cast("string").alias("source_id"), F.col("source_type").alias("title"), F.array_join("tags", "/").alias("location"), "tags")
    return retrieval.query(_queries(table(spark, d, "embeddings")), library, chunks, sources, 8)


def answers(spark, d):
    return _answers(spark, d).select("query_id", "top_score", "confidence", "rank", "score", "chunk_id", F.length("text").alias("n_chars"), "title", "location")


def lookup(spark, d):
    """Hits without the private ones, which are taken out after the ranking."""
    return retrieval.lookup(_answers(spark, d)).select("query_id", "confidence", "rank", "score", "title", "location", "source_id")


def deep_gaps(spark, d):
    """Topics of four questions each, by the number of the question, that no hit answers well."""
    rows = _answers(spark, d).withColumn("topic_id", F.floor(F.col("query_id") / 200)).where("chunk_id is null or chunk_id <> cast(query_id as string)")
    return retrieval.deep(rows.withColumn("top_score", F.coalesce("score", F.lit(0.0))), 0.5)[1]


def vectors_within(spark, d):
    """All vectors with a score of 0.3 or more to each query, beyond any number of hits."""
    vecs = table(spark, d, "embeddings")
    return vectors.within(_queries(vecs), vecs, 0.3)


def kept_vectors(spark, d):
    """Ids that are left once ``dropped_vectors`` is applied."""
    return store.without(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), dropped_vectors(spark, d), "id")


def query_confidence(spark, d):
    return vectors.answer_confidence(_hits(spark, d, 8))


def _triaged(spark, d):
    rows = table(spark, d, "sample_messages_for_triage").groupBy("id").agg(F.min(F.struct("channel", "from", "from_id", "subject", "snippet", "received_at", "is_dm", "labels")).alias("m")).select("id", "m.*")
    rows = messages.timed(rows, table(spark, d, "channel_clock"))
    return messages.triage(rows, NOW, messages.TriageConfig(high_senders=("ximena",), low_senders=("bot",)))


def triage_scores(spark, d):
    return _triaged(spark, d).select("id", "score", "category")


def triage_category_counts(spark, d):
    return messages.category_counts(_triaged(spark, d))


def triage_top(spark, d):
    return messages.top_per_category(_triaged(spark, d), 5).select("category", "place", "id", "score")


def draft_preflight(spark, d):
    """All messages to respond to now, and the best three of today."""
    return messages.preflight(_triaged(spark, d)).select("id", "category", "score")


def triage_ranked(spark, d):
    """The twenty best messages; of equal scores the lesser id stands for the earlier arrival."""
    return messages.ranked(_triaged(spark, d), "id").limit(20).select("id", "score")


def _sent_items(spark, d):
    """Events as sent items: sent at ts, answered a day before (event_id % 3 = 0) or a day after (= 1) it, internal for
    event_id % 17 = 0, nudged ten days later for event_id % 5 = 0; now is ten days after the last event."""
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    k = F.col("event_id") % 3
    return e.select(
        "event_id", F.col("at").alias("sent_at"), F.when(k == 0, F.col("at") - 86400).when(k == 1, F.col("at") + 86400).alias("last_inbound_at"),
        (F.col("event_id") % 17 == 0).alias("is_internal"), F.when(F.col("event_id") % 5 == 0, F.col("at") + 864000).alias("already_nudged_at"),
    )


#: Now of the follow-up queries: 2024-01-31.
FOLLOW_UP_NOW = 1_706_659_200.0


def followup_scan(spark, d):
    return messages.follow_ups(_sent_items(spark, d), FOLLOW_UP_NOW).where("reason is null").select("event_id", "score")


def followup_skip_reasons(spark, d):
    return messages.follow_ups(_sent_items(spark, d), FOLLOW_UP_NOW).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n_items"))


def followup_report(spark, d):
    return messages.follow_up_report(_sent_items(spark, d), FOLLOW_UP_NOW, order="event_id")[0].select("event_id", "score", "age_days")


def followup_counts(spark, d):
    return messages.follow_up_report(_sent_items(spark, d), FOLLOW_UP_NOW, order="event_id")[1]


def _windows(spark, d):
    e = table(spark, d, "events").withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    windows = e.where("event_id % 50 = 0").select(F.col("event_id").alias("window_id"), "start", (F.col("start") + 1800).alias("end"))
    # Every hundredth event lasts for days instead of minutes.
    length = F.coalesce("value", F.lit(0.0)) * F.when(F.col("event_id") % 100 == 7, 3600).otherwise(60)
    return windows, e.select("event_id", "start", (F.col("start") + length).alias("end"))


def conflict_counts(spark, d):
    """How many events overlap each half-hour window, the event itself ignored; some events are very long."""
    windows, events = _windows(spark, d)
    own = windows.select("window_id", F.col("window_id").alias("event_id"))
    return messages.conflict_counts(windows, messages.conflicts(windows, events, ignore=own))


def _calendars(spark, d):
    """One calendar file per event: the start in UTC, in a named zone or as a date by event_id modulo 3; an hour long but for dates, which have no end."""
    e = table(spark, d, "events").where("ts is not null")
    at = lambda seconds, form: F.date_format(F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) + seconds), form)
    moment, kind = "yyyyMMdd'T'HHmmss", F.col("event_id") % 3
    times = (
        F.when(kind == 0, F.concat(F.lit("DTSTART:"), at(0, moment), F.lit("Z\r\nDTEND:"), at(3600, moment), F.lit("Z")))
        .when(kind == 1, F.concat(F.lit("DTSTART;TZID=UTC:"), at(0, moment), F.lit("\r\nDTEND;TZID=UTC:"), at(3600, moment)))
        .otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), at(0, "yyyyMMdd")))
    )
    whole = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("event_id")), F.concat(F.lit("SUMMARY:user "), F.col("user_id"), F.lit("\\, fol\r\n ded "), F.coalesce("event_type", F.lit(""))), times, F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
    return readers.calendar_events(e.select(F.concat(F.lit("cal/"), F.col("event_id")).alias("location"), whole.alias("content")))


def parsed_calendars(spark, d):
    return _calendars(spark, d).select("uid", "summary", F.unix_timestamp("start").alias("starts_at"), F.unix_timestamp("end").alias("ends_at"), "all_day", F.size("warnings").alias("n_warnings"))


def calendar_conflicts(spark, d):
    """How many parsed events overlap the hour of every fiftieth event, itself left out by its uid."""
    own = _calendars(spark, d).select(F.col("uid").cast("long").alias("event_id"), F.unix_timestamp("start").cast("double").alias("start"), F.unix_timestamp("end").cast("double").alias("end"))
    windows = own.where("event_id % 50 = 0").select(F.col("event_id").alias("window_id"), "start", (F.col("start") + 3600).alias("end"))
    return messages.conflict_counts(windows, messages.conflicts(windows, own, ignore=windows.select("window_id", F.col("window_id").alias("event_id"))))


def page_texts(spark, d):
    """Documents as fetched pages whose body is their number."""
    page = F.concat(F.lit("<html><head><title> "), F.coalesce("source", F.lit("")), F.lit(" </title><script>x()</script></head><body><nav>menu</nav><p>no. &amp;"), F.col("doc_id"), F.lit("</p><footer>f</footer></body></html>"))
    return readers.fetched_pages(table(spark, d, "documents").select(F.concat(F.lit("http://x/"), F.col("doc_id")).alias("url"), page.alias("html")))


def interval_conflicts(spark, d):
    """Half-hour windows at the events with event_id % 50 = 0 against all other events as [ts, ts + value minutes)."""
    e = table(spark, d, "events").withColumn("start", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    windows = e.where("event_id % 50 = 0").select(F.col("event_id").alias("window_id"), "start", (F.col("start") + 1800).alias("end"))
    events = e.select("event_id", "start", (F.col("start") + F.coalesce("value", F.lit(0.0)) * 60).alias("end"))
    return messages.conflicts(windows, events).where("window_id <> event_id")


def approval_streaks(spark, d):
    """Outcomes per user in order of (ts, event_id): a purchase is an unchanged approval, error and signup end a streak."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'error', 'signup')")
    rows = e.select(F.col("user_id").alias("key"), F.to_date("ts").alias("period"), F.struct("ts", "event_id").alias("seq"), (F.col("event_type") == "purchase").alias("unchanged"))
    return messages.streaks(rows).select(F.col("key").alias("user_id"), F.col("seq.event_id").alias("event_id"), "streak", "eligible")


def _sent(spark, d):
    """Sent messages with each id once, the least row of it."""
    rows = table(spark, d, "sent_messages")
    return rows.groupBy("sent_id").agg(F.min(F.struct("channel", "subject", "body", "to")).alias("m")).select("sent_id", "m.*")


def message_templates(spark, d):
    return messages.template_counts(table(spark, d, "sample_messages_for_triage").select(F.col("snippet").alias("text")))


def pattern_best_match(spark, d):
    counts = checkpointed(messages.template_counts(table(spark, d, "sample_messages_for_triage").select(F.col("snippet").alias("text"))).where("template <> ''"))
    return messages.best_patterns(counts.select(F.col("template").alias("draft")), counts.where("n_messages >= 3").select(F.col("template").alias("pattern")))


def _outcomes(spark, d):
    """Sent messages as outcomes in order of their id: edited where the body's length is divisible by 5, cancelled where it
    is one more, else sent unchanged; the recipient is the first one."""
    n = F.length(F.coalesce("body", F.lit("")))
    result = F.when(n % 5 == 0, "sent_with_edit").when(n % 5 == 1, "cancelled").otherwise("sent_unchanged")
    return _sent(spark, d).select(F.col("sent_id").alias("seq"), n.cast("double").alias("at"), "channel", F.try_element_at("to", F.lit(1)).alias("recipient"), "body", result.alias("result"))


def _pattern_store(spark, d):
    """The store after the messages of the tables: each draft's first 40 code points are its body, so that some recur."""
    rows = _outcomes(spark, d).withColumn("body", F.substring("body", 1, 40))
    return checkpointed(patterns.recorded(rows, patterns.empty_store(spark)))


def pattern_store(spark, d):
    own = _pattern_store(spark, d)
    return own.select("id", "template", F.size("exemplars").alias("n_exemplars"), F.array_join("recipients_seen", "|").alias("recipients"), "channel", "approved_unchanged_count", "approved_with_edit_count", "cancelled_count", "first_seen_at", "last_used_at", "eligible")


def pattern_list(spark, d):
    return patterns.listed(patterns.with_threshold(_pattern_store(spark, d), 2)).select("id", "approved_unchanged_count", "eligible", "preview")


def compared_drafts(spark, d):
    """Drafts with the id divisible by none: all messages against the patterns they made, by equal templates only."""
    rows = _outcomes(spark, d).select(F.col("seq").alias("draft"), F.substring("body", 1, 40).alias("body"), "recipient", "channel")
    return patterns.compared(rows, _pattern_store(spark, d), 1.0).select("draft", "pattern_id", "similarity", "approved_unchanged_count", "recipient_seen", "same_channel")


def _voice_store(spark, d):
    return voice.profiles(_sent(spark, d), "2026-09-20T00:00:00Z")


def voice_store(spark, d):
    return _voice_store(spark, d).select("recipient", "sample_count", "avg_words_per_message", F.array_join("channels", "|").alias("channels"))


def voice_injected(spark, d):
    """The style for the first recipient of each message."""
    drafts = _sent(spark, d).select(F.col("sent_id").alias("draft"), F.try_element_at("to", F.lit(1)).alias("recipient"))
    return voice.injected(drafts, _voice_store(spark, d)).select("draft", "scope", F.col("style.sample_count").alias("sample_count"), "no_em_dash")


def voice_status(spark, d):
    return voice.profile_status(_voice_store(spark, d)).select("sample_count", "n_recipients", F.array_join("channels", "|").alias("channels"), "built_at")


def voice_global(spark, d):
    return voice.profile(voice.features(_sent(spark, d)))


def voice_by_recipient(spark, d):
    return voice.per_recipient(_sent(spark, d))


def voice_greetings(spark, d):
    return voice.top_formulas(voice.features(_sent(spark, d)), "greeting")


def voice_sign_offs(spark, d):
    return voice.top_formulas(voice.features(_sent(spark, d)), "sign_off")


def voice_fillers(spark, d):
    return voice.top_fillers(_sent(spark, d))


def _threads(spark, d):
    """Threads with each id once, in its longest state."""
    rows = table(spark, d, "sample_email_thread")
    return rows.groupBy("id").agg(F.max(F.struct(F.size("messages").alias("n"), "subject", "participants", "messages", "user_intent")).alias("t")).select("id", "t.subject", "t.participants", "t.messages", "t.user_intent")


def rendered_threads(spark, d):
    return threads.rendered(_threads(spark, d)).select("id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def last_messages(spark, d):
    return threads.last_messages(_threads(spark, d), 6)


def draft_topics(spark, d):
    return threads.topics(_threads(spark, d))


def reply_routes(spark, d):
    return threads.routes(_threads(spark, d))


def sensitive_threads(spark, d):
    return threads.sensitive(_threads(spark, d))


def action_items(spark, d):
    return threads.action_items(_threads(spark, d), "noa.verel@")


QUERIES = {
    f.__name__: f
    for f in (
        content_hash_dedup, outdated_hashes, new_chunks, upserted_sources, chunks_after_deletion, sources_after_deletion, source_chunk_counts, listed_sources, store_status,
        shown_sources, stale_sources, source_tags, logged_contradictions, chunked_documents, embedded_chunks, knn_topk, knn_filtered, near_duplicate_vectors, dropped_vectors,
        contradiction_pairs, near_duplicate_vectors_all, dropped_vectors_all, contradiction_pairs_all, query_confidence, triage_scores, triage_category_counts, triage_top, followup_scan, followup_skip_reasons, interval_conflicts, approval_streaks,
        message_templates, pattern_best_match, voice_global, voice_by_recipient, voice_greetings, voice_sign_offs, voice_fillers, rendered_threads, last_messages, draft_topics,
        reply_routes, sensitive_threads, action_items, upsert_results, chunks_after_upsert, ingest_summary, fetched_chunks, newest_chunks, merged_vectors, logged_gaps, open_gaps,
        appended_contradictions, chunk_metadata, note_sources, contacts, outcome_notes, due_profiles, query_filtered, answers, lookup, deep_gaps, vectors_within, kept_vectors, draft_preflight,
        triage_ranked, followup_report, followup_counts, conflict_counts, parsed_calendars, calendar_conflicts, page_texts, pattern_store, pattern_list, compared_drafts, voice_store, voice_injected, voice_status,
    )
}

_HASH = f"substring(sha256(lower(trim(regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g'), ' '))), 1, 32)"
_UNIT = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


def _knn(k: int, condition: str = "true", stored: str = "embeddings") -> str:
    return f"""
    SELECT query_id, vec_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank
      FROM (SELECT q.vec_id AS query_id, v.vec_id, {_UNIT} AS s FROM embeddings q, {stored} v WHERE q.vec_id % 50 = 0 AND {condition})
    ) WHERE rank <= {k}"""


_PAIRS = "SELECT least(query_id, vec_id) AS id_a, greatest(query_id, vec_id) AS id_b, max(score) AS score FROM ({}) WHERE query_id <> vec_id AND score >= {} GROUP BY 1, 2"
_NEGATED = "regexp_matches(lower(coalesce(text, '')), ' not | no | never | false|isn''t|aren''t|don''t|doesn''t|won''t|cannot|can''t')"
_SENT_ITEMS = """
  SELECT event_id, epoch_us(ts) / 1e6 AS sent_at, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) / 1e6 - 86400 WHEN 1 THEN epoch_us(ts) / 1e6 + 86400 END AS last_in,
    event_id % 17 = 0 AS internal, CASE WHEN event_id % 5 = 0 THEN epoch_us(ts) / 1e6 + 864000 END AS nudged FROM events"""
_FOLLOW_UPS = f"""
  SELECT event_id, ({FOLLOW_UP_NOW} - sent_at) / 86400 AS age, CASE WHEN sent_at IS NULL THEN 'no sent_at' WHEN ({FOLLOW_UP_NOW} - sent_at) / 86400 < 5 THEN 'too recent'
    WHEN ({FOLLOW_UP_NOW} - sent_at) / 86400 > 21 THEN 'too old' WHEN internal THEN 'internal' WHEN last_in >= sent_at THEN 'already replied'
    WHEN {FOLLOW_UP_NOW} - nudged < 7 * 86400 THEN 'recently nudged' END AS reason FROM ({_SENT_ITEMS})"""
_ONCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(messages) DESC) AS place FROM sample_email_thread) WHERE place = 1"
_LAST = "coalesce(messages[-1].body, '')"
# All messages of the tables are more than two days older than NOW, and a value denotes an instant if it has a digit above 0.
_TRIAGE = f"""
  SELECT id, raw, CASE WHEN high AND question AND raw < 50 THEN 'respond_today' WHEN raw >= 70 THEN 'respond_now' WHEN raw >= 50 THEN 'respond_today' WHEN raw >= 30 THEN 'read_only' ELSE 'archive' END AS category,
    CAST(greatest(0, least(100, raw)) AS INTEGER) AS score FROM (
    SELECT id, high, question, 30 + CASE WHEN high THEN 25 ELSE 0 END - CASE WHEN contains(sender, 'bot') THEN 20 ELSE 0 END + CASE WHEN is_dm THEN 10 ELSE 0 END
      + CASE WHEN list_has_any(list_transform(coalesce(labels, []), lambda x: lower(coalesce(x, ''))), ['@me', 'blocker', 'urgent']) THEN 15 ELSE 0 END
      + CASE WHEN regexp_matches(subject || chr(10) || snippet, 'urgent|asap|blocker|blocking|by eod|by end of day|today|right now|deadline|as soon as possible') THEN 20 ELSE 0 END
      + CASE WHEN question THEN 10 ELSE 0 END - CASE WHEN regexp_matches(subject, '^\\[no-?reply\\]|newsletter|weekly digest|^automatic reply') THEN 30 ELSE 0 END
      + CASE WHEN hours < 2 THEN 5 WHEN hours > 48 THEN -10 ELSE 0 END AS raw
    FROM (SELECT id, is_dm, labels, sender, contains(sender, 'ximena') AS high, lower(coalesce(subject, '')) AS subject, lower(coalesce(snippet, '')) AS snippet, contains(coalesce(snippet, ''), '?') AS question,
        CASE WHEN regexp_matches(coalesce(received_at, ''), '[1-9]') THEN 999 ELSE 0 END AS hours
      FROM (SELECT *, lower(coalesce(nullif(from_id, ''), "from", '')) AS sender, row_number() OVER (PARTITION BY id ORDER BY labels) AS place FROM sample_messages_for_triage) WHERE place = 1))"""
_CLEAN = "lower(trim({}, ' '))"
_DEAD = f"""
  last_gone AS (SELECT {_CLEAN.format("kind")} AS kind, {_CLEAN.format("key")} AS key, max(deleted_at) AS gone FROM deletion_log GROUP BY 1, 2),
  dead AS (SELECT source_id FROM sources s JOIN last_gone g ON g.kind = 'source' AND g.key = {_CLEAN.format("s.source_id")}
    WHERE s.ingested_at <= g.gone AND g.key IN (SELECT {_CLEAN.format("source_id")} FROM chunks))"""

_any = lambda words: "|".join(w.replace("'", "''") for w in words)
_LINES = r"string_split_regex({}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"
_TEXTS = rf"""
  SELECT sent_id, "to", rtrim(regexp_replace(array_to_string(CASE WHEN ends > 0 THEN lines[1:ends - 1] ELSE lines END, chr(10)), '\s+$', ''), ' ') AS text FROM (
    SELECT sent_id, "to", lines, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(x, '^\s*>') OR (starts_with(lower(trim(x, ' ')), 'on ') AND contains(lower(trim(x, ' ')), ' wrote:'))
      OR regexp_matches(lower(trim(x, ' ')), '^(?:{_any(SIGNATURE_STARTS)})')), true), 0) AS ends
    FROM (SELECT sent_id, "to", {_LINES.format("coalesce(body, '')")} AS lines FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY channel NULLS FIRST, subject NULLS FIRST, body NULLS FIRST, "to" NULLS FIRST) AS place FROM sent_messages) WHERE place = 1))"""
_COUNTED = rf"""
  SELECT sent_id, "to", text, len(regexp_extract_all(lower(text), '[a-z'']+')) AS words, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\x0B\x{{85}}\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: len(regexp_extract_all(lower(x), '[a-z'']+'))), lambda n: n > 0) AS sizes, len(regexp_extract_all(text, '{EMOJI}')) AS emoji,
    len(regexp_extract_all(lower(text), '\b(?:{_any(CONTRACTIONS)})\b')) AS contractions, contains(text, '—') AS em_dash,
    list_filter(list_transform({_LINES.format("text")}, lambda x: trim(x, ' ')), lambda x: x <> '') AS filled FROM ({_TEXTS})"""
_PROFILE = """count(*) AS sample_count, avg(CAST(words AS DOUBLE)) AS avg_words_per_message, sum(list_sum(sizes)) / nullif(sum(len(sizes)), 0) AS avg_words_per_sentence, avg(CAST(emoji AS DOUBLE)) AS emoji_rate,
  sum(contractions) / greatest(sum(words), 1) AS contraction_rate, avg(CASE WHEN len(list_filter(filled, lambda x: regexp_matches(x, '^(?:[-*•] |·|\\d+[.)]\\s)'))) > 0 THEN 1.0::DOUBLE ELSE 0 END) AS bullet_rate,
  avg(CASE WHEN em_dash THEN 1.0::DOUBLE ELSE 0 END) AS em_dash_rate"""
_OPENER = rf"'(?i)^({_any(GREETINGS)})\b[\s,]*([0-9A-Za-z_ \-]*?)[,.!]?$'"
_TOP = "SELECT formula, n, n / t AS share FROM (SELECT formula, count(*) AS n, sum(count(*)) OVER () AS t FROM ({}) WHERE formula IS NOT NULL GROUP BY formula) ORDER BY n DESC, formula LIMIT 5"

_LIBRARY = "(SELECT e.*, d.kind, list_filter([d.lang, d.source, CASE WHEN d.doc_id % 7 = 0 THEN 'private' END], lambda x: x IS NOT NULL) AS tags, d.text FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)"
_ANSWERS = f"""
  WITH h AS ({_knn(8, "true", _LIBRARY)}), t AS (SELECT query_id, greatest(0.0, max(score)) AS top_score FROM h GROUP BY query_id), q AS (SELECT DISTINCT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0)
  SELECT q.query_id, coalesce(t.top_score, 0.0) AS top_score, CASE WHEN coalesce(t.top_score, 0) >= 0.75 THEN 'high' WHEN coalesce(t.top_score, 0) >= 0.55 THEN 'medium' ELSE 'low' END AS confidence, h.rank, h.score,
    CAST(h.vec_id AS VARCHAR) AS chunk_id, CAST(length(coalesce(l.text, '')) AS INTEGER) AS n_chars, coalesce(l.kind, '') AS title, coalesce(array_to_string(l.tags, '/'), '') AS location
  FROM q LEFT JOIN t ON t.query_id = q.query_id LEFT JOIN h ON h.query_id = q.query_id LEFT JOIN {_LIBRARY} l ON l.vec_id = h.vec_id"""
_TOPICS = f"""
  SELECT DISTINCT unnest(list_filter([coalesce(subject, ''), coalesce(user_intent, ''), substring(trim(regexp_replace({_LAST}, '{SPACE}+', ' ', 'g'), ' '), 1, 300)], lambda x: x <> '')) AS question, id,
    list_filter([coalesce(subject, ''), coalesce(user_intent, ''), substring(trim(regexp_replace({_LAST}, '{SPACE}+', ' ', 'g'), ' '), 1, 300)], lambda x: x <> '') AS l FROM ({_ONCE})"""
_GAPS = f"""
  SELECT row_number() OVER (ORDER BY encode(question)) AS id, question, 'weak-match' AS reason, CAST({NOW} AS DOUBLE) AS logged_at, length(question) % 2 = 0 AS resolved
  FROM (SELECT DISTINCT question FROM ({_TOPICS}) WHERE list_position(list_transform(l, lambda y: lower(y)), lower(question)) = list_position(l, question))"""
_CONTRADICTIONS = f"""SELECT id_a, id_b, score FROM ({_PAIRS.format(_knn(5), 0.3)}) p
      JOIN (SELECT doc_id, source AS sa, {_NEGATED} AS na FROM documents) a ON a.doc_id = id_a JOIN (SELECT doc_id, source AS sb, {_NEGATED} AS nb FROM documents) b ON b.doc_id = id_b
      WHERE sa IS DISTINCT FROM sb AND na <> nb"""
_SENT_ONCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY channel NULLS FIRST, subject NULLS FIRST, body NULLS FIRST, \"to\" NULLS FIRST) AS place FROM sent_messages) WHERE place = 1"


def _template(column: str) -> str:
    """The template of a column. RE2's boundaries know ASCII only, so they are written out; each step runs twice, as neighbours share one."""
    word = r"\p{L}\p{M}\p{N}\p{Pc}"
    no, yes, digit, some = f"(^|[^{word}])", f"($|[^{word}])", r"\p{Nd}", r"[^\s\p{Z}\x{85}]"
    steps = (
        (rf"{no}[{word}][{word}.+-]*@[{word}-]+\.[{word}.-]*[{word}]{yes}", "EMAIL"), (f"https?://{some}+", "URL"),
        (f"{no}{digit}{{4}}-{digit}{{2}}-{digit}{{2}}{yes}", "DATE"), (f"{no}{digit}{{1,2}}[/-]{digit}{{1,2}}(?:[/-]{digit}{{2,4}})?{yes}", "DATE"),
        (rf"(?i){no}(?:{digit}{{1,2}}(?::{digit}{{2}})?[\s\p{{Z}}\x{{85}}]?(?:am|pm)|{digit}{{2}}:{digit}{{2}}){yes}", "TIME"), (f"{no}{digit}{{4,}}{yes}", "NUM"),
        (f"(?i){no}(?:mon|tues?|wed(?:nes)?|thur?s?|fri|sat(?:ur)?|sun)(?:day)?{yes}", "DAY"), (f"(?i){no}(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*{yes}", "MONTH"),
    )
    out = f"coalesce({column}, '')"
    for pattern, name in steps:
        for _ in range(1 if name == "URL" else 2):
            out = f"regexp_replace({out}, '{pattern}', '<URL>', 'g')" if name == "URL" else f"regexp_replace({out}, '{pattern}', '\\1<{name}>\\2', 'g')"
    return f"trim(regexp_replace(regexp_replace(lower({out}), '[^{word}\\s\\p{{Z}}\\x{{85}}<>]', ' ', 'g'), '{SPACE}+', ' ', 'g'), ' ')"


_BIGRAMS = "CASE WHEN len(string_split(t, ' ')) = 1 THEN [t || ' '] ELSE list_distinct(list_transform(range(1, len(string_split(t, ' '))), lambda i: string_split(t, ' ')[i] || ' ' || string_split(t, ' ')[i + 1])) END"
_CALENDARS = """
  SELECT event_id, CAST(event_id AS VARCHAR) AS uid, 'user ' || user_id || ', folded ' || coalesce(event_type, '') AS summary, CASE WHEN event_id % 3 = 2 THEN a - a % 86400 ELSE a END AS s,
    CASE WHEN event_id % 3 = 2 THEN a - a % 86400 ELSE a + 3600 END AS t, event_id % 3 = 2 AS all_day FROM (SELECT *, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS a FROM events WHERE ts IS NOT NULL)"""
_OUTCOMES = f"""
  SELECT sent_id AS seq, CAST(length(coalesce(body, '')) AS DOUBLE) AS moment, channel, "to"[1] AS recipient, substring(body, 1, 40) AS body, {_template("substring(body, 1, 40)")} AS template,
    CASE length(coalesce(body, '')) % 5 WHEN 0 THEN 'sent_with_edit' WHEN 1 THEN 'cancelled' ELSE 'sent_unchanged' END AS result FROM ({_SENT_ONCE})"""
_STORE_ALL = f"""
  WITH o AS ({_OUTCOMES}), r AS (SELECT template, max(CASE WHEN result <> 'sent_unchanged' THEN seq END) AS reset FROM o GROUP BY template),
    p AS (SELECT template, list(recipient ORDER BY seq) AS people FROM (SELECT template, recipient, min(seq) AS seq FROM o WHERE coalesce(recipient, '') <> '' GROUP BY 1, 2) GROUP BY template),
    c AS (SELECT o.template, count(*) FILTER (result = 'sent_unchanged' AND (reset IS NULL OR seq > reset)) AS streak, count(*) FILTER (result = 'sent_with_edit') AS edits, count(*) FILTER (result = 'cancelled') AS cancels,
      count(*) FILTER (result = 'sent_unchanged' AND coalesce(body, '') <> '') AS shown, min(struct_pack(q := seq, c := channel, a := moment, b := coalesce(body, ''))) AS f, max(struct_pack(q := seq, a := moment)) AS u FROM o JOIN r ON r.template = o.template GROUP BY o.template)
  SELECT 'p_' || substring(sha256(c.template), 1, 24) AS id, c.template, CAST(least(5, 1 + shown) AS INTEGER) AS n_exemplars, coalesce(array_to_string(people, '|'), '') AS recipients, f.c AS channel, streak AS approved_unchanged_count,
    edits AS approved_with_edit_count, cancels AS cancelled_count, f.a AS first_seen_at, u.a AS last_used_at, streak >= 3 AS eligible, f.b AS first_example FROM c LEFT JOIN p ON p.template = c.template"""
_STORE = f"SELECT * EXCLUDE (first_example) FROM ({_STORE_ALL})"

SQL = {
    "voice_global": f"SELECT {_PROFILE} FROM ({_COUNTED})",
    "voice_by_recipient": f"SELECT recipient, {_PROFILE} FROM (SELECT *, lower(trim(unnest(\"to\"), ' ')) AS recipient FROM ({_COUNTED})) WHERE recipient <> '' GROUP BY recipient HAVING count(*) >= 5",
    "voice_greetings": _TOP.format(f"""SELECT CASE WHEN o = '' THEN NULL WHEN trim(n, ' ') <> '' THEN o || ' <name>' ELSE o END AS formula
      FROM (SELECT lower(regexp_extract(coalesce(filled[1], ''), {_OPENER}, 1)) AS o, regexp_extract(coalesce(filled[1], ''), {_OPENER}, 2) AS n FROM ({_COUNTED}))"""),
    "voice_sign_offs": _TOP.format(f"""SELECT CASE WHEN len(filled) >= 2 THEN list_filter(list_transform(filled[greatest(len(filled) - 2, 1):], lambda x: regexp_replace(lower(x), '[,.!]+$', '')),
      lambda x: x IN ({", ".join(f"'{w}'" for w in SIGN_OFFS)}))[1] END AS formula FROM ({_COUNTED})"""),
    "voice_fillers": f"""SELECT filler, count(*) AS n FROM (SELECT text, unnest([{", ".join(f"'{w}'" for w in FILLERS)}]) AS filler FROM ({_TEXTS}))
      WHERE regexp_matches(lower(text), '\\b' || filler || '\\b') GROUP BY filler ORDER BY n DESC, filler LIMIT 5""",
    "content_hash_dedup": f"SELECT {_HASH} AS content_hash, count(*) AS n_chunks, min(chunk_id) AS first_chunk_id FROM chunks WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "outdated_hashes": f"SELECT chunk_id, content_hash, {_HASH} AS actual_hash FROM chunks WHERE lower(trim(content_hash, ' ')) IS DISTINCT FROM {_HASH}",
    "new_chunks": f"SELECT chunk_id, source_id, position FROM chunks WHERE ingested_at >= {SPLIT} AND {_HASH} NOT IN (SELECT {_HASH} FROM chunks WHERE ingested_at < {SPLIT})",
    "upserted_sources": f"""
      WITH fresh AS (SELECT DISTINCT source_id FROM chunks WHERE ingested_at >= {SPLIT} AND {_HASH} NOT IN (SELECT {_HASH} FROM chunks WHERE ingested_at < {SPLIT})),
        arrived AS (SELECT DISTINCT source_id FROM chunks WHERE ingested_at >= {SPLIT}), stored AS (SELECT * FROM sources WHERE ingested_at < {SPLIT}),
        coming AS (SELECT * FROM sources WHERE source_id IN (SELECT source_id FROM arrived))
      SELECT coalesce(s.source_id, n.source_id) AS source_id, coalesce(s.type, n.type) AS type,
        CASE WHEN n.source_id IS NOT NULL AND (s.source_id IS NULL OR n.source_id IN (SELECT source_id FROM fresh)) THEN coalesce(n.title, '') || ' (new)' ELSE s.title END AS title,
        coalesce(s.location, n.location) AS location, coalesce(s.ingested_at, n.ingested_at) AS ingested_at,
        CASE WHEN n.source_id IS NOT NULL THEN CAST({NOW} AS DOUBLE) ELSE s.last_verified_at END AS last_verified_at,
        array_to_string(CASE WHEN n.source_id IS NOT NULL AND (s.source_id IS NULL OR n.source_id IN (SELECT source_id FROM fresh)) THEN list_append(coalesce(n.tags, []), 'again') ELSE coalesce(s.tags, []) END, '|') AS tags,
        CASE WHEN n.source_id IS NOT NULL AND (s.source_id IS NULL OR n.source_id IN (SELECT source_id FROM fresh)) THEN '{{"again": true}}' ELSE s.extra END AS extra
      FROM stored s FULL OUTER JOIN coming n ON s.source_id = n.source_id""",
    "chunks_after_deletion": f"""WITH {_DEAD} SELECT chunk_id, source_id FROM chunks c
      WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE {_CLEAN.format("d.source_id")} = {_CLEAN.format("c.source_id")})
        AND NOT EXISTS (SELECT 1 FROM last_gone g WHERE g.kind = 'chunk' AND g.key = {_CLEAN.format("c.chunk_id")} AND c.ingested_at <= g.gone)""",
    "sources_after_deletion": f"WITH {_DEAD} SELECT source_id, type FROM sources WHERE source_id NOT IN (SELECT source_id FROM dead)",
    "source_chunk_counts": "SELECT s.source_id, s.type, s.title, s.last_verified_at, count(c.chunk_id) AS n_chunks FROM sources s LEFT JOIN chunks c ON c.source_id = s.source_id GROUP BY 1, 2, 3, 4",
    "listed_sources": """SELECT s.source_id, s.type, s.title, s.last_verified_at, count(c.chunk_id) AS n_chunks FROM sources s LEFT JOIN chunks c ON c.source_id = s.source_id
      WHERE s.type = 'url' GROUP BY 1, 2, 3, 4 ORDER BY s.last_verified_at DESC, s.source_id LIMIT 50""",
    "store_status": f"""SELECT (SELECT count(*) FROM sources) AS n_sources, (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM contradiction_log WHERE resolution IS NULL) AS n_open_contradictions,
      (SELECT count(*) FROM ({_GAPS}) WHERE NOT resolved) AS n_open_gaps, (SELECT count(*) FROM embeddings) AS n_vectors""",
    "shown_sources": """SELECT s.source_id, any_value(s.title) AS title, any_value(s.extra) AS extra, CAST(count(c.chunk_id) AS INTEGER) AS n_chunks,
      coalesce(string_agg(c.chunk_id, ',' ORDER BY c.position, c.chunk_id), '') AS chunk_ids, CAST(coalesce(sum(coalesce(length(c.text), 0)), 0) AS BIGINT) AS n_chars FROM sources s LEFT JOIN chunks c ON c.source_id = s.source_id GROUP BY s.source_id""",
    "upsert_results": f"""WITH a AS (SELECT source_id, count(*) AS n, count(*) FILTER ({_HASH} NOT IN (SELECT {_HASH} FROM chunks WHERE ingested_at < {SPLIT})) AS f FROM chunks WHERE ingested_at >= {SPLIT} GROUP BY source_id)
      SELECT source_id, f AS upserted, n - f AS skipped, CASE WHEN f = 0 THEN 'all chunks are known' END AS note FROM a WHERE source_id IN (SELECT source_id FROM sources)""",
    "ingest_summary": f"""WITH a AS (SELECT source_id, count(*) AS n, count(*) FILTER ({_HASH} NOT IN (SELECT {_HASH} FROM chunks WHERE ingested_at < {SPLIT})) AS f FROM chunks WHERE ingested_at >= {SPLIT} GROUP BY source_id),
      r AS (SELECT * FROM a WHERE source_id IN (SELECT source_id FROM sources))
      SELECT count(*) AS n_sources, CAST(coalesce(sum(f), 0) AS BIGINT) AS n_new, CAST(coalesce(sum(n - f), 0) AS BIGINT) AS n_skipped, coalesce(sum(n - f), 0) > coalesce(sum(n), 0) * 0.05 AS advise_dedup FROM r""",
    "chunks_after_upsert": f"SELECT chunk_id, source_id, position FROM chunks WHERE ingested_at < {SPLIT} OR {_HASH} NOT IN (SELECT {_HASH} FROM chunks WHERE ingested_at < {SPLIT})",
    "fetched_chunks": """SELECT c.chunk_id, c.source_id, s.title, s.location, CAST(length(c.text) AS INTEGER) AS n_chars FROM chunks c JOIN sources s ON s.source_id = c.source_id
      WHERE c.chunk_id IN (SELECT unnest([chunk_a, chunk_b]) FROM contradiction_log WHERE resolution IS NULL)""",
    "newest_chunks": "SELECT chunk_id, ingested_at FROM chunks ORDER BY ingested_at DESC, chunk_id LIMIT 20",
    "merged_vectors": "SELECT vec_id AS chunk_id, CAST(CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS INTEGER) AS label FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0",
    "logged_gaps": _GAPS,
    "open_gaps": f"SELECT id, question FROM ({_GAPS}) WHERE NOT resolved ORDER BY id LIMIT 50",
    "appended_contradictions": f"""WITH p AS (SELECT id_a, id_b FROM ({_CONTRADICTIONS}))
      SELECT (SELECT coalesce(max(id), 0) FROM contradiction_log) + row_number() OVER (ORDER BY CAST(id_a AS VARCHAR), CAST(id_b AS VARCHAR)) AS id, CAST(id_a AS VARCHAR) AS chunk_a, CAST(id_b AS VARCHAR) AS chunk_b, 'negation-asymmetry' AS note FROM p""",
    "chunk_metadata": """SELECT c.chunk_id, coalesce(s.type, '') AS source_type, coalesce(s.title, '') AS title, coalesce(s.location, '') AS location, array_to_string(coalesce(s.tags, []), '|') AS tags,
      substring(c.text, 1, 300) AS text_preview, CAST(64 AS INTEGER) AS n_dimensions FROM chunks c LEFT JOIN sources s ON s.source_id = c.source_id""",
    "note_sources": """WITH n AS (SELECT regexp_replace(text, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g') AS t FROM documents WHERE kind = 'note')
      SELECT DISTINCT 'note:' || substring(sha256(t), 1, 16) AS source_id, replace(substring(t, 1, 60), chr(10), ' ') AS title, 'note://inline' AS location FROM n WHERE t <> ''""",
    "contacts": r"""SELECT address, count(*) AS n_messages FROM (SELECT DISTINCT id, nullif(regexp_extract(lower(coalesce(nullif(trim(from_id, ' '), ''), "from")), '([^\s<>]+@[^\s<>]+)', 1), '') AS address FROM sample_messages_for_triage)
      WHERE address IS NOT NULL GROUP BY address""".replace("\\", "\\"),
    "outcome_notes": f"""SELECT '[comms-outcome] mail thread=' || coalesce(id, '') || ' action=sent: ' || user_intent AS text,
      array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS tags FROM (SELECT *, list_concat(['comms-outcome', 'mail'], list_transform(list_filter(coalesce(participants, []), lambda p: p IS NOT NULL), lambda p: 'with:' || p)) AS l FROM ({_ONCE}))
      WHERE length(trim(coalesce(user_intent, ''), ' ')) > 0""",
    "due_profiles": f"""SELECT received_at, CASE WHEN t IS NULL THEN 'unparseable built_at' WHEN a >= 30 THEN 'age_days=' || CAST(a AS VARCHAR) END AS reason
      FROM (SELECT received_at, t, CAST(floor(({NOW} - epoch(t)) / 86400) AS BIGINT) AS a FROM (SELECT DISTINCT received_at, try_strptime(received_at, '%Y-%m-%dT%H:%M:%SZ') AS t
        FROM sample_messages_for_triage WHERE regexp_full_match(received_at, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z')))""",
    "query_filtered": _knn(8, "v.kind = 'email' AND list_contains(v.tags, 'en')", _LIBRARY),
    "answers": _ANSWERS,
    "lookup": f"SELECT query_id, confidence, rank, score, title, location, CAST(chunk_id AS VARCHAR) AS source_id FROM ({_ANSWERS}) WHERE NOT list_contains(string_split(location, '/'), 'private')",
    "deep_gaps": f"""SELECT topic_id, max(top_score) AS top_score FROM (SELECT CAST(floor(query_id / 200) AS BIGINT) AS topic_id, coalesce(score, 0) AS top_score FROM ({_ANSWERS})
      WHERE chunk_id IS NULL OR chunk_id <> CAST(query_id AS VARCHAR)) GROUP BY topic_id HAVING max(top_score) < 0.5""",
    "vectors_within": f"SELECT query_id, vec_id, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, {_UNIT} AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE round(s, 6) >= 0.3",
    "kept_vectors": f"SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id_b FROM ({_PAIRS.format(_knn(5), 0.35)}))",
    "draft_preflight": f"""SELECT id, category, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS place FROM ({_TRIAGE})) WHERE category = 'respond_now' OR (category = 'respond_today' AND place <= 3)""",
    "triage_ranked": f"SELECT id, score FROM ({_TRIAGE}) ORDER BY score DESC, id LIMIT 20",
    "followup_report": f"SELECT event_id, CAST(trunc(least(100, 40 + (age - 5) * 6)) AS INTEGER) AS score, round(age, 1) AS age_days FROM ({_FOLLOW_UPS}) WHERE reason IS NULL ORDER BY score DESC, age_days DESC, event_id LIMIT 25",
    "followup_counts": f"SELECT count(*) FILTER (reason IS NULL) AS n_stale, count(*) FILTER (reason IS NOT NULL) AS n_skipped FROM ({_FOLLOW_UPS})",
    "conflict_counts": """
      WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + coalesce(value, 0) * CASE WHEN event_id % 100 = 7 THEN 3600 ELSE 60 END AS t FROM events)
      SELECT w.event_id AS window_id, count(e.event_id) AS n_conflicts FROM e w LEFT JOIN e ON e.s < w.s + 1800 AND e.t > w.s AND e.s <= e.t AND e.event_id <> w.event_id WHERE w.event_id % 50 = 0 GROUP BY w.event_id""",
    "parsed_calendars": f"SELECT uid, summary, s AS starts_at, t AS ends_at, all_day, CAST(0 AS INTEGER) AS n_warnings FROM ({_CALENDARS})",
    "calendar_conflicts": f"""WITH e AS ({_CALENDARS}) SELECT w.event_id AS window_id, count(e.event_id) AS n_conflicts
      FROM e w LEFT JOIN e ON e.s < w.s + 3600 AND e.t > w.s AND e.event_id <> w.event_id WHERE w.event_id % 50 = 0 GROUP BY w.event_id""",
    "page_texts": """SELECT 'http://x/' || doc_id AS location, coalesce(nullif(trim(source, ' '), ''), 'http://x/' || doc_id) AS title,
      CASE WHEN coalesce(trim(source, ' '), '') = '' THEN '' ELSE trim(source, ' ') || chr(10) END || 'no. &' || doc_id AS text, CAST(NULL AS VARCHAR) AS error FROM documents""",
    "message_templates": f"SELECT substring(sha256(t), 1, 24) AS fingerprint, t AS template, count(*) AS n_messages FROM (SELECT {_template('snippet')} AS t FROM sample_messages_for_triage) GROUP BY t",
    "pattern_best_match": f"""
      WITH t AS (SELECT t, count(*) AS n FROM (SELECT {_template('snippet')} AS t FROM sample_messages_for_triage) WHERE t <> '' GROUP BY t), b AS (SELECT t, n, {_BIGRAMS} AS b FROM t),
        p AS (SELECT d.t AS draft, p.t AS pattern, CASE WHEN d.t = p.t THEN 1.0 ELSE len(list_intersect(d.b, p.b)) / (len(d.b) + len(p.b) - len(list_intersect(d.b, p.b))) END AS similarity FROM b d JOIN b p ON p.n >= 3)
      SELECT draft, pattern, similarity FROM (SELECT *, row_number() OVER (PARTITION BY draft ORDER BY draft <> pattern, similarity DESC, pattern) AS place FROM p WHERE similarity >= 0.85) WHERE place = 1""",
    "pattern_store": _STORE,
    "pattern_list": f"SELECT id, approved_unchanged_count, approved_unchanged_count >= 2 AS eligible, first_example || '…' AS preview FROM ({_STORE_ALL})",
    "compared_drafts": f"""SELECT o.seq AS draft, s.id AS pattern_id, CAST(1 AS DOUBLE) AS similarity, s.approved_unchanged_count, coalesce(o.recipient, '') = '' OR list_contains(string_split(s.recipients, '|'), o.recipient) AS recipient_seen,
      coalesce(o.channel, '') = '' OR coalesce(s.channel, '') = '' OR o.channel = s.channel AS same_channel FROM ({_OUTCOMES}) o JOIN ({_STORE}) s ON s.template = o.template""",
    "voice_store": f"""SELECT recipient, count(*) AS sample_count, avg(CAST(words AS DOUBLE)) AS avg_words_per_message, array_to_string(list_sort(list_distinct(list(nullif(trim(channel, ' '), '')))), '|') AS channels
        FROM (SELECT c.*, o.channel, lower(trim(unnest(c."to"), ' ')) AS recipient FROM ({_COUNTED}) c JOIN ({_SENT_ONCE}) o ON o.sent_id = c.sent_id) WHERE recipient <> '' GROUP BY recipient HAVING count(*) >= 5
      UNION ALL SELECT NULL, count(*), avg(CAST(words AS DOUBLE)), array_to_string(list_sort(list_distinct(list(nullif(trim(channel, ' '), '')))), '|') FROM (SELECT c.words, o.channel FROM ({_COUNTED}) c JOIN ({_SENT_ONCE}) o ON o.sent_id = c.sent_id)""",
    "voice_injected": f"""WITH k AS (SELECT recipient, count(*) AS n FROM (SELECT lower(trim(unnest("to"), ' ')) AS recipient FROM ({_SENT_ONCE})) WHERE recipient <> '' GROUP BY recipient HAVING count(*) >= 5)
      SELECT sent_id AS draft, CASE WHEN n IS NOT NULL THEN 'recipient' ELSE 'global' END AS scope, coalesce(n, (SELECT count(*) FROM ({_SENT_ONCE}))) AS sample_count, true AS no_em_dash
      FROM (SELECT sent_id, lower(trim("to"[1], ' ')) AS r FROM ({_SENT_ONCE})) LEFT JOIN k ON k.recipient = r""",
    "voice_status": f"""SELECT (SELECT count(*) FROM ({_SENT_ONCE})) AS sample_count, (SELECT count(*) FROM (SELECT recipient FROM (SELECT lower(trim(unnest("to"), ' ')) AS recipient FROM ({_SENT_ONCE})) WHERE recipient <> '' GROUP BY recipient HAVING count(*) >= 5)) AS n_recipients,
      array_to_string(list_sort(list_distinct(list(nullif(trim(channel, ' '), '')))), '|') AS channels, '2026-09-20T00:00:00Z' AS built_at FROM ({_SENT_ONCE})""",
    "stale_sources": f"SELECT source_id, location, last_verified_at FROM sources WHERE type = 'url' AND last_verified_at < {NOW} - 30 * 86400",
    "source_tags": "SELECT tag, count(DISTINCT source_id) AS n_sources FROM (SELECT source_id, lower(trim(unnest(tags), ' ')) AS tag FROM sources) WHERE tag <> '' GROUP BY tag",
    "logged_contradictions": f"""
      SELECT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b, count(*) AS n_times, min(detected_at) AS first_at, (max(struct_pack(t := detected_at, i := id, r := resolution))).r AS resolution
      FROM (SELECT {_CLEAN.format("chunk_a")} AS a, {_CLEAN.format("chunk_b")} AS b, detected_at, id, {_CLEAN.format("resolution")} AS resolution FROM contradiction_log) WHERE a <> '' AND b <> '' GROUP BY 1, 2""",
    "embedded_chunks": "SELECT chunk_id, CAST(64 AS INTEGER) AS n_dimensions FROM chunks",
    "knn_topk": _knn(8),
    "knn_filtered": _knn(8, "q.label = v.label"),
    "near_duplicate_vectors": _PAIRS.format(_knn(5), 0.35),
    "dropped_vectors": f"SELECT id_b AS id, count(*) AS n_pairs FROM ({_PAIRS.format(_knn(5), 0.35)}) GROUP BY id_b",
    "contradiction_pairs": f"""SELECT id_a, id_b, score FROM ({_PAIRS.format(_knn(5), 0.3)}) p
      JOIN (SELECT doc_id, source AS sa, {_NEGATED} AS na FROM documents) a ON a.doc_id = id_a JOIN (SELECT doc_id, source AS sb, {_NEGATED} AS nb FROM documents) b ON b.doc_id = id_b
      WHERE sa IS DISTINCT FROM sb AND na <> nb""",
    "query_confidence": f"""SELECT query_id, top_score, CASE WHEN top_score >= 0.75 THEN 'high' WHEN top_score >= 0.55 THEN 'medium' ELSE 'low' END AS confidence
      FROM (SELECT query_id, greatest(0.0, max(score)) AS top_score FROM ({_knn(8)}) WHERE query_id <> vec_id GROUP BY query_id)""",
    "triage_scores": f"SELECT id, score, category FROM ({_TRIAGE})",
    "triage_category_counts": f"SELECT category, count(*) AS n_messages FROM ({_TRIAGE}) GROUP BY category",
    "triage_top": f"SELECT category, CAST(place AS INTEGER) AS place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id) AS place FROM ({_TRIAGE})) WHERE place <= 5",
    "followup_scan": f"SELECT event_id, CAST(trunc(least(100, 40 + (age - 5) * 6)) AS INTEGER) AS score FROM ({_FOLLOW_UPS}) WHERE reason IS NULL",
    "followup_skip_reasons": f"SELECT reason, count(*) AS n_items FROM ({_FOLLOW_UPS}) WHERE reason IS NOT NULL GROUP BY reason",
    "interval_conflicts": """
      WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + coalesce(value, 0) * 60 AS t FROM events)
      SELECT w.event_id AS window_id, e.event_id FROM e w JOIN e ON e.s < w.s + 1800 AND e.t > w.s WHERE w.event_id % 50 = 0 AND e.s <= e.t AND e.event_id <> w.event_id""",
    "approval_streaks": """
      WITH r AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS ok, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
        FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
      n AS (SELECT user_id, event_id, CAST(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) AS streak FROM r)
      SELECT user_id, event_id, streak, streak >= 3 AS eligible FROM n""",
    "last_messages": f"""SELECT id, CAST(i - 1 AS INTEGER) AS place, messages[i]."from" AS sender
      FROM (SELECT id, messages, unnest(range(greatest(len(messages) - 6, 0) + 1, len(messages) + 1)) AS i FROM ({_ONCE}))""",
    "reply_routes": f"""SELECT id, CASE WHEN len(coalesce(participants, [])) >= 3 AND contains({_LAST}, '?') THEN 'reply_all' ELSE 'reply' END AS route, coalesce(messages[-1]."from", '') AS reply_to FROM ({_ONCE})""",
    "sensitive_threads": f"SELECT id FROM ({_ONCE}) WHERE regexp_matches(lower({_LAST}), 'wire|iban|ssn|social security|credit card|password|api key|secret')",
    "draft_topics": f"""
      WITH t AS (SELECT id, list_filter([coalesce(subject, ''), coalesce(user_intent, ''), substring(trim(regexp_replace({_LAST}, '{SPACE}+', ' ', 'g'), ' '), 1, 300)], lambda x: x <> '') AS l FROM ({_ONCE})),
      u AS (SELECT id, list_filter(l, lambda x, i: NOT list_contains(list_transform(l[1:i - 1], lambda y: lower(y)), lower(x))) AS l FROM t)
      SELECT id, CAST(i - 1 AS INTEGER) AS place, l[i] AS topic FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM u)""",
    "rendered_threads": f"""
      WITH r AS (SELECT id, trim('Subject: ' || coalesce(subject, '') || chr(10) || 'Participants: ' || array_to_string(coalesce(participants, []), ', ') || CASE WHEN len(messages) > 0 THEN chr(10) || array_to_string(list_transform(messages,
        lambda m: 'From: ' || coalesce(m."from", '') || chr(10) || 'Date: ' || coalesce(m.date, '') || chr(10) || coalesce(m.body, '') || chr(10) || '---'), chr(10)) ELSE chr(10) END, ' ') AS text FROM ({_ONCE}))
      SELECT id, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS digest FROM r""",
}
