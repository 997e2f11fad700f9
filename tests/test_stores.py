"""The pattern and voice stores, retrieval, stored state, and operators at scales that one task or bucket must not hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle import session
from brindle.operators import messages, patterns, retrieval, state, store, upkeep, vectors, voice
from brindle.sources import readers

OUTCOME = "seq int, at double, channel string, recipient string, body string, result string"


def one(df):
    return {r.id: r for r in df.collect()}


def test_streaks_of_patterns(spark):
    """unchanged, unchanged, edit, unchanged x 3: eligible only at the end."""
    results = ["sent_unchanged", "sent_unchanged", "sent_with_edit", "sent_unchanged", "sent_unchanged", "sent_unchanged"]
    counts = []
    known = patterns.empty_store(spark)
    for i, r in enumerate(results):
        known = session.checkpointed(patterns.recorded(spark.createDataFrame([(i, float(i), "mail", f"p{i % 2}@x", "Confirming Tuesday at 3pm", r)], OUTCOME), known))
        row = known.collect()[0]
        counts.append((row.approved_unchanged_count, row.eligible))
    assert counts == [(1, False), (2, False), (0, False), (1, False), (2, False), (3, True)]
    assert (row.approved_with_edit_count, row.cancelled_count, row.recipients_seen, row.first_seen_at, row.last_used_at) == (1, 0, ["p0@x", "p1@x"], 0.0, 5.0)
    assert row.exemplars == ["Confirming Tuesday at 3pm"] * 5
    batch = patterns.recorded(spark.createDataFrame([(i, float(i), "mail", f"p{i % 2}@x", "Confirming Friday at 11am", r) for i, r in enumerate(results)], OUTCOME), patterns.empty_store(spark)).collect()[0]
    assert batch.template == row.template and [batch[c] for c in ("approved_unchanged_count", "approved_with_edit_count", "recipients_seen", "eligible")] == [3, 1, ["p0@x", "p1@x"], True]


def test_patterns_match_report_and_reset(spark):
    body = "please find the weekly numbers of the harbour office in the folder that we share"
    rows = [(1, 1.0, "mail", "a@x", body, "sent_unchanged"), (2, 2.0, None, None, None, "cancelled"), (3, 3.0, "mail", "", "", "nonsense"), (4, 4.0, "chat", "b@x", "an unlike text", "sent_unchanged")]
    known = session.checkpointed(patterns.recorded(spark.createDataFrame(rows, OUTCOME), patterns.empty_store(spark)))
    assert known.count() == 3
    pattern = known.where("channel = 'mail'").collect()[0]
    drafts = spark.createDataFrame([("d1", body + " again", "a@x", "mail"), ("d2", body, "c@x", "chat"), ("d3", "nothing like it", None, None), ("d4", body, None, "")], "draft string, body string, recipient string, channel string")
    got = {r.draft: r for r in patterns.compared(drafts, known).collect()}
    assert got["d1"].pattern_id == pattern.id and 0.85 <= got["d1"].similarity < 1 and got["d1"].recipient_seen and got["d1"].same_channel
    assert (got["d2"].similarity, got["d2"].recipient_seen, got["d2"].same_channel) == (1.0, False, False)
    assert (got["d3"].pattern_id, got["d3"].similarity, got["d3"].approved_unchanged_count) == (None, 0.0, 0) and got["d4"].recipient_seen and got["d4"].same_channel
    assert one(patterns.with_threshold(known, 1))[pattern.id].eligible and not one(patterns.reset(known, pattern.id, 1))[pattern.id].eligible
    assert one(patterns.listed(known))[pattern.id].preview == body + "…"
    with pytest.raises(KeyError):
        patterns.reset(known, "p_none")
    with pytest.raises(ValueError, match="threshold"):
        patterns.with_threshold(known, 0)
    assert patterns.recorded(spark.createDataFrame([], OUTCOME), known).count() == 3 and patterns.compared(drafts.limit(0), known).count() == 0


def test_voice_store(spark):
    sent = spark.createDataFrame([(f"s{i}", ["A@x ", "b@x"][: 1 + (i < 2)], ["gmail", " ", None, "slack"][i % 4], f"Hi Ann,\nword {i}") for i in range(6)], "sent_id string, `to` array<string>, channel string, body string")
    known = voice.profiles(sent, "2026-01-01T00:00:00Z")
    assert sorted((r.recipient or "", r.sample_count, r.channels) for r in known.collect()) == [("", 6, ["gmail", "slack"]), ("a@x", 6, ["gmail", "slack"])]
    drafts = spark.createDataFrame([("d1", " a@X"), ("d2", "b@x"), ("d3", None)], "draft string, recipient string")
    assert {r.draft: r.scope for r in voice.injected(drafts, known).collect()} == {"d1": "recipient", "d2": "global", "d3": "global"}
    assert {r.scope for r in voice.injected(drafts, known.limit(0)).collect()} == {"none"}
    assert tuple(voice.profile_status(known).collect()[0]) == (6, 1, ["gmail", "slack"], "2026-01-01T00:00:00Z")


def test_retrieval(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0], "note", ["a"]), (2, [0.9, 0.1], "note", ["a", "private"]), (3, [0.0, 1.0], "file", None), (4, [0.8, 0.2], "note", [])], "vec_id long, embedding array<float>, source_type string, tags array<string>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, None)], "query_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.search(asked, vecs, 2, kind="note", tag="a").orderBy("rank").collect()] == [1, 2]
    assert retrieval.search(asked, vecs, 2, kind="none").count() == 0
    chunks = spark.createDataFrame([(1, "c1", "s1", "one"), (2, "c2", "s2", "two"), (3, "c3", None, None)], "vec_id long, chunk_id string, source_id string, text string")
    sources = spark.createDataFrame([("s1", "T1", "L1", ["x"]), ("s2", "T2", None, ["private"])], "source_id string, title string, location string, tags array<string>")
    answers = retrieval.query(asked, vecs, chunks, sources, 3)
    assert [(r.query_id, r["rank"], r.chunk_id, r.title, r.confidence) for r in answers.orderBy("query_id", "rank").collect()] == [(10, 1, "c1", "T1", "high"), (10, 2, "c2", "T2", "high"), (10, 3, None, "", "high"), (11, None, None, "", "low")]
    assert [r["rank"] for r in retrieval.lookup(answers).where("query_id = 10").orderBy("rank").collect()] == [1, 3]
    hits, gaps = retrieval.deep(answers.withColumn("topic_id", F.col("query_id")))
    assert sorted((r.topic_id, r.source_id) for r in hits.collect()) == [(10, ""), (10, "s1"), (10, "s2")] and [r.topic_id for r in gaps.collect()] == [11]
    assert retrieval.embedded_questions(spark.createDataFrame([(1, "a b"), (2, None)], "query_id long, question string")).count() == 2


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    asked = df.withColumnRenamed("vec_id", "query_id")
    run = lambda: [sorted(map(tuple, x.collect())) for x in (vectors.nearest(asked, df, 4), vectors.nearest(asked, df, 4, same_label=True), vectors.within(asked, df, 0.5))]
    whole = run()
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 20)
    monkeypatch.setattr(vectors, "VECTORS_AT_ONCE", 7)
    assert run() == whole and len(whole[0]) == 360
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert {(q, v) for q, v, _ in whole[2]} == {(i, j) for i, j in zip(*np.nonzero(m @ m.T >= 0.5), strict=True)}
    assert vectors.nearest(asked.limit(0), df, 4).count() == 0 and vectors.within(asked, df.limit(0), 0.5).count() == 0


def test_conflicts_of_intervals_of_all_lengths(spark):
    """Against all pairs; an interval of centuries takes a handful of rows."""
    rng = random.Random(6)
    span = lambda: rng.choice([0, 60, 3600, 86_400, 5_000_000, 9_000_000_000])
    make = lambda n: [(i, s, s + span() * rng.random()) for i in range(n) for s in [rng.random() * 1e7]]
    w, e = make(80) + [(900, 5.0, 1.0), (901, None, 3.0)], make(150) + [(901, 10.0, 10.0), (902, 10.0, 5.0), (903, None, None)]
    windows, events = spark.createDataFrame(w, "window_id long, start double, end double"), spark.createDataFrame(e, "event_id long, start double, end double")
    got = [tuple(r) for r in messages.conflicts(windows, events).collect()]
    pairs = {(i, j) for i, a, b in w for j, c, d in e if None not in (a, b, c, d) and a < b and c <= d and c < b and d > a}
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 1000
    ignore = spark.createDataFrame([(i, j) for i, j in pairs if i == j] or [(1, 1)], "window_id long, event_id long")
    left = messages.conflicts(windows, events, ignore=ignore)
    assert {tuple(r) for r in left.collect()} == {p for p in pairs if p[0] != p[1]}
    counts = {r.window_id: r.n_conflicts for r in messages.conflict_counts(windows, left).collect()}
    assert counts[900] == 0 and sum(counts.values()) == sum(1 for p in pairs if p[0] != p[1])
    assert messages.conflicts(windows.limit(0), events).count() == 0 and messages.conflicts(windows, events.limit(0)).count() == 0


def test_numbered_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.place == r.k + 1 for r in session.numbered(rows, ["k"]).collect()) and session.numbered(rows.limit(0), ["k"]).count() == 0


def test_state(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"threshold": 5}')
    (tmp_path / "bad.json").write_text("{")
    assert state.load_document(spark, str(tmp_path / "good.json")) == {"threshold": 5}
    assert state.load_document(spark, str(tmp_path / "bad.json"), {}) == {} == state.load_document(spark, str(tmp_path / "none.json"), {})
    assert state.merged_settings(state.PATTERN_SETTINGS, {"threshold": 5, "x": 1}, None, ["no"]) == {"enabled": False, "threshold": 5, "min_similarity": 0.85, "x": 1}
    log = spark.createDataFrame([], "at double, event string, payload string")
    settings, log = state.changed_settings(spark.createDataFrame([("enabled", "false")], "key string, value string"), log, "enabled", True, 1.0)
    assert settings.collect()[0].value == "true"
    log = state.logged(log, spark.createDataFrame([(2.0, "record", "p1", 3), (3.0, "check", None, None)], "at double, event string, pattern string, n int"), cap=2)
    assert [(r.event, r.payload) for r in state.last_entries(log).collect()] == [("record", '{"pattern":"p1","n":3}'), ("check", "{}")]
    rows = spark.createDataFrame([(["a", "b"], '{"k": 1}', 1), (None, "{", 2)], "tags array<string>, extra string, _internal int")
    back = rows.select(state.decoded_tags(state.encoded(F.col("tags"))).alias("t"), state.decoded_object(F.col("extra")).alias("e")).collect()
    assert [(r.t, r.e) for r in back] == [(["a", "b"], {"k": "1"}), ([], {})]
    assert [r.json for r in state.as_json(rows.drop("tags")).collect()] == ['{"extra":"{\\"k\\": 1}"}', '{"extra":"{"}']


def test_reports_of_follow_ups_and_sweeps(spark):
    day = 86_400.0
    sent = spark.createDataFrame([(i, 100 * day - a * day, None, False, None) for i, a in enumerate([5, 8.4, 10, 21, 4.9, 21.1, 10])], "ordinal int, sent_at double, last_inbound_at double, is_internal boolean, already_nudged_at double")
    report, counts = messages.follow_up_report(sent, 100 * day, top=4)
    assert [(r.ordinal, r.score) for r in report.collect()] == [(3, 100), (2, 70), (6, 70), (1, 60)] and tuple(counts.collect()[0]) == (5, 2)
    scored = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate([("respond_now", 80), ("respond_today", 50), ("respond_today", 60), ("respond_today", 55), ("respond_today", 52), ("archive", 0)])], "id int, category string, score int")
    assert sorted(r.id for r in messages.preflight(scored).collect()) == [0, 2, 3, 4] and [r.id for r in messages.ranked(scored, "id").limit(2).collect()] == [0, 2]


def test_triage_of_mixed_times(spark):
    clock = spark.createDataFrame([("gmail", "America/New_York", "mdy")], "channel string, zone string, date_order string")
    base = "id string, channel string, `from` string, from_id string, subject string, snippet string, received_at string, is_dm boolean, labels array<string>"
    now = 1_772_380_800.0
    rows = spark.createDataFrame([(k, "gmail", None, None, None, None, v, None, None) for k, v in [("new", "2026-03-01 10:30"), ("old", "02/20/2026 10:00"), ("day", "1772300000000"), ("none", "pending"), ("null", None)]], base)
    assert {r.id: r.score for r in messages.triage(messages.timed(rows, clock), now).collect()} == {"new": 35, "old": 20, "day": 30, "none": 35, "null": 35}


def test_upsert_and_show(spark):
    source = "source_id string, type string, title string, location string, ingested_at double, last_verified_at double, tags array<string>, extra string"
    chunk = "chunk_id string, source_id string, text string, content_hash string, position int, ingested_at double"
    stored = spark.createDataFrame([("s", "note", "T", "L", 1.0, 1.0, ["a"], "{}")], source)
    chunks = spark.createDataFrame([("c1", "s", "One", "", 0, 1.0), ("c0", "s", "Two", "", 0, 1.0)], chunk)
    incoming = spark.createDataFrame([("s", "file", "T2", "L2", 9.0, 9.0, [], None), ("e", "note", "E", "", 9.0, 9.0, [], None), ("n", "note", "N", "", 9.0, 9.0, [], None)], source)
    arrived = spark.createDataFrame([("c2", "s", " one", "", 0, 9.0), ("c3", "n", "fresh", "", 0, 9.0), ("c4", "n", "two", "", 1, 9.0)], chunk)
    sources, after, result = store.upsert(stored, chunks, incoming, arrived, 9.0)
    assert {r.source_id: (r.title, r.last_verified_at) for r in sources.collect()} == {"s": ("T", 9.0), "n": ("N", 9.0)}
    assert {r.source_id: (r.upserted, r.skipped, r.note is not None) for r in result.collect()} == {"s": (0, 1, True), "n": (1, 1, False)}
    assert sorted(r.chunk_id for r in after.collect()) == ["c0", "c1", "c3"] and tuple(store.ingest_summary(result).collect()[0]) == (2, 1, 2, True)
    shown = {r.source_id: [c.chunk_id for c in r.chunks] for r in store.shown(sources, after).collect()}
    assert shown == {"s": ["c0", "c1"], "n": ["c3"]}
    with pytest.raises(KeyError):
        store.resolve(spark.createDataFrame([], "chunk_a string, chunk_b string, resolution string"), chunks, "c1", "gone")
    merged = store.merge_vectors(spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int"), spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "chunk_id string, v int"))
    assert sorted(map(tuple, merged.collect())) == [("a", 1), ("b", 4), ("c", 5)]


def test_calendars_of_any_size_and_zone(spark):
    event = lambda i, zone: f"BEGIN:VEVENT\nUID:u{i}\nDTSTART;TZID={zone}:20260508T100000\nEND:VEVENT\n"
    files = spark.createDataFrame([("f", event(0, "America/Los_Angeles") + event(1, "America/Nowhere") + event(2, "Not a zone")), ("g", "BEGIN:VCALENDAR"), ("h", None)], "location string, content string")
    got = readers.calendar_events(files)
    assert [(r.uid, r.start.hour, len(r.warnings)) for r in got.orderBy("place").collect()] == [("u0", 17, 0), ("u1", 10, 1), ("u2", 10, 1)]
    assert [(r.location, r.uid, r.extra_events) for r in readers.first_event(got).collect()] == [("f", "u0", 2)]
    pages = readers.fetched_pages(spark.createDataFrame([("http://a", "<title> T </title><p>x</p>"), ("http://b", None), ("http://c", "<p>y</p>")], "url string, html string"))
    assert [(r.title, r.text, r.error) for r in pages.orderBy("location").collect()][1:] == [("http://b", None, "not fetched"), ("http://c", "y", None)]


def test_logs_go_on(spark):
    log = spark.createDataFrame([(7, "a", "b", None, 1.0, None)], "id long, chunk_a string, chunk_b string, note string, detected_at double, resolution string")
    many = spark.range(300).select(F.format_string("%04d", "id").alias("id_a"), F.lit("z").alias("id_b"))
    assert sorted(r.id for r in upkeep.log_contradictions(log, many, 2.0).collect()) == list(range(7, 308))
