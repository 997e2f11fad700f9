"""Upkeep of the store, notes and draft context on small fixtures."""

from pyspark.sql import functions as F

from brindle.operators import chunking, store, upkeep, vectors

SOURCE = "source_id string, type string, title string, location string, ingested_at double, last_verified_at double, tags array<string>, extra string"
CHUNK = "chunk_id string, source_id string, text string, content_hash string, position int, ingested_at double"
DAY = 86_400.0


def test_gaps(spark):
    gaps = spark.createDataFrame([(3, "q1", "manual", 1.0, False), (4, "q2", "manual", 2.0, True)], "id long, question string, reason string, logged_at double, resolved boolean")
    more = store.log_gaps(gaps, spark.createDataFrame([("zeta",), ("alpha",)], "question string"), 9.0, "weak-match")
    assert sorted((r.id, r.question) for r in more.collect()) == [(3, "q1"), (4, "q2"), (5, "alpha"), (6, "zeta")]
    done = upkeep.resolve_gaps(more, spark.createDataFrame([(3,), (5,), (99,)], "id long"))
    assert [r.id for r in upkeep.open_gaps(done).collect()] == [6]
    assert store.log_gaps(gaps.limit(0), spark.createDataFrame([("a",)], "question string"), 1.0).collect()[0].id == 1
    weak = upkeep.weak_answers(spark.createDataFrame([(1, "high"), (2, "low")], "query_id int, confidence string"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, question string"))
    assert sorted(r.question for r in weak.collect()) == ["b", "c"]


def test_contradictions(spark):
    log = spark.createDataFrame([(1, "a", "b", None, 1.0, None), (2, "b", "a", None, 2.0, None)], "id long, chunk_a string, chunk_b string, note string, detected_at double, resolution string")
    more = upkeep.log_contradictions(log, spark.createDataFrame([("c", "d", 0.9)], "id_a string, id_b string, score double"), 5.0)
    assert sorted((r.id, r.chunk_a) for r in more.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    resolved, chunks = store.resolve(more, spark.createDataFrame([("a",), ("b",)], "chunk_id string"), "a", "b")
    assert [r.resolution for r in resolved.orderBy("id").collect()] == ["superseded", "superseded", None] and chunks.count() == 1


def test_refresh(spark):
    sources = spark.createDataFrame([("u1", "url", "Old", "http://a", 0.0, 0.0, ["x"], None), ("u2", "url", "New", "http://b", 0.0, 99 * DAY, ["x"], None), ("f", "file", "F", "/f", 0.0, 0.0, [], None)], SOURCE)
    chunks = spark.createDataFrame([("c", "u1", "same text", "", 0, 0.0)], CHUNK)
    pages = spark.createDataFrame([("http://a", "Old 2", "fresh text"), ("http://b", "x", "y"), ("http://c", "x", None)], "location string, title string, text string")
    merged, added = upkeep.refreshed(sources, chunks, pages, 100 * DAY)
    got = {r.source_id: (r.title, r.tags, r.last_verified_at) for r in merged.collect()}
    assert got["u1"] == ("Old 2", [], 100 * DAY) and got["u2"][0] == "New" and got["f"][2] == 0.0
    assert [r.text for r in added.collect()] == ["fresh text"]
    unchanged, none = upkeep.refreshed(sources, chunks, pages.withColumn("text", F.lit(" SAME  text")), 100 * DAY)
    assert none.count() == 0 and {r.source_id: r.title for r in unchanged.collect()}["u1"] == "Old"


def test_reembedding_and_search(spark):
    sources = spark.createDataFrame([("s", "url", "T", "http://a", 0.0, 0.0, ["Private"], None)], SOURCE)
    chunks = spark.createDataFrame([("c1", "s", "alpha beta gamma", "", 0, 0.0), ("c2", "gone", "delta echo", "", 0, 0.0), ("c3", "s", None, "", 0, 0.0)], CHUNK)
    made = {r.chunk_id: r for r in upkeep.reembedded(chunks, sources).collect()}
    assert made["c1"].source_type == "url" and made["c2"].title == "" and made["c2"].tags == [] and not any(made["c3"].embedding)
    vecs = spark.createDataFrame([(i, made[f"c{i}"].embedding) for i in (1, 2)], "vec_id long, embedding array<float>")
    question = spark.createDataFrame([(7, chunking.embed(["alpha beta gamma"])[0].tolist())], "query_id long, embedding array<float>")
    rows = vectors.retrieve(question, vecs, spark.createDataFrame([(1, "c1", "s", "x"), (2, "c2", "gone", "y")], "vec_id long, chunk_id string, source_id string, text string"), sources, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.private, r.title) for r in rows] == [("c1", True, "T"), ("c2", False, "")] and rows[0].score > 0.99
    reports = upkeep.healed(vectors.nearest(question, vecs, 2), spark.createDataFrame([(1, "is not so", "a"), (7, "is", "b")], "id long, text string, source string"), sources, 99 * DAY)
    assert [tuple(r)[:2] for r in reports["dedup"].collect()] == [(1, 7)] and reports["contradictions"].count() == 1 and reports["stale"].count() == 1


def test_notes(spark):
    notes = upkeep.note_sources(spark.createDataFrame([("  one\ntwo " + "x" * 80,), (" ",), (None,)], "text string")).collect()
    assert len(notes) == 1 and len(notes[0].title) == 60 and notes[0].title.startswith("one two") and notes[0].source_id.startswith("note:")
    outcomes = spark.createDataFrame([("gmail", "t1", "sent", "done", ["a@x", "a@x"]), (None, None, None, " ", None), (None, None, None, "x", None)], "channel string, thread_id string, action string, summary string, participants array<string>")
    got = sorted((r.text, r.tags) for r in upkeep.outcome_notes(outcomes).collect())
    assert got == [("[comms-outcome]  thread= action=: x", ["comms-outcome"]), ("[comms-outcome] gmail thread=t1 action=sent: done", ["comms-outcome", "gmail", "with:a@x"])]
    items = spark.createDataFrame([("t", "request", "send it", "user", None)], "id string, kind string, text string, owner string, deadline string")
    assert upkeep.action_notes(items).collect()[0].tags == ["action-item", "kind:request", "owner:user", "thread:t"]
    rows = spark.createDataFrame([("1", "A@x.y", None), ("1", "a@x.y ", None), ("2", None, "Ann <a@x.y>"), ("3", None, None), ("4", "U1", "Ann")], "id string, from_id string, `from` string")
    assert [tuple(r) for r in upkeep.contacts(rows).collect()] == [("a@x.y", 2)]
    ages = spark.createDataFrame([(None,), ("x",), ("1970-01-01T00:00:00",), ("1970-04-10 00:00:00",)], "t string").select(upkeep.profile_age(F.col("t"), 100 * DAY).alias("a")).collect()
    assert [r.a for r in ages] == ["missing", "unparseable built_at", "age_days=100", None]
    assert spark.createDataFrame([(" a, ,b ",), (None,)], "t string").select(upkeep.parsed_tags(F.col("t")).alias("t")).collect() == [(["a", "b"],), ([],)]


def test_draft_context(spark):
    message = "array<struct<`from`: string, date: string, body: string>>"
    mail = spark.createDataFrame([("1", "Plan", ["a", "b", "c"], [("x", None, "What now?")], "plan"), ("2", None, None, [("y", None, "my password is")], None), ("3", "S", [], None, None)], f"id string, subject string, participants array<string>, messages {message}, user_intent string")

    def search(asked):
        return asked.where("topic = 'Plan'").select("query_id", F.lit("c1").alias("chunk_id"), F.lit(0.8).alias("score")).unionByName(asked.select("query_id", F.lit("c2").alias("chunk_id"), F.lit(0.2).alias("score")))

    got = {r.id: (r.route, r.reply_to, r.n_hits, r.best_chunk, r.warnings) for r in upkeep.draft_context(mail, search).collect()}
    assert got == {"1": ("reply_all", "x", 1, "c1", []), "2": ("reply", "y", 0, None, ["sensitive terms in the thread", "no context found"]), "3": ("reply", "", 0, None, ["no context found"])}
