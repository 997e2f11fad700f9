"""The text store and message analytics: hand-made fixtures, brute force and the SQL of every query."""

import glob
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from brindle.functions import text as tx
from brindle.operators import chunking, messages, store, threads, vectors, voice
from brindle.plans import data_queries, store_queries
from brindle.sources import readers
from brindle.sources.warehouse import Warehouse, append_capped

CORE_SQL = {**store_queries.SQL, **data_queries.SQL}


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(small + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(f"SELECT {', '.join(columns)} FROM ({CORE_SQL[name]})")
    assert got == sorted((tuple(map(plain, r)) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(store_queries.QUERIES) - set(store_queries.SQL)))
def test_query_runs(spark, small, name):
    assert entry.queries()[name](spark, small).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(column(F.col("t"))).collect()]


def test_content_hash(spark):
    a, b, c, d, e, f = one(spark, tx.content_hash, "Hello  World\n", " hello world", "HELLO\tWORLD", "hello-world", None, "")
    assert a == b == c != d and len(a) == 32 and e is None and f


def test_templates(spark):
    steps = one(spark, tx.template, "Confirming Tuesday at 3pm", "Confirming Friday at 11am", "Invoice 5/8 due Sat", "Thus the market may decide on 2026-05-08 at 14:30, ref 12345, see https://x.y/z or a.b@c.io!", None, "café!")
    assert steps[0] == steps[1] == "confirming <day> at <time>"
    assert steps[2:] == ["invoice <date> due <day>", "<day> the <month> <month> <month> on <date> at <time> ref <num> see <url> or <email>", "", "café"]
    pairs = [("a b c", "a b d", 1 / 3), ("", "", 1.0), ("a", "", 0.0), ("a", "a", 1.0), ("a", "a b", 0.0)]
    got = spark.createDataFrame(pairs, "a string, b string, e double").select(tx.jaccard(tx.bigrams(F.col("a")), tx.bigrams(F.col("b"))), "e").collect()
    assert all(abs(x - y) < 1e-12 for x, y in got)


def test_best_patterns(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta <num> <day> echo fox".split()
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
    patterns = sorted({make() for _ in range(40)} | {"", "alpha"})
    drafts = sorted({make() for _ in range(40)} | {p + " echo" for p in patterns} | set(patterns[:10]) | {""})
    pairs = lambda s: (lambda t: set(zip(t, t[1:], strict=False)) if len(t) > 1 else {(x, "") for x in t})(s.split())

    def sim(a, b):
        a, b = pairs(a), pairs(b)
        return 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0

    expected = {}
    for d in drafts:
        ranked = sorted((d != p, -sim(d, p), p) for p in patterns if d == p or sim(d, p) >= 0.7)
        if ranked:
            expected[d] = ranked[0][2]
    got = messages.best_patterns(spark.createDataFrame([(d,) for d in drafts], "draft string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), 0.7)
    assert {r.draft: r.pattern for r in got.collect()} == expected


def test_triage(spark):
    now = 1_746_370_000.0
    schema = "id string, from_id string, `from` string, subject string, snippet string, received_at string, is_dm boolean, labels array<string>"
    day = str(now - 86_400)
    rows = [
        ("1", "a", "a", "", "Anything blocking?", day, False, ["@Me"]),
        ("2", "a", "a", None, "blocking, right?", day, True, None),
        ("3", None, "A", "weekly digest", "x", day, False, []),
        ("4", "", "Boss", "weekly digest", "news?", day, False, []),
        ("5", None, None, None, None, None, None, None),
        ("6", "a", "a", "urgent", "?", "0", True, ["urgent", None]),
    ]
    got = {r.id: (r.score, r.category) for r in messages.triage(spark.createDataFrame(rows, schema), now, messages.TriageConfig(high_senders=("BOSS",))).collect()}
    assert got == {"1": (75, "respond_now"), "2": (70, "respond_now"), "3": (0, "archive"), "4": (35, "respond_today"), "5": (35, "read_only"), "6": (90, "respond_now")}


def test_follow_ups(spark):
    now, day = 1_700_000_000.0, 86_400.0
    rows = [("a", now - 5 * day, None, None, None), ("b", now - 8.4 * day, 0.0, False, now - 7 * day), ("c", now - 21 * day, now - 22 * day, False, None), ("d", now - 4.9 * day, None, True, None)]
    rows += [("e", now - 21.1 * day, None, False, None), ("f", now - 10 * day, now - 10 * day, False, None), ("g", 0.0, None, None, None), ("h", None, None, None, None), ("i", now - 9 * day, None, True, None), ("j", now - 9 * day, None, False, now - day)]
    got = {r.id: (r.reason, r.score) for r in messages.follow_ups(spark.createDataFrame(rows, "id string, sent_at double, last_inbound_at double, is_internal boolean, already_nudged_at double"), now).collect()}
    stale = {k: v[1] for k, v in got.items() if v[0] is None}
    assert stale == {"a": 40, "b": 60, "c": 100}
    assert {k: v[0] for k, v in got.items() if v[0]} == {"d": "too recent", "e": "too old", "f": "already replied", "g": "no sent_at", "h": "no sent_at", "i": "internal", "j": "recently nudged"}


def test_conflicts(spark):
    h = 3600.0
    events = [(1, 10 * h, 11 * h), (2, 10.5 * h, 10.5 * h), (3, 10 * h, 10 * h), (4, 9 * h, 30 * h), (5, 12 * h, 11 * h), (6, None, 5.0)]
    windows = [(1, 11 * h, 12 * h), (2, 10 * h, 11 * h), (3, 12 * h, 12 * h)]
    got = messages.conflicts(spark.createDataFrame(windows, "window_id int, start double, `end` double"), spark.createDataFrame(events, "event_id int, start double, `end` double"))
    assert sorted(map(tuple, got.collect())) == [(1, 4), (2, 1), (2, 2), (2, 4)]


def test_streaks(spark):
    rng = random.Random(5)
    rows = [(k, i // 7, i, rng.random() < 0.7) for k in "ab" for i in range(60)] + [("c", 0, 0, True), ("c", 5, 9, True), ("d", 1, 1, False)]
    expected, run = {}, {}
    for k, _, i, ok in rows:
        run[k] = run.get(k, 0) + 1 if ok else 0
        expected[k, i] = (run[k], run[k] >= 3)
    got = messages.streaks(spark.createDataFrame(rows, "key string, period int, seq int, unchanged boolean"))
    assert {(r.key, r.seq): (r.streak, r.eligible) for r in got.collect()} == expected


@pytest.mark.parametrize(
    ("text", "sizes"),
    [("", []), (None, []), ("hi", [2]), ("a" * 1200, [1200]), ("a" * 1201, [1200, 153]), ("\n\n".join(["p" * 600] * 3), [600, 752, 752]), ("x" * 50 + "\n\n" + "y" * 1190, [1242]), (("A" + "b" * 798 + ". ") * 2, [800, 952]), ("a" * 2500 + ". Zed end.", [1200, 1352, 263])],
)
def test_chunks(text, sizes):
    assert [len(c) for c in chunking.chunk(text)] == sizes


def test_chunked_table(spark):
    rows = spark.createDataFrame([("s", "x" * 3000, "k"), ("s", "x" * 3000, "k"), ("n", None, "k"), (None, "hello", "k")], "source_id string, text string, position string")
    got = chunking.chunked(rows)
    assert got.count() == 7 and got.where("source_id = 's'").select("chunk_id").distinct().count() == 3
    assert chunking.chunked(rows.limit(0)).count() == 0
    own = chunking.embedded(spark.createDataFrame([("a", "one two"), ("b", None), ("c", "One  two!")], "id string, text string")).orderBy("id").collect()
    assert own[0].embedding == own[2].embedding and not any(own[1].embedding) and abs(np.linalg.norm(own[0].embedding) - 1) < 1e-6


def test_merge_and_delete(spark):
    schema = "source_id string, type string, title string, location string, ingested_at double, last_verified_at double, tags array<string>, extra string"
    row = lambda s, t, at: (s, "url", t, "l", at, at, [t], None)
    stored = spark.createDataFrame([row("a", "A", 1.0), row("b", "B", 1.0), row("z", "Z", 1.0)], schema)
    coming = spark.createDataFrame([row("a", "A2", 5.0), row("b", "B2", 5.0), row("c", "C2", 5.0), row("d", "D2", 5.0)], schema)
    chunk = "chunk_id string, source_id string, text string, content_hash string, position int, ingested_at double"
    old = spark.createDataFrame([("1", "a", "one", "", 0, 1.0)], chunk)
    new = spark.createDataFrame([("2", "a", "ONE ", "", 0, 5.0), ("3", "b", "two", "", 0, 5.0), ("4", "b", "two", "", 1, 5.0), ("5", "c", None, "", 0, 5.0)], chunk)
    added = store.new_chunks(new, old)
    assert sorted(r.chunk_id for r in added.collect()) == ["3", "4", "5"]
    got = {r.source_id: (r.title, r.ingested_at, r.last_verified_at) for r in store.merge_sources(stored, coming, added, new, 9.0).collect()}
    assert got == {"a": ("A", 1.0, 9.0), "b": ("B2", 1.0, 9.0), "c": ("C2", 5.0, 9.0), "z": ("Z", 1.0, 1.0)}
    gone = spark.createDataFrame([("source", "A ", 2.0), ("source", "z", 2.0), ("chunk", "3", 6.0), ("chunk", "4", 4.0), ("source", None, 1.0)], "kind string, key string, deleted_at double")
    sources, chunks = store.delete_records(stored, old.unionByName(new), gone)
    assert sorted(r.source_id for r in sources.collect()) == ["b", "z"]
    assert sorted(r.chunk_id for r in chunks.collect()) == ["4", "5"]
    assert store.delete_records(stored, old.limit(0), gone.limit(0))[0].count() == 3


def test_vectors(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(80, 8)).astype(np.float32)
    m[7] = m[3]
    m[9] = 0
    rows = [(i, m[i].tolist(), int(i % 3)) for i in range(80)] + [(100, None, 0), (101, [], 0)]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    hits = vectors.nearest(vecs.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label"), vecs, 4)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
    scores = unit.astype(float) @ unit.astype(float).T
    for q in range(0, 80, 5):
        expected = sorted(range(80), key=lambda v: (-round(scores[q, v], 9), v))[:4]
        assert [r.vec_id for r in sorted(hits.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] == expected
    pairs = vectors.near_duplicates(vectors.nearest(vecs.select(F.col("vec_id").alias("query_id"), "embedding"), vecs, 5), 0.95)
    assert [tuple(r)[:2] for r in pairs.collect()] == [(3, 7)]
    assert [r.confidence for r in spark.createDataFrame([(0.75,), (0.7499,), (0.55,), (0.5499,), (None,)], "s double").select(store.confidence(F.col("s")).alias("confidence")).collect()] == ["high", "medium", "medium", "low", "low"]
    assert vectors.nearest(vecs.limit(0).select(F.col("vec_id").alias("query_id"), "embedding"), vecs, 3).count() == 0


def test_near_vectors_of_all_ids(spark, tmp_path):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 8))
    m[1::2] = m[::2] + 0.01 * rng.normal(size=(30, 8))
    spark.createDataFrame([(i + 1, row.tolist(), 0) for i, row in enumerate(m)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    docs = [(i + 1, "this is not so" if i % 2 else "this is so", f"s{i % 2}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    u = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(float)
    cos = u @ u.T
    near = {(i, j) for i in range(60) for j in np.lexsort((np.arange(60), -cos[i]))[:5] if i != j}
    expected = lambda t: {(min(i, j) + 1, max(i, j) + 1) for i, j in near if cos[i, j] >= t}
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert {(r.id_a, r.id_b) for r in run("near_duplicate_vectors_all")} == expected(0.35) >= {(i, i + 1) for i in range(1, 60, 2)}
    assert {r.id for r in run("dropped_vectors_all")} == {b for _, b in expected(0.35)}
    assert {(r.id_a, r.id_b) for r in run("contradiction_pairs_all")} == {(a, b) for a, b in expected(0.3) if (a - b) % 2}


def test_action_items(spark):
    def item(text, user=False):
        rows = spark.createDataFrame([("t", [("noa@x" if user else "ann@x", None, text)])], "id string, messages array<struct<`from`: string, date: string, body: string>>")
        return [(r.kind, r.text, r.owner, r.deadline) for r in threads.action_items(rows, "Noa@").orderBy("place").collect()]

    assert item("Please send the slides by Friday EOD.") == [("request", "send the slides by Friday EOD", "user", "Friday")]
    assert item("I'll review it by next week.") == [("commitment", "review it by next week", "sender", "next week")]
    assert item("I'll review it by next week.", True)[0][2] == "user"
    assert item("No need to answer, could you wait?") == []
    assert item("Anything blocking?") == [("direct_question", "Anything blocking", "user", None)]
    assert item("thanks for that?") == [] and item(None) == [] and item("  ") == []
    assert [k for k, *_ in item("Could you call Ann? Could you call Ann?")] == ["request", "direct_question"]


def test_voice(spark):
    rows = [("1", "Hi Alice,\nIt's fine. Really fine!\n- one\nCheers,\nBob"), ("2", "Hello!\nlol ok\n> quoted 😀\nmore"), ("3", None), ("4", "Hi Alice, thanks for that"), ("5", "text\nOn Monday Ann wrote:\nold — text")]
    got = {r.id: r for r in voice.features(spark.createDataFrame(rows, "id string, body string")).collect()}
    assert (got["1"].greeting, got["1"].sign_off, got["1"].bullets, got["1"].contractions) == ("hi <name>", "cheers", True, 1)
    assert (got["2"].greeting, got["2"].emoji, got["2"].words) == ("hello", 0, 3)
    assert got["3"].words == 0 and got["4"].greeting is None and not got["5"].em_dash
    many = spark.createDataFrame([([" A@x ", "a@X"], "hi there"), (["a@x"], "one two three"), (None, "x")], "`to` array<string>, body string")
    assert [(r.recipient, r.sample_count) for r in voice.per_recipient(many, 3).collect()] == [("a@x", 3)]


def test_pages():
    page = "<html><head><style>x{}</style></head><body><nav>Menu</nav><h1>Title</h1><p>One &amp; <b>two</b></p><script>no()</script><footer>f</footer></body>"
    assert readers.page_text(page) == "Title\nOne &\ntwo" and readers.page_text(None) == ""


def test_calendar(spark):
    ics = (
        "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long na\r\n me\\, here\r\nDTSTART;TZID=America/Los_Angeles:20260508T100000\r\nDTEND:20260508T180000Z\r\nATTENDEE;CN=A:mailto:a@x\r\nATTENDEE:mailto:b@x\r\nEND:VEVENT\r\n"
        "BEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20260508\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:3\r\nDTSTART;TZID=No/Where:20260508T100000\r\nEND:VEVENT\r\nEND:VCALENDAR"
    )
    rows = readers.calendar_events(spark.createDataFrame([("f", ics), ("g", None), ("h", "no calendar")], "location string, content string")).orderBy("place").collect()
    assert [r.uid for r in rows] == ["1", "2", "3"] and rows[0].summary == "Long name, here" and rows[0].attendees == ["a@x", "b@x"]
    assert [r.start.isoformat() for r in rows] == ["2026-05-08T17:00:00", "2026-05-08T00:00:00", "2026-05-08T10:00:00"] and rows[1].all_day
    assert rows[0].warnings == [] and len(rows[2].warnings) == 1


def test_folder_and_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.md").write_bytes(b"caf\xff text")
    (tmp_path / "two.html").write_text("<p>Hi</p>")
    (tmp_path / "three.pdf").write_bytes(b"broken")
    (tmp_path / "skip.json").write_text("[]")
    rows = {r.title: r for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"one", "two", "three"} and rows["two"].text == "Hi" and rows["three"].error and rows["three"].text is None
    (tmp_path / "s.json").write_text('[{"to": "a@x", "body": "x"}, {"to": ["b@x", "c@x"]}, {"body": "y"}]')
    assert sorted(len(r.to) for r in readers.read_sent_messages(spark, str(tmp_path / "s.json")).collect()) == [0, 1, 2]
    assert readers.read_json(spark, str(tmp_path / "skip.json"), "message").count() == 0


def test_warehouse(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        w.read("t")
    for i in range(3):
        w.write("t", spark.range(i + 1) if not i else w.read("t").unionByName(spark.range(1)))
    os.makedirs(tmp_path / "t/9")  # a version that never was finished
    assert w.read("t").count() == 3 and w.versions("t") == [1, 2, 3]
    w.prune("t", 1)
    assert w.versions("t") == [3]
    assert append_capped(spark.createDataFrame([(i, "e") for i in range(5)], "`at` int, event string"), spark.createDataFrame([(9, "x", 1)], "`at` int, event string, n int"), 3).count() == 3


def test_streams(spark, tmp_path):
    from brindle.streaming import jobs

    spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 5, True)], "key string, seq long, unchanged boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("key string, seq long, unchanged boolean").parquet(str(tmp_path / "in"))
    query = jobs.streak_stream(feed).writeStream.format("memory").queryName("streaks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.key, r.seq, r.streak) for r in spark.table("streaks").collect()) == [("a", 1, 1), ("a", 2, 2), ("a", 3, 0), ("a", 4, 1), ("b", 5, 1)]
    schema = "id string, text string, ingested timestamp"
    spark.createDataFrame([("1", "One"), ("2", "one "), ("3", "two")], "id string, text string").withColumn("ingested", F.timestamp_seconds(F.lit(1_700_000_000))).coalesce(1).write.parquet(str(tmp_path / "texts"))
    query = jobs.first_texts(spark.readStream.schema(schema).parquet(str(tmp_path / "texts"))).writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("texts").count() == 2


def test_core_never_imports_llm():
    root = os.path.dirname(entry.__file__)
    for path in glob.glob(root + "/brindle/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"^\s*(?:from|import) brindle\.llm", open(path, encoding="utf-8").read(), re.M), path
