"""The text operators against brute force, exact round trips, held-out accuracy and hard cases."""

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import boilerplate, conversations, encoding, leakage, near_duplicates, personal, queries, quoting, subjects

CLOCK = "channel string, zone string, date_order string, owner_id string, owner_name string"
CLOCKS = [("gmail", "America/New_York", "mdy", "noa@x.example", "Noa Verel"), ("slack", "UTC", "mdy", "U0", "Noa Verel")]
MESSAGES = "id string, channel string, `from` string, from_id string, received_at string, snippet string, thread_id string"
WORDS = "alpha beta gamma delta echo fox golf hotel india juliet kilo lima mike nova oscar papa".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert df.count() >= 0 and "void" not in dict(df.dtypes).values()


# --- conversations


def brute_turns(rows):
    threads, seen = {}, {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r[1:])):
        seen.setdefault(r[0], r)
    for key, channel, sender, sender_id, at, snippet, thread in seen.values():
        t = (thread or "").strip().lower()
        if t and snippet and re.search(r"[^\s​ ]", snippet):
            threads.setdefault(t, []).append((None if at in (None, "pending") else int(at), key, "user" if sender_id == "U0" or (not (sender_id or "").strip() and sender in ("Noa Verel", "verel, noa")) else "contact", bool((sender or "").strip() or (sender_id or "").strip())))
    out = set()
    for t, turns in threads.items():
        if all(a is not None and ok for a, _, _, ok in turns) and {x[2] for x in turns} == {"user", "contact"}:
            out |= {(t, i, k, role) for i, (_, k, role, _) in enumerate(sorted(turns), 1)}
    return out


def test_conversations(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        thread = "T0" if i % 3 == 0 else rng.choice([None, " ", *(f"t{rng.randrange(40)}" for _ in range(8)), f" T{rng.randrange(40)}"])
        who = rng.choice([("Noa Verel", "U0"), ("verel, noa", None), ("Ann Lee", "U1"), ("Ann Lee", " "), (None, "U2")] * 12 + [(None, None)] * (i % 3 > 0))
        rows.append((f"m{i}", "slack", *who, rng.choice([str(1_700_000_000 + rng.randrange(50))] * 60 + [None, "pending"][: 2 * (i % 3 > 0)]), rng.choice(["hi", "ok ​", "x"] * 5 + [None, "", " ​ "]), thread))
    rows += rows[:40]
    df = spark.createDataFrame(rows, MESSAGES).selectExpr("*", "1 AS turn", "'x' AS event", "'y' AS part")
    got = conversations.turns(df, spark.createDataFrame(CLOCKS, CLOCK))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_turns(rows) and len(found) > 150
    assert conversations.turns(df.limit(0), spark.createDataFrame(CLOCKS, CLOCK)).count() == 0
    assert conversations.turns(df, spark.createDataFrame([], CLOCK)).count() == 0


def test_automaton_over_slices():
    """Maps of slices, however they are cut, lead to the state that reading event by event leads to."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        events = rng.choice(4, size=rng.integers(1, 30), p=[0.4, 0.4, 0.17, 0.03])
        cuts = np.sort(rng.choice(len(events), size=min(len(events), 3), replace=False))
        place = np.arange(len(events)) - np.maximum.accumulate(np.where(np.isin(np.arange(len(events)), [0, *cuts]), np.arange(len(events)), 0))
        maps = conversations.composed(conversations.STEP[events], place)
        state, ends = conversations.SILENT, [*(c - 1 for c in cuts if c), len(events) - 1]
        for e in sorted(set(ends)):
            state = maps[e][state]
        plain = conversations.SILENT
        for e in events:
            plain = conversations.STEP[e][plain]
        assert state == plain
        told = set(events.tolist())
        assert (plain == conversations.ANSWERED) == ({0, 1} <= told and 3 not in told)


def test_long_conversations_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_conversations(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- encoding


def test_encoding_against_libraries(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(encoding.VOCABULARIES + "/byte_bpe_50k.json")
    own.encode_special_tokens = True
    rng = random.Random(2)
    texts = [None, "", " ", "a b", "aaa aaaa aaaaaaa", "  x  y ", "it's <|endoftext|> ok", "é́ \U0001f642\U0001f643 ", "\r\n \n\n z\t\t w", "  x y　z", "x" * 50_000, "\0 a \0", "DK-95819 and 12345678901"]
    texts += ["".join(rng.choice("ab  \n\r\t'é.1 ​") for _ in range(rng.randrange(60))) for _ in range(400)] + ["repeat me"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS ids")
    got = {r.doc_id: r.ids for r in encoding.encode(rows).collect()}
    assert got == {i: own.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    assert encoding.encode(rows.limit(0)).count() == 0
    ranks = encoding.load_ranks(encoding.VOCABULARIES + "/byte_bpe_50k.tiktoken")
    tokens = {r: t for t, r in ranks.items()}
    assert all(b"".join(tokens[i] for i in got[k]).decode() == (t or "") for k, t in enumerate(texts))


def test_encoding_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"word{i} " * 50) for i in range(20)], "doc_id long, text string")
    whole = encoding.encode(rows).collect()
    encoder = encoding.CorpusEncoder(encoding.load_ranks(encoding.VOCABULARIES + "/byte_bpe_50k.tiktoken"))
    for r, t in zip(whole, rows.collect(), strict=True):
        assert encoder.encode([t.text])[0].tolist() == r.ids


# --- near duplicates


def jaccard(a, b, size):
    grams = lambda t: {tuple(w[i : i + size]) for w in [[x.lower() for x in re.findall(r"[^\W_]+", t or "")]] for i in range(len(w) - size + 1)}
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.6), (5, 0.8)])
def test_near_duplicates(spark, size, threshold):
    rng = random.Random(size)
    texts = []
    for _ in range(30):
        base = " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(3, 120)))
        texts += [base] + [edited(rng, base, rng.randrange(4)) for _ in range(rng.randrange(5))]
    hot = " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(60))
    texts += [edited(rng, hot, 1) for _ in range(len(texts) // 2)] + [hot] * 5
    texts += [None, "", "one", "one two", "Éa b c d e f g", "éA, b. C d-e f g!", "w " * 3000, "w " * 3000]
    rows = spark.createDataFrame([(f"i{k:03d}", t) for k, t in enumerate(texts)] + [("i000", texts[0])], "id string, text string").selectExpr("*", "'x' AS key", "1 AS block")
    expected = {(f"i{i:03d}", f"i{j:03d}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j], size) >= threshold - 1e-12}
    got = [tuple(r) for r in near_duplicates.similar_pairs(rows, size, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 100
    groups = {r.id: (r.group_id, r.n_links) for r in near_duplicates.similar_groups(rows, size, threshold).collect()}
    parent = {k: k for k in groups}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    same = {}
    for k, t in enumerate(texts):
        same.setdefault(t, []).append(f"i{k:03d}")
    copies = {(a, b) for t, ids in same.items() if t is not None for a, b in zip(ids, ids[1:], strict=False)}
    for a, b in sorted(expected | copies):
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    assert {k: root(k) for k in groups} == {k: g for k, (g, _) in groups.items()}
    assert near_duplicates.similar_pairs(rows.limit(0), size, threshold).count() == 0


def test_near_duplicate_steps(monkeypatch):
    """Columns that are walked in steps or cut into strips give the same pairs."""
    base = " ".join(f"w{i}" for i in range(40))
    texts = [edited(random.Random(i), base, 1) for i in range(60)]
    scale = np.full(1 << near_duplicates.COUNT_BITS, round(8 * np.log2(61)), np.uint8)

    def pairs():
        batches = [b for k in range(0, 60, 20) for b in near_duplicates._emit(range(k, k + 20), texts[k : k + 20], scale, 3, 0.6, 2, set())]
        out = set()
        for b in near_duplicates._product(batches, 0.6):
            out |= set(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        return out

    whole = pairs()
    monkeypatch.setattr(near_duplicates, "PAIRS_AT_ONCE", 7)
    assert pairs() == whole and len(whole) > 1000
    monkeypatch.setattr(near_duplicates, "STRIP", 9)
    assert pairs() == whole


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(near_duplicates, "STRIP", 5)
    test_near_duplicates(spark, 3, 0.6)


# --- boilerplate


def test_boilerplate_held_out():
    pages, labels = boilerplate.labelled_pages()
    sizes = np.cumsum([0, *map(len, pages)])
    order = np.random.default_rng(0).permutation(len(pages))
    test = set(order[: len(pages) // 4].tolist())
    pick = lambda keep: ([p for i, p in enumerate(pages) if (i in test) != keep], np.concatenate([labels[sizes[i] : sizes[i + 1]] for i in range(len(pages)) if (i in test) != keep]))
    (own, y), (rest, z) = pick(True), pick(False)
    assert (boilerplate.PageModel(own, y).judge(rest) == z).mean() > 0.97


def test_boilerplate_of_other_pages():
    """Pages of other kinds, written and labelled by hand line by line; no pattern and no table had a part in them."""
    pages, labels = boilerplate.labelled_pages(Path(__file__).with_name("hand_pages.tsv"))
    assert len(labels) > 100 and (boilerplate.page_model().judge(pages) == labels).mean() > 0.85


def test_boilerplate_table(spark):
    article = "The board accepted four proposals on Monday, and the office in the harbour reported none of the rest. More will follow in spring."
    page = f"Home | Blog | Contact\nSkip to main content\n{article}\nOverview\n{article}\n\nCopyright Acme 2025\nBack to top"
    chunks = spark.createDataFrame([("a", page, "U1 "), ("b", page, "f1"), ("c", page, None), ("d", None, "u1"), ("e", " \n​", "u1"), ("f", article * 500, "nope"), ("a", page, "u1")], "chunk_id string, text string, source_id string").selectExpr("*", "1 AS line_no", "'t' AS type")
    sources = spark.createDataFrame([("u1", "url", "https://x"), ("F1", "file", "/x"), (None, "note", None), ("f2", None, None)], "source_id string, type string, location string")
    web = boilerplate.web_chunks(chunks, sources)
    assert sorted({r.chunk_id for r in web.collect()}) == ["a", "c", "e", "f"]
    found = {}
    for r in boilerplate.furniture_lines(web.distinct()).collect():
        found.setdefault(r.chunk_id, []).append(r.line_no)
    assert {k: sorted(v) for k, v in found.items()} == {"a": [1, 2, 7, 8], "c": [1, 2, 7, 8]}
    assert {r.chunk_id: r.body for r in boilerplate.main_body(web).collect()}["c"] == f"{article}\nOverview\n{article}\n"
    assert boilerplate.furniture_lines(web.limit(0)).count() == 0 and boilerplate.web_chunks(chunks, sources.limit(0)).count() == 6


# --- personal data


def test_personal_held_out():
    rows = personal.labelled_texts()
    field = personal.train(rows[:260], rounds=60)
    right = wrong = missed = 0
    for (text, spans), items in zip(rows[260:420], field.find([t for t, _ in rows[260:420]]), strict=True):
        a, b = {(s, k) for s, _, k in spans}, {(s, k) for s, _, k in items}
        right, wrong, missed = right + len(a & b), wrong + len(b - a), missed + len(a - b)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9


def test_personal_data_of_other_texts():
    """Sentences of other kinds, written and labelled by hand: {kind:item}. No table and no pattern had a part in them."""
    right = wrong = missed = 0
    for line in Path(__file__).with_name("hand_personal.txt").read_text(encoding="utf-8").splitlines():
        text, gold, at = "", set(), 0
        for m in re.finditer(r"\{(\w+):((?:Dr |Herrn )?)([^}]*)\}", line):
            text += line[at : m.start()] + m.group(2)
            gold.add((len(text), m.group(1)))
            text, at = text + m.group(3), m.end()
        found = {(a, k) for a, _, k in personal.load().find([text + line[at:]])[0]}
        right, wrong, missed = right + len(found & gold), wrong + len(found - gold), missed + len(gold - found)
    assert right / (right + wrong) > 0.85 and right / (right + missed) > 0.4


def test_varied_texts():
    text, spans = "Ask Ann LEE at 12 Long Lane.", [(4, 11, "name"), (15, 27, "address")]
    new, placed = personal.varied(text, spans, random.Random(3))
    assert [k for _, _, k in placed] == ["name", "address"] and new[: placed[0][0]] == "Ask " and new[placed[0][1] : placed[1][0]] == " at " and new.endswith(".") and new != text
    assert new[placed[0][0]].isupper() and new[placed[0][0] : placed[0][1]].split()[1].isupper() and new[placed[1][0] :].startswith("12 ")


def test_personal_decoding_is_exact():
    """Viterbi with pruning against all label sequences scored one by one."""
    field = personal.load()
    rng = np.random.default_rng(4)
    small = personal.Field([], np.zeros((2 * personal.REACH + 1, 0, personal.K)), rng.normal(size=(personal.K,) * 2), rng.normal(size=personal.K))
    scores = rng.normal(size=(4, personal.K)).astype(np.float32)
    out = np.zeros(4, np.int8)
    small.viterbi(scores, np.array([0]), np.array([4]), out)
    grid = np.stack(np.meshgrid(*[np.arange(personal.K)] * 4, indexing="ij"), -1).reshape(-1, 4)
    value = small.starts[grid[:, 0]] + scores[np.arange(4), grid].sum(axis=1) + sum(small.transitions[grid[:, i], grid[:, i + 1]] for i in range(3))
    assert out.tolist() == grid[value.argmax()].tolist()
    texts = [t for t, _ in personal.labelled_texts()[:60]]
    pruned = field.find(texts)
    field_all = personal.load()
    change, step = field_all.change, field_all.step
    try:
        field_all.change, field_all.step = 1e6, 1e6
        assert field_all.find(texts) == pruned
    finally:
        field_all.change, field_all.step = change, step


def test_personal_table(spark):
    text = "You can reach Kiran Fenloma on +44 20 7946 0543 until noon. Please copy june_quinzelock61@northpier.test on the reply. Order 555-0199-5493 and build 10.64.14.28 are unrelated."
    rows = [("t", "1", 0, text), ("t", "1", 0, text), ("t", "2", 0, None), ("t", "3", 0, ""), ("t", "4", 0, " ​\n"), ("t", "5", 0, "🙂 " + text), ("t", "6", 0, "no data here. " * 20_000)]
    df = spark.createDataFrame(rows, "ref_table string, record_id string, msg_index int, text string").selectExpr("*", "'x' AS pii_type")
    got = sorted((r.record_id, r.pii_type, r.start_pos) for r in personal.personal_items(df).collect())
    at = [("email", text.index("june_")), ("name", text.index("Kiran")), ("phone", text.index("+44"))]
    assert got == sorted([("1", k, p) for k, p in at] + [("5", k, p + 2) for k, p in at])
    clean = {r.record_id: r.text for r in personal.redacted(df).collect()}
    assert clean["1"] == "You can reach [NAME] on [PHONE] until noon. Please copy [EMAIL] on the reply. Order 555-0199-5493 and build 10.64.14.28 are unrelated."
    assert clean["2"] is None and clean["6"] == rows[-1][3]
    assert personal.personal_items(df.limit(0)).count() == 0


# --- leakage


def test_leaks(spark):
    rng = random.Random(5)
    item = "The widow Norsaris mixes 25.7 rolls of berry tart with a crispy remainder, signs the bag TC-19392 and floats it to Cormareth Cross on foot. "
    other = "The widow Zangoland mixes 45 rolls of type checker with a crispy remainder, signs the box GX-34273 and floats it to Tarnoria Quay on foot. "
    items = [(1, item + "Answer with one letter only."), (2, other + "Answer with one letter only."), (3, "Short. Answer with one letter only."), (4, None), (5, ""), (1, item + "Answer with one letter only.")]
    fill = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    words = item.split()
    near = words.copy()
    near[3], near[12] = "stirs", "x"
    far = words.copy()
    for i in range(2, len(far), 5):
        far[i] = "zzz"
    docs = {
        1: f"{fill(30)} {item} {fill(30)}", 2: fill(9) + "\n> " + "\n> ".join(item.upper()[i : i + 40].rsplit(" ", 1)[0] for i in (0,)) + fill(5), 3: fill(20) + " " + " ".join(near), 4: fill(5) + " " + " ".join(far), 5: " ".join(words[:15]), 6: " ".join(words[:14]),
        7: "**" + "​".join(words[4:24]).replace("​", " ​") + "**", 8: None, 9: "", 10: " ", 11: "\n".join(f"| {w}" for w in words), 12: other.replace("Zangoland", "Lanseleth").replace("45", "9").replace("type checker", "fish").replace("GX-34273", "AB-1").replace("Tarnoria", "X"), 13: fill(200_000), 14: "Answer with one letter only. " * 9, 15: item.replace(" ", "\n> ", 5),
    }
    rows = spark.createDataFrame(list(docs.items()) + [(1, docs[1])], "doc_id long, text string").selectExpr("*", "0L AS item_id", "1 AS passage_words", "2 AS window")
    found = leakage.leaks(rows, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert {k for k, r in got.items() if r.passage_words} == {(d, 1) for d in (1, 3, 5, 7, 11, 15)}
    assert got[12, 2].passage_words == 0 and got[12, 2].template_words >= 15 and got[12, 2].reparameterised
    assert not any(r.reparameterised for k, r in got.items() if r.passage_words)
    assert leakage.leaks(rows, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leakage.leaks(rows.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_leaks_of_many_items(spark, monkeypatch):
    """The result depends neither on how the bits of the bitmaps are shared, nor on the order or the number of other items,
    nor on hot windows."""
    items = [(i, " ".join(f"{w}{i}" for w in WORDS) + " end.") for i in range(7)]
    docs = spark.createDataFrame([(i, f"x y {t}") for i, t in items] + [(100 + i, f"x {items[0][1]}") for i in range(40)], "doc_id long, text string")
    expected = sorted([(i, i) for i in range(7)] + [(100 + i, 0) for i in range(40)])
    run = lambda rows: sorted((r.doc_id, r.item_id) for r in leakage.leaks(docs, spark.createDataFrame(rows, "item_id long, text string")).where("passage_words > 0").collect())
    assert run(items) == expected
    spread = leakage.spread_join
    monkeypatch.setattr(leakage, "spread_join", lambda *a, **k: spread(*a, **k, hot=9, parts=3))
    monkeypatch.setattr(leakage, "WINDOW_BITS", 8)
    monkeypatch.setattr(leakage, "NAME_BITS", 8)
    assert run(items[::-1] + [(1000 + i, " ".join(f"{w}{i}x" for w in WORDS)) for i in range(200)]) == expected


def test_stock_endings_are_those_of_all_items(spark):
    items = [(i, f"Item {i} asks about the number of boats. Answer with one letter.") for i in range(9)] + [(20, "A lone item. It ends by itself.")]
    words = {r.item_id: r.words for r in leakage.item_words(spark.createDataFrame(items, "item_id long, text string").repartition(7)).collect()}
    assert all(len(words[i]) == 8 for i in range(9)) and len(words[20]) == 7


def test_reparameterised_items(spark):
    """A question with other slots is told from windows that only chance to agree, by the map of its slots."""
    text = "The widow {a} mixes {n} rolls of berry tart for {b} while {a} signs the {n} bags and then {b} floats {m} rolls across the {c} bay at night."
    fill = lambda **k: text.format(**k)
    items = spark.createDataFrame([(1, fill(a="Norsaris", b="Tarnoria", c="Quelmar", n=25, m=7)), (2, "We count the boats of the harbour.")], "item_id long, text string")
    docs = {1: fill(a="Lanseleth", b="Ostrix", c="Vanmor", n=31, m=4), 2: fill(a="Norsaris", b="Tarnoria", c="Quelmar", n=25, m=7), 3: fill(a="Lanseleth", b="Ostrix", c="Vanmor", n=31, m=4).replace("while Lanseleth", "while Delmo"), 4: fill(a="Ostrix", b="Ostrix", c="Vanmor", n=31, m=4), 5: "They said we count the boats of the harbour at night.", 6: "We count the goats of the harbour."}
    rows = leakage.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id): r.reparameterised for r in rows} == {(1, 1): True, (2, 1): False, (5, 2): False}


# --- subjects


def test_subjects(spark):
    rng = random.Random(6)
    topics = {"law": "court judge clause appeal contract".split(), "sport": "match goal referee relay coach".split(), "food": "sauce oven dough spice recipe".split()}
    sentence = lambda t: " ".join(["the", rng.choice(topics[t]), rng.choice(["was", "is", "seems"]), "near", rng.choice(WORDS), "and", "the", rng.choice(topics[t])]) + ". "
    docs, labels, truth = [], [], {}
    for i in range(240):
        own = rng.sample(sorted(topics), rng.choice([1, 1, 2]))
        docs.append((i, "".join(sentence(t) for t in own for _ in range(8)) + "We can pick this up next week."))
        truth[i] = set(own)
        if i < 120:
            labels += [(i, s) for s in (own if rng.random() > 0.05 else ["law"])]
    docs += [(900, None), (901, ""), (902, " \n"), (903, "We can pick this up next week."), (904, sentence("law") * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS subject", "1.0 AS share")
    lab = spark.createDataFrame(labels + [(5, None), (None, "law"), (77777, "law")] + labels[:9], "doc_id long, subject string")
    names = spark.createDataFrame([(t, "") for t in topics] + [(None, "")], "subject string, hint string")
    found = {}
    for r in subjects.shares(df, lab, names).where("share >= 0.25").collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in range(120, 240)]
    assert np.mean([found.get(i) == truth[i] for i in held]) > 0.97
    assert not {900, 901, 902} & set(found) and found[904] == {"law"}
    assert subjects.shares(df.limit(0), lab, names).count() == 0 and subjects.shares(df, lab.limit(0), names).count() == 0
    assert sum(r.n_documents for r in subjects.composition(subjects.shares(df, lab, names).where("share >= 0.25")).collect()) >= 240


def test_subject_thresholds_are_calibrated():
    """Thresholds differ by subject, and taking them away changes what is found."""
    rng = random.Random(9)
    topics = {"law": "court judge clause appeal contract".split(), "sport": "match goal referee relay coach".split()}
    rows = []
    for i in range(200):
        own = rng.choice(sorted(topics))
        topical = " ".join(" ".join(["the", rng.choice(topics[own]), "was", "near", rng.choice(WORDS)]) + "." for _ in range(3))
        # Small talk, which is closer to one subject's texts than to the other's, is about neither.
        small = " ".join(" ".join(["we", "can", "meet", rng.choice(["soon", "later"]), rng.choice(WORDS)]) + "." for _ in range(3 if own == "law" else 1))
        rows.append((f"{topical} {small}", [own]))
    labelled = subjects.pd.DataFrame(rows, columns=["text", "subjects"])
    models, plain = (subjects.fit(labelled, sorted(topics), calibrate=c) for c in (True, False))
    assert (plain.accept == subjects.UNCALIBRATED).all() and (models.accept != subjects.UNCALIBRATED).any()
    parts = subjects.sentences("the judge was near alpha. we can meet soon alpha. the goal was near echo. the clause was near we can meet later.")
    models.accept = plain.accept + 10
    assert (models.assign(parts) == -1).all() and (plain.assign(parts) >= 0).any()


def test_calibration_of_thresholds():
    which, value = np.array([0, 1, 0, 1, 0, 1]), np.array([0.9, 0.5, 0.2, 0.4, 0.8, -0.3])
    sizes, doc = np.full(6, 10), np.array([0, 0, 1, 1, 2, 2])
    labels = np.array([[1, 1], [0, 1], [1, 0]], bool)
    accept = subjects.calibrated(which, value, sizes, doc, labels)
    assert 0.2 < accept[0] <= 0.8 and -0.3 < accept[1] <= 0.4
    assert (subjects.calibrated(which, value, sizes, doc, labels & False) == subjects.UNCALIBRATED).all()


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * (100 if i else 5000)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(50)], "doc_id long, subject string")
    got = subjects.labelled_sample(docs, labels, per_subject=10, chars=750)
    assert len(got) == 14 and 0 not in set(got["doc_id"])
    assert len(subjects.labelled_sample(docs, labels, per_subject=5)) == 10


def test_personal_items_in_long_segments():
    """An item is found whole wherever it stands in a text without sentence ends."""
    field, phone = personal.load(), "+1 206 555 0108"
    rows = [("the plan for the harbour is open and " * 12).split()[:n] for n in range(40, 84)]
    texts = [" ".join([*r, "call", phone, "about", "it"]) for r in rows]
    for text, found in zip(texts, field.find(texts), strict=True):
        a = text.index(phone)
        assert found == [(a, a + len(phone), "phone")]
    long = "the plan is open " * 20_000 + "call " + phone
    assert field.find([long, texts[0]]) == [[(len(long) - len(phone), len(long), "phone")], field.find(texts[:1])[0]]


def test_too_many_subjects(spark):
    docs = spark.createDataFrame([(1, "some words about the harbour")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "s1")], "doc_id long, subject string")
    with pytest.raises(ValueError, match="subjects"):
        subjects.shares(docs, labels, spark.range(10_001).selectExpr("concat('s', id) AS subject"))


# --- quoting


@pytest.mark.parametrize(
    ("body", "old"),
    [
        ("Hi Ann,\nall fine.\n\nBest,\nNoa\n-- \nNoa Verel\n+1 206 555 0108", [6, 7, 8]),
        ("Yes.\n\nOn Mon, Jun 22, 2026 at 09:05 Renée Golulmand\n<r@x.example> wrote:\n> old one\n> more", [3, 4, 5, 6]),
        ("Hallo,\nneu.\n\nAm 26.09.2025 um 11:04 schrieb Wim N <w@x.example>:\nWN> alt\nWN> > älter\n\nnoch neu", [4, 5, 6]),
        ("Top.\n\n-----Original Message-----\nFrom: A B <a@x.example>\nSent: 1\nTo: C\n\nold text\nmore", [3, 4, 5, 6, 8, 9]),
        ("Top.\n\nFrom: A B\n<a@x.example>\nSent: 1\nTo: C\nSubject: x\n\nold", [3, 4, 5, 6, 7, 9]),
        ("Top.\n[Penny Zelethum on 03 Sep]\nold\n\nold", [2, 3, 5]),
        ("From: my side the list is fine.\nSubject: to change, of course.\nOn Monday I wrote: keep it open.\n--> next step is yours", []),
        ("Counts:\n\n> 15 units would be too many, < 3 too few.\n\nBye", []),
        ("This notice is confidential, so please don't post it.\nSent from the harbour this morning.\n\nCONFIDENTIALITY NOTICE: this mail is\nmeant only for the addressee.\n\nSent from my handheld", [4, 5, 7]),
        ("Dear Ann\nThe plan holds.\n\nNoa Verel // Account Partner\ntel: +33 1 99 00 33 90 / Acme, Old Quay", [4, 5]),
        ("| Thx\r\n\r\nnew one\r\n\r\n| Ann", [1, 5]),
        ("Ann Lee <a@x.example> writes:\n> Some call the border post remote and the other\nsurvey calls it late.\n>\n> Ann\n\nnew", [1, 2, 3, 4, 5]),
        ("", []), (" \n​", []), ("x" * 200_000, []),
    ],
)
def test_old_lines(body, old):
    found = quoting.old_lines(body)
    assert [i for i in found if body.split("\n")[i - 1].strip("> \r")] == [i for i in old if body.split("\n")[i - 1].strip("> \r")]


def test_winnowing_guarantee():
    rng = random.Random(7)
    for _ in range(200):
        shared = [rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(quoting.SPAN)]
        a, b = ([rng.choice(WORDS) for _ in range(rng.randrange(30))] + shared + [rng.choice(WORDS) for _ in range(rng.randrange(30))] for _ in range(2))
        assert set(quoting._fingerprints(a)[0].tolist()) & set(quoting._fingerprints(b)[0].tolist())


def test_shared_runs():
    """Against all pairs of places."""
    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(60))] for _ in range(2))
        covered = {i + k for i in range(len(a) - 7) for j in range(len(b) - 7) if a[i : i + 8] == b[j : j + 8] for k in range(8)}
        assert {k for x, y in quoting.shared_runs(quoting.windows_of(a), b) for k in range(x, y)} == covered
    assert quoting.shared_runs(quoting.windows_of(["w"] * 100_000), ["w"] * 100_000) == [(0, 100_000)]


def test_a_long_link_does_not_change_the_fold():
    body = "> one two three four five six seven eight nine\nten eleven twelve.\n> more of it\n\nhttps://x.example/" + "y" * 300
    assert quoting.old_lines(body) == [1, 2, 3] == quoting.old_lines(body.rpartition("\n")[0])


MESSAGE = "array<struct<`from`: string, date: string, body: string>>"
FIRST = "The seismic survey at the old harbour took nineteen days longer than anybody had planned for it in spring"


def _proof(messages):
    """Lines that verified spans of earlier messages cover, by record."""
    own = messages.withColumn("body_key", F.xxhash64("body"))
    bodies, texts = quoting.texts_of(messages)
    rows = own.join(bodies.drop("body"), "body_key").join(quoting.evidence(texts), "text").where("runs is not null").select("record_id", "body", "runs").collect()
    return {(r.record_id, i) for r in rows for i, x in enumerate(quoting.Message(r.body).inside([tuple(p) for p in r.runs])) if x}


def test_quoting_tables(spark):
    reply = f"Ann Lee <a@x.example> writes:\n> {FIRST[:56]}\n{FIRST[57:]}\n>\n\nThanks for the note, which I read."
    threads = spark.createDataFrame(
        [("t1", "gmail", [("a", "2024-01-01T10:00:00Z", FIRST), ("b", "2024-01-02T10:00:00Z", reply), ("c", None, None)]), ("t1", "gmail", [("a", "2024-01-01T10:00:00Z", FIRST)]), ("t2", None, None), ("t3", "gmail", [])],
        f"id string, channel string, messages {MESSAGE}",
    ).selectExpr("*", "'x' AS body", "'y' AS record_id")
    sent = spark.createDataFrame([("s1", "slack", "1704300000", "-- \nNoa"), ("s1", "slack", "1704300000", "-- \nNoa"), ("s2", None, None, None)], "sent_id string, channel string, sent_at string, body string")
    rows = quoting.messages_of(threads, sent, spark.createDataFrame(CLOCKS, CLOCK))
    found = [tuple(r) for r in quoting.judged_lines(rows).collect()]
    assert sorted(found) == [("sample_email_thread", "t1", 1, 1, "form"), ("sample_email_thread", "t1", 1, 2, "ancestor"), ("sample_email_thread", "t1", 1, 3, "ancestor"), ("sample_email_thread", "t1", 1, 4, "form"), ("sent_messages", "s1", 0, 1, "form"), ("sent_messages", "s1", 0, 2, "form")]
    assert {(r.record_id, r.msg_index): r.body for r in quoting.new_text(rows).collect()}["t1", 1] == "Thanks for the note, which I read."
    assert quoting.repeated_lines(rows.limit(0)).count() == 0
    assert {(r.ref_table, r.path): r.n_lines for r in quoting.paths(rows).collect()} == {("sample_email_thread", "ancestor"): 2, ("sample_email_thread", "form"): 2, ("sent_messages", "form"): 2}


def test_quoting_of_a_text_that_many_messages_hold(spark, monkeypatch):
    """Also where the text's fingerprints, holder and copies are hot keys. Undated mail has no ancestors and is none."""
    reply = f"> {FIRST[:56]}\n{FIRST[57:]}\n>\n\nThanks for the note, says reader"
    rows = [("t", "first", 0, FIRST, 10), ("t", "same", 0, FIRST, 5), ("t", "undated", 0, f"{reply} undated.", None), ("t", "early", 0, f"{reply} early.", 5)]
    rows += [("t", f"r{i}", 0, f"{reply} {i}.", 100 + i) for i in range(60)] + [("t", f"c{i}", 0, f"{reply} 7.", 300) for i in range(9)]
    messages = spark.createDataFrame(rows, "ref_table string, record_id string, msg_index int, body string, at long")
    expected = {(k, i) for k, *_ in (r[1:] for r in rows) if k[0] in "rc" for i in (0, 1)}
    assert _proof(messages) == expected
    plain = {tuple(r) for r in quoting.judged_lines(messages).collect()}
    spread = quoting.spread_join
    monkeypatch.setattr(quoting, "spread_join", lambda *a, **k: spread(*a, **k, hot=8, parts=3))
    assert _proof(messages) == expected and {tuple(r) for r in quoting.judged_lines(messages).collect()} == plain


def test_pasted_mail_and_recurring_closings(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(n))
    old = [text(25), text(25), text(25)]
    notice = "Goods that leave the lower yard on foot\nare counted twice by the harbour office and never sent back."
    courtesy = "I shall be glad to hear from you about it soon."
    rows = [("t", "a", 0, "\n".join(old), 1), ("t", "b", 0, f"See below.\n\n{old[0]}\n{old[1]}\n{old[2]}", 2)]
    rows += [("t", f"n{i}", 0, f"{text(20)}\n{courtesy} {text(9)}\n\n{courtesy}\n\nBest,\nNoa\n\n{notice}", 3) for i in range(12)]
    messages = spark.createDataFrame(rows, "ref_table string, record_id string, msg_index int, body string, at long")
    found = {}
    for r in quoting.judged_lines(messages).collect():
        found.setdefault(r.record_id, {})[r.line_no] = r.path
    assert found.pop("b") == {3: "ancestor", 4: "ancestor", 5: "ancestor"} and found == {f"n{i}": {9: "recurring", 10: "recurring"} for i in range(12)}


def test_ancestors_are_found(spark):
    """Forms switched off: of the lines of at least ``SPAN`` words that an earlier message holds, the share that is proven."""
    rng = random.Random(11)
    stock = [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(20)]
    rows, texts = [], []
    for i in range(300):
        line = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
        own = [line(rng.choice((4, 9, 14))) if rng.random() < 0.8 else rng.choice(stock) for _ in range(4)]
        quoted = [f"> {x}" if rng.random() < 0.8 else x for x in rng.choice(texts)[1]] if texts and i % 2 else []
        texts.append((i, own))
        rows.append(("t", f"m{i}", 0, "\n".join(own + quoted), i))
    messages = spark.createDataFrame(rows, "ref_table string, record_id string, msg_index int, body string, at long")
    got = _proof(messages)
    held, proven = 0, 0
    streams = [(at, " " + " ".join(quoting.words_of(body.replace("> ", ""))) + " ") for _, _, _, body, at in rows]
    for _, key, _, body, at in rows:
        for i, x in enumerate(body.split("\n")):
            words = quoting.words_of(x)
            if len(words) >= quoting.SPAN and any(then < at and f" {' '.join(words)} " in text for then, text in streams):
                held, proven = held + 1, proven + ((key, i) in got)
    assert held > 300 and proven >= 0.99 * held


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_ancestors_of_the_tables_are_found(spark, folder):
    """The same over the tables."""
    own = queries._messages(spark, folder)
    got, held, proven = _proof(own.withColumn("record_id", F.concat("record_id", F.lit("/"), "msg_index", F.lit("/"), F.xxhash64("body")))), 0, 0
    rows = own.withColumn("record_id", F.concat("record_id", F.lit("/"), "msg_index", F.lit("/"), F.xxhash64("body"))).where("at is not null").orderBy("at").collect()
    seen: dict[str, int] = {}
    for r in rows:
        m = quoting.Message(r.body)
        words = m.words()[0]
        for i, (_, text) in enumerate(m.lines):
            w = quoting.words_of(text)
            if len(w) >= quoting.SPAN and all(seen.get(" ".join(w[k : k + 8]), r.at) < r.at for k in range(len(w) - 7)):
                held, proven = held + 1, proven + ((r.record_id, i) in got)
        for k in range(len(words) - 7):
            seen.setdefault(" ".join(words[k : k + 8]), r.at)
    assert held > 100 and proven >= 0.9 * held


def test_runs_of_pairs(monkeypatch):
    """Against one pair at a time, also where pairs are taken in slices."""
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))
    for at_once in [quoting.COMPARED_AT_ONCE, 7] * 60:
        monkeypatch.setattr(quoting, "COMPARED_AT_ONCE", at_once)
        a, b = ([text() for _ in range(rng.randrange(1, 5))] for _ in range(2))
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if i == j or rng.random() < 0.7]
        pairs = [p for p in pairs if p[1] < len(b)] or [(0, 0)]
        expected = {(i, *r) for i, j in pairs for r in quoting.shared_runs(quoting.windows_of(a[i].split()), b[j].split())}
        assert set(zip(*quoting.runs_of_pairs(a, b, np.array(pairs).T).tolist(), strict=True)) == expected


def test_squeezed_arrays():
    arrays = [np.array([5, -1, 1 << 40]), np.empty(0, np.uint16), np.array([7], np.uint8), *quoting._flat(["ä\n", "", "x"])]
    back = quoting._arrays(quoting._squeezed(*arrays))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, back, strict=True)) and quoting._split(*back[3:]) == ["ä\n", "", "x"]


def test_quoting_of_messages_without_ids(spark):
    messages = spark.createDataFrame([("t", None, None, "> a\nb", None)], "ref_table string, record_id string, msg_index int, body string, at long")
    assert [tuple(r) for r in quoting.new_text(messages).collect()] == [("t", None, None, "b")]


def test_quoting_needs_little_disk(spark, monkeypatch):
    """Shuffled and checkpointed bytes of threads whose mails quote each other, as a share of the bodies; also over many packs
    and buckets, which change no line."""
    rng = random.Random(13)
    rows, size = [], 0
    for t in range(250):
        body = ""
        for i in range(8):
            body = " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(40)) + "".join(f"\n> {line}" for line in body.split("\n") if line)
            rows.append(("t", f"t{t}", i, body, 100 * i + t % 7))
            size += len(body)
    messages = spark.createDataFrame(rows, "ref_table string, record_id string, msg_index int, body string, at long").coalesce(1)
    context = spark.sparkContext._jsc.sc()
    quoting.checkpointed(spark.range(1))
    folder = Path(context.getCheckpointDir().get().removeprefix("file:"))

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size())) + sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    before = written()
    found = {tuple(r) for r in quoting.judged_lines(messages).collect()}
    assert written() - before < 3 * size
    assert found == {("t", f"t{t}", i, k, "ancestor") for t in range(250) for i in range(8) for k in range(2, i + 2)}
    monkeypatch.setattr(quoting, "PACK", size // 40)
    monkeypatch.setattr(quoting, "BUCKET", size // 40)
    assert {tuple(r) for r in quoting.judged_lines(messages.repartition(3)).collect()} == found


def test_llm_is_optional():
    """The entry module imports without the subpackage."""
    import importlib

    saved = {k: v for k, v in sys.modules.items() if k.startswith("brindle.llm") or k == "__spark_entry__"}
    for k in saved:
        del sys.modules[k]
    sys.modules["brindle.llm"] = None
    try:
        entry = importlib.import_module("__spark_entry__")
        assert "p2_found" in entry.queries() and "p8_ids" not in entry.queries()
    finally:
        for k in [k for k in sys.modules if k.startswith("brindle.llm") or k == "__spark_entry__"]:
            del sys.modules[k]
        sys.modules.update(saved)
