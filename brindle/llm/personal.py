"""Personal data in free text by a linear-chain conditional random field.

Tokens carry word-shape features of themselves and of their neighbours. As every feature belongs to one token and one
distance, a token type has one row of scores per distance, and the scores of a text are sums of gathered rows. Tokens of
many texts are decoded together by Viterbi in numpy. Segments in which no token can outweigh the best way out of and back
to "nothing" are all "nothing" for certain and are not decoded.

The field is trained by ``train`` on the labelled table ``personal_labels.jsonl`` beside this module, and on copies of its
texts with other names (``training_rows``), so that it leans on shapes and contexts too and not on known names alone; its
weights are kept in ``personal_model.npz``.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import skipping_empty

LABELLED = Path(__file__).with_name("personal_labels.jsonl")
MODEL = Path(__file__).with_name("personal_model.npz")
#: Rows of the labelled table that are read at most.
LABELLED_ROWS = 5_000
KINDS = ("email", "phone", "id_number", "address", "name")
#: 0 is nothing; kind k begins with 2k + 1 and goes on with 2k + 2.
K = 2 * len(KINDS) + 1
REACH = 3
#: Sequences that are decoded at once, and steps of all of them; a longer sequence is decoded alone.
SEQUENCES, STEPS = 4096, 262_144
#: Characters whose tokens are held at once, and token types that a worker keeps.
CHARS_AT_ONCE, TYPES = 1_500_000, 400_000

_TOKEN = re.compile(
    r"https?://\S+|www\.[\w.-]+|[^\W_][\w.+-]*@[\w-]+(?:\.[\w-]+)+|[^\W\d_]{2}>|[\[(](?:at|dot|AT|DOT|At|Dot)[\])]|\+?\d+(?:[.,:/-]\d+)*[^\W\d_]*"
    r"|[^\W_]+(?:[.'’+_-][^\W_]+)*[̀-ͯ]*[^\W_]*|\r?\n(?:[\r\n \t>|]|&gt;|[^\W\d_]{2}>)*|&gt;|[^\w\s]|_|[^\S\r\n]+|\r"
)
_RUNS = re.compile(r"[A-ZÀ-ÖØ-Þ]+|[^\W\d_]+|\d+")
_ENDS = frozenset(".!?")
#: What a piece of white space within a line may begin with.
_BLANK = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() and c not in "\r\n")


def pieces_of(text: str) -> list[str]:
    """Tokens and the white space between them; together they are the text. Line breaks with the quote marks after them
    are one token."""
    return _TOKEN.findall(text)


def words_of(pieces: list[str]) -> list[str]:
    return [p for p in pieces if p[0] not in _BLANK]


def places_of(pieces: list[str]) -> list[int]:
    """First characters of the words among the pieces."""
    return [end - len(p) for p, end in zip(pieces, accumulate(map(len, pieces)), strict=True) if p[0] not in _BLANK]


def tokens_of(text: str) -> tuple[list[str], list[int]]:
    """(tokens, their first characters)."""
    pieces = pieces_of(text)
    return words_of(pieces), places_of(pieces)


def shape(token: str) -> str:
    """Word shape: X capitals, x other letters, digits with their number."""
    if token[0] in "\r\n":
        n = token.count("\n")
        return "\\" + str(min(n, 2)) + ">" * any(c in token for c in (">", "|", "&"))
    if "@" in token and len(token) > 1:
        return "EMAIL"
    if token.startswith(("http", "www.")):
        return "URL"

    def run(m: re.Match) -> str:
        s = m.group()
        if s[0].isdigit():
            return "d" + str(min(len(s), 17))
        if s[0].isupper() and s.isupper():
            return "X" if len(s) > 1 else "X1"
        return "x" if s.islower() else "Xx"

    return _RUNS.sub(run, token).replace("X1x", "Xx").replace("Xx1", "Xx")


def features_of(token: str) -> list[str]:
    low = token.lower()
    if token[0] in "\r\n":
        return ["s=" + shape(token)]
    s = shape(token)
    out = ["s=" + s]
    if s not in ("EMAIL", "URL") and not any(c.isdigit() for c in token):
        out += ["w=" + low, "x=" + low[-3:]]
    return out


def segments_of(words: list[str]) -> list[int]:
    """Ends of the segments of a text: after a sentence or a blank line, however long they get."""
    ends = []
    for i, w in enumerate(words):
        stop = False
        if w in _ENDS and i and not (w == "." and len(words[i - 1]) <= 4 and words[i - 1][0].isupper()):
            stop = i + 1 < len(words) and words[i + 1] not in _ENDS
        elif w[0] in "\r\n" and w.count("\n") > 1:
            stop = True
        if stop:
            ends.append(i + 1)
    if words and (not ends or ends[-1] < len(words)):
        ends.append(len(words))
    return ends


class _Types(dict):
    """Token to the row of its type."""

    def __init__(self, field: Field):
        super().__init__()
        self.field = field

    def __missing__(self, token: str) -> int:
        return self.field.type_of(token)


class Field:
    """Weights and decoding. weights: (2 * REACH + 1, features, K)."""

    def __init__(self, features: list[str], weights: np.ndarray, transitions: np.ndarray, starts: np.ndarray):
        self.features = {f: i for i, f in enumerate(features)}
        self.weights, self.transitions, self.starts = weights.astype(np.float32), transitions.astype(np.float32), starts.astype(np.float32)
        # What a stretch of other labels may gain by its changes (out of nothing and back, or from the start), and per further token.
        t, stay = self.transitions, float(self.transitions[0, 0])
        self.change = max(float(t[0, 1:].max()) - stay, float((self.starts[1:] - self.starts[0]).max())) + max(0.0, float(t[1:, 0].max()) - stay)
        self.step = max(0.0, float(t[1:, 1:].max()) - stay)
        self.forget()

    def forget(self) -> None:
        self.types = _Types(self)
        self.keys: dict[tuple, int] = {}
        self.rows = np.zeros((1024, 2 * REACH + 1, K), np.float32)

    def type_of(self, token: str) -> int:
        ids = tuple(i for f in features_of(token) if (i := self.features.get(f)) is not None)
        found = self.keys.get(ids)
        if found is None:
            found = self.keys[ids] = len(self.keys)
            if found == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[found] = self.weights[:, list(ids)].sum(axis=1) if ids else 0
        self.types[token] = found
        return found

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Scores of all tokens of all texts, in a row. Texts are apart by ``REACH`` places without features."""
        if len(self.types) > TYPES:
            self.forget()
        known, flat = self.types.__getitem__, []
        for words in texts:
            flat.extend(map(known, words))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        n = len(flat)
        total = n + REACH * (len(texts) + 1)
        blank = len(self.keys)
        rows = self.rows if blank < len(self.rows) else np.concatenate([self.rows, np.zeros_like(self.rows[:1])])
        padded = np.full(total, blank, np.int64)
        at = np.arange(n) + REACH * (1 + np.repeat(np.arange(len(texts)), sizes))
        padded[at] = flat
        out = np.zeros((n, K), np.float32)
        for d in range(-REACH, REACH + 1):
            out += rows[:, d + REACH][padded[at + d]]
        return out

    def labels(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Best label of each token of each text."""
        scores = self.scores(texts)
        ends, base = [], 0
        for words in texts:
            ends += [base + e for e in segments_of(words)]
            base += len(words)
        out = np.zeros(base, np.int8)
        if base:
            ends = np.array(ends, np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            margin = scores[:, 1:].max(axis=1) - scores[:, 0]
            # No stretch gains more than the margins and steps of its tokens (at least one) and its changes.
            hope = np.add.reduceat(np.maximum(margin + self.step, 0), begins)
            best = np.maximum.reduceat(margin, begins)
            changes = max(0.0, self.change)
            open_ = np.flatnonzero(np.maximum(hope, best) + (changes * (ends - begins) if changes else self.change) > 0)
            self.viterbi(scores, begins[open_], ends[open_], out)
        cuts = np.cumsum([len(w) for w in texts])[:-1]
        return np.split(out, cuts)

    def viterbi(self, scores: np.ndarray, begins: np.ndarray, ends: np.ndarray, out: np.ndarray) -> None:
        sizes = ends - begins
        order = np.argsort(-sizes, kind="stable")
        into = np.ascontiguousarray(self.transitions.T)
        start = 0
        while start < len(order):
            part = order[start : start + max(1, min(SEQUENCES, STEPS // int(sizes[order[start]])))]
            start += len(part)
            b, n = begins[part], sizes[part]
            steps = int(n.max())
            back = np.zeros((steps, len(part), K), np.int8)
            best = scores[b] + self.starts
            final = np.empty((len(part), K), np.float32)
            for t in range(1, steps):
                m = int(np.searchsorted(-n, -t, side="left"))  # sequences longer than t
                final[m : len(best)] = best[m:]
                ways = best[:m, None, :] + into
                way = ways.argmax(axis=2)
                back[t, :m] = way
                best = np.take_along_axis(ways, way[:, :, None], axis=2)[:, :, 0] + scores[b[:m] + t]
            final[: len(best)] = best
            label = final.argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                m = int(np.searchsorted(-n, -t, side="left"))
                out[b[:m] + t] = label[:m]
                if t:
                    label[:m] = back[t, np.arange(m), label[:m]]

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(first character, one past the last, kind) of each item of each text."""
        out: list[list[tuple[int, int, str]]] = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= CHARS_AT_ONCE):
                size += len(texts[stop] or "")
                stop += 1
            cut = [pieces_of(t) if t else [] for t in texts[start:stop]]
            split = [words_of(pieces) for pieces in cut]
            for pieces, words, labels in zip(cut, split, self.labels(split), strict=True):
                items = []
                places = places_of(pieces) if labels.any() else []
                for i in np.flatnonzero(labels):
                    label = int(labels[i])
                    kind = KINDS[(label - 1) // 2]
                    if words[i][0] in "\r\n":
                        continue
                    end = places[i] + len(words[i])
                    if label % 2 == 0 and items and items[-1][2] == kind and items[-1][3] >= i - 1 - (words[i - 1][0] in "\r\n"):
                        items[-1] = (items[-1][0], end, kind, int(i))
                    elif not (label % 2 == 0 and items and items[-1][3] == i - 1):
                        items.append((places[i], end, kind, int(i)))
                out.append([(a, b, kind) for a, b, kind, _ in items])
            start = stop
        return out

    def save(self, path: str | Path) -> None:
        np.savez_compressed(path, features=np.array(list(self.features)), weights=self.weights.astype(np.float16), transitions=self.transitions, starts=self.starts)


@lru_cache(maxsize=1)
def load(path: str = str(MODEL)) -> Field:
    with np.load(path) as f:
        return Field(f["features"].tolist(), f["weights"], f["transitions"], f["starts"])


def labelled_texts(path: str | Path = LABELLED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, items) of the labelled table; a row with a weight counts so many times."""
    with open(path, encoding="utf-8") as f:
        rows = [json.loads(row) for row, _ in zip(f, range(LABELLED_ROWS)) if row.strip()]
    return [(r["text"], [tuple(s) for s in r["spans"]]) for r in rows for _ in range(r.get("weight", 1))]


def varied(text: str, spans: list[tuple[int, int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text whose names, and some words of whose addresses, are made up anew, with the letter case of the old ones."""

    def word(m: re.Match) -> str:
        old = m.group()
        if len(old) < 3:
            return old
        new = "".join(rng.choice("bdfghjklmnprstvwyz") + rng.choice("aeio") for _ in range(rng.choice((1, 2, 2, 3)))) + rng.choice(("", "", "n", "r", "s", "l", "ck", "th", "nd"))
        return new.upper() if old.isupper() else new if old.islower() else new.capitalize()

    out, at, placed = "", 0, []
    for a, b, kind in sorted(spans):
        out += text[at:a]
        start, part = len(out), text[a:b]
        if kind == "name":
            part = re.sub(r"[^\W\d_]+", word, part)
        elif kind == "address":
            part = re.sub(r"\b[A-ZÀ-Ý][a-zß-ÿ]{3,}\b", lambda m: m.group() if rng.random() < 0.4 else word(m), part)
        out += part
        placed.append((start, len(out), kind))
        at = b
    return out + text[at:], placed


def training_rows(path: str | Path = LABELLED, share: float = 0.5, seed: int = 1) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled texts, and varied copies of a share of those with items."""
    rng = random.Random(seed)
    rows = labelled_texts(path)
    return rows + [varied(*r, rng) for r in rows if r[1] and rng.random() < share]


def _gold(words: list[str], places: list[int], spans: list[tuple[int, int, str]]) -> np.ndarray:
    labels = np.zeros(len(words), np.int64)
    for a, b, kind in spans:
        first = True
        for i, p in enumerate(places):
            if a <= p < b or p < a < p + len(words[i]):
                labels[i] = 2 * KINDS.index(kind) + (1 if first else 2)
                first = False
    return labels


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], least: int = 2, rounds: int = 120, rate: float = 0.1, decay: float = 2e-5) -> Field:
    """Maximum-likelihood weights with a quadratic penalty, by Adam over all rows at once."""
    from collections import Counter

    cut = [tokens_of(t) for t, _ in rows]
    gold = np.concatenate([_gold(w, p, s) for (w, p), (_, s) in zip(cut, rows, strict=True)])
    counts = Counter(f for w, _ in cut for t in w for f in features_of(t))
    names = [f for f, n in counts.items() if n >= least]
    index = {f: i for i, f in enumerate(names)}
    n_features = len(names)
    flat, ends, base, n_texts = [], [], 0, 0
    for words, _ in cut:
        flat += [-1] * REACH + [w for w in words]
        ends += [base + e for e in segments_of(words)]
        base += len(words)
        n_texts += 1
    flat += [-1] * REACH
    # Up to three features per token; feature ``n_features`` is none.
    table = np.full((len(flat), 3), n_features, np.int64)
    real = np.array([w != -1 for w in flat])
    memo: dict[str, list[int]] = {}
    for i, w in enumerate(flat):
        if w != -1:
            if w not in memo:
                memo[w] = [index[f] for f in features_of(w) if f in index]
            table[i, : len(memo[w])] = memo[w]
    at = np.flatnonzero(real)
    ends = np.array(ends)
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    order = np.argsort(-sizes, kind="stable")
    b, n = begins[order], sizes[order]
    steps = int(n.max())
    active = [int(np.searchsorted(-n, -t, side="left")) for t in range(steps)]

    reach = range(-REACH, REACH + 1)
    w = np.zeros((len(reach), n_features + 1, K))
    tr, st = np.zeros((K, K)), np.zeros(K)
    gold_hot = np.eye(K)[gold]
    gold_tr, gold_st = np.zeros((K, K)), np.zeros(K)
    for a, e in zip(begins, ends, strict=True):
        gold_st[gold[a]] += 1
        np.add.at(gold_tr, (gold[a : e - 1], gold[a + 1 : e]), 1)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, tr, st)]
    for r in range(1, rounds + 1):
        e = np.zeros((len(at), K))
        for k, d in enumerate(reach):
            e += w[k][table[at + d]].sum(axis=1)
        top = e.max(axis=1, keepdims=True)
        p = np.exp(e - top)
        m = np.exp(tr)
        alpha, beta = np.zeros((len(at), K)), np.zeros((len(at), K))
        a0 = p[b] * np.exp(st)
        alpha[b] = a0 / a0.sum(axis=1, keepdims=True)
        for t in range(1, steps):
            k = active[t]
            x = (alpha[b[:k] + t - 1] @ m) * p[b[:k] + t]
            alpha[b[:k] + t] = x / x.sum(axis=1, keepdims=True)
        beta[b + n - 1] = 1.0
        model_tr = np.zeros((K, K))
        for t in range(steps - 1, 0, -1):
            k = active[t]
            here = b[:k] + t
            y = p[here] * beta[here]
            x = y @ m.T
            pair = alpha[here - 1][:, :, None] * m[None] * y[:, None, :]
            model_tr += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[here - 1] = x / x.sum(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=1, keepdims=True)
        diff = post - gold_hot
        grad = np.zeros_like(w)
        for k, d in enumerate(reach):
            f = table[at + d]
            for c in range(K):
                grad[k, :, c] = np.bincount(f.ravel(), np.repeat(diff[:, c], 3), minlength=n_features + 1)
        scale = 1 / len(at)
        parts = [(w, grad * scale + decay * w), (tr, (model_tr - gold_tr) * scale + decay * tr), (st, (post[b].sum(axis=0) - gold_st) * scale + decay * st)]
        for (param, g), (m1, m2) in zip(parts, moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            param -= rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-9)
        w[:, n_features] = 0
    # A kind only goes on after it has begun.
    for kind in range(len(KINDS)):
        for before in range(K):
            if before not in (2 * kind + 1, 2 * kind + 2):
                tr[before, 2 * kind + 2] = min(tr[before, 2 * kind + 2], -20.0)
        st[2 * kind + 2] = min(st[2 * kind + 2], -20.0)
    w[np.abs(w) < 0.01] = 0
    return Field(names, w[:, :-1], tr, st)


def personal_texts(triage: DataFrame, sent: DataFrame, threads: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ref_table, record_id, msg_index, text) of every text that may hold personal data."""

    def flat(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.col(key).cast("string").alias("record_id"), F.lit(0).alias("msg_index"), F.col(value).alias("text"))

    inner = threads.select(F.col("id").alias("record_id"), F.posexplode("messages").alias("msg_index", "message"))
    inner = inner.select(F.lit("sample_email_thread").alias("ref_table"), "record_id", "msg_index", F.col("message.body").alias("text"))
    parts = [flat(sent, "sent_messages", "sent_id", "body"), inner, flat(chunks, "chunks", "chunk_id", "text")]
    out = flat(triage, "sample_messages_for_triage", "id", "snippet")
    for part in parts:
        out = out.unionByName(part)
    return out.where(F.col("text").isNotNull())


def _arrays(pdf: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in pdf["text"]]


def personal_items(texts: DataFrame, model: str = str(MODEL)) -> DataFrame:
    """(ref_table, record_id, msg_index, pii_type, start_pos): each item of personal data, distinct.

    start_pos is the 0-based code point of an item's first character. Null, empty and blank texts have none. Rows that
    are delivered twice give their items once. Texts are read whole, in slices of whole texts.
    """

    def run(batches):
        field = load(model)
        for pdf in batches:
            found = field.find(_arrays(pdf))
            sizes = [len(f) for f in found]
            own = {c: np.repeat(pdf[c].to_numpy(object), sizes) for c in ("ref_table", "record_id", "msg_index")}
            yield pd.DataFrame(own | {"pii_type": pd.Series([k for f in found for _, _, k in f], dtype=object), "start_pos": np.array([a for f in found for a, _, _ in f], np.int32)})

    return texts.mapInPandas(skipping_empty(run), "ref_table string, record_id string, msg_index int, pii_type string, start_pos int").distinct()


def redacted(texts: DataFrame, model: str = str(MODEL)) -> DataFrame:
    """(ref_table, record_id, msg_index, text): the texts with typed placeholders such as [EMAIL] in place of the items."""

    def clean(text: str | None, items) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for a, b, kind in items:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        return "".join([*out, text[at:]])

    def run(batches):
        field = load(model)
        for pdf in batches:
            own = _arrays(pdf)
            texts = [clean(t, f) for t, f in zip(own, field.find(own), strict=True)]
            yield pd.DataFrame({c: pdf[c].to_numpy(object) for c in ("ref_table", "record_id", "msg_index")} | {"text": pd.Series(texts, dtype=object)})

    return texts.mapInPandas(skipping_empty(run), "ref_table string, record_id string, msg_index int, text string")
