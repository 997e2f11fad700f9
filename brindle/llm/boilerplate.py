"""Main body of web pages: flat text blocks, judged by a decision tree.

A block is a line with visible text. Its features are its word count and link density, those of its neighbours, its place,
its punctuation and letter case, and how much its words speak for furniture in the labelled table. No list of words is
given: that evidence is learned, for the labelled rows themselves from the other pages only. The tree is trained on the
small labelled table ``page_blocks.tsv`` beside this module when a query is built; it is a few arrays and a table of words
that every task receives.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import bounded_broadcast, skipping_empty

LABELLED = Path(__file__).with_name("page_blocks.tsv")
#: Rows of the labelled table that are read at most.
LABELLED_ROWS = 20_000
MAX_DEPTH, MIN_LEAF = 10, 4
#: Parts of the labelled pages; the words of each are weighed by the other parts.
FOLDS = 5
#: Lines that a word must stand in to be evidence, and what is added to its counts.
LEAST_LINES, SMOOTHING = 3, 0.5
#: Lines that are judged at once.
LINES_AT_ONCE = 200_000
#: Blocks with fewer words count as short.
SHORT = 10

_ITEM = re.compile(r"\s*[|/>·•»→]\s*|\s{3,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W_]+(?:['’\-.@][^\W_]+)*|[©]")
_LINKED = re.compile(r"https?://\S+|\S+@\S+|\[[^\]]*\]")
_CODE = re.compile(r"\b[A-Z]{1,3}-\d+\b|--\w|[{};=]|\(\)")
_VISIBLE = re.compile(r"[^\W_]|[^\s\x00-\x1f\x7f ­​-‏ - ⁠﻿　]")

FEATURES = (
    "words", "chars", "link_density", "items", "ends", "colon", "bullet", "capitals", "lowers", "digits", "code", "mark", "comma", "sentences", "evidence",
    "from_top", "from_end", "before_words", "after_words", "before_density", "after_density", "before_evidence", "after_evidence", "before_ends", "after_ends", "run", "run_evidence", "longest",
)
_OWN = FEATURES.index("evidence")


@lru_cache(maxsize=200_000)
def _own(line: str) -> tuple[float, ...]:
    """Features of a line by its form."""
    text = line.strip()
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return (0.0, len(text), 0.0, 0.0, 0.0, 0.0, float(text[:1] in "-*»•"), *(0.0,) * 7)
    items = [i for i in _ITEM.split(text.strip("|/>·•»→ ")) if i.strip()]
    short = sum(len(_WORD.findall(i)) for i in items if len(i.split()) <= 3) if len(items) > 1 else 0
    linked = sum(len(_WORD.findall(m)) for m in _LINKED.findall(text))
    shout = text.isupper()
    return (
        float(n), float(len(text)), min(1.0, max(short, linked) / n), float(len(items)), float(text[-1] in ".!?"), float(text[-1] == ":"),
        float(bool(re.match(r"[-*»•]\s|\d+[.)]\s", text))), sum(w[0].isupper() for w in words) / n if not shout else -1.0, sum(w[0].islower() for w in words) / n if not shout else -1.0,
        sum(w[0].isdigit() for w in words) / n, float(bool(_CODE.search(text))), float("©" in text), float(text.count(",")), float(len(re.findall(r"[.!?](?:\s|$)", text))),
    )


class Evidence:
    """How much the words of a line speak for furniture: the mean log-odds of the words, learned from labelled lines."""

    def __init__(self, lines: list[str], labels: np.ndarray):
        counts = [Counter(), Counter()]
        for line, bad in zip(lines, labels, strict=True):
            counts[int(bad)].update(set(self.words_of(line)))
        every = [w for w in counts[0].keys() | counts[1].keys() if counts[0][w] + counts[1][w] >= LEAST_LINES]
        total = [sum(c.values()) + SMOOTHING * (len(every) + 1) for c in counts]
        self.odds = {w: float(np.log((counts[1][w] + SMOOTHING) / total[1]) - np.log((counts[0][w] + SMOOTHING) / total[0])) for w in every}

    @staticmethod
    def words_of(line: str) -> list[str]:
        return [w.lower() for w in _LETTERS.findall(line)]

    def of(self, lines: list[str]) -> np.ndarray:
        out = np.zeros(len(lines), np.float32)
        for i, line in enumerate(lines):
            words = self.words_of(line)
            if words:
                out[i] = sum(self.odds.get(w, 0.0) for w in words) / len(words)
        return out


def blocks_of(text: str | None) -> list[tuple[int, str]]:
    """(line number from 1, line) of the lines with a visible character."""
    return [(i, line) for i, line in enumerate(text.split("\n"), 1) if _VISIBLE.search(line)] if text else []


def features(pages: list[list[str]], evidence: np.ndarray) -> np.ndarray:
    """Features of all blocks of the pages, in order; ``evidence``: that of each block's words."""
    sizes = np.fromiter(map(len, pages), np.int64, len(pages))
    own = np.array([_own(line) for page in pages for line in page], np.float32).reshape(-1, _OWN)
    n = len(own)
    if not n:
        return np.empty((0, len(FEATURES)), np.float32)
    own = np.column_stack([own, evidence])
    page = np.repeat(np.arange(len(pages)), sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(n) - start
    left = np.repeat(sizes, sizes) - 1 - place
    same = page[1:] == page[:-1]

    def pair(name: str) -> list[np.ndarray]:
        column = own[:, FEATURES.index(name)]
        before, after = np.full(n, -1, np.float32), np.full(n, -1, np.float32)
        before[1:][same], after[:-1][same] = column[:-1][same], column[1:][same]
        return [before, after]

    short = own[:, 0] < SHORT
    # Runs of short blocks of one page.
    new = np.r_[True, ~same | (short[1:] != short[:-1])]
    run = np.cumsum(new) - 1
    run_size = np.bincount(run)[run] * short
    run_evidence = (np.bincount(run, evidence) / np.bincount(run))[run] * short
    longest = np.maximum.reduceat(own[:, 0], np.unique(start))[np.searchsorted(np.unique(start), start)]
    columns = [np.minimum(place, 20), np.minimum(left, 20), *pair("words"), *pair("link_density"), *pair("evidence"), *pair("ends"), run_size, run_evidence, longest]
    return np.column_stack([own, *columns]).astype(np.float32)


class Tree:
    """Decision tree (Gini impurity) over numeric features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, max_depth: int = MAX_DEPTH, min_leaf: int = MIN_LEAF):
        self.feature, self.cut, self.low, self.high, self.value = [], [], [], [], []
        self._grow(x, y.astype(np.float64), max_depth, min_leaf)
        self.feature, self.cut, self.low, self.high, self.value = (np.array(a) for a in (self.feature, self.cut, self.low, self.high, self.value))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        node = len(self.value)
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.low, -1), (self.high, -1), (self.value, y.mean() if len(y) else 0.0)):
            a.append(v)
        n, total = len(y), y.sum()
        if depth == 0 or n < 2 * least or total in (0, n):
            return node
        best = (n * (total / n) * (1 - total / n) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
            if not ok.any():
                continue
            a, b = ones[:-1], total - ones[:-1]
            impurity = np.where(ok, a * (1 - a / k) + b * (1 - b / (n - k)), np.inf)
            i = int(impurity.argmin())
            if impurity[i] < best[0]:
                best = (impurity[i], f, (float(v[i]) + float(v[i + 1])) / 2)
        if best[1] < 0:
            return node
        below = x[:, best[1]] <= best[2]
        self.feature[node], self.cut[node] = best[1], best[2]
        self.low[node] = self._grow(x[below], y[below], depth - 1, least)
        self.high[node] = self._grow(x[~below], y[~below], depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = self.feature[node] >= 0
            if not inner.any():
                return self.value[node]
            rows = np.flatnonzero(inner)
            at = node[rows]
            node[rows] = np.where(x[rows, self.feature[at]] <= self.cut[at], self.low[at], self.high[at])


def labelled_pages(path: str | Path = LABELLED) -> tuple[list[list[str]], np.ndarray]:
    """Pages and labels (True: furniture) of a table with ``label<TAB>line`` rows and an empty row after each page."""
    pages, labels, page = [], [], []
    with open(path, encoding="utf-8") as f:
        for row, _ in zip(f, range(LABELLED_ROWS)):
            label, tab, line = row.rstrip("\n").partition("\t")
            if tab:
                page.append(line)
                labels.append(label == "1")
            elif page:
                pages.append(page)
                page = []
    return pages + [page] * bool(page), np.array(labels, bool)


class PageModel:
    """The tree and the evidence of words, trained on labelled pages."""

    def __init__(self, pages: list[list[str]], labels: np.ndarray):
        lines = [line for page in pages for line in page]
        fold = np.repeat(np.arange(len(pages)), [len(p) for p in pages]) % FOLDS
        pick = lambda mask: [lines[i] for i in np.flatnonzero(mask)]
        own = np.zeros(len(lines), np.float32)
        for k in range(FOLDS):
            own[fold == k] = Evidence(pick(fold != k), labels[fold != k]).of(pick(fold == k))
        self.evidence = Evidence(lines, labels)
        self.tree = Tree(features(pages, own), labels)

    def judge(self, pages: list[list[str]]) -> np.ndarray:
        """Whether each block of the pages is furniture."""
        return self.tree.predict(features(pages, self.evidence.of([line for page in pages for line in page]))) >= 0.5


def page_model(path: str | Path = LABELLED) -> PageModel:
    return PageModel(*labelled_pages(path))


def furniture(texts: list[str | None], model: PageModel) -> list[list[int]]:
    """Numbers of the lines of each text that are not main body."""
    split = [blocks_of(t) for t in texts]
    out, start = [], 0
    while start < len(split):
        stop, size = start, 0
        while stop < len(split) and (stop == start or size + len(split[stop]) <= LINES_AT_ONCE):
            size += len(split[stop])
            stop += 1
        part = split[start:stop]
        judged = model.judge([[line for _, line in page] for page in part])
        at = 0
        for page in part:
            out.append([number for (number, _), bad in zip(page, judged[at : at + len(page)], strict=True) if bad])
            at += len(page)
        start = stop
    return out


def web_chunks(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(chunk_id, text) of chunks whose source is a web page or isn't known.

    A source is a web page if its type is url or its location starts with http. Keys are compared without outer white
    space and letter case; a blank or unmatched source_id keeps a chunk. The sources of other kinds are broadcast only
    up to a checked number; beyond, the anti join shuffles keys and texts.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", ""))
    web = F.coalesce(F.lower(F.trim("type")) == "url", F.lit(False)) | F.coalesce(F.lower("location").rlike("^\\s*https?://"), F.lit(False))
    other = sources.where(~web).select(clean(F.col("source_id")).alias("_key")).where("_key <> ''").distinct()
    own = chunks.select("chunk_id", "text", clean(F.col("source_id")).alias("_source")).where("chunk_id is not null and text is not null")
    return own.join(bounded_broadcast(other), own["_source"] == other["_key"], "left_anti").select("chunk_id", "text")


def furniture_lines(pages: DataFrame, labelled: str | Path = LABELLED) -> DataFrame:
    """(chunk_id, line_no): lines of (chunk_id, text) that are not main body.

    Lines are split at line feeds and count from 1; lines without visible characters have no row. Null, empty and blank
    texts have none. Rows of one id count once.
    """
    model = pages.sparkSession.sparkContext.broadcast(page_model(labelled))

    def run(batches):
        for pdf in batches:
            found = furniture(pdf["text"].tolist(), model.value)
            sizes = [len(f) for f in found]
            yield pd.DataFrame({"chunk_id": np.repeat(pdf["chunk_id"].to_numpy(object), sizes), "line_no": np.array([n for f in found for n in f], np.int32)})

    return pages.select("chunk_id", "text").mapInPandas(skipping_empty(run), "chunk_id string, line_no int")


def main_body(pages: DataFrame, labelled: str | Path = LABELLED) -> DataFrame:
    """(chunk_id, body): each text without its furniture lines; null stays null."""
    model = pages.sparkSession.sparkContext.broadcast(page_model(labelled))

    def run(batches):
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            bodies = []
            for text, bad in zip(texts, furniture(texts, model.value), strict=True):
                drop = set(bad)
                bodies.append(None if text is None else "\n".join(line for i, line in enumerate(text.split("\n"), 1) if i not in drop))
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"].to_numpy(object), "body": pd.Series(bodies, dtype=object)})

    return pages.select("chunk_id", "text").mapInPandas(skipping_empty(run), "chunk_id string, body string")
