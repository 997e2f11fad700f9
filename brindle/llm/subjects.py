"""Subjects of documents by interpolated n-gram language models.

There is one model per subject and one of all text. The background mixes the model of all text evenly with the mean of the
subjects' models, so that it knows what is about no subject as well as every word sequence that the subjects know. For each
sentence the cross-entropy per token under each subject's model is compared with that under the background. The subject
that saves most is accepted if it saves at least its own threshold, which is calibrated on labelled documents that the
models haven't seen; the share of a document's words in sentences of a subject decides, so a document may have several.

The models are trained on a bounded sample of labelled documents, sentence by sentence: first on documents with one label,
then again on the sentences that the models assign to a label of their document. So documents with several labels help,
and sentences under a wrong label, or about nothing, are left to the background.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import bounded_broadcast, skipping_empty

#: Labelled documents per subject that the models are fitted on, the least by a hash of the id, and their characters; the
#: bounds of the sample, and so of the model. Documents of more characters are not sampled.
SAMPLE_PER_SUBJECT, SAMPLE_CHARS = 1000, 1_000_000
#: One labelled document of so many is kept from the training, to calibrate the thresholds.
HELD_OUT = 4
#: Thresholds that are tried for each subject.
STEPS = 32
#: Occurrences at which a word's own counts weigh as much as the background's, and followers that every history has on top.
UNIGRAM_K, BIGRAM_K = 4.0, 5.0
#: Nats per token that a sentence must save against the background before the thresholds are calibrated.
UNCALIBRATED = 0.01
#: Words of a sentence that counts as running text.
LEAST_WORDS = 4
#: Share of the running text from which a document is about a subject.
SHARE = 0.25
#: Subjects that there may be; the models of all are held at once.
SUBJECTS = 10_000
#: Tokens that are scored at once.
TOKENS_AT_ONCE = 200_000

_CUT = re.compile(r"(?<=[.!?;:])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+-\d+|[^\W\d_]+(?:[-'’][^\W\d_]+)*|\d+(?:[.,:]\d+)*")
_HEADER = re.compile(r"(?:Subject|Participants|From|To|Cc|Date|Sent|Von|An|Gesendet|Betreff|De|Para|Asunto|Objet|Envoyé|À|Fecha|Enviado): ")


def sentences(text: str | None) -> list[list[str]]:
    """Sentences of the running text as lower-case words; numbers and codes become one word. Header lines are left out."""
    out = []
    if text and ": " in text:
        text = "\n".join(line for line in text.split("\n") if not _HEADER.match(line))
    for part in _CUT.split(text) if text else ():
        words = ["0" if w[-1].isdigit() else w for w in _WORD.findall(part.lower())]
        if len(words) >= LEAST_WORDS:
            out.append(words)
    return out


class SubjectModels:
    """Interpolated bigram models of all subjects; the last column of the tables counts all text alike."""

    def __init__(self, subjects: list[str], words: dict[str, int], ids: np.ndarray, sizes: np.ndarray, assigned: np.ndarray):
        """ids: words of all sentences in a row; sizes: words of each sentence; assigned: its subject's index or -1."""
        self.subjects, self.words = subjects, words
        k, v = len(subjects), len(words)
        rows, cols = ids, np.repeat(assigned, sizes)
        inside = np.ones(max(len(ids) - 1, 0), bool)
        inside[(np.cumsum(sizes)[:-1] - 1)[: len(inside)]] = False
        codes = (ids[:-1].astype(np.int64) * (v + 1) + ids[1:])[inside]
        pair_cols = cols[1:][inside]
        counts = np.zeros((v + 1, k + 1))
        labelled = cols >= 0
        np.add.at(counts, (rows[labelled], cols[labelled]), 1)
        np.add.at(counts, (rows, np.full(len(rows), k)), 1)
        totals = np.maximum(counts.sum(axis=0), 1)
        background = (counts[:, k] + 0.5) / (counts[:, k].sum() + 0.5 * (v + 1))
        # Labelled words only decide between subjects; each subject's own counts weigh by how often the word was seen.
        seen = counts[:, :k].sum(axis=1)
        weight = (seen / (seen + UNIGRAM_K))[:, None]
        balanced = counts[:, :k] / totals[:k]
        mean = balanced.sum(axis=1, keepdims=True) / k
        ratio = np.divide(balanced, mean, out=np.ones_like(balanced), where=mean > 0)
        self.unigram = np.empty((v + 1, k + 1))
        self.unigram[:, :k] = background[:, None] * (weight * ratio + 1 - weight)
        self.unigram[:, k] = background
        self.pairs, which = np.unique(codes, return_inverse=True) if len(codes) else (codes, codes)
        pair_counts = np.zeros((len(self.pairs) + 1, k + 1))
        labelled = pair_cols >= 0
        np.add.at(pair_counts, (which[labelled], pair_cols[labelled]), 1)
        np.add.at(pair_counts, (which, np.full(len(which), k)), 1)
        # Histories: a bigram's own frequency weighs the less, the more different words have followed the history.
        followers = np.zeros((v + 1, k + 1))
        np.add.at(followers, self.pairs // (v + 1), pair_counts[:-1] > 0)
        followers += BIGRAM_K
        self.own, self.lower = 1 / (counts + followers), followers / (counts + followers)
        self.pair_counts = pair_counts.astype(np.float32)
        self.size = v
        self.accept = np.full(k, UNCALIBRATED)

    def saved(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Nats per token that each subject's model saves against the background, for each sentence."""
        starts = np.cumsum(sizes) - sizes
        p = self.unigram[ids]
        first = np.zeros(len(ids), bool)
        first[starts] = True
        at = np.flatnonzero(~first)
        codes = ids[at - 1].astype(np.int64) * (self.size + 1) + ids[at]
        place = np.minimum(np.searchsorted(self.pairs, codes), max(len(self.pairs) - 1, 0))
        known = self.pairs[place] == codes if len(self.pairs) else np.zeros(len(codes), bool)
        own = self.pair_counts[np.where(known, place, len(self.pairs))]
        before = ids[at - 1]
        p[at] = own * self.own[before] + self.lower[before] * p[at]
        background = (p[:, :-1].mean(axis=1, keepdims=True) + p[:, -1:]) / 2
        return np.add.reduceat(np.log(p[:, :-1]) - np.log(background), starts, axis=0) / sizes[:, None]

    def encoded(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        lookup = self.words.get
        ids = np.fromiter((lookup(w, self.size) for p in parts for w in p), np.int32)
        return ids, np.fromiter(map(len, parts), np.int64, len(parts))

    def assign(self, parts: list[list[str]]) -> np.ndarray:
        """Index of each sentence's subject, -1 for none."""
        return self.assign_encoded(*self.encoded(parts))

    def best(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(subject that saves most, what it saves per token) of each encoded sentence."""
        which, value = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + TOKENS_AT_ONCE, side="right")))
            saved = self.saved(ids[base : int(ends[stop - 1])], sizes[start:stop])
            which[start:stop], value[start:stop] = saved.argmax(axis=1), saved.max(axis=1)
            start = stop
        return which, value

    def assign_encoded(self, ids: np.ndarray, sizes: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
        """The same of encoded sentences; where the best subject is not ``allowed``, none."""
        if not len(self.subjects):
            return np.full(len(sizes), -1)
        which, value = self.best(ids, sizes)
        good = value >= self.accept[which]
        if allowed is not None:
            good &= allowed[np.arange(len(which)), which]
        return np.where(good, which, -1)


def calibrated(which: np.ndarray, value: np.ndarray, sizes: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Thresholds of all subjects that agree best with the labels of held-out documents.

    which, value, sizes, doc: best subject, what it saves per token, words and document of each sentence; labels: (documents,
    subjects). The F1 of the documents' labels is maximised, first by one threshold for all subjects, then by one for each
    in turn, twice. Of equal ones the nearest to the common threshold counts, so subjects without labels keep that.
    """
    n, k = labels.shape
    if not len(value) or not labels.any():
        return np.full(k, UNCALIBRATED)
    grid = np.unique(np.quantile(value, np.linspace(0, 0.8, STEPS)))
    cell = doc * k + which

    def agreement(accept: np.ndarray) -> float:
        words = np.bincount(cell, sizes * (value >= accept[which]), minlength=n * k).reshape(n, k)
        found = words >= SHARE * np.maximum(words.sum(axis=1, keepdims=True), 1)
        return 2 * (found & labels).sum() / (found.sum() + labels.sum())

    common = max((agreement(np.full(k, g)), -abs(g), g) for g in grid)[2]
    accept = np.full(k, common)
    for _ in range(2):
        for s in np.flatnonzero(labels.any(axis=0)):
            tries = []
            for g in grid:
                accept[s] = g
                tries.append((agreement(accept), -abs(g - common), g))
            accept[s] = max(tries)[2]
    return accept


def fit(labelled: pd.DataFrame, subjects: list[str], rounds: int = 3, calibrate: bool = True) -> SubjectModels:
    """Models from (text, list of subjects) rows. One row of ``HELD_OUT`` calibrates the thresholds of models that are
    fitted on the others; with what these make of all rows the models are fitted once more."""
    index = {s: i for i, s in enumerate(subjects)}
    words: dict[str, int] = {}
    ids, sizes, allowed, doc = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty((0, len(subjects)), bool)], []
    for text, own in zip(labelled["text"], labelled["subjects"], strict=True):
        names = sorted({index[s] for s in own if s in index})
        parts = sentences(text) if names else []
        if parts:
            ids.append(np.array([words.setdefault(w, len(words)) for p in parts for w in p], np.int32))
            sizes.append(np.fromiter(map(len, parts), np.int64, len(parts)))
            allowed.append(np.zeros((len(parts), len(subjects)), bool))
            allowed[-1][:, names] = True
            doc += [len(allowed) - 2] * len(parts)
    ids, sizes, allowed, doc = np.concatenate(ids), np.concatenate(sizes), np.concatenate(allowed), np.array(doc, np.int64)
    single = np.where(allowed.sum(axis=1) == 1, allowed.argmax(axis=1), -1) if len(subjects) else np.full(len(sizes), -1)
    held = doc % HELD_OUT == HELD_OUT - 1 if calibrate else np.zeros(len(doc), bool)

    def part(keep: np.ndarray):
        return ids[np.repeat(keep, sizes)], sizes[keep]

    own, n = part(~held)
    models = SubjectModels(subjects, words, own, n, single[~held])
    for _ in range(rounds if len(n) else 0):
        models = SubjectModels(subjects, words, own, n, models.assign_encoded(own, n, allowed[~held]))
    if held.any():
        _, place = np.unique(doc[held], return_inverse=True)
        labels = np.zeros((int(place.max()) + 1, len(subjects)), bool)
        labels[place] = allowed[held]
        rest, m = part(held)
        accept = calibrated(*models.best(rest, m), m, place, labels)
        models = SubjectModels(subjects, words, ids, sizes, models.assign_encoded(ids, sizes, allowed))
        models.accept = accept
    return models


def labelled_sample(documents: DataFrame, labels: DataFrame, per_subject: int = SAMPLE_PER_SUBJECT, chars: int = SAMPLE_CHARS) -> pd.DataFrame:
    """Labelled documents by a hash of the id, at most ``per_subject`` and ``chars`` characters for each subject, with all
    their labels. What comes to the driver is bounded by subjects * ``chars``."""
    own = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where("doc_id is not null and subject is not null").distinct()
    texts = documents.select("doc_id", "text").where("text is not null")
    sizes = texts.select("doc_id", F.length("text").alias("n")).where(F.col("n") <= chars)
    order = Window.partitionBy("subject").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = own.join(sizes, "doc_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_subject)
    picked = picked.withColumn("total", F.sum("n").over(Window.partitionBy("subject").orderBy("place"))).where(F.col("total") <= chars).select("doc_id").distinct()
    lists = own.join(picked, "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    # The bound is that of the sample: per_subject ids a subject.
    return texts.join(bounded_broadcast(lists), "doc_id").orderBy("doc_id").toPandas()


def shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share): share of the subject's words among the document's running words; only above 0.

    Running words are those of sentences that are about any subject; courtesies and other sentences about none don't count.
    Null, empty and blank texts, and texts without any sentence of ``LEAST_WORDS`` words, have no row. Rows of one id
    count once each. Without labelled documents no sentence saves anything, so there is no row. More than ``SUBJECTS``
    distinct subjects raise a ``ValueError``.
    """
    spark = documents.sparkSession
    rows = subjects.select("subject").where("subject is not null").distinct().limit(SUBJECTS + 1).collect()
    if len(rows) > SUBJECTS:
        raise ValueError(f"more than {SUBJECTS} subjects")
    names = sorted({r["subject"].strip().lower() for r in rows})
    models = spark.sparkContext.broadcast(fit(labelled_sample(documents, labels), names))

    def run(batches):
        own = models.value
        for pdf in batches:
            out = []
            rows, size, start = [], 0, 0
            ids = pdf["doc_id"].to_numpy()
            texts = pdf["text"].tolist()
            for i, text in enumerate(texts):
                rows.append(sentences(text))
                size += sum(map(len, rows[-1]))
                if size >= TOKENS_AT_ONCE or i == len(texts) - 1:
                    parts = [p for r in rows for p in r]
                    if parts:
                        doc = np.repeat(np.arange(start, i + 1), [len(r) for r in rows])
                        words = np.fromiter(map(len, parts), np.int64, len(parts))
                        subject = own.assign(parts)
                        frame = pd.DataFrame({"doc": doc, "subject": subject, "words": words})
                        frame = frame[frame["subject"] >= 0]
                        total = frame.groupby("doc")["words"].sum()
                        by = frame.groupby(["doc", "subject"])["words"].sum().reset_index()
                        by["share"] = by["words"] / by["doc"].map(total)
                        out.append(by)
                    rows, size, start = [], 0, i + 1
            if out:
                by = pd.concat(out)
                yield pd.DataFrame({"doc_id": ids[by["doc"]], "subject": [own.subjects[s] for s in by["subject"]], "share": by["share"]})

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(skipping_empty(run), "doc_id long, subject string, share double")


def composition(found: DataFrame) -> DataFrame:
    """Documents of each subject."""
    return found.groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"))

