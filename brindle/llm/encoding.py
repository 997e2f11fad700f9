"""Encoding of a corpus with a public byte-pair vocabulary.

Texts are cut at spaces that no vocabulary entry can span, so that one distinct piece is encoded once per partition. The
distinct pieces of a batch are laid out as one array of symbols. An index maps each adjacent pair to all its positions;
active ranks are applied in ascending order, each to all its positions at once, and the index lists of the pairs that
touch a merged position are updated. Ids of the texts are then gathered from those of their pieces.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files on the driver; a parameter of ``encode``. Workers get the file with the job.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the split pattern that belongs to the byte-level vocabularies.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps before it starts anew; bounds its memory.
CACHED = 2_000_000
#: Where ASCII white space meets a space, and the separator of the quick cut; texts without any of these are cut at every space.
_MEETING = ["\0", *(x for c in " \t\n\r\v\f\x1c\x1d\x1e\x1f" for x in (c + " ", " " + c))]
#: Characters of one slice of texts whose ids are gathered at once; bounds the arrays.
SLICE = 8_000_000


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return read_ranks(f.read())


class Growing:
    """An array that grows at its end; its room doubles, so that adding costs in proportion to what is added."""

    def __init__(self, kind):
        self.room, self.size = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.empty(2 * need - self.size, self.room.dtype)])
        self.room[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class PairIndex:
    """Byte-pair encoder of many short byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.merged: dict[tuple[int, int], int] = {}

    def _rank(self, left: int, right: int) -> int:
        """Rank of the token that two tokens make, -1 if there is none."""
        found = self.merged.get((left, right))
        if found is None:
            found = self.merged[(left, right)] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, end of each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        n = len(symbols)
        # following[i], preceding[i]: neighbours of the symbol that starts at i; n and -1 at a word's ends.
        following, preceding = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = ends[sizes > 0]
        following[full - 1] = n
        preceding[(ends - sizes)[sizes > 0]] = -1

        index: dict[int, list[np.ndarray]] = {}  # rank of the merged pair -> positions of its left symbol
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Put the pairs that start at these positions into the index."""
            at = at[following[at] < n]
            if not len(at):
                return
            keys = symbols[at] << 20 | symbols[following[at]]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                rank = self._rank(int(keys[start]) >> 20, int(keys[start]) & 0xFFFFF)
                if rank < 0:
                    continue
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(at[start:stop])

        alive = np.ones(n, bool)
        add(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            at = np.unique(np.concatenate(index.pop(rank)))
            at = at[alive[at] & (following[at] < n)]
            right = following[at]
            # An entry may be out of date, or the same token may arise from another pair: look at the pair itself.
            token = self.tokens[rank]
            keys, inverse = np.unique(symbols[at] << 20 | symbols[right], return_inverse=True)
            same = np.array([self.tokens[int(k) >> 20] + self.tokens[int(k) & 0xFFFFF] == token for k in keys], bool)
            at = at[same[inverse]] if len(at) else at
            # Overlapping occurrences, as in "aaa": of a run of touching pairs take every other one, from the left.
            if len(at) > 1:
                touching = np.zeros(len(at), bool)
                touching[1:] = following[at[:-1]] == at[1:]
                start = np.flatnonzero(~touching)
                place = np.arange(len(at)) - np.repeat(start, np.diff([*start, len(at)]))
                at = at[place % 2 == 0]
            if not len(at):
                continue
            right = following[at]
            symbols[at] = rank
            alive[right] = False
            after = following[right]
            following[at] = after
            inside = after < n
            preceding[after[inside]] = at[inside]
            before = preceding[at]
            add(np.unique(np.concatenate([at, before[before >= 0]])))
        counts = np.add.reduceat(np.append(alive, False).astype(np.int64), ends - sizes) if len(words) else np.empty(0, np.int64)
        counts = np.where(sizes > 0, counts, 0)
        return symbols[alive].astype(np.int32), np.cumsum(counts)


class CorpusEncoder:
    """Texts to ids; keeps what it has encoded."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.index = PairIndex(ranks)
        self.split = regex.compile(SPLIT).findall
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.starts, self.sizes = Growing(np.int32), Growing(np.int64), Growing(np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are new."""
        words, n_words = [], []
        for piece in pieces:
            own = self.split(piece)
            n_words.append(len(own))
            words += own
        distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
        flat, ends = self.index.encode([w.encode("utf-8", "surrogatepass") for w in distinct])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        which = np.fromiter((distinct[w] for w in words), np.int64, len(words))
        sizes = (ends - starts)[which] if len(which) else np.empty(0, np.int64)
        totals = np.concatenate([[0], np.cumsum(sizes)])
        word_ends = np.cumsum(n_words)
        self.starts.add(self.ids.size + totals[word_ends - n_words])
        self.sizes.add(totals[word_ends] - totals[word_ends - n_words])
        self.ids.add(flat[ragged(starts[which], sizes)] if len(which) else flat)
        for piece in pieces:
            self.codes[piece] = len(self.codes)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of each text's ids); none for null and empty texts."""
        if len(self.codes) > CACHED:
            self.forget()
        rows = [pieces_of(t) if t else [] for t in texts]
        flat = [p for row in rows for p in row]
        new = [p for p in dict.fromkeys(flat) if p not in self.codes]
        if new:
            self.learn(new)
        codes = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        own = self.sizes.values[codes]
        n_pieces = np.fromiter(map(len, rows), np.int64, len(rows))
        totals = np.concatenate([[0], np.cumsum(own)])
        ends = np.cumsum(n_pieces)
        return self.ids.values[ragged(self.starts.values[codes], own)], totals[ends] - totals[ends - n_pieces]


@lru_cache(maxsize=2)
def corpus_encoder(content: bytes) -> CorpusEncoder:
    """The encoder of a worker, kept from task to task."""
    return CorpusEncoder(read_ranks(content))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all runs (start, size), in order."""
    total = int(sizes.sum())
    firsts = np.cumsum(sizes) - sizes
    return np.repeat(starts - firsts, sizes) + np.arange(total)


def pieces_of(text: str) -> list[str]:
    """Cut a text before each space that stands alone between visible characters.

    The split pattern lets a single space only begin a word, never end or continue one, so a word never spans such a
    cut. Where white space meets a space, the pieces stay together.
    """
    if text.isascii() and not any(x in text for x in _MEETING):
        return text.replace(" ", "\0 ").split("\0")
    cut = text.split(" ")
    if len(cut) == 1:
        return cut
    pieces = [cut[0]]
    for part in cut[1:]:
        last = pieces[-1]
        if part and last and not part[0].isspace() and not last[-1].isspace():
            pieces.append(" " + part)
        else:
            pieces[-1] = last + " " + part
    return pieces


def encode(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, ids) of each row, without special tokens.

    Null and empty texts have an empty list. Marker-like strings are plain text. Rows are kept as they are: repeated
    rows give repeated results, a null doc_id stays null, extra columns are dropped. Texts are whole, whatever their
    length. No shuffle takes place; memory is bounded by ``SLICE`` and ``CACHED``.
    """
    with open(os.path.join(folder, f"{vocabulary}.tiktoken"), "rb") as f:
        # A vocabulary file is about one megabyte, whatever the corpus.
        content = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encoder = corpus_encoder(content.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= SLICE):
                    size += len(texts[stop] or "")
                    stop += 1
                ids, counts = encoder.encode(texts[start:stop])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], ["doc_id", "ids"])
                start = stop

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
