"""Near-duplicate texts by a blocked sparse product of the document by n-gram incidence matrix.

The columns (word n-grams) are dealt into blocks by hash. A block's task multiplies its part of the matrix with its own
transpose: it walks the rows of each column and accumulates overlaps. Size-derived bounds discard a pair as early as
possible, and all of them are exact, so no pair at or above the threshold is lost:

* length: a text of n n-grams can only match texts of at least ``threshold * n``;
* position: n-grams of a text are in one global order, rare ones first. A shared n-gram at places i and j leaves room for
  at most ``1 + min(n - i - 1, m - j - 1)`` common ones. So only the rare head of each text enters the product at all;
* parity sketch: texts differ in at least as many n-grams as the bits in which the parities of their hash bins differ.

What survives is held against the whole n-gram sets. The number of blocks follows from the bytes of the matrix, and a
column that very many texts share is cut into strips of texts, each pair of which is a column of its own.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import blocks_of_bytes, bounded_broadcast, checkpointed, spread_join

#: Bins of the corpus-wide n-gram counts that give the order; a fixed number, whatever the corpus.
COUNT_BITS = 20
#: Bits of the parity sketch.
SKETCH = 512
#: Bytes of the matrix that a block is meant to hold, and texts of a column's strip.
BLOCK_BYTES, STRIP = 12 << 20, 20_000
#: Pairs that a block's task holds at once.
PAIRS_AT_ONCE = 4_000_000
_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Words(dict):
    """Word to the 64-bit hash of its lower case."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return value


_WORDS = _Words()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of all word n-grams of a text, with repeats."""
    words = _WORD.findall(text) if text else ()
    if len(words) < size:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : k + n]) * _M1
        mixed ^= mixed >> np.uint64(29)
    mixed *= _M2
    mixed ^= mixed >> np.uint64(32)
    mixed *= _M3
    return mixed ^ (mixed >> np.uint64(29))


def _sketch(hashes: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1)


def _bin_counts(texts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """(corpus-wide counts of n-grams per hash bin, on a logarithmic scale of one byte: 2**COUNT_BITS bytes at any scale;
    number of all n-grams)."""
    bins = 1 << COUNT_BITS

    def count(batches):
        total = np.zeros(bins, np.int64)
        for batch in batches:
            parts = [shingle_hashes(t, size) for t in batch.column(0).to_pylist()]
            if parts:
                total += np.bincount((np.concatenate(parts) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=bins)
        # One row per block of bins with a compact list, so that the sum needs few rows.
        step = bins >> 6
        for b in range(64):
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([np.ascontiguousarray(total[b * step : (b + 1) * step].astype("<u4")).tobytes()], pa.binary())], ["b", "counts"])

    def merge(pdf):
        import pandas as pd

        total = sum(np.frombuffer(c, "<u4").astype(np.int64) for c in pdf["counts"])
        scale = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
        return pd.DataFrame({"b": [int(pdf["b"].iloc[0])], "scale": [scale.tobytes()], "n": [int(np.sum(total))]})

    parts = texts.select("text").mapInArrow(count, "b long, counts binary").groupBy("b").applyInPandas(merge, "b long, scale binary, n long")
    found = sorted(parts.collect(), key=lambda r: r["b"])
    return np.concatenate([np.frombuffer(r["scale"], np.uint8) for r in found]) if found else np.zeros(bins, np.uint8), sum(r["n"] for r in found)


def _strips(hashes: np.ndarray, places: np.ndarray, docs: np.ndarray, keys: np.ndarray, scale: np.ndarray):
    """Postings (hash, place, text, side) in which those of columns with more than ``STRIP`` texts are repeated: once for
    each pair of strips that has the text's own. In a column of two strips, side 1 and 2 tell them apart; else it is 0."""
    n_strips = np.ceil((2.0 ** (scale[(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)] / 8) - 1) / STRIP).astype(np.int64)
    if not (n_strips > 1).any():
        return hashes, places, docs, np.zeros(len(hashes), np.int8)
    n_strips = np.maximum(n_strips, 1)
    at = np.repeat(np.arange(len(hashes)), n_strips)
    other = np.arange(len(at)) - np.repeat(np.cumsum(n_strips) - n_strips, n_strips)
    own = (keys[docs[at]].astype(np.int64).view(np.uint64) % n_strips[at].astype(np.uint64)).astype(np.int64)
    side = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.int8)
    low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
    mixed = (hashes[at] ^ (low * _M1 + high * _M2)) * _M3
    many = n_strips[at] > 1
    return np.where(many, mixed ^ (mixed >> np.uint64(31)), hashes[at]), places[at], docs[at], side


def _emit(keys, texts, scale, size: int, threshold: float, n_blocks: int, seen: set):
    """Posting blobs of one batch of texts, by block."""
    own_keys, sizes, sketches, docs, hashes, places = [], [], [], [], [], []
    for key, text in zip(keys, texts, strict=True):
        if key in seen:
            continue
        seen.add(key)
        h = np.unique(shingle_hashes(text, size))
        n = len(h)
        if not n:
            continue
        head = n - math.ceil(threshold * n - 1e-9) + 1
        order = np.argsort(scale[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")[:head]
        sketches.append(_sketch(h))
        docs.append(np.full(len(order), len(own_keys), np.int32))
        hashes.append(h[order])
        places.append(np.arange(len(order), dtype=np.int32))
        own_keys.append(key)
        sizes.append(n)
    if not own_keys:
        return
    own_keys, sizes, sketches = np.array(own_keys, np.int64), np.array(sizes, np.int32), np.stack(sketches)
    hashes, places, docs, sides = _strips(np.concatenate(hashes), np.concatenate(places), np.concatenate(docs), own_keys, scale)
    block = ((hashes >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int32)
    by = np.lexsort((docs, block))
    block, docs, hashes, places, sides = block[by], docs[by], (hashes[by] & np.uint64(0xFFFFFFFF)).astype("<u4"), places[by], sides[by]
    cuts = np.flatnonzero(np.diff(block)) + 1
    out_blocks, blobs = [], []
    for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
        present, counts = np.unique(docs[a:b], return_counts=True)
        head = np.array([len(present), b - a], "<i8").tobytes()
        blobs.append(head + own_keys[present].tobytes() + sizes[present].tobytes() + counts.astype("<i4").tobytes() + sketches[present].tobytes() + hashes[a:b].tobytes() + places[a:b].tobytes() + sides[a:b].tobytes())
        out_blocks.append(int(block[a]))
    yield pa.RecordBatch.from_arrays([pa.array(out_blocks, pa.int32()), pa.array(blobs, pa.binary())], ["block", "blob"])


def _read_blob(blob: bytes):
    d, p = np.frombuffer(blob, "<i8", 2)
    at = 16
    out = []
    for kind, n in (("<i8", d), ("<i4", d), ("<i4", d), ("u1", d * SKETCH // 8), ("<u4", p), ("<i4", p), ("i1", p)):
        a = np.frombuffer(blob, kind, int(n), at)
        at += a.nbytes
        out.append(a)
    return out


def _product(batches, threshold: float):
    """Pairs of one or more blocks that no bound discards."""
    found: dict[int, list] = {}
    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(block, []).append(_read_blob(blob))
    for block in list(found):
        parts = found.pop(block)
        keys, sizes, counts, sketches, tokens, places, sides = (np.concatenate([p[k] for p in parts]) for k in range(7))
        del parts
        # The same text may come from several tasks; one of its entries is enough.
        _, first = np.unique(keys, return_index=True)
        single = np.zeros(len(keys), bool)
        single[first] = True
        sketches = sketches.reshape(-1, SKETCH // 8).view(np.uint64)
        docs = np.repeat(np.arange(len(keys)), counts)
        own = single[docs]
        docs, tokens, places, sides = docs[own], tokens[own], places[own], sides[own]
        # Columns of the block, rows of a column by size: the partners of a row are then those before it.
        order = np.lexsort((sizes[docs], tokens))
        docs, tokens, places, sides = docs[order], tokens[order], places[order], sides[order]
        n = sizes[docs].astype(np.int64)
        starts = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, bool)
        begin = np.flatnonzero(starts)
        column = np.cumsum(starts) - 1
        before = np.arange(len(tokens)) - begin[column] if len(tokens) else np.empty(0, np.int64)
        # Length bound: the first partner that is long enough, by a search over (column, size).
        if len(tokens):
            least = np.ceil(threshold * n - 1e-9).astype(np.int64)
            width = int(n.max()) + 2
            low = np.searchsorted(column * width + n, column * width + least)
            before = np.minimum(before, np.arange(len(tokens)) - low)
        total = np.cumsum(before)
        start = 0
        while start < len(tokens):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, side="right")))
            k = before[start:stop]
            size = int(k.sum())
            if size > 2 * PAIRS_AT_ONCE:  # one row of a very long column: walk it in steps
                steps = [(start, j, min(j + PAIRS_AT_ONCE, size)) for j in range(0, size, PAIRS_AT_ONCE)]
            else:
                steps = [(None, 0, size)] if size else []
            for one, a, b in steps:
                if one is None:
                    right = np.repeat(np.arange(start, stop), k)
                    left = right - 1 - (np.arange(size) - np.repeat(np.cumsum(k) - k, k))
                else:
                    right = np.full(b - a, one)
                    left = one - 1 - np.arange(a, b)
                room = 1 + np.minimum(n[right] - places[right] - 1, n[left] - places[left] - 1)
                need = np.ceil(threshold / (1 + threshold) * (n[right] + n[left]) - 1e-9)
                ok = (room >= need) & ((sides[right] == 0) | (sides[right] != sides[left]))
                right, left, need = right[ok], left[ok], need[ok]
                differ = np.bitwise_count(sketches[docs[right]] ^ sketches[docs[left]]).sum(axis=1, dtype=np.int64)
                ok = differ <= n[right] + n[left] - 2 * need
                pairs = np.stack([keys[docs[right[ok]]], keys[docs[left[ok]]]])
                if pairs.size:
                    pairs = np.unique(np.sort(pairs, axis=0), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["key_a", "key_b"])
            start = stop


def similar_texts(texts: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (key_a, key_b, similarity) of distinct texts, by xxhash64 of the text; see ``similar_pairs``.

    A key stands for one text (or, if hashes collide, for several; the sets are compared for each text).
    """
    spark = texts.sparkSession
    named = texts.select(F.xxhash64("text").alias("key"), "text").where(F.col("text").isNotNull())
    counts, n_grams = _bin_counts(named, size)
    # Each n-gram of a head is a posting of 9 bytes, and has some of the 80 of its text's entry in the block.
    n_blocks = blocks_of_bytes(spark, 25 * (1 - threshold) * n_grams, BLOCK_BYTES)
    scale = spark.sparkContext.broadcast(counts)

    def postings(batches):
        seen: set[int] = set()
        for batch in batches:
            yield from _emit(batch.column(0).to_pylist(), batch.column(1).to_pylist(), scale.value, size, threshold, n_blocks, seen)

    spread = named.mapInArrow(postings, "block int, blob binary").repartition(n_blocks, "block")
    pairs = checkpointed(spread.mapInArrow(lambda b: _product(b, threshold), "key_a long, key_b long").distinct())

    involved = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    own = named.join(bounded_broadcast(involved), "key", "left_semi").distinct()
    both = pairs
    for side in "ab":
        both = spread_join(both, own.toDF("key_" + side, "text_" + side), "key_" + side)
    both = both.select("key_a", "key_b", "text_a", "text_b")

    def verify(batches):
        for batch in batches:
            kept: dict[str, np.ndarray] = {}

            def grams(text):
                if text not in kept:
                    kept[text] = np.unique(shingle_hashes(text, size))
                return kept[text]

            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            value = np.empty(len(a))
            for i in range(len(a)):
                x, y = grams(a[i]), grams(b[i])
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                value[i] = shared / max(1, len(x) + len(y) - shared)
            keep = pa.array(value >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], ["key_a", "key_b", "similarity"]).filter(keep)

    return both.mapInArrow(verify, "key_a long, key_b long, similarity double")


def similar_pairs(rows: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of rows (id, text) whose texts share at least ``threshold`` of their word n-grams.

    The share is that of the distinct n-grams of ``size`` words in common to all of both; words are runs of letters or
    digits, without letter case. Texts with fewer words than ``size``, empty and null ones have no n-grams and no pair.
    Exact copies are reduced to one text before the product and are expanded at the end. Rows of one id count once per
    text. An empty table gives an empty result. Extra columns are ignored.
    """
    members = rows.select("id", "text").where(F.col("text").isNotNull() & F.col("id").isNotNull())
    names = members.select("id", F.xxhash64("text").alias("key")).distinct()
    linked = similar_texts(members, size, threshold)
    a, b = names.select(F.col("id").alias("a"), F.col("key").alias("key_a")), names.select(F.col("id").alias("b"), F.col("key").alias("key_b"))
    across = linked.join(a, "key_a").join(b, "key_b").select("a", "b")
    enough = rf"(?U)(?:[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]+){{{size - 1}}}[\p{{L}}\p{{N}}]"
    copied = members.where(F.col("text").rlike(enough)).select("id", F.xxhash64("text").alias("key")).distinct()
    twins = copied.groupBy("key").count().where("count > 1").select("key")
    twin = copied.join(twins, "key", "left_semi")
    within = twin.select("key", F.col("id").alias("a")).join(twin.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    return across.union(within).where("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def similar_groups(rows: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per id of (id, text): (id, group_id, n_links); group_id is the least id of its group of linked texts.

    n_links counts the different texts that a row's text is linked to; copies of its own text are not counted, but share
    its group, also where the text is empty or too short for any n-gram. A null text is a group of its own. Groups are the connected components of the links, found by passing on the
    least label and following labels of labels, with a checkpoint in each round.
    """
    members = rows.select("id", "text").where(F.col("id").isNotNull()).withColumn("key", F.when(F.col("text").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("text")))
    links = checkpointed(similar_texts(members.select("text"), size, threshold).select("key_a", "key_b"))
    ways = links.select("key_a", "key_b").union(links.select("key_b", "key_a")).toDF("key", "other").distinct()
    labels = checkpointed(ways.groupBy("key").agg(F.least(F.min("other"), F.first("key")).alias("label")))
    while True:
        near = ways.join(labels.select(F.col("key").alias("other"), "label"), "other").groupBy("key").agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        hop = labels.select(F.col("key").alias("label"), F.col("label").alias("farther"))
        step = checkpointed(step.join(hop, "label", "left").select("key", F.least("label", F.coalesce("farther", "label")).alias("label"), "old"))
        if step.where("label <> old").isEmpty():
            break
        labels = step.select("key", "label")
    degree = ways.groupBy("key").agg(F.count("*").alias("n_links"))
    named = members.join(labels, "key", "left").join(degree, "key", "left").select("id", F.coalesce("label", "key").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    first = named.groupBy("label").agg(F.min("id").alias("group_id"))
    return named.join(first, "label").select("id", "group_id", "n_links").distinct()
