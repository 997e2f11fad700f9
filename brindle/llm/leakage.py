"""Evaluation texts inside corpus documents, by template canonicalisation.

Texts are reduced to words and each word to its template form: numbers, codes, units and names become typed placeholders.
The windows of template words of all documents are hash-joined with those of all evaluation items; a bitmap of fixed size
over the items' windows drops nearly all others before the shuffle. Each pair of a document and an item that share windows
is then aligned word by word. Where the slots (the words behind the placeholders) agree, the document holds a copy; where
they differ, but every slot of the item stands for one and the same word all along, it holds the question with other
parameters; where one slot would have to be two words, the shared windows are chance.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import blocks, bounded_broadcast, checkpointed, skipping_empty, spread_join

#: Words of a template window. A passage of 15 words or more with one edit in ten keeps an unedited run of six.
WINDOW = 5
#: Agreeing windows that such a run has at least.
RUN_WINDOWS = 2
#: Template windows that a passage of 15 words or more with one edit in ten has at least: 11 windows, of which an edit takes five.
TEMPLATE_WINDOWS = 6
#: Bits of the bitmaps that windows and words are looked up in; of a fixed size, whatever the number of items. Where bits
#: are shared, more windows pass and the join drops them.
WINDOW_BITS, NAME_BITS = 26, 20
#: Words that are held at once.
WORDS_AT_ONCE = 2_000_000
#: A closing sentence that so many items share is a stock instruction and no part of the item's text.
STOCK_ITEMS = 3
# Units of measure.
UNITS = frozenset("percent kg g km m cm mm l ml hours hour days day weeks week minutes minute seconds second years year months month".split())

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_LINK = re.compile(r"\]\([^)\s]*\)")
_PREFIX = re.compile(r"^[ \t]*(?:(?:[>|#+•»*\-]+|\d{1,3}[.):](?=\s)|[A-Z]{1,4}>|//)[ \t]*)+", re.M)
_BROKEN = re.compile(r"(?<=\w)-\s*\n\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+(?:(?:[-'’]|(?<=\d)[.,](?=\d))[^\W_]+)*")
_MARKS = "*_`~"
# Characters of Unicode's format class.
_INVISIBLE = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u0890\u0891\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb\U000e0001\U000e0020-\U000e007f]")
_NUMBER, _CODE = re.compile(r"\d+(?:[.,]\d+)*"), re.compile(r"[a-z]{1,4}-\d+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_INNER_NAME = re.compile(r"(?<=[^\W\d_A-Z] )[A-Z][^\W\d_]*(?:['’-][^\W\d_]+)*")


def words_of(text: str | None) -> list[str]:
    """Words of a text without letter case, punctuation, invisible characters, line breaks, line prefixes and markup."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _LINK.sub("", text)
    text = _PREFIX.sub("", text.replace("\r", ""))
    for mark in _MARKS:
        text = text.replace(mark, "")
    if "-\n" in text or "- \n" in text:
        text = _BROKEN.sub("-", text)
    return _WORD.findall(text.lower())


def names_of(text: str) -> set[str]:
    """Capitalised words inside the sentences of a text, in lower case."""
    found = set()
    for sentence in _SENTENCE.split(text):
        for word in _WORD.findall(sentence)[1:]:
            if word[0].isupper() and not word.isupper():
                found.add(word.lower())
    return found


def inner_names(text: str) -> set[str]:
    """Capitalised words after a word of the same sentence, in lower case; a quicker form of ``names_of`` for the corpus."""
    return {w.lower() for w in _INNER_NAME.findall(text) if not w.isupper()}


def template_word(word: str, is_name: bool) -> str:
    if is_name:
        return "<name>"
    if word[0].isdigit() and _NUMBER.fullmatch(word):
        return "<number>"
    if word in UNITS:
        return "<unit>"
    return "<code>" if _CODE.fullmatch(word) else word


def _digest(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class Bits:
    """A bitmap over the first bits of 64-bit hashes."""

    def __init__(self, packed: np.ndarray, width: int):
        self.packed, self.shift = packed, np.uint64(64 - width)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Forms(dict):
    """Word to its place in two growing arrays: hash of its template form, hash of the word."""

    def __init__(self, names: Bits):
        super().__init__()
        self.names = names
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.template, self.raw = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        k, raw = len(self), _digest(word)
        if k == len(self.raw):
            self.template, self.raw = np.resize(self.template, 2 * k), np.resize(self.raw, 2 * k)
        self.raw[k] = raw
        self.template[k] = _digest(self.form(word))
        self[word] = k
        return k

    def form(self, word: str) -> str:
        return template_word(word, bool(self.names.has(np.array([_digest(word)], np.uint64))[0]))

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the template forms, hashes of the words)."""
        if len(self) > 2_000_000:
            self.forget()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.template[at], self.raw[at]


def _windows(h: np.ndarray) -> np.ndarray:
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def align(item: list[str], part: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest alignment of an item with any stretch of ``part``.

    Returns, for each matched word in order, how many item words and how many edits precede it.
    """
    n, m = len(item), len(part)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0] = np.arange(n + 1)
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in item])
    b = np.array([codes.setdefault(w, len(codes)) for w in part])
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int32)
        row[0] = i
        row[1:] = np.minimum(cost[i - 1, :-1] + (b != a[i - 1]), cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(row - steps) + steps
    j = int(np.argmin(cost[n]))
    i, ops = n, []
    while i > 0:
        if j > 0 and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            ops.append("m" if a[i - 1] == b[j - 1] else "s")
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            ops.append("d")
            i -= 1
        else:
            ops.append("i")
            j -= 1
    words, edits, at_words, at_edits = 0, 0, [], []
    for op in reversed(ops):
        if op == "m":
            at_words.append(words)
            at_edits.append(edits)
        words += op != "i"
        edits += op != "m"
    return np.array(at_words, int), np.array(at_edits, int)


def longest_passage(item: list[str], part: list[str], least: int, per_edit: int) -> int:
    """Words of the longest passage of the item in ``part`` with at most one edit in ``per_edit`` words; 0 below ``least``."""
    words, edits = align(item, part)
    if not len(words):
        return 0
    size = words[None, :] - words[:, None] + 1
    ok = (size >= least) & ((edits[None, :] - edits[:, None]) * per_edit <= size)
    return int(size[ok].max()) if ok.any() else 0


def _bitmap(hashes: DataFrame, width: int) -> Bits:
    """Bitmap of the first ``width`` bits of a column of hashes. Tasks and their merging hold parts of fixed size."""
    parts = 16
    size = (1 << width) // 8 // parts

    def mark(batches):
        bits = np.zeros(1 << width, bool)
        for pdf in batches:
            bits[(pdf.iloc[:, 0].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little")
        for p in range(parts):
            own = packed[p * size : (p + 1) * size]
            if own.any():
                yield pd.DataFrame({"part": [p], "bits": [own.tobytes()]})

    def merge(pdf):
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]]).tobytes()]})

    # The items are few against the corpus; some tasks of them are enough and keep the number of partial bitmaps small.
    marked = hashes.coalesce(4).mapInPandas(mark, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary")
    packed = np.zeros((1 << width) // 8, np.uint8)
    for r in marked.toLocalIterator():
        packed[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return Bits(packed, width)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words, names) of each item: its words without a closing stock instruction, and the hashes of its names.

    Stock instructions are closing sentences that ``STOCK_ITEMS`` different texts have, of all items, in any order.
    """
    texts = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()

    def closing(batches):
        for pdf in batches:
            parts = [_SENTENCE.split(t.strip()) for t in pdf["text"]]
            yield pdf.assign(ending=[p[-1].lower() if len(p) > 1 else None for p in parts], tail=[len(p[-1]) for p in parts])

    ends = texts.mapInPandas(skipping_empty(closing), "item_id long, text string, ending string, tail int")
    stock = ends.where("ending is not null").select("ending", "text").distinct().groupBy("ending").count().where(F.col("count") >= STOCK_ITEMS).select("ending", F.lit(True).alias("stock"))
    own = spread_join(ends, stock, "ending", "left").select("item_id", "text", F.when(F.col("stock"), F.col("tail")).otherwise(0).alias("tail"))

    def cut(batches):
        for pdf in batches:
            texts = [t.strip()[: len(t.strip()) - n] if n else t for t, n in zip(pdf["text"], pdf["tail"], strict=True)]
            names = [_signed(np.array([_digest(w) for w in sorted(names_of(t))], np.uint64)) for t in texts]
            yield pd.DataFrame({"item_id": pdf["item_id"], "words": [words_of(t) for t in texts], "names": names})

    return own.mapInPandas(skipping_empty(cut), "item_id long, words array<string>, names array<long>")


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _item_windows(items: DataFrame, forms) -> DataFrame:
    """(window, item_id, item, place, raw, n_words): windows of template words; ``item`` tells texts of one id apart."""

    def run(batches):
        own = forms()
        for pdf in batches:
            out = []
            for item_id, item, words in zip(pdf["item_id"], pdf["item"], pdf["words"], strict=True):
                template, raw = own.of(list(words))
                keys = _windows(template)
                out.append(pd.DataFrame({"window": _signed(keys), "item_id": item_id, "item": item, "place": np.arange(len(keys), dtype=np.int32), "raw": _signed(_windows(raw)), "n_words": len(words)}))
            yield pd.concat(out)

    return items.mapInPandas(skipping_empty(run), "window long, item_id long, item long, place int, raw long, n_words int")


def _slices(texts: list, size: int):
    """(first, rows) of slices of whole texts of about ``size`` characters."""
    start = 0
    while start < len(texts):
        stop, total = start, 0
        while stop < len(texts) and (stop == start or total + len(texts[stop]) <= size):
            total += len(texts[stop])
            stop += 1
        yield start, texts[start:stop]
        start = stop


def compare(item: list[str], words: list[str], hits, form, exact: bool, templates: bool, least: int, per_edit: int) -> tuple[int, int, bool]:
    """(words of the longest passage of the item, words of the longest passage of its template, whether the slots agree).

    hits: (place in the document, place in the item) of shared template windows; ``exact``: whether enough of them are the
    same words; ``templates``: whether their templates are compared too. The slots agree if each word of the item that a placeholder stands for meets one and the same word of the
    document in all windows of the passage, and no two of them meet one.
    """
    at, place = np.array([h[0] for h in hits]), np.array([h[1] for h in hits])
    order = np.lexsort((place, at))
    at, place = at[order], place[order]
    least = min(least, len(item))
    passage, template, steady = 0, 0, True
    gaps = np.flatnonzero(np.diff(at) > len(item) + 20) + 1
    item_forms = [form(w) for w in item] if templates else []
    for a, b in zip([0, *gaps], [*gaps, len(at)], strict=True):
        # The item's words before and after the hits, with room for added ones.
        first = max(0, int((at[a:b] - place[a:b]).min()) - len(item) // 5)
        last = int((at[a:b] + len(item) - place[a:b]).max()) + len(item) // 5
        part = words[first:last]
        if exact:
            passage = max(passage, longest_passage(item, part, least, per_edit))
        if not templates:
            continue
        own = longest_passage(item_forms, [form(w) for w in part], least, per_edit) if len(set(place[a:b].tolist())) >= min(TEMPLATE_WINDOWS, max(1, len(item) - WINDOW + 1)) else 0
        if own > template:
            template = own
            # Windows that stand on the way that most of them share; others repeat words of the item elsewhere.
            shift = at[a:b] - place[a:b]
            main = np.abs(shift - np.median(shift)) <= max(2, len(item) // per_edit)
            there: dict[str, set[str]] = {}
            back: dict[str, set[str]] = {}
            for i, j in {(p + k, q + k) for q, p in zip(at[a:b][main], place[a:b][main], strict=True) for k in range(WINDOW)}:
                if item_forms[i][0] == "<":
                    there.setdefault(item[i], set()).add(words[j])
                    back.setdefault(words[j], set()).add(item[i])
            steady = all(len(x) == 1 for x in (*there.values(), *back.values()))
    return passage, template, steady


def leaks(documents: DataFrame, items: DataFrame, least: int = 15, per_edit: int = 10, templates: bool = True) -> DataFrame:
    """(doc_id, item_id, passage_words, template_words, reparameterised): documents that share a passage, or the template
    of a passage, with evaluation items.

    passage_words is the length of the longest passage of the item, a closing stock instruction aside, of at least
    ``least`` words with at most one word in ``per_edit`` replaced, dropped or added; 0 where there is none. template_words
    is the same of the template forms. reparameterised tells the documents that hold the template but not the words, with
    slots that agree; those whose slots contradict each other, and hold no passage either, have no row. Without
    ``templates`` only pairs whose slots agree in windows enough for a passage are aligned, and only their words:
    template_words is 0 then, and nothing is reparameterised. Items shorter than
    ``least`` words must be contained whole; those of less than ``WINDOW`` words have no window and no row. Letter case,
    punctuation, invisible characters, line breaks, line prefixes and markup do not count. Null, empty and blank texts on
    either side give no row. Rows of one id count by their best text. The corpus is read once for the windows and once
    more for the documents of candidate pairs, whatever the number of items; the result doesn't depend on their order.
    """
    spark = documents.sparkSession
    own = checkpointed(item_words(items).withColumn("item", F.xxhash64("item_id", "words")))
    names = spark.sparkContext.broadcast(_bitmap(own.select(F.explode("names").alias("h")), NAME_BITS))
    forms = lambda: Forms(names.value)
    windows = checkpointed(_item_windows(own.select("item_id", "item", "words"), forms))
    wanted = spark.sparkContext.broadcast(_bitmap(windows.select("window"), WINDOW_BITS))
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null").withColumn("doc", F.xxhash64("doc_id", "text"))

    def search(batches):
        known = forms()
        for pdf in batches:
            docs, doc_ids = pdf["doc"].to_numpy(), pdf["doc_id"].to_numpy()
            for start, part in _slices(pdf["text"].tolist(), 6 * WORDS_AT_ONCE):
                rows = [words_of(t) for t in part]
                sizes = np.fromiter(map(len, rows), np.int64, len(rows))
                template, raw = known.of([w for row in rows for w in row])
                ends, raws = np.cumsum(sizes), _windows(raw)
                keys = _windows(template)
                # Names that no item has become placeholders too; both forms are looked up, as an item may not have them.
                own = [w in new for t, row in zip(part, rows, strict=True) for new in (inner_names(t),) for w in row]
                named = _windows(np.where(np.array(own, bool), np.uint64(_digest("<name>")), template))
                both = (keys, np.arange(len(keys))), (named, np.flatnonzero(named != keys))
                for windows_, at in both:
                    hit = at[wanted.value.has(windows_[at])]
                    of = np.searchsorted(ends, hit, side="right")
                    inside = hit + WINDOW <= ends[of]
                    hit, of = hit[inside], of[inside]
                    yield pd.DataFrame({"window": _signed(windows_[hit]), "doc_id": doc_ids[start + of], "doc": docs[start + of], "at": (hit - ends[of] + sizes[of]).astype("int32"), "doc_raw": _signed(raws[hit])})

    hits = checkpointed(texts.mapInPandas(skipping_empty(search), "window long, doc_id long, doc long, at int, doc_raw long"))
    met = spread_join(hits, windows, "window").groupBy("doc", "item").agg(
        F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("n_words").alias("n_words"),
        F.count_if(F.col("raw") == F.col("doc_raw")).alias("same"), F.count("*").alias("n"), F.collect_list(F.struct("at", "place")).alias("hits"),
    )
    # What a passage or the template of one has at least; an item of less than ``least`` words by the windows it has.
    long = F.col("n_words") >= least
    enough = F.col("same") >= F.when(long, RUN_WINDOWS).otherwise(1)
    pairs = checkpointed(met.where((enough | (F.col("n") >= TEMPLATE_WINDOWS) | ~long) if templates else enough))
    named = texts.join(bounded_broadcast(pairs.select("doc").distinct()), "doc", "left_semi").select("doc", "text").dropDuplicates(["doc"])
    both = pairs.join(named, "doc")
    both = spread_join(both, own.select("item", "words").dropDuplicates(["item"]), "item")
    both = both.select("doc_id", "item_id", "text", "words", "hits", enough.alias("exact")).repartition(blocks(spark))

    def check(batches):
        known = forms()
        for pdf in batches:
            out = []
            for doc_id, item_id, text, words, hits, exact in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["words"], pdf["hits"], pdf["exact"], strict=True):
                own = inner_names(text)
                form = lambda w, own=own: "<name>" if w in own else known.form(w)
                passage, template, steady = compare(list(words), words_of(text), [(h["at"], h["place"]) for h in hits], form, exact, templates, least, per_edit)
                if passage or (template and steady):
                    out.append((doc_id, item_id, passage, template, not passage))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "passage_words", "template_words", "reparameterised"])

    found = both.mapInPandas(skipping_empty(check), "doc_id long, item_id long, passage_words int, template_words int, reparameterised boolean")
    return found.groupBy("doc_id", "item_id").agg(F.max("passage_words").alias("passage_words"), F.max("template_words").alias("template_words"), F.min("reparameterised").alias("reparameterised"))
