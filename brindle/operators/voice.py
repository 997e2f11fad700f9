"""Writing-style aggregates over sent messages, over all of them and per recipient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import CONTRACTIONS, EMOJI, FILLERS, GREETINGS, SIGN_OFFS, SIGNATURE_STARTS, any_of, lines_of, sentences


def own_text(body: Column) -> Column:
    """A body up to the first quoted line, attribution or signature line; trailing white space cut. Null counts as empty."""
    lines = lines_of(body)
    low = lambda x: F.lower(F.trim(x))
    ends = lambda x: x.rlike(r"^\s*>") | (low(x).startswith("on ") & F.contains(low(x), F.lit(" wrote:"))) | low(x).rlike("^(?:" + any_of(SIGNATURE_STARTS) + ")")
    at = F.array_position(F.transform(lines, ends), True)
    kept = F.when(at > 0, F.slice(lines, F.lit(1), at - 1)).otherwise(lines)
    return F.rtrim(F.regexp_replace(F.array_join(kept, "\n"), r"\s+$", ""))


def _filled(text: Column) -> Column:
    return F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda x: x != "")


def greeting(text: Column) -> Column:
    """Opener of the first filled line if the whole line is a greeting, with " <name>" if it names someone; else null."""
    first = F.try_element_at(_filled(text), F.lit(1))
    pattern = rf"(?i)^({any_of(GREETINGS)})\b[\s,]*([\w \-]*?)[,.!]?$"
    opener, name = F.lower(F.regexp_extract(first, pattern, 1)), F.trim(F.regexp_extract(first, pattern, 2))
    return F.when(opener != "", F.when(name != "", F.concat(opener, F.lit(" <name>"))).otherwise(opener))


def sign_off(text: Column) -> Column:
    """The first closing formula among the last three filled lines of a text with two or more; else null."""
    filled = _filled(text)
    size = F.size(filled)
    tail = F.slice(filled, F.greatest(size - 2, F.lit(1)), F.lit(3))
    known = F.filter(F.transform(tail, lambda x: F.regexp_replace(F.lower(x), r"[,.!]+$", "")), lambda x: x.isin(*SIGN_OFFS))
    return F.when(size >= 2, F.try_element_at(known, F.lit(1)))


def features(messages: DataFrame) -> DataFrame:
    """Messages (id, body, ...) with the counts that a style is made of."""
    text = F.col("_text")
    words = lambda t: F.regexp_count(F.lower(t), F.lit(r"[a-z']+"))
    lengths = F.filter(F.transform(sentences(text), words), lambda n: n > 0)
    bullets = F.exists(_filled(text), lambda x: x.rlike(r"^(?:[-*•] |·|\d+[.)]\s)"))
    return (
        messages.withColumn("_text", own_text(F.col("body")))
        .withColumn("words", words(text).cast("long"))
        .withColumn("n_sentences", F.size(lengths).cast("long"))
        .withColumn("sentence_words", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n))
        .withColumn("emoji", F.regexp_count(text, F.lit(EMOJI)).cast("long"))
        .withColumn("contractions", F.regexp_count(F.lower(text), F.lit(rf"\b(?:{any_of(CONTRACTIONS)})\b")).cast("long"))
        .withColumn("bullets", bullets)
        .withColumn("em_dash", F.contains(text, F.lit("—")))
        .withColumn("greeting", greeting(text))
        .withColumn("sign_off", sign_off(text))
        .drop("_text")
    )


def profile(counted: DataFrame, *keys: str) -> DataFrame:
    """Style of all messages, or of each key: averages and rates, not rounded. An empty table gives one row of nulls
    without keys, none with keys."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return counted.groupBy(*keys).agg(
        F.count("*").alias("sample_count"),
        rate("words").alias("avg_words_per_message"),
        (F.sum("sentence_words") / F.nullif(F.sum("n_sentences"), F.lit(0))).alias("avg_words_per_sentence"),
        rate("emoji").alias("emoji_rate"),
        (F.sum("contractions") / F.greatest(F.sum("words"), F.lit(1))).alias("contraction_rate"),
        rate("bullets").alias("bullet_rate"),
        rate("em_dash").alias("em_dash_rate"),
    )


def per_recipient(messages: DataFrame, least: int = 5) -> DataFrame:
    """Style of each recipient with ``least`` messages or more. Recipients are compared without outer white space and
    letter case; blank ones are left out; one who is named twice in a message counts twice."""
    key = F.lower(F.trim("_to"))
    rows = features(messages).withColumn("_to", F.explode("to")).withColumn("recipient", key).where("recipient <> ''")
    return profile(rows, "recipient").where(F.col("sample_count") >= least)


def top_formulas(counted: DataFrame, column: str, k: int = 5) -> DataFrame:
    """(formula, n, share): the ``k`` most used values of a column, a top-k report; shares of all filled values."""
    totals = counted.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("formula")).agg(F.count("*").alias("n"))
    every = totals.agg(F.sum("n").alias("_all"))
    return totals.join(F.broadcast(every)).withColumn("share", F.col("n") / F.col("_all")).drop("_all").orderBy(F.desc("n"), "formula").limit(k)


def top_fillers(messages: DataFrame, k: int = 5) -> DataFrame:
    """(filler, n): the ``k`` filler words that most messages contain, a top-k report."""
    text = own_text(F.col("body"))
    present = F.filter(F.array(*map(F.lit, FILLERS)), lambda f: F.rlike(F.lower(text), F.concat(F.lit(r"\b"), f, F.lit(r"\b"))))
    return messages.select(F.explode(present).alias("filler")).groupBy("filler").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "filler").limit(k)


def profiles(messages: DataFrame, built_at: str, least: int = 5) -> DataFrame:
    """The profile store: a row for all messages (recipient null) and one for each recipient with ``least`` messages or more:
    (recipient, the style of ``profile``, channels, built_at); channels are the distinct filled ones, sorted."""
    counted = features(messages)
    named = F.array_sort(F.collect_set(F.nullif(F.trim("channel"), F.lit(""))))
    rows = counted.withColumn("_to", F.explode("to")).withColumn("recipient", F.lower(F.trim("_to"))).where("recipient <> ''")
    by = profile(rows, "recipient").where(F.col("sample_count") >= least).join(rows.groupBy("recipient").agg(named.alias("channels")), "recipient")
    every = profile(counted).join(counted.agg(named.alias("channels"))).withColumn("recipient", F.lit(None).cast("string"))
    return by.unionByName(every).withColumn("built_at", F.lit(built_at))


def injected(drafts: DataFrame, store: DataFrame) -> DataFrame:
    """Drafts (draft, recipient) with the style to write them in: ``scope`` is recipient, global where there is none of the
    recipient, or none without any profile; the rule against em dashes holds in any case.

    Recipients are compared without outer white space and letter case. There is one row per recipient in the store, so
    the join adds no rows.
    """
    style = [c for c in store.columns if c not in ("recipient", "built_at", "channels")]
    own = store.where("recipient is not null").select(F.col("recipient").alias("_key"), F.struct(*style).alias("_own"))
    whole = store.where("recipient is null").agg(F.first(F.struct(*style)).alias("_all"))
    joined = drafts.join(own, F.lower(F.trim("recipient")) == F.col("_key"), "left").join(F.broadcast(whole))
    scope = F.when(F.col("_own").isNotNull(), "recipient").when(F.col("_all").isNotNull(), "global").otherwise("none")
    return joined.select("draft", "recipient", scope.alias("scope"), F.coalesce("_own", "_all").alias("style"), F.lit(True).alias("no_em_dash"))


def profile_status(store: DataFrame) -> DataFrame:
    """(sample_count, n_recipients, channels, built_at): one row about the store."""
    whole = F.col("recipient").isNull()
    return store.agg(F.max(F.when(whole, F.col("sample_count"))).alias("sample_count"), F.count_if(~whole).alias("n_recipients"), F.max(F.when(whole, F.col("channels"))).alias("channels"), F.max("built_at").alias("built_at"))
