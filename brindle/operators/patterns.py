"""The pattern store: templates of approved messages with their counters, recipients and examples.

The store is a table of patterns, one of settings and a capped log. Recording is set-oriented: a batch of outcomes is
assigned to patterns (known ones first, then new ones by their template), and each pattern's counters follow from the
order of its outcomes. Which drafts may be sent without asking is a rule of business and left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.text import fingerprint, template
from brindle.operators.messages import best_patterns
from brindle.session import checkpointed, spread_join

PATTERN = (
    "id string, fingerprint string, template string, exemplars array<string>, recipients_seen array<string>, channel string, approved_unchanged_count long, "
    "approved_with_edit_count long, cancelled_count long, first_seen_at double, last_used_at double, eligible boolean"
)
RESULTS = ("sent_unchanged", "sent_with_edit", "cancelled")
#: Unchanged approvals in a row from which on a pattern is eligible, its similarity to a draft, and its examples.
THRESHOLD, SIMILARITY, EXEMPLARS = 3, 0.85, 5


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], PATTERN)


def matched(drafts: DataFrame, patterns: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Drafts (draft, body, ...) with ``template`` and the id and similarity of the pattern most like theirs, null without one.

    An equal template wins, then the more similar, then the lesser. Null bodies count as empty. If two patterns have one
    template the one with the lesser id counts.
    """
    own = drafts.withColumn("template", template(F.col("body")))
    known = patterns.groupBy("template").agg(F.min("id").alias("id"))
    best = best_patterns(own.select(F.col("template").alias("draft")).distinct(), known.select(F.col("template").alias("pattern")), least)
    found = best.join(known.select(F.col("template").alias("pattern"), F.col("id").alias("pattern_id")), "pattern").select(F.col("draft").alias("template"), "pattern_id", "similarity")
    return spread_join(own, found, "template", "left")


def recorded(outcomes: DataFrame, patterns: DataFrame, threshold: int = THRESHOLD, least: float = SIMILARITY) -> DataFrame:
    """The store after a batch of outcomes (seq, at, channel, recipient, body, result).

    ``seq`` orders them and is unique; results other than ``RESULTS`` are left out. An outcome belongs to the stored pattern
    most like it, else to a new one of its template, whose id is made of the fingerprint. An edit and a cancellation end
    the streak of unchanged approvals; recipients are appended once, in order; examples are those of the first outcome and
    of unchanged approvals, up to ``EXEMPLARS``. Patterns without outcomes keep their row, with eligibility as of ``threshold``.
    """
    rows = matched(outcomes.where(F.col("result").isin(*RESULTS)).withColumn("draft", F.col("seq")), patterns, least).drop("draft", "similarity")
    rows = checkpointed(rows.withColumn("id", F.coalesce("pattern_id", F.concat(F.lit("p_"), fingerprint(F.col("template"))))))
    unchanged = F.col("result") == "sent_unchanged"
    resets = rows.groupBy("id").agg(F.max(F.when(~unchanged, F.col("seq"))).alias("reset"))
    filled = F.nullif("body", F.lit(""))
    counted = spread_join(rows, resets, "id").groupBy("id").agg(
        F.first("reset").alias("reset"),
        F.count_if(unchanged & (F.col("reset").isNull() | (F.col("seq") > F.col("reset")))).alias("streak"),
        F.count_if(F.col("result") == "sent_with_edit").alias("edits"),
        F.count_if(F.col("result") == "cancelled").alias("cancels"),
        F.min_by(F.struct("template", "channel", "at", "body"), "seq").alias("f"),
        F.max_by("at", "seq").alias("used"),
    )
    # The first examples and recipients of each pattern: reduced before they are put in order.
    people = rows.where(F.col("recipient").isNotNull() & (F.col("recipient") != "")).groupBy("id", "recipient").agg(F.min("seq").alias("seq"))
    people = people.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "recipient"))), lambda x: x["recipient"]).alias("people"))
    order = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    examples = rows.where(unchanged & filled.isNotNull()).select("id", "seq", "body").withColumn("place", order).where(F.col("place") <= EXEMPLARS)
    examples = examples.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda x: x["body"]).alias("examples"))
    news = counted.join(people, "id", "left").join(examples, "id", "left")
    s = patterns.alias("s").join(news.alias("n"), "id", "full")
    none = F.array().cast("array<string>")
    known = F.col("s.template").isNotNull()
    begun = F.when(known, F.coalesce("s.exemplars", none)).otherwise(F.array(F.coalesce("n.f.body", F.lit(""))))
    streak = F.coalesce("n.streak", F.lit(0)) + F.when(F.col("n.reset").isNull(), F.coalesce("s.approved_unchanged_count", F.lit(0))).otherwise(0)
    return s.select(
        "id",
        F.coalesce("s.fingerprint", fingerprint(F.col("n.f.template"))).alias("fingerprint"),
        F.coalesce("s.template", "n.f.template").alias("template"),
        F.slice(F.concat(begun, F.coalesce("n.examples", none)), 1, EXEMPLARS).alias("exemplars"),
        F.array_union(F.coalesce("s.recipients_seen", none), F.coalesce("n.people", none)).alias("recipients_seen"),
        F.when(known, F.col("s.channel")).otherwise(F.col("n.f.channel")).alias("channel"),
        streak.cast("long").alias("approved_unchanged_count"),
        (F.coalesce("s.approved_with_edit_count", F.lit(0)) + F.coalesce("n.edits", F.lit(0))).cast("long").alias("approved_with_edit_count"),
        (F.coalesce("s.cancelled_count", F.lit(0)) + F.coalesce("n.cancels", F.lit(0))).cast("long").alias("cancelled_count"),
        F.when(known, F.col("s.first_seen_at")).otherwise(F.col("n.f.at")).alias("first_seen_at"),
        F.coalesce("n.used", "s.last_used_at").alias("last_used_at"),
        (streak >= threshold).alias("eligible"),
    )


def compared(drafts: DataFrame, patterns: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(draft, pattern_id, similarity, approved_unchanged_count, recipient_seen, same_channel) of drafts (draft, recipient,
    channel, body): how each stands to the pattern most like it. A missing recipient or channel agrees with any; without a
    pattern the id is null, the similarity 0 and the count 0."""
    own = checkpointed(matched(drafts, patterns, least))
    about = patterns.select(F.col("id").alias("pattern_id"), "approved_unchanged_count", "recipients_seen", F.col("channel").alias("_channel"))
    joined = spread_join(own, about, "pattern_id", "left")
    absent = lambda c: F.coalesce(c, F.lit("")) == ""
    seen = F.coalesce(F.array_contains("recipients_seen", F.col("recipient")), F.lit(False))
    same = F.coalesce(F.col("_channel") == F.col("channel"), F.lit(False))
    return joined.select(
        "draft", "pattern_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("approved_unchanged_count", F.lit(0)).alias("approved_unchanged_count"),
        (absent(F.col("recipient")) | seen).alias("recipient_seen"), (absent(F.col("channel")) | absent(F.col("_channel")) | same).alias("same_channel"),
    )


def listed(patterns: DataFrame) -> DataFrame:
    """Patterns as a report: counters, recipients, channel, times and a preview of 120 code points of the first example."""
    first = F.try_element_at("exemplars", F.lit(1))
    preview = F.when(first.isNotNull(), F.concat(F.substring(first, 1, 120), F.lit("…"))).otherwise("")
    return patterns.withColumn("preview", preview).drop("fingerprint", "template", "exemplars")


def with_threshold(patterns: DataFrame, threshold: int) -> DataFrame:
    """Patterns with eligibility by another threshold, at least 1."""
    if threshold < 1:
        raise ValueError("a threshold is at least 1")
    return patterns.withColumn("eligible", F.col("approved_unchanged_count") >= threshold)


def reset(patterns: DataFrame, pattern_id: str, threshold: int = THRESHOLD) -> DataFrame:
    """Patterns with one streak set to zero; a ``KeyError`` if there is no such pattern."""
    if patterns.where(F.col("id") == pattern_id).isEmpty():
        raise KeyError(pattern_id)
    streak: Column = F.when(F.col("id") == pattern_id, F.lit(0)).otherwise(F.col("approved_unchanged_count")).cast("long")
    return with_threshold(patterns.withColumn("approved_unchanged_count", streak), threshold)
