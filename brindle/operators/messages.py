"""Message analytics: scores, follow-ups, interval conflicts, streaks and message templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.timestamps import utc_us
from brindle.operators.instants import with_clock
from brindle.functions.text import ARCHIVE_SUBJECTS, HIGH_SIGNAL_TAGS, URGENT_PHRASES, any_of, bigrams, fingerprint, jaccard, template

DAY = 86_400


@dataclass(frozen=True)
class TriageConfig:
    """Settings of ``triage``; senders match as parts of the id (or, without one, of the name)."""

    high_senders: tuple[str, ...] = ()
    low_senders: tuple[str, ...] = ()
    high_tags: tuple[str, ...] = HIGH_SIGNAL_TAGS
    archive_subjects: tuple[str, ...] = ARCHIVE_SUBJECTS


def triage(messages: DataFrame, now: float, config: TriageConfig = TriageConfig()) -> DataFrame:
    """Messages with ``score`` (0 to 100) and ``category``.

    A column ``at`` gives the epoch seconds of each message (``timed`` makes it of mixed spellings); without it received_at
    is read as such. Null, 0 and other values count as now. The category follows the score before it is bounded; a
    high-signal sender with a question gets at least respond_today. Null columns count as empty.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    sender = F.lower(F.coalesce(F.nullif("from_id", F.lit("")), F.col("from"), F.lit("")))
    contains = lambda names: F.lit(False) if not names else F.exists(F.array(*map(F.lit, map(str.lower, names))), lambda s: F.contains(sender, s))
    high, low_sender = contains(config.high_senders), contains(config.low_senders)
    tags = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.lower(F.coalesce(x, F.lit(""))))
    question = F.contains(low("snippet"), F.lit("?"))
    at = F.coalesce(F.nullif(F.col("at" if "at" in messages.columns else "received_at").try_cast("double"), F.lit(0.0)), F.lit(now))
    hours = F.greatest(F.lit(0.0), (F.lit(now) - at) / 3600)
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    raw = (
        F.lit(30)
        + points(high, 25)
        + points(low_sender, -20)
        + points(F.coalesce("is_dm", F.lit(False)), 10)
        + points(F.arrays_overlap(tags, F.array(*map(F.lit, map(str.lower, config.high_tags)))), 15)
        + points(F.concat(low("subject"), F.lit("\n"), low("snippet")).rlike(any_of(URGENT_PHRASES)), 20)
        + points(question, 10)
        + points(low("subject").rlike("(?i)" + "|".join(f"(?:{p})" for p in config.archive_subjects)), -30)
        + F.when(hours < 2, 5).when(hours > 48, -10).otherwise(0)
    )
    plain = F.when(F.col("_raw") >= 70, "respond_now").when(F.col("_raw") >= 50, "respond_today").when(F.col("_raw") >= 30, "read_only").otherwise("archive")
    scored = messages.withColumn("_raw", raw).withColumn("_bump", high & question)
    category = F.when(F.col("_bump") & (F.col("_raw") < 50), "respond_today").otherwise(plain)
    return scored.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.col("_raw")))).withColumn("category", category).drop("_raw", "_bump")


def timed(messages: DataFrame, clock: DataFrame) -> DataFrame:
    """Messages with ``at``: epoch seconds of received_at in any spelling, by the clock of the channel; null if it is none."""
    return with_clock(messages, clock).withColumn("at", utc_us("received_at", "_zone", "_order") / 1e6).drop("_zone", "_order")


def ranked(scored: DataFrame, order: str = "ordinal") -> DataFrame:
    """Scored messages by score, the best first; equal ones in the order of a column that keeps their arrival."""
    return scored.orderBy(F.desc("score"), order)


def preflight(scored: DataFrame, today: int = 3) -> DataFrame:
    """What a sweep drafts: all respond_now messages and the best few of respond_today, a top-k report."""
    return scored.where("category = 'respond_now'").unionByName(top_per_category(scored.where("category = 'respond_today'"), today).drop("place"))


def follow_ups(sent: DataFrame, now: float, least: float = 5, most: float = 21, cooldown: float = 7) -> DataFrame:
    """Sent items with ``reason`` (null: stale, to be followed up), ``age_days`` and ``score`` (null unless stale).

    sent: sent_at, last_inbound_at, is_internal, already_nudged_at, in epoch seconds. Reasons in this order: no sent_at,
    too recent, too old, internal, already replied, recently nudged. Null and 0 count as missing.
    """
    time = lambda c: F.nullif(c, F.lit(0.0))
    age = (F.lit(now) - time("sent_at")) / DAY
    reason = (
        F.when(time("sent_at").isNull(), "no sent_at")
        .when(age < least, "too recent")
        .when(age > most, "too old")
        .when(F.coalesce("is_internal", F.lit(False)), "internal")
        .when(time("last_inbound_at") >= time("sent_at"), "already replied")
        .when((F.lit(now) - time("already_nudged_at")) < cooldown * DAY, "recently nudged")
    )
    out = sent.withColumn("reason", reason).withColumn("age_days", age)
    return out.withColumn("score", F.when(F.col("reason").isNull(), F.least(F.lit(100.0), F.lit(40) + (F.col("age_days") - least) * 6).cast("int")))


def follow_up_report(sent: DataFrame, now: float, top: int = 25, order: str = "ordinal", **rules) -> tuple[DataFrame, DataFrame]:
    """(report, counts): the stale items with the highest (score, age to a tenth of a day), ties in their order of arrival, a
    top-k report; and one row (n_stale, n_skipped) over all items."""
    judged = follow_ups(sent, now, **rules)
    stale = judged.where("reason is null").withColumn("age_days", F.round("age_days", 1)).drop("reason")
    counts = judged.agg(F.count_if(F.col("reason").isNull()).alias("n_stale"), F.count_if(F.col("reason").isNotNull()).alias("n_skipped"))
    return stale.orderBy(F.desc("score"), F.desc("age_days"), order).limit(top), counts


#: Levels of buckets that intervals are dealt into; each is four times as wide as the one before.
LEVELS = 20


def conflicts(windows: DataFrame, events: DataFrame, bucket: int = 3600, ignore: DataFrame | None = None) -> DataFrame:
    """(window_id, event_id): events that overlap a window, half-open; a window or event that ends before it starts, or
    without times, conflicts with nothing, an event of no length only strictly inside. Pairs of ``ignore`` (window_id,
    event_id) are left out, such as the event that a window is about.

    windows: (window_id, start, end), events: (event_id, start, end) in seconds. An interval lies in the level of buckets
    that are as wide as itself, so in two buckets at most however long it is, and is looked up from the levels of longer
    ones. The join is by equality; a pair is reported in the bucket of its later start only.
    """
    def levelled(df: DataFrame, name: str, kept: Column) -> DataFrame:
        own = df.select(name, F.col("start").alias(name + "_s"), F.col("end").alias(name + "_e")).where(kept)
        length = F.greatest(F.col(name + "_e") - F.col(name + "_s"), F.lit(1.0)) / bucket
        return own.withColumn("own", F.least(F.greatest(F.ceil(F.log(length) / F.log(F.lit(4.0))), F.lit(0)), F.lit(LEVELS)).cast("int"))

    def spread(df: DataFrame, name: str, levels: Column) -> DataFrame:
        at = lambda c: F.floor(F.col(name + c) / (bucket * F.pow(F.lit(4.0), F.col("level"))))
        return df.withColumn("level", F.explode(levels)).withColumn("bucket", F.explode(F.sequence(at("_s"), at("_e"))))

    w = levelled(windows, "window_id", F.col("start") < F.col("end"))
    e = levelled(events, "event_id", F.col("start") <= F.col("end"))
    tops = {name: df.agg(F.max("own")).first()[0] for name, df in (("w", w), ("e", e))}
    above = lambda least, top: F.sequence(F.col("own") + least, F.lit(top)) if top is not None else F.array().cast("array<int>")
    higher = lambda least, top: F.when(F.col("own") + least <= F.lit(-1 if top is None else top), above(least, top))
    one = spread(w, "window_id", F.array("own")).drop("own").join(spread(e, "event_id", higher(0, tops["w"])).drop("own"), ["level", "bucket"])
    two = spread(w, "window_id", higher(1, tops["e"])).drop("own").join(spread(e, "event_id", F.array("own")).drop("own"), ["level", "bucket"])
    size = bucket * F.pow(F.lit(4.0), F.col("level"))
    overlap = (F.col("event_id_s") < F.col("window_id_e")) & (F.col("event_id_e") > F.col("window_id_s"))
    first = F.col("bucket") == F.floor(F.greatest("window_id_s", "event_id_s") / size)
    found = one.unionByName(two).where(overlap & first).select("window_id", "event_id")
    return found if ignore is None else found.join(ignore.select("window_id", "event_id"), ["window_id", "event_id"], "left_anti")


def conflict_counts(windows: DataFrame, found: DataFrame) -> DataFrame:
    """(window_id, n_conflicts) of all windows; 0 where nothing overlaps."""
    counted = found.groupBy("window_id").agg(F.count("*").alias("n_conflicts"))
    return windows.select("window_id").distinct().join(counted, "window_id", "left").select("window_id", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))


def streaks(outcomes: DataFrame, threshold: int = 3) -> DataFrame:
    """(key, seq, streak, eligible): per key and row, how many outcomes were unchanged since the last other one.

    outcomes: (key, period, seq, unchanged), ``seq`` unique and ``period`` (such as the day) not falling with it. Rows
    are numbered within (key, period); only one row per (key, period) is carried over periods, so a key with very many
    rows is no single task.
    """
    inside = Window.partitionBy("key", "period").orderBy("seq")
    resets = F.sum(F.when(F.col("unchanged"), 0).otherwise(1)).over(inside)
    rows = outcomes.withColumn("_run", resets)
    rows = rows.withColumn("_local", F.sum(F.col("unchanged").cast("int")).over(Window.partitionBy("key", "period", "_run").orderBy("seq")))
    last = outcomes.groupBy("key", "period").agg(F.max(F.when(~F.col("unchanged"), F.col("seq"))).alias("_reset"), F.count("*").alias("_n"))
    tail = outcomes.join(last, ["key", "period"]).where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).groupBy("key", "period").agg(F.count("*").alias("_tail"))
    ends = last.join(tail, ["key", "period"], "left").select("key", "period", F.coalesce("_tail", F.lit(0)).alias("_tail"), F.col("_reset").isNotNull().alias("_broken"))
    order = Window.partitionBy("key").orderBy("period")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # The tails since the last period with a reset, that period's included.
    ends = ends.withColumn("_epoch", F.sum(F.col("_broken").cast("int")).over(order))
    ends = ends.withColumn("_carry", F.sum("_tail").over(Window.partitionBy("key", "_epoch").orderBy("period")))
    ends = ends.withColumn("_in", F.coalesce(F.last("_carry").over(before), F.lit(0))).select("key", "period", "_in")
    streak = F.col("_local") + F.when(F.col("_run") == 0, F.col("_in")).otherwise(0)
    joined = rows.join(ends, ["key", "period"])
    return joined.select("key", "seq", streak.cast("long").alias("streak"), (streak >= threshold).alias("eligible"))


def template_counts(texts: DataFrame) -> DataFrame:
    """(fingerprint, template, n_messages) of the templates of (text); null texts count as empty ones."""
    normal = template(F.col("text"))
    return texts.select(normal.alias("template")).groupBy("template").agg(F.count("*").alias("n_messages")).select(fingerprint(F.col("template")).alias("fingerprint"), "template", "n_messages")


def best_patterns(drafts: DataFrame, patterns: DataFrame, least: float = 0.85) -> DataFrame:
    """(draft, pattern, similarity): the pattern most like each draft, from ``least`` by shared word pairs.

    drafts: (draft), patterns: (pattern), both templates. An equal pattern wins, then the more similar, then the lesser
    one. Only the first ``(1 - least) * n + 1`` of a template's n pairs, rare ones first, are joined, which every match shares.
    Empty templates match each other only.
    """
    d0, p0 = (df.select(name).distinct().withColumn("pairs", bigrams(F.col(name))) for df, name in ((drafts, "draft"), (patterns, "pattern")))
    # Rare pairs first, by how many patterns hold them: hot pairs then come last in every template and are hardly joined.
    held = p0.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))

    def prefixed(df: DataFrame, name: str) -> DataFrame:
        pairs = df.select(name, F.explode("pairs").alias("pair")).join(held, "pair", "left")
        ordered = pairs.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("pair").alias("h")))).alias("o"))
        kept = F.greatest(F.lit(0), F.size("o") - F.ceil(F.size("o") * least - 1e-9).cast("int") + 1)
        return df.join(ordered.select(name, F.transform(F.slice("o", F.lit(1), kept), lambda x: x["h"]).alias("head")), name, "left")

    d, p = prefixed(d0, "draft"), prefixed(p0, "pattern")
    left = d.select("draft", F.col("pairs").alias("d_pairs"), F.explode("head").alias("h"))
    right = p.select("pattern", F.col("pairs").alias("p_pairs"), F.explode("head").alias("h"))
    near = left.join(right, "h").where((F.size("p_pairs") >= least * F.size("d_pairs") - 1e-9) & (F.size("d_pairs") >= least * F.size("p_pairs") - 1e-9))
    near = near.dropDuplicates(["draft", "pattern"]).withColumn("similarity", jaccard(F.col("d_pairs"), F.col("p_pairs"))).where(F.col("similarity") >= least)
    exact = d.join(p, F.col("draft") == F.col("pattern")).select("draft", "pattern", F.lit(1.0).alias("similarity"))
    both = near.select("draft", "pattern", "similarity").unionByName(exact)
    best = both.groupBy("draft").agg(F.min(F.struct((F.col("draft") != F.col("pattern")).alias("other"), (-F.col("similarity")).alias("s"), "pattern", "similarity")).alias("b"))
    return best.select("draft", "b.pattern", "b.similarity")


def category_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("category").agg(F.count("*").alias("n_messages"))


def top_per_category(scored: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best messages of each category: a top-k report, ties by id."""
    place: Column = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)
