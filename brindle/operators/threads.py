"""Operators over message threads: rendering, last messages, topics, reply route, warnings and action items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import SENSITIVE_TERMS, any_of, collapsed

# Patterns of requests, commitments and deadlines, and phrases that void them.
REQUESTS = (
    r"\b(?:could|can|would|will)\s+you\s+([^?.!\n]{4,200})",
    r"\bplease\s+([a-z][^.!?\n]{3,200})",
    r"\b(?:do you mind|any chance you could|are you able to)\s+([^?.!\n]{4,200})",
    r"\bwe (?:need|have) to\s+([^.!?\n]{4,200})",
    r"\blet'?s\s+([a-z][^.!?\n]{3,200})",
)
COMMITMENTS = (r"\bi(?:'ll| will| am going to| plan to| intend to)\s+([^.!?\n]{4,200})", r"\blet me\s+([a-z][^.!?\n]{3,200})")
DEADLINE = (
    r"\b(?:by|before|due|no later than)\s+(today|tomorrow|tonight|(?:next |this )?(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*"
    r"|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}(?:st|nd|rd|th)?|\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?|\d{4}-\d{2}-\d{2}"
    r"|end of (?:day|week|month|quarter)|eo[dwmqy]|next week)"
)
LOOSE_DEADLINE = r"\b(?:deadline|due date|cut[- ]?off)\b[^.!?\n]{0,80}"
VOIDED = ("no need to", "you don't have to", "we don't need to", "ignore this", "this is just fyi", "no action required", "nothing required from you")
PLEASANTRIES = ("fyi ", "btw ", "cool ", "great ", "thanks ", "thank you")

_empty = lambda c: F.coalesce(c, F.lit(""))


def rendered(threads: DataFrame) -> DataFrame:
    """(id, text): each thread as plain text: subject, participants, then From, Date and body of each message, set off by
    a line of dashes. Null fields count as empty."""
    part = lambda m: F.concat_ws("\n", F.concat(F.lit("From: "), _empty(m["from"])), F.concat(F.lit("Date: "), _empty(m["date"])), _empty(m["body"]), F.lit("---"))
    head = F.concat(F.lit("Subject: "), _empty(F.col("subject")), F.lit("\nParticipants: "), F.concat_ws(", ", _empty_list("participants")))
    text = F.concat_ws("\n", head, F.array_join(F.transform(_messages(), part), "\n"))
    return threads.select("id", F.trim(text).alias("text"))


def _empty_list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _messages() -> Column:
    return F.coalesce(F.col("messages"), F.array().cast("array<struct<from:string,date:string,body:string>>"))


def last_messages(threads: DataFrame, n: int = 6) -> DataFrame:
    """(id, place, sender): the last ``n`` messages of each thread, in order; place counts from 0 within the thread."""
    m = _messages()
    start = F.greatest(F.size(m) - n, F.lit(0))
    kept = threads.select("id", start.alias("start"), F.posexplode(F.slice(m, start + 1, F.lit(n))).alias("i", "message"))
    return kept.select("id", (F.col("start") + F.col("i")).cast("int").alias("place"), F.col("message.from").alias("sender"))


def _last_body() -> Column:
    return _empty(F.try_element_at(_messages(), F.lit(-1))["body"])


def topics(threads: DataFrame) -> DataFrame:
    """(id, place, topic): up to three queries per thread: subject, intent, and the first 300 characters of the last body.

    Empty ones and repeats without letter case are left out. This prefix is the feature: a short search query.
    """
    body = F.substring(collapsed(_last_body()), 1, 300)
    listed = F.filter(F.array(_empty(F.col("subject")), _empty(F.col("user_intent")), body), lambda t: t != "")
    first = F.filter(listed, lambda t, i: ~F.exists(F.slice(listed, F.lit(1), i), lambda s: F.lower(s) == F.lower(t)))
    return threads.select("id", F.posexplode(first).alias("place", "topic"))


def routes(threads: DataFrame) -> DataFrame:
    """(id, route, reply_to): reply_all for three participants or more and a question in the last body, else reply; to
    the last sender, or nobody without messages."""
    asks = (F.size(_empty_list("participants")) >= 3) & F.contains(_last_body(), F.lit("?"))
    return threads.select("id", F.when(asks, "reply_all").otherwise("reply").alias("route"), _empty(F.try_element_at(_messages(), F.lit(-1))["from"]).alias("reply_to"))


def sensitive(threads: DataFrame) -> DataFrame:
    """(id) of threads whose last body names credentials or payment data."""
    return threads.where(F.lower(_last_body()).rlike(any_of(SENSITIVE_TERMS))).select("id")


def _sentences(body: Column) -> Column:
    """Sentences of a message on one line each, without empty ones."""
    parts = F.split(F.replace(_empty(body), F.lit("\r"), F.lit("")), r"(?U)(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, collapsed), lambda x: x != "")


def _found(line: Column, pattern: str) -> Column:
    """What the first group of a pattern matches, collapsed; empty where nothing does."""
    return collapsed(F.regexp_extract(line, "(?iU)" + pattern, 1))


def _deadline(line: Column) -> Column:
    near = _found(line, DEADLINE)
    loose = collapsed(F.regexp_extract(line, "(?iU)(" + LOOSE_DEADLINE + ")", 1))
    return F.coalesce(F.nullif(near, F.lit("")), F.nullif(loose, F.lit("")))


_ITEM = "struct<kind:string,text:string,deadline:string>"


def items(body: Column) -> Column:
    """Array of (kind, text, deadline): the requests, commitments and questions of a message, in order.

    A sentence with a voiding phrase gives none. A text that came before in the message is not repeated; a sentence that
    gave no new request or commitment counts as a question if it has a question mark and doesn't open with a pleasantry.
    """
    low = lambda c: F.lower(c)
    item = lambda kind, text, due: F.struct(kind.alias("kind"), text.alias("text"), due.alias("deadline"))

    def candidates(line: Column) -> Column:
        named = lambda kind, p: F.struct(F.lit(kind).alias("kind"), _found(line, p).alias("text"))
        return F.filter(F.array(*[named("request", p) for p in REQUESTS], *[named("commitment", p) for p in COMMITMENTS]), lambda x: x["text"] != "")

    def step(done: Column, s: Column) -> Column:
        met = lambda text, among: F.exists(among, lambda x: low(x["text"]) == low(text))
        new = F.filter(s["found"], lambda x, i: ~met(x["text"], done) & ~met(x["text"], F.slice(s["found"], F.lit(1), i)))
        asks = s["asks"] & ~met(s["asked"], done)
        question = F.when(asks, F.array(item(F.lit("direct_question"), s["asked"], s["due"]))).otherwise(F.array().cast(f"array<{_ITEM}>"))
        return F.concat(done, F.when(F.size(new) > 0, F.transform(new, lambda x: item(x["kind"], x["text"], s["due"]))).otherwise(question))

    def told(line: Column) -> Column:
        asks = F.contains(line, F.lit("?")) & ~low(line).rlike("^(?:" + any_of(PLEASANTRIES) + ")")
        return F.struct(asks.alias("asks"), candidates(line).alias("found"), _deadline(line).alias("due"), F.regexp_replace(line, r"\?+$", "").alias("asked"))

    # Only sentences that give anything go on to the fold.
    lines = F.filter(_sentences(body), lambda x: ~low(x).rlike(any_of(VOIDED)))
    giving = F.filter(F.transform(lines, told), lambda x: x["asks"] | (F.size(x["found"]) > 0))
    return F.aggregate(giving, F.array().cast(f"array<{_ITEM}>"), step)


def action_items(threads: DataFrame, user: str = "") -> DataFrame:
    """(id, msg_index, place, kind, text, owner, deadline): action items of every message, see ``items``.

    What is asked for is up to the reader: the user, or in the user's own messages their sender; what is promised, up to
    the other one. ``user`` is part of the user's address. Null and blank bodies have none.
    """
    rows = threads.select("id", F.posexplode(_messages()).alias("msg_index", "m"))
    mine = F.contains(F.lower(_empty(F.col("m.from"))), F.lit(user.lower())) if user else F.lit(False)
    rows = rows.select("id", "msg_index", mine.alias("mine"), F.posexplode(items(F.col("m.body"))).alias("place", "i"))
    owner = F.when((F.col("i.kind") == "commitment") == F.col("mine"), "user").otherwise("sender")
    return rows.select("id", "msg_index", "place", "i.kind", "i.text", owner.alias("owner"), "i.deadline")
