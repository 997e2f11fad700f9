"""Text functions as Spark columns: hashes, templates, sentences, tokens, and word lists of the message operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that a text is collapsed by, as one character class for Java and RE2 alike.
SPACE = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]"

# Phrases and patterns of the message operators.
URGENT_PHRASES = ("urgent", "asap", "blocker", "blocking", "by eod", "by end of day", "today", "right now", "deadline", "as soon as possible")
ARCHIVE_SUBJECTS = (r"^\[no-?reply\]", r"newsletter", r"weekly digest", r"^automatic reply")
HIGH_SIGNAL_TAGS = ("@me", "blocker", "urgent")
NEGATIONS = (" not ", " no ", " never ", " false", "isn't", "aren't", "don't", "doesn't", "won't", "cannot", "can't")
SENSITIVE_TERMS = ("wire", "iban", "ssn", "social security", "credit card", "password", "api key", "secret")
FILLERS = ("lol", "lmao", "haha", "btw", "tbh", "imo", "ngl", "lmk", "ty", "thx", "ttyl", "ofc", "fwiw", "iirc")
SIGN_OFFS = ("cheers", "thanks", "thank you", "ty", "regards", "best", "best regards", "kind regards", "warmly", "talk soon", "appreciate it")
GREETINGS = ("hi", "hey", "hello", "good morning", "good afternoon", "dear", "yo", "sup")
SIGNATURE_STARTS = ("sent from my", "get outlook for", "this email and any attachments", "confidentiality notice")
CONTRACTIONS = (
    "don't", "won't", "can't", "isn't", "aren't", "wasn't", "weren't", "couldn't", "shouldn't", "wouldn't", "haven't", "hasn't", "hadn't", "doesn't", "didn't", "mustn't", "needn't",
    "i'm", "i'll", "i've", "i'd", "you're", "you'll", "you've", "you'd", "he's", "she's", "it's", "we're", "we'll", "we've", "we'd", "they're", "they'll", "they've", "they'd",
    "that's", "there's", "here's", "what's", "where's", "who's", "how's", "let's",
)
EMOJI = r"[\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{27BF}]"
# The ordered substitutions of a message template.
TEMPLATE_STEPS = (
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<EMAIL>"),
    (r"(?U)https?://\S+", "<URL>"),
    (r"(?U)\b\d{4}-\d{2}-\d{2}\b", "<DATE>"),
    (r"(?U)\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b", "<DATE>"),
    (r"(?iU)\b\d{1,2}(?::\d{2})?\s?(?:am|pm)\b|\b\d{2}:\d{2}\b", "<TIME>"),
    (r"(?U)\b\d{4,}\b", "<NUM>"),
    (r"(?iU)\b(?:mon|tues?|wed(?:nes)?|thur?s?|fri|sat(?:ur)?|sun)(?:day)?\b", "<DAY>"),
    (r"(?iU)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b", "<MONTH>"),
)


def any_of(phrases: tuple[str, ...]) -> str:
    """A pattern that finds any of some literal phrases."""
    import re

    return "|".join(re.escape(p).replace("\\ ", " ").replace("'", "'") for p in phrases)


def collapsed(text: Column) -> Column:
    """White space runs to one space, none outside; null stays null."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def content_hash(text: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the collapsed, lower-cased text. Null gives null, blank the hash of ''."""
    return F.substring(F.sha2(F.lower(collapsed(text)), 256), 1, 32)


def source_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(key, 256), 1, 16))


def template(text: Column) -> Column:
    """Message template: addresses, links, dates, times, long numbers, days and months as placeholders, in this order;
    then lower case, punctuation to spaces, white space collapsed. Null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, placeholder in TEMPLATE_STEPS:
        out = F.regexp_replace(out, pattern, placeholder)
    return collapsed(F.regexp_replace(F.lower(out), r"(?U)[^\w\s<>]", " "))


def fingerprint(normal: Column) -> Column:
    return F.substring(F.sha2(normal, 256), 1, 24)


def bigrams(normal: Column) -> Column:
    """Set of adjacent word pairs, joined by a space; a single word pairs with nothing, no word gives an empty set."""
    words = F.filter(F.split(normal, " "), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) == 1, F.array(F.concat(words[0], F.lit(" ")))).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def lines_of(text: Column) -> Column:
    """Lines, split at any line break."""
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? followed by white space."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def has_negation(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(any_of(NEGATIONS)), F.lit(False))
