"""Readers: text, web pages, JSON documents, folders, calendars and, where their libraries exist, PDF and DOCX files."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import skipping_empty
from pyspark.sql import types as T

# Suffixes that a folder scan takes, and tags whose content is no text.
TEXT_SUFFIXES = ("md", "markdown", "txt", "rst")
PAGE_SUFFIXES = ("html", "htm")
BINARY_SUFFIXES = ("pdf", "docx")
SKIPPED_TAGS = frozenset(("script", "style", "noscript", "header", "footer", "nav"))

SCHEMAS = {
    "message": "id string, channel string, `from` string, from_id string, `to` array<string>, subject string, snippet string, received_at string, thread_id string, is_dm boolean, labels array<string>",
    "thread": "id string, thread_id string, channel string, subject string, participants array<string>, messages array<struct<`from`: string, date: string, body: string>>, user_intent string",
    "sent_item": "thread_id string, channel string, subject string, sent_at double, `to` array<string>, last_inbound_at double, is_internal boolean, already_nudged_at double",
    "draft": "channel string, thread_id string, recipient string, subject string, body string, warnings array<string>",
    "outcome": "channel string, thread_id string, action string, summary string, participants array<string>",
}


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Documents of a kind from JSON files that hold an array or an object each; broken files give rows of nulls.
    Outcomes need a summary; those without one are left out."""
    rows = spark.read.schema(SCHEMAS[kind]).json(path, multiLine=True)
    return rows.where(F.length(F.trim(F.coalesce("summary", F.lit("")))) > 0) if kind == "outcome" else rows


def read_sent_messages(spark: SparkSession, path: str) -> DataFrame:
    """Sent messages; ``to`` may be one recipient or an array of them."""
    raw = spark.read.schema("`to` string, channel string, sent_at string, subject string, body string").json(path, multiLine=True)
    many = F.from_json("to", "array<string>")
    return raw.withColumn("to", F.when(F.col("to").startswith("["), many).when(F.col("to").isNotNull(), F.array("to")).otherwise(F.array().cast("array<string>")))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(location, title, text, error) of all files of known kinds below a folder, one row each, in order of location.

    Files are read as bytes; text is UTF-8 with broken bytes replaced. A file that can't be read has a null text and its
    error; it stops no other file.
    """
    names = [s for s in TEXT_SUFFIXES + PAGE_SUFFIXES + BINARY_SUFFIXES]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(names) + "}").load(path)

    def run(batches):
        for pdf in batches:
            rows = []
            for place, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((place, extract(place.rpartition(".")[2].lower(), bytes(content)), None))
                except Exception as e:  # the file's own error is its result
                    rows.append((place, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["location", "text", "error"])

    return files.select("path", "content").mapInPandas(skipping_empty(run), "location string, text string, error string").withColumn("title", stem(F.col("location"))).orderBy("location")


def extract(suffix: str, content: bytes) -> str:
    """Text of a file's bytes."""
    if suffix == "pdf":
        return _pdf(content)
    if suffix == "docx":
        return _docx(content)
    text = content.decode("utf-8", "replace")
    return page_text(text) if suffix in PAGE_SUFFIXES else text


def _pdf(content: bytes) -> str:
    import io

    try:
        import pdfplumber
    except ImportError:
        from pypdf import PdfReader

        return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
    with pdfplumber.open(io.BytesIO(content)) as pages:
        return "\n\n".join(filter(None, (page.extract_text() for page in pages.pages)))


def _docx(content: bytes) -> str:
    import io

    import docx

    return "\n\n".join(p.text for p in docx.Document(io.BytesIO(content)).paragraphs if p.text.strip())


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED_TAGS:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.open and data.strip():
            self.parts.append(data.strip())


def page_text(page: str | None) -> str:
    """Text of an HTML page without scripts, styles, headers, footers and menus; pieces on lines of their own."""
    parser = _Page()
    parser.feed(page or "")
    parser.close()
    return "\n".join(parser.parts)


@F.pandas_udf(T.StringType())
def page_text_column(page: pd.Series) -> pd.Series:
    """``page_text`` of a column; null gives an empty text."""
    return page.map(lambda p: page_text(p if isinstance(p, str) else None))


def calendar_events(files: DataFrame) -> DataFrame:
    """Events of (location, content) iCalendar texts, one row per VEVENT: (location, place, uid, summary, status, location
    as venue, organizer, attendees, rrule, sequence, duration_raw, start, end, all_day, warnings).

    Folded lines are joined, times with Z or a known TZID become UTC, floating times and unknown zones count as UTC with
    a warning, dates start at midnight UTC. Of a property that comes twice the last one counts. Broken lines are skipped.
    """
    lines = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), r"\r?\n[ \t]", ""), r"\r?\n")
    whole = F.array_join(lines, "\n")
    parts = F.split(whole, r"(?m)^BEGIN:VEVENT\s*$")
    blocks = F.slice(parts, F.lit(2), F.size(parts))
    rows = files.select("location", F.posexplode(F.transform(blocks, lambda b: F.element_at(F.split(b, r"(?m)^END:VEVENT\s*$"), 1))).alias("place", "block"))

    def last(name: str, group: int) -> Column:
        return F.try_element_at(F.regexp_extract_all("block", F.lit(rf"(?m)^{name}((?:;[^:\n]*)?):(.*)$"), F.lit(group)), F.lit(-1))

    def plain(name: str) -> Column:
        return F.replace(F.replace(last(name, 2), F.lit("\\n"), F.lit("\n")), F.lit("\\,"), F.lit(","))

    mail = lambda c: F.regexp_replace(c, r"^mailto:", "")
    out = rows.select(
        "location", "place", last("UID", 2).alias("uid"), plain("SUMMARY").alias("summary"), plain("DESCRIPTION").alias("description"), plain("LOCATION").alias("venue"), last("STATUS", 2).alias("status"),
        mail(last("ORGANIZER", 2)).alias("organizer"), F.transform(F.regexp_extract_all("block", F.lit(r"(?m)^ATTENDEE(?:;[^:\n]*)?:(.*)$"), F.lit(1)), mail).alias("attendees"), last("RRULE", 2).alias("rrule"),
        last("SEQUENCE", 2).alias("sequence"), last("DURATION", 2).alias("duration_raw"), last("DTSTART", 1).alias("_sp"), last("DTSTART", 2).alias("_sv"), last("DTEND", 1).alias("_ep"), last("DTEND", 2).alias("_ev"),
    )
    start, end = calendar_time(F.col("_sp"), F.col("_sv")), calendar_time(F.col("_ep"), F.col("_ev"))
    all_day = F.coalesce(F.length(F.trim("_sv")) == 8, F.lit(False))
    floating = lambda p, v: F.coalesce((F.length(F.trim(v)) > 8) & ~F.trim(v).endswith("Z") & _zone(p).isNull(), F.lit(False))
    warnings = F.array_compact(F.array(F.when(floating(F.col("_sp"), F.col("_sv")), "start has no known zone"), F.when(floating(F.col("_ep"), F.col("_ev")), "end has no known zone")))
    return out.withColumn("start", start).withColumn("end", F.coalesce(end, start)).withColumn("all_day", all_day).withColumn("warnings", warnings).drop("_sp", "_sv", "_ep", "_ev")


@F.pandas_udf(T.StringType())
def _known_zone(name: pd.Series) -> pd.Series:
    """Names that are zones of the zone data, as they are; null for all others."""
    from zoneinfo import available_timezones

    known = available_timezones()
    return name.map(lambda n: n if n in known else None)


def _zone(params: Column) -> Column:
    """The TZID of parameters if there is such a zone, else null."""
    return _known_zone(F.regexp_extract(F.coalesce(params, F.lit("")), r'TZID="?([^;"]+)', 1))


def calendar_time(params: Column, value: Column) -> Column:
    """UTC timestamp of an iCalendar time; null where it is none. A zone that doesn't exist counts as UTC."""
    v = F.trim(value)
    day = F.to_timestamp(F.try_to_timestamp(v, F.lit("yyyyMMdd")))
    moment = F.try_to_timestamp(F.regexp_replace(v, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss"))
    zone = _zone(params)
    return F.when(F.length(v) == 8, day).when(v.endswith("Z") | zone.isNull(), moment).otherwise(F.to_utc_timestamp(moment, F.coalesce(zone, F.lit("UTC"))))


def first_event(events: DataFrame) -> DataFrame:
    """The first event of each file of ``calendar_events`` with ``extra_events``, how many more there are. A file without
    events has no row."""
    return events.groupBy("location").agg(F.min_by(F.struct(*[c for c in events.columns if c != "location"]), "place").alias("e"), (F.count("*") - 1).alias("extra_events")).select("location", "e.*", "extra_events")


def fetched_pages(pages: DataFrame) -> DataFrame:
    """(location, title, text, error) of (url, html) pages that something else has fetched: the title is that of the page or
    its address; a null page was not fetched and has an error."""
    title = F.nullif(F.trim(F.regexp_extract(F.col("html"), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return pages.select(F.col("url").alias("location"), F.coalesce(title, "url").alias("title"), F.when(F.col("html").isNotNull(), page_text_column(F.col("html"))).alias("text"), F.when(F.col("html").isNull(), "not fetched").alias("error"))
