"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from brindle.llm.boilerplate import furniture_lines, main_body, web_chunks
from brindle.llm.conversations import turns
from brindle.llm.encoding import encode
from brindle.llm.leakage import leaks
from brindle.llm.near_duplicates import similar_groups, similar_pairs
from brindle.llm.personal import personal_items, personal_texts, redacted
from brindle.llm.quoting import message_rows, messages_of, new_text, paths, repeated_lines
from brindle.llm.subjects import SHARE, composition, shares
from brindle.session import table


def _messages(spark, d):
    return messages_of(table(spark, d, "sample_email_thread"), table(spark, d, "sent_messages"), table(spark, d, "channel_clock"))


def _message_rows(spark, d):
    return message_rows(table(spark, d, "sample_email_thread"), table(spark, d, "sent_messages"), table(spark, d, "channel_clock"))


def p1_found(spark, d):
    return repeated_lines(_message_rows(spark, d))


def p1_new_text(spark, d):
    return new_text(_message_rows(spark, d))


def p1_paths(spark, d):
    return paths(_message_rows(spark, d))


def p3_found(spark, d):
    return turns(table(spark, d, "sample_messages_for_triage"), table(spark, d, "channel_clock"))


def p4_found(spark, d):
    rows = table(spark, d, "chunks").select("chunk_id", "text").toDF("id", "text")
    return similar_pairs(rows, size=3, threshold=0.6).toDF("chunk_a", "chunk_b")


def p4_groups(spark, d):
    rows = table(spark, d, "chunks").select("chunk_id", "text").toDF("id", "text")
    return similar_groups(rows, size=3, threshold=0.6).toDF("chunk_id", "group_id", "n_links")


def p5_found(spark, d):
    return furniture_lines(web_chunks(table(spark, d, "chunks"), table(spark, d, "sources")))


def p5_body(spark, d):
    return main_body(web_chunks(table(spark, d, "chunks"), table(spark, d, "sources")))


def _personal(spark, d):
    return personal_texts(*(table(spark, d, t) for t in ("sample_messages_for_triage", "sent_messages", "sample_email_thread", "chunks")))


def p7_found(spark, d):
    return personal_items(_personal(spark, d))


def p7_redacted(spark, d):
    return redacted(_personal(spark, d))


def p8_ids(spark, d):
    return encode(table(spark, d, "documents"))


def p9_found(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), templates=False).select("doc_id", "item_id")


def p9_templates(spark, d):
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark, d):
    return shares(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects")).where(f"share >= {SHARE}").select("doc_id", "subject")


def p10_composition(spark, d):
    return composition(p10_found(spark, d))


QUERIES = {"p1_found": p1_found, "p1_new_text": p1_new_text, "p1_paths": p1_paths, "p3_found": p3_found, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_body": p5_body, "p7_found": p7_found, "p7_redacted": p7_redacted, "p8_ids": p8_ids, "p9_found": p9_found, "p9_templates": p9_templates, "p10_found": p10_found, "p10_composition": p10_composition}
#: Where SQL can express a query over whole tables.
SQL = {
    "p4_found": r"""
      WITH w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM chunks WHERE text IS NOT NULL),
        g AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id),
        c AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
      SELECT chunk_a, chunk_b FROM c JOIN n x ON x.chunk_id = chunk_a JOIN n y ON y.chunk_id = chunk_b WHERE c >= 0.6 * (x.n + y.n - c)""",
}
