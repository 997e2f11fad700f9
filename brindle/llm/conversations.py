"""Conversations rebuilt from message rows.

Message rows are sorted by (conversation, time, id) over range partitions, so that one conversation may span many
partitions and no task ever holds a whole one. A finite-state automaton reads the turns in that order. As a slice of a
conversation doesn't know the state that it begins in, it is reduced to the map from each state to the one it leads to;
the maps of a conversation's slices are applied one after the other, and the state at the end decides whether it is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.timestamps import utc_us
from brindle.operators.instants import with_clock
from brindle.session import blocks, bounded_broadcast, checkpointed, skipping_empty

#: States: nothing said yet, only the owner or only the contact has spoken (a reply is missing), answered, broken.
SILENT, ASKED, TOLD, ANSWERED, BROKEN = range(5)
#: Events: a turn of the owner, a turn of the contact, a row without visible text, a row without time or sender.
USER, CONTACT, EMPTY, FAULT = range(4)
#: The state that each event leads to from each state. Empty rows change nothing, and nothing mends a broken conversation.
STEP = np.array([[ASKED, ASKED, ANSWERED, ANSWERED, BROKEN], [TOLD, ANSWERED, TOLD, ANSWERED, BROKEN], [SILENT, ASKED, TOLD, ANSWERED, BROKEN], [BROKEN] * 5], np.int8)
N_STATES = STEP.shape[1]


def visible(text: Column) -> Column:
    """Whether a text has any character that shows: not only white space, controls and zero-width marks."""
    return F.coalesce(text.rlike(r"[^\p{Z}\p{C}\s]"), F.lit(False))


def filled(text: Column) -> Column:
    return F.when(visible(text), F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")))


def is_owner(sender: Column, sender_id: Column, owner_id: Column, owner_name: Column) -> Column:
    """Whether the account's owner wrote a row. The id decides; without it the address in the sender, else the name in
    either order ("First Last" or "Last, First"), without letter case and repeated spaces."""
    one = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    name = one(owner_name)
    words = F.split(name, " ")
    reverse = F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    address = F.nullif(F.regexp_extract(one(sender), r"([^\s<>]+@[^\s<>]+)", 1), F.lit(""))
    shown = one(F.regexp_replace(sender, r'[<>"]', ""))
    by_name = F.coalesce(shown == name, F.lit(False)) | F.coalesce(shown == reverse, F.lit(False))
    owner = one(owner_id)
    return F.coalesce(filled(sender_id) == owner, address == owner, shown == owner, F.lit(False)) | (filled(sender_id).isNull() & address.isNull() & by_name)


def turns(messages: DataFrame, clock: DataFrame) -> DataFrame:
    """Ordered turns of whole conversations: (thread_id, turn, id, speaker_role).

    thread_id is trimmed and lower-cased; null and blank are no conversation. Rows of one id count once (the least row
    by its columns). Rows without visible text are left out first. A conversation is dropped if no row is left, if a row
    has no instant or neither sender nor sender id, or unless owner and contact both speak. ``turn`` counts from 1 by
    instant, then id. Ties in both can't occur, as ids are unique by then. Extra columns are ignored.
    """
    thread = F.nullif(F.lower(F.regexp_replace(F.col("thread_id"), r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", "")), F.lit(""))
    rows = messages.select("id", thread.alias("thread_id"), "channel", F.col("from").alias("sender"), F.col("from_id").alias("sender_id"), "received_at", "snippet")
    rows = rows.where(F.col("thread_id").isNotNull() & F.col("id").isNotNull())
    rows = rows.groupBy("id").agg(F.min(F.struct("thread_id", "channel", "sender", "sender_id", "received_at", "snippet")).alias("r")).select("id", "r.*")
    owners = clock.groupBy(F.lower(F.trim("channel")).alias("_own")).agg(F.min(F.struct("owner_id", "owner_name")).alias("_owner"))
    timed = with_clock(rows, clock).withColumn("at", utc_us("received_at", "_zone", "_order"))
    timed = timed.join(bounded_broadcast(owners), F.lower(F.trim("channel")) == F.col("_own"), "left")
    owned = is_owner(F.col("sender"), F.col("sender_id"), F.col("_owner.owner_id"), F.col("_owner.owner_name"))
    no_sender = ~visible(F.col("sender")) & ~visible(F.col("sender_id"))
    event = F.when(~visible(F.col("snippet")), EMPTY).when(F.col("at").isNull() | no_sender, FAULT).when(owned, USER).otherwise(CONTACT)
    slim = checkpointed(timed.select("thread_id", "id", "at", event.alias("event")))
    kept = numbered(slim).where(F.col("event") != EMPTY)
    return kept.select("thread_id", "turn", "id", F.when(F.col("event") == USER, "user").otherwise("contact").alias("speaker_role"))


def composed(steps: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Running composition of maps between states: row i leads from the state before its run to that after row i.

    ``place`` is each row's place in its run. Maps compose associatively, so runs are combined by doubling their length.
    """
    out, d = steps.copy(), 1
    while len(place) and d <= int(place.max()):
        at = np.flatnonzero(place >= d)
        out[at] = np.take_along_axis(out[at], out[at - d], axis=1)
        d *= 2
    return out


def _read_slices(batches):
    """Each row with its number among the turns of its conversation in this partition, and the map of the slice up to it
    as a number with a digit per state; rows arrive sorted."""
    from pyspark import TaskContext

    part, last, n, place, carried = TaskContext.get().partitionId(), None, 0, 0, None
    digits = N_STATES ** np.arange(N_STATES)
    for pdf in batches:
        if not len(pdf):
            continue
        ids, events = pdf["thread_id"].to_numpy(object), pdf["event"].to_numpy()
        run = np.r_[True, ids[1:] != ids[:-1]]
        start = np.flatnonzero(run)[np.cumsum(run) - 1]
        own = np.arange(len(ids)) - start
        maps = composed(STEP[events], own)
        turns = np.cumsum(events != EMPTY)
        turns = turns - (turns[start] - (events[start] != EMPTY))
        if ids[0] == last:
            first = start == 0
            maps[first] = maps[first][:, carried]
            turns, own = turns + first * n, own + first * place
        last, n, place, carried = ids[-1], int(turns[-1]), int(own[-1]) + 1, maps[-1]
        yield pd.DataFrame({"thread_id": ids, "id": pdf["id"].to_numpy(object), "event": events, "part": part, "place": own, "local": turns.astype("int32"), "leads": (maps @ digits).astype("int32")})


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of the conversations that end in the state ``ANSWERED``, with their ``turn`` within the conversation.

    Only the last row of each slice (one per partition and conversation) is shuffled by conversation, to give each slice
    its offset and the conversation its final state. Both come back by (conversation, partition), so a conversation with
    very many rows is joined in as many parts as it spans.
    """
    ordered = rows.repartitionByRange(blocks(rows.sparkSession), "thread_id", "at", "id").sortWithinPartitions("thread_id", "at", "id")
    schema = "thread_id string, id string, event int, part int, place long, local int, leads int"
    local = checkpointed(ordered.mapInPandas(skipping_empty(_read_slices), schema))
    slices = local.groupBy("thread_id", "part").agg(F.max_by(F.struct("local", "leads"), "place").alias("last")).select("thread_id", "part", "last.local", "last.leads")
    # A conversation has at most as many slices as there are partitions; the list of them is small.
    lists = slices.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("part", "local", "leads"))).alias("s"))
    follow = lambda state, x: (F.floor(x["leads"] / F.pow(F.lit(N_STATES), state)) % N_STATES).cast("int")
    lists = lists.where(F.aggregate("s", F.lit(SILENT), follow) == ANSWERED)
    before = lambda s: F.aggregate(F.filter(F.col("s"), lambda x: x["part"] < s["part"]), F.lit(0), lambda a, x: a + x["local"])
    offsets = lists.select("thread_id", F.explode(F.transform("s", lambda s: F.struct(s["part"].alias("part"), before(s).alias("offset")))).alias("o")).select("thread_id", "o.part", "o.offset")
    return local.join(offsets, ["thread_id", "part"]).withColumn("turn", (F.col("local") + F.col("offset")).cast("int"))
