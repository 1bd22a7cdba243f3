"""Chat formatting from event logs.

A log holds events (conv_id, seq, message, kind, role, text). `fold` sorts the events of a conversation by
sequence and makes final messages of them: deltas are appended, an edit replaces the text so far, a
regeneration empties it and takes back what was said after that message until then, a deletion takes the
message out. `render` writes each message between turn marks and says which characters count for the loss.

A conversation may hold any share of all rows: texts are folded by message, what regenerations take back is
found by a running minimum over keys only, and rendering is one row a message.

Control strings inside roles and texts are escaped by one more backslash between `<` and `|`, which can be
undone: `<|` becomes `<\\|`, and `<\\|` becomes `<\\\\|`.

Defined results: a null text counts as empty, a null role as an empty role; a null conversation is one
conversation, a null sequence number comes first. Events with equal sequence numbers are ordered by message,
kind, role and text. An empty log gives no messages. Columns other than the six are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
PIECE = 64  # code points of a delta in a log made from turns
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def turns_as_events(turns: DataFrame) -> DataFrame:
    """Events of a table (conv_id, turn, role, text): each row is one whole message, repeated rows too."""
    ties = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    return turns.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.struct(F.col("turn").alias("turn"), F.row_number().over(ties).alias("nth")).alias("message"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def turns_as_log(turns: DataFrame) -> DataFrame:
    """Events of a table (conv_id, turn, role, text) as a chat service logs them, which `fold` makes the turns of again.

    An answer is a draft of one delta and a follow-up to it, both taken back by a regeneration, then its text in
    deltas of PIECE characters. Every other turn is a message with the first piece, then an edit with the whole
    text. An empty or null text has no deltas after the regeneration.
    """
    ties = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select("conv_id", "turn", F.row_number().over(ties).alias("nth"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("pieces", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    start, nothing = F.coalesce(F.get("pieces", F.lit(0)), F.lit("")), F.lit(None).cast("string")

    def event(part: int, kind: str, role: Column, text: Column) -> Column:
        message = F.struct("turn", "nth", F.lit(part).alias("part"))
        return F.struct(message.alias("message"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    draft = F.array(
        event(0, "delta", F.col("role"), start), event(1, "message", F.lit("user"), start), event(0, "regenerate", nothing, nothing)
    )
    answer = F.concat(draft, F.transform("pieces", lambda piece: event(0, "delta", nothing, piece)))
    other = F.array(event(0, "message", F.col("role"), start), event(0, "edit", nothing, F.col("text")))
    log = F.when(F.col("role") == LOSS_ROLE, answer).otherwise(other)
    steps = rows.select("conv_id", "turn", "nth", F.posexplode(log).alias("step", "event"))
    return steps.select("conv_id", F.struct("turn", "nth", "step").alias("seq"), "event.*")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, message, role, text): final messages; seq is where a message first appeared."""
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "message").agg(F.min("seq").alias("seq"), F.sort_array(F.collect_list(event)).alias("log"))
    n = F.size("log")
    # the last event that sets the text anew; what it says and the deltas after it are the text
    resets = F.filter(F.sequence(F.lit(1), n), lambda i: F.get("log", i - 1)["kind"].isin("message", "edit", "regenerate"))
    logs = logs.withColumn("_at", F.coalesce(F.get(resets, F.size(resets) - 1), F.lit(1)))
    said = F.filter(F.slice("log", F.col("_at"), n), lambda e: e["kind"] != "regenerate")
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    messages = logs.select(
        "conv_id", "seq", "message",
        F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"),
        F.exists("log", lambda e: e["kind"] == "delete").alias("_deleted"),
    )
    back = taken_back(events)
    same = messages["conv_id"].eqNullSafe(back["_conv"]) & messages["message"].eqNullSafe(back["_message"])
    return messages.filter(~F.col("_deleted")).drop("_deleted").join(back, same, "left_anti")


def taken_back(events: DataFrame) -> DataFrame:
    """(_conv, _message) of messages that a later regeneration of an earlier message takes back.

    Events are folded to one row a message first: where it was first seen, and its last regeneration, which
    covers its earlier ones. Only conversations with a regeneration are looked at. A message first seen at
    `first` goes if, among the regenerations after it, the earliest target lies before it: a running minimum from
    the end, over two short rows a message and without texts.
    """
    place = F.struct("seq", "message")
    seen = events.groupBy(F.col("conv_id").alias("_conv"), F.col("message").alias("_message")).agg(
        F.min(place).alias("_first"), F.max(F.when(F.col("kind") == "regenerate", F.struct("seq"))).alias("_redone")
    )
    redone = seen.filter("_redone IS NOT NULL").select(F.col("_conv").alias("_its")).distinct()
    seen = seen.join(redone, F.col("_conv").eqNullSafe(F.col("_its")), "left_semi")
    target = F.when(F.lit(False), F.col("_first"))
    marked = seen.select("_conv", "_message", "_first", F.col("_first.seq").alias("seq"), target.alias("_target")).unionByName(
        seen.filter("_redone IS NOT NULL").select(
            "_conv", "_message", target.alias("_first"), F.col("_redone.seq").alias("seq"), F.col("_first").alias("_target")
        )
    )
    # in falling order, all rows of later sequence numbers come before
    later = W.partitionBy("_conv").orderBy(F.desc("seq")).rangeBetween(W.unboundedPreceding, W.currentRow)
    marked = marked.withColumn("_target", F.min("_target").over(later))
    return marked.filter("_first IS NOT NULL AND _target < _first").select("_conv", "_message")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, message, formatted, loss_start, loss_end): the formatted text of a conversation is what its
    messages give in order of (seq, message); the loss range is in code points of the message, null if none."""
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit(SEPARATOR))
    counts = F.col("role") == LOSS_ROLE
    return messages.select(
        "conv_id", "seq", "message",
        F.concat(head, text, F.lit(END)).alias("formatted"),
        F.when(counts, F.length(head)).alias("loss_start"),
        F.when(counts, F.length(head) + F.length(text)).alias("loss_end"),
    )


_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEPARATOR) + "(.*?)" + re.escape(END), re.DOTALL)
_ESCAPED = re.compile(r"<\\(\\*)\|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted text."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rendered: DataFrame) -> DataFrame:
    """(conv_id, counts and hashes) read back from the formatted text of each conversation.

    The messages of a conversation are hashed as they stream past in order; none is kept.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(state):
            conv, turns, all_turns, chars, loss, formatted = state
            return (conv, turns, all_turns.hexdigest(), chars, loss.hexdigest(), formatted)

        state = None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")]
            for conv, formatted, start, end in zip(*columns):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescaped(formatted[start:end])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(formatted)
            yield _rows(done, batch.schema.field("conv_id").type)
        if state is not None:
            yield _rows([closed(state)], batch.schema.field("conv_id").type)

    placed = rendered.select("conv_id", "seq", "message", "formatted", "loss_start", "loss_end").repartition("conv_id")
    return placed.sortWithinPartitions("conv_id", "seq", "message").drop("seq", "message").mapInArrow(hashed, f"conv_id {kind}, {DIGEST}")


def _rows(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", *[c.split()[0] for c in DIGEST.split(", ")]]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
