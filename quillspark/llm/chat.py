"""Chat formatting by event sourcing.

Logs are rows (conv_id, message, seq, kind, role, text). Events of one message are folded in the
order of seq: a task holds the message it is at, so a conversation of any length is spread over
tasks. Final messages are rendered by column expressions, one row each, and stay in rows; whoever needs a
conversation's digest streams over them in order.

    start       begins the message with its role
    delta       appends text
    edit        replaces the text so far
    regenerate  discards the text so far, and what follows is built anew
    delete      removes the message; a later event begins it again
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches

TURN, TEXT_END = "<|turn|>", "<|end|>\n"
#: Strings that common chat templates give a meaning. A backslash after the first character breaks them.
CONTROL = r"(<)(?=/?s>|\||</?SYS>>)|(\[)(?=/?INST\])"


def turns_as_events(turns: DataFrame, chunk: int = 512) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of a streaming chat: a start, then deltas of `chunk` characters.

    Each row is one message, repeated ones too; rows of one turn keep the order of the table.
    A null role or text counts as empty.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("message", F.monotonically_increasing_id())
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / chunk).cast("int") - 1)), lambda k: F.struct((k + 1).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.substr("text", k * chunk + 1, F.lit(chunk)).alias("text")))
    events = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), F.lit("").alias("text"))), parts)
    return rows.select("conv_id", "turn", "message", "role", F.explode(events).alias("e")).select("conv_id", "turn", "message", "e.seq", "e.kind", F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at: tuple | None = None
    now: dict | None = None
    done: list[tuple] = []

    def out() -> Iterator[pd.DataFrame]:
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "turn", "message", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "message": "Int64"})
            done.clear()

    for pdf in batches:
        for conv, turn, message, kind, role, text in zip(*(pdf[c] for c in ("conv_id", "turn", "message", "kind", "role", "text")), strict=True):
            key = tuple(None if pd.isna(x) else int(x) for x in (conv, turn, message))
            if key != at:
                if now is not None:
                    done.append((*at, now["role"], "".join(now["text"])))
                at, now = key, None
            if kind == "delete":
                now = None
                continue
            if now is None:
                now = {"role": "", "text": []}
            if role is not None and kind == "start":
                now["role"] = role
            if kind in ("edit", "regenerate"):
                now["text"] = []
            if text:
                now["text"].append(text)
        yield from out()
    if now is not None:
        done.append((*at, now["role"], "".join(now["text"])))
    yield from out()


def fold(events: DataFrame) -> DataFrame:
    """Events -> final messages (conv_id, turn, message, role, text); any id may be null.

    Events of equal seq are applied by kind (delete, regenerate, edit, start, delta), then by role and text, nulls first, so the result doesn't
    depend on the order of rows. Repeated events count repeatedly. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(events.sparkSession)
    dealt = events.repartition("conv_id", "turn", "message").withColumn("_rank", F.array_position(F.array(*map(F.lit, ("delete", "regenerate", "edit", "start", "delta"))), F.col("kind"))).sortWithinPartitions("conv_id", "turn", "message", "seq", "_rank", "role", "text")
    return dealt.select("conv_id", "turn", "message", "kind", "role", "text").mapInPandas(_fold, "conv_id long, turn long, message long, role string, text string")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1$2\\\\")


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Messages -> rows (conv_id, turn, message, formatted, loss_start, loss_length), in code points of formatted.

    formatted is <|turn|>, the role, a line break, the text, <|end|> and a line break. Backslashes in texts and
    roles are doubled, control strings get a backslash after their first character, line breaks in a role
    one before them. The loss mask is the text of trained roles, else of length 0.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head, text = F.concat(F.lit(TURN), role, F.lit("\n")), escape(F.col("text"))
    return messages.select(
        "conv_id", "turn", "message", F.concat(head, text, F.lit(TEXT_END)).alias("formatted"),
        F.length(head).alias("loss_start"), F.when(F.col("role").isin(*trained), F.length(text)).otherwise(F.lit(0)).alias("loss_length"),
    )


PIECE = re.compile(r"<\|turn\|>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!\|end\|>\n))*+)<\|end\|>\n", re.DOTALL)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at: object = batches
    state: list = []
    done: list[tuple] = []

    def end() -> None:
        if state:
            done.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def out() -> pd.DataFrame:
        rows, done[:] = list(done), []
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    for pdf in batches:
        for conv, formatted, start, length in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_start"], pdf["loss_length"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if conv != at:
                end()
                at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            m = PIECE.fullmatch(formatted)
            state[0] += 1
            state[1].update("".join(unescape(x) + "\n" for x in m.groups()).encode("utf-8", "surrogatepass"))
            loss = unescape(formatted[start : start + length])
            state[2] += len(loss)
            state[3].update(loss.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
        if done:
            yield out()
    end()
    if done:
        yield out()


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from rendered rows, in the order of turn and message: one row per conversation.

    conv_id, n_turns, turns_sha256 (role, line break, text, line break of each turn), loss_chars and
    loss_sha256 (the unescaped text under the loss mask), formatted_chars. A conversation is streamed
    through hashes, never held.
    """
    small_batches(formatted.sparkSession)
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_length").mapInPandas(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
