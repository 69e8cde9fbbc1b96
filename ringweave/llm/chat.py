"""Chat formatting from an event log: partition by conversation, sort by sequence, fold, render.

An event is (conv_id, turn, message, seq, op, role, text), in any order of arrival. Events of a message are folded
in the order of ``seq``:

    message     opens a message with this role and text
    delta       adds text to the message that is open (streamed output)
    edit        puts this text in place of the message's
    regenerate  drops the message's text, which later deltas give anew
    delete      drops the message

The template marks turns so: ``<|im_start|>role\\n text <|im_end|>\\n`` (without the spaces).
"""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates, less their first character; none may stand in a text as it is.
_CONTROL = (
    r"\|[A-Za-z0-9_]+\|>",
    r"/?s>",
    r"/?INST\]",
    r"</?SYS>>",
    r"/?(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>",
)
_RAW = re.compile(rf"([<\[])(\\*)({'|'.join(_CONTROL)})")
_KEPT = re.compile(rf"([<\[])\\(\\*)({'|'.join(_CONTROL)})")


def escape(text: str) -> str:
    """``text`` with one backslash more after the first character of each control string.

    A control string may have any number of backslashes there already, so ``unescape`` gives every text back.
    """
    return _RAW.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _KEPT.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """As ``escape``; a role is one line, so line feeds (and backslashes) are written as escapes."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends there."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


_TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns; raises where something else stands between them."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def fold(events):
    """Messages (key, role, text) of events ((key), op, role, text) in order; holds one message at a time."""
    key = role = None
    parts: list[str] | None = None
    for own, op, who, text in events:
        if parts is not None and (own != key or op == "message"):
            yield key, role, "".join(parts)
            parts = None
        if op == "message":
            key, role, parts = own, who, [text]
        elif own != key or parts is None:
            continue  # there is no message to change
        elif op == "delta":
            parts.append(text)
        elif op == "edit":
            parts = [text]
        elif op == "regenerate":
            parts = []
        elif op == "delete":
            parts = None
        else:
            raise ValueError(f"no such event: {op}")
    if parts is not None:
        yield key, role, "".join(parts)


_TURNS = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]
)


def format_events(events: DataFrame, learn: tuple[str, ...] = ("assistant",), spread: bool = False) -> DataFrame:
    """Formatted turns of an event log (conv_id, turn, message, seq, op, role, text), one row each.

    conv_id, turn, nth (of the turn's messages, from 0), role, formatted, text_start and text_end (code points
    in ``formatted``), loss (whether that span is under the loss mask: roles in ``learn``). A conversation is its
    rows' ``formatted`` in the order of (turn, nth).

    The log is partitioned by conversation and sorted by turn, message and seq; each task folds its events one by
    one, holding one message, and the rows come out in that order. With ``spread`` it is dealt by ranges of
    (conv_id, turn) instead, which shares out a single long conversation. ``message``, a string, tells messages of
    one turn apart and orders them; a log without that column has one run of events for each turn.
    A null text or role counts as empty. A null conv_id
    is a conversation and a null turn a turn of it, before the others. Events with one ``seq`` are taken in the
    order of op, role and text, so repeated rows are repeated events. Changes to a message that isn't there have
    no effect; an unknown op is an error. An empty log gives no rows. Other columns are ignored, whatever their
    names.
    """
    ship_package(events.sparkSession)

    def run(batches):
        def rows():
            for batch in batches:
                conv, turn, message, op, role, text = (batch.column(k).to_pylist() for k in range(6))
                yield from zip(zip(conv, turn, message), op, role, text)

        out: list[tuple] = []
        size, last, nth = 0, None, 0
        for (conv, turn, _), role, text in fold(rows()):
            nth = nth + 1 if (conv, turn) == last else 0
            last = (conv, turn)
            formatted, a, b = render(role, text)
            out.append((conv, turn, nth, role, formatted, a, b, role in learn))
            size += len(formatted)
            if size > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _TURNS)], schema=_TURNS)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _TURNS)], schema=_TURNS)

    own = events.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        (F.col("message").cast("string") if "message" in events.columns else F.lit(None).cast("string")).alias("message"),
        F.col("seq").cast("long").alias("seq"),
        "op",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = own.repartitionByRange("conv_id", "turn") if spread else own.repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "message", "seq", "op", "role", "text")
    return ordered.select("conv_id", "turn", "message", "op", "role", "text").mapInArrow(
        run, "conv_id long, turn long, nth long, role string, formatted string, text_start long, text_end long, loss boolean"
    )


#: A streamed text comes in deltas of at least so many code points, and in so many deltas at most.
DELTA_CHARS, DELTAS = 64, 64


def conversation_events(conversations: DataFrame, streamed: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The log that finished conversations (conv_id, turn, role, text) would have left, latest events first.

    A turn of a role in ``streamed`` is opened empty, gets a draft, is regenerated and then streamed in deltas; a
    message beside it is withdrawn. Any other turn is sent with half its text and edited to the whole. Null texts and
    roles count as empty. Rows of one turn are messages in the order of the MD5 of role, line feed and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.concat(F.md5(F.concat(role, F.lit("\n"), text)), F.lit("-"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")).alias("message"),
    )

    def event(message, seq, op, role, text):
        return F.struct(
            message.alias("message"), F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else seq.alias("seq"), F.lit(op).alias("op"), role.alias("role"), text.alias("text")
        )

    own, none, n = F.col("message"), F.lit(None).cast("string"), F.length("text")
    size = F.greatest(F.lit(DELTA_CHARS), F.ceil(n / DELTAS)).cast("int")
    deltas = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda i: event(own, (i + 3).cast("long"), "delta", none, F.substring(F.col("text"), i * size + 1, size)),
    )
    beside = F.concat(own, F.lit("-withdrawn"))
    streams = F.concat(
        F.array(
            event(own, 0, "message", F.col("role"), F.lit("")),
            event(own, 1, "delta", none, F.concat(F.lit("Draft: "), F.left("text", F.lit(DELTA_CHARS)))),
            event(own, 2, "regenerate", none, none),
            event(beside, 0, "message", F.col("role"), F.lit("withdrawn")),
            event(beside, 1, "delete", none, none),
        ),
        deltas,
    )
    sent = F.array(
        event(own, 0, "message", F.col("role"), F.left("text", (n / 2).cast("int"))),
        event(own, 1, "edit", none, F.col("text")),
    )
    log = F.reverse(F.when(F.col("role").isin(*streamed), streams).otherwise(sent))
    return rows.select("conv_id", "turn", F.explode(log).alias("e")).select("conv_id", "turn", "e.*")


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def read_back(turns: DataFrame, in_order: bool = False) -> DataFrame:
    """What formatted conversations say, read from their template and loss mask alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A conversation's digests need its
    turns one after another, so it goes to one task, which holds one turn at a time. ``in_order``: the rows come so
    already, as from ``format_events``, and need not travel again.
    """

    def run(batches):
        out: list[tuple] = []
        now = None

        def done():
            out.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        for batch in batches:
            conv, formatted, a, b, loss = (batch.column(k).to_pylist() for k in range(5))
            for c, f, start, end, masked in zip(conv, formatted, a, b, loss):
                if now is None or now[0] != c:
                    if now is not None:
                        done()
                    now = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(f):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if masked:
                    text = unescape(f[start:end])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(f)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _DIGEST)], schema=_DIGEST)
                out = []
        if now is not None:
            done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _DIGEST)], schema=_DIGEST)

    ordered = turns if in_order else turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "nth")
    return ordered.select("conv_id", "formatted", "text_start", "text_end", "loss").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings: their event logs, folded, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    odd = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = spark.read.parquet(os.path.join(sf_dir, "conversations.parquet")).select("conv_id", "turn", "role", "text")
    return read_back(format_events(conversation_events(given.unionByName(odd))), in_order=True)


_SQL_CONTROL = "|".join(_CONTROL)
OP2_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)({_SQL_CONTROL})', '\1\\\2\3', 'g') AS body,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*)({_SQL_CONTROL})', '\1\\\2\3', 'g') AS name
  FROM said
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, md5(role || chr(10) || text))) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, md5(role || chr(10) || text))) AS loss_sha256,
  sum(length(body) + length(name) + {len(OPEN) + len(CLOSE) + 2})::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
