"""Repair of conversations whose turns are damaged, at the least cost, with an audit of the edits.

A conversation is sound if its roles' initials read ``(s?(ua)+)?``: nothing, or a system turn at most and then user and
assistant in turn. Edits: Keep a turn (0), Rerole it to user or assistant (1), Delete it (2), Insert an empty user or
assistant turn (5); a truncated turn that isn't deleted costs 5 more, and blank or duplicate turns have to be deleted.

The costs lie in layers, as the errors of approximate matching do in bit-parallel search: for each turn a word has, for
each cost above a base, the set of grammar states from which the rest can be accepted at that cost (four bits a layer,
sixteen layers). One step is a few shifts and masks of the word: an edit of cost c moves sets up by c layers. From any
state the rest costs at most ten more than from any other (two insertions lead from one to any other that counts), so
the layers above the base hold all that a cheapest repair can use, whatever the length of the conversation. The first
layer that holds the first state gives the cost; the bits then lead forward, least letter first, to the ASCII-least audit.
"""

from __future__ import annotations

import hashlib
import os
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from .quality_rules import SPACE

#: Costs of edits, and of a truncated turn that stays.
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn. 0 and 3 accept.
_S, _U, _A = 0x2222222222222222, 0x4444444444444444, 0x8888888888888888
_WORD = (1 << 64) - 1
#: What the conversation may go on with, from each state: its index in "ua", and the state after it.
_NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Words are kept at every so many turns, and made again between them.
STRIDE = 1024

FAULTS = ("", "blank", "duplicate", "truncated")
_INITIALS = "sua"


def code(initial: str, fault: str) -> int:
    """A turn as the repair sees it, in a byte: fault * 4 + place of the initial in "sua", 3 if none."""
    return FAULTS.index(fault) * 4 + (_INITIALS.find(initial) if initial else 3) % 4


def _before(word: int) -> int:
    """States from which the next turn of the grammar leads into the word's states."""
    after_user, after_assistant = word & _U, word & _A
    return after_user >> 2 | after_user >> 1 | after_user << 1 & _WORD | after_assistant >> 1


def _with_insertions(word: int, base: int) -> tuple[int, int]:
    while (more := (word | _before(word) << 4 * INSERT) & _WORD) != word:
        word = more
    while not word & 15:
        word >>= 4
        base += 1
    return word, base


_END = _with_insertions(0b1001, 0)


def _step(word: int, base: int, turn: int) -> tuple[int, int]:
    """The layers before a turn, from those after it."""
    fault, initial = turn >> 2, turn & 3
    to = word << 4 * DELETE
    if fault in (0, 3):
        extra = TRUNCATED if fault == 3 else 0
        to |= _before(word) << 4 * (RETYPE + extra)
        kept = (word & _S) >> 1 if initial == 0 else _before(word & _U) if initial == 1 else (word & _A) >> 1 if initial == 2 else 0
        to |= kept << 4 * extra
    return _with_insertions(to & _WORD, base)


def cheapest(turns: bytes) -> tuple[int, str]:
    """Least cost of repairing the turns (see ``code``), and the ASCII-least of the audits of that cost.

    Memory: a byte for each turn and two words for each ``STRIDE`` of them.
    """
    n = len(turns)
    words, bases = array("Q"), array("q")
    word, base = _END
    for k in range(n - 1, -1, -1):
        if (k + 1) % STRIDE == 0:
            words.append(word)
            bases.append(base)
        word, base = _step(word, base, turns[k])
    cost = base
    while not word >> 4 * (cost - base) & 1:
        cost += 1
    words.reverse()
    bases.reverse()
    audit: list[str] = []
    state, rest, at = 0, cost, 0
    for start in range(0, max(n, 1), STRIDE):
        end = min(start + STRIDE, n)
        layers = [(words[start // STRIDE], bases[start // STRIDE]) if end - start == STRIDE else _END]
        for k in range(end - 1, start - 1, -1):
            layers.append(_step(*layers[-1], turns[k]))
        layers.reverse()

        def can(k: int, to: int, costs: int) -> bool:
            word, base = layers[k - start]
            up = rest - costs - base
            return 0 <= up < 16 and bool(word >> 4 * up + to & 1)

        while at < end or end == n and rest:
            following = _NEXT[state][1]
            fault, initial = (turns[at] >> 2, turns[at] & 3) if at < n else (1, 3)
            extra = TRUNCATED if fault == 3 else 0
            role = {0: 1 if state == 0 else None, 1: 2 if state != 2 else None, 2: 3 if state == 2 else None, 3: None}[initial]
            if at < n and can(at + 1, state, DELETE):
                letter, costs, to, on = "D", DELETE, state, 1
            elif can(at, following, INSERT):
                letter, costs, to, on = "I", INSERT, following, 0
            elif fault in (0, 3) and role is not None and can(at + 1, role, extra):
                letter, costs, to, on = "K", extra, role, 1
            else:
                letter, costs, to, on = "R", RETYPE + extra, following, 1
            audit.append(letter)
            state, rest, at = to, rest - costs, at + on
    return cost, "".join(audit)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, absent: the rows after damage, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, which stays as ``absent`` to name its conversation; 1 empties the text; 2 takes its ``.!?``; 3 repeats
    it; 4 makes it the user's. Null roles and texts, and nulls in ``conv_id:turn``, are one space.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fate = F.crc32(F.encode(name, "UTF-8")) % 20
    role, text = (F.coalesce(c, blank) for c in ("role", "text"))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate == 0).alias("absent"),
        F.explode(copies).alias("copy"),
    )


def first_fault(text: Column, seen: Column) -> Column:
    """A turn's first fault: blank, duplicate (``seen``), truncated, or the empty string."""
    bare = F.rtrim(text, F.lit(SPACE))
    return F.when(bare == "", "blank").when(seen, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()), ("fault", pa.string()), ("given", pa.string()), ("role", pa.string()), ("text", pa.string())])
_TURN_TYPES = "conv_id long, turn long, edit string, cost long, fault string, given string, role string, text string"


def repair_turns(turns: DataFrame) -> DataFrame:
    """The edits of each conversation's cheapest repair in order, with the turns that it leaves.

    ``turns``: conv_id, turn, role, text, copy (which of equal rows), absent (the row only names its conversation).
    Returns conv_id, turn, edit (K, R, D, I; null for an absent row), cost, fault, given (the role before; null if
    inserted), role and text (after; null if deleted). Turns come by number, nulls first, then role, text, copy. A null
    conv_id is a conversation of its own; null roles and texts are one space. Extra columns are ignored, and an empty
    table gives an empty one.

    A conversation's repair depends on all its turns, so it is one task's, where it passes by twice in order: as a byte
    a turn, from which the edits are found, and then as its texts, one at a time. Texts travel once.
    """
    ship_package(turns.sparkSession)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copy", "absent")
    order = [F.asc_nulls_first("turn"), "role", "text", "copy"]
    # the window needs no exchange of its own: rows of a conversation are together
    seen = F.row_number().over(Window.partitionBy("conv_id", "absent", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    fault = F.when(F.col("absent"), "").otherwise(first_fault(F.col("text"), seen))
    judged = rows.repartition("conv_id").withColumn("fault", fault)
    twice = judged.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass")).where("pass = 1 OR NOT absent")
    ordered = twice.sortWithinPartitions(F.asc_nulls_first("conv_id"), "pass", *order)
    again = F.col("pass") == 1
    sent = ordered.select("conv_id", "pass", "absent", "fault", F.left("role", F.lit(1)).alias("initial"), F.when(again, F.col("turn")).alias("turn"), F.when(again, F.col("role")).alias("role"), F.when(again, F.col("text")).alias("text"))

    def run(batches):
        none = object()
        now, codes = none, bytearray()
        audit, at, state, left = None, 0, 0, 0
        out: list[tuple] = []

        def inserted():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                role, state = _NEXT[state]
                out.append((now, None, "I", INSERT, "", None, role, ""))
                at += 1

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for conv, again, absent, fault, initial, turn, role, text in zip(*columns):
                if now is none or conv != now:
                    now, codes, audit, at, state, left = conv, bytearray(), None, 0, 0, 0
                if not again:
                    codes.append(code(initial, fault))
                    continue
                if audit is None:
                    audit, left = cheapest(bytes(codes))[1], len(codes)
                if absent:
                    out.append((now, turn, None, 0, "", role, None, None))
                    continue
                inserted()
                edit = audit[at]
                at += 1
                left -= 1
                costs = (0 if edit == "D" or fault != "truncated" else TRUNCATED) + {"D": DELETE, "R": RETYPE, "K": 0}[edit]
                to, goes = role, state
                if edit == "R":
                    to, goes = _NEXT[state]
                elif edit == "K":
                    goes = 1 + _INITIALS.index(initial)
                out.append((now, turn, edit, costs, fault, role, None if edit == "D" else to, None if edit == "D" else text))
                state = goes
                if not left:
                    inserted()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _TURNS)], schema=_TURNS)
                out.clear()

    return sent.mapInArrow(run, _TURN_TYPES)


_SUMS = "gaps blank duplicate truncated illegal cost".split()
_SUMMARY = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in _SUMS), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repair_summary(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair_turns``, whose rows come in its order: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. A conversation of absent rows alone has zeros and an empty audit."""

    def run(batches):
        none = object()
        now, sums, audit, digest, lines = none, {}, [], None, 0
        least = most = last = previous = None
        distinct = 0
        out: list[tuple] = []

        def done():
            sums["gaps"] = most - least + 1 - distinct if distinct else 0
            out.append((now, *(sums[c] for c in _SUMS), "".join(audit), digest.hexdigest()))

        for batch in batches:
            for conv, turn, edit, cost, fault, given, role, text in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if now is none or conv != now:
                    if now is not none:
                        done()
                    now, sums, audit, digest, lines = conv, dict.fromkeys(_SUMS, 0), [], hashlib.sha256(), 0
                    least = most = last = previous = None
                    distinct = 0
                if edit is None:
                    continue
                audit.append(edit)
                sums["cost"] += cost
                if role is not None:
                    digest.update(("\n" * bool(lines) + f"{role}:{text}").encode())
                    lines += 1
                if edit == "I":
                    continue
                if fault:
                    sums[fault] += 1
                if previous is not None and previous + given[:1] not in ("su", "ua", "au"):
                    sums["illegal"] += 1
                previous = given[:1]
                if turn is not None:
                    least, most = turn if least is None else least, turn
                    distinct += turn != last
                    last = turn
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _SUMMARY)], schema=_SUMMARY)
                out = []
        if now is not none:
            done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _SUMMARY)], schema=_SUMMARY)

    return repaired.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in _SUMS) + ", audit string, repaired_sha256 string")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired."""
    given = spark.read.parquet(os.path.join(sf_dir, "conversations.parquet")).select("conv_id", "turn", "role", "text")
    return repair_summary(repair_turns(damaged(given)))


def _sql_moves() -> str:
    """The least (cost, audit, text) of each state, written as one string, which compares as they do in that order."""

    def plus(of: str, costs: str, letter: str, line: str = "''") -> str:
        # cost (9 digits), audit, a control character, repaired lines
        return (
            f"CASE WHEN {of} IS NULL THEN NULL ELSE lpad((left({of}, 9)::INTEGER + {costs})::VARCHAR, 9, '0') || substr(split_part({of}, chr(1), 1), 10) || '{letter}' || chr(1)"
            f" || substr({of}, strpos({of}, chr(1)) + 1) || {line} END"
        )

    said = "role || ':' || body || chr(10)"
    stays = "fault IN ('', 'truncated')"
    extra = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    retype = f"1 + {extra}"

    def to(state: int) -> str:
        ways = [plus(f"s{state}", "2", "D")]
        initial, sources, name = {1: ("s", (0,), ""), 2: ("u", (0, 1, 3), "user"), 3: ("a", (2,), "assistant")}.get(state, ("", (), ""))
        for k in sources:
            ways.append(f"CASE WHEN {stays} AND left(role, 1) = '{initial}' THEN {plus(f's{k}', extra, 'K', said)} END")
            if name:
                ways.append(f"CASE WHEN {stays} THEN " + plus(f"s{k}", retype, "R", f"'{name}:' || body || chr(10)") + " END")
        return f"least({', '.join(ways)}, NULL) AS s{state}"

    def inserted(of: str) -> str:
        user = ", ".join(plus(f"s{k}", "5", "I", "'user:' || chr(10)") for k in (0, 1, 3))
        return f"SELECT * REPLACE (least(s2, {user}) AS s2, least(s3, {plus('s2', '5', 'I', repr('assistant:') + ' || chr(10)')}) AS s3) FROM ({of})"

    step = f"SELECT r.conv, r.k, {', '.join(map(to, range(4)))} FROM walk w JOIN turns r ON r.conv = w.conv AND r.k = w.k + 1"
    first = "SELECT DISTINCT conv, 0 AS k, '000000000' || chr(1) AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM given"
    closed = [inserted(inserted(x)) for x in (first, step)]
    return " UNION ALL ".join(f"SELECT * FROM ({x})" for x in closed)


OP12_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS sums
), given AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), fated AS (
  SELECT g.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda k: ord(substr(name, k::INTEGER, 1))::BIGINT)),
    lambda x, y: xor(x // 256, sums[xor(x, y) % 256 + 1])), 4294967295) % 20 AS fate
  FROM given g, bits
), harmed AS (
  SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS body,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, body, copy) AS k FROM harmed
), turns AS (
  SELECT *, CASE WHEN NOT regexp_matches(body, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv, role, body ORDER BY k) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(body, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY k) || left(role, 1) AS pair
  FROM placed
), walk AS ({{moves}}
), ends AS (
  SELECT conv, least(s0, s3) AS best FROM walk WHERE true QUALIFY k = max(k) OVER (PARTITION BY conv)
), sums AS (
  SELECT conv, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, left(best, 9)::BIGINT AS cost,
  substr(split_part(best, chr(1), 1), 10) AS audit, sha256(left(substr(best, strpos(best, chr(1)) + 1), greatest(length(best) - strpos(best, chr(1)) - 1, 0))) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM given) c JOIN ends USING (conv) LEFT JOIN sums USING (conv)
""".replace("{moves}", _sql_moves())
