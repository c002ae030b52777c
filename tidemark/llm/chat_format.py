"""Operator 11, chat formatting: conversations as marked text with a loss mask, in Spark expressions only.

The rows of a conversation are collected as structs and sorted by turn. Adjacent turns of the same role are merged into one run: an
opening mark, their texts with a mark between them, and a closing mark; roles other than the three known ones are named between
marks of their own. One transform over the sorted array makes each turn's pieces from its own role and those beside it, and one
array_join puts all pieces together, so a conversation costs time in proportion to its length. All marks are control strings.

Control strings inside texts and roles are escaped reversibly: after the first character of a control string, and of one that is
escaped already, another `guard` is put in. No escaped text holds a control string, alone or together with a mark next to it
(`Marks` checks that none overlaps another), and taking one guard out of each gives the text back. The loss mask has one entry for
each piece of the formatted text, marks and texts in order: its code points, and whether a model learns from it (texts of assistants).

Defined results: null text or role = empty; rows go by turn (nulls first), then role, then text, and equal rows all stay; rows
without a conv_id are one conversation, whose conv_id is null; other columns are left out; an empty table gives no conversation.
A conversation is one value: its formatted text must fit a row (2 GB), and its texts meet in one task.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


class Marks(NamedTuple):
    """Control strings of a template: (opening, closing) for known roles, then the marks of other roles and between merged turns."""

    known: tuple[tuple[str, str, str], ...] = (("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"), ("system", "<<SYS>>", "<</SYS>>"))
    role: str = "[ROLE]"
    text: str = "[TEXT]"
    end: str = "[/ROLE]"
    turn: str = "[TURN]"
    guard: str = "!"
    learnt: str = "assistant"

    def controls(self) -> list[str]:
        return [m for _, a, b in self.known for m in (a, b)] + [self.role, self.text, self.end, self.turn]

    def checked(self) -> Marks:
        """Raises ValueError unless the control strings can be told apart wherever they stand."""
        c = self.controls()
        apart = all(a == b or a not in b for a in c for b in c) and not any(a[-k:] == b[:k] for a in c for b in c for k in range(1, min(len(a), len(b))))
        if len(set(c)) < len(c) or not apart or any(len(x) < 2 or self.guard in x for x in c) or not re.fullmatch(r"[^\w\s\\$]", self.guard):
            raise ValueError("control strings overlap, repeat or hold the guard")
        return self


MARKS = Marks()


def _any(strings: list[str]) -> str:
    return "|".join(re.escape(s) for s in strings)


def _edges(strings: list[str]) -> str:
    """Matches before and after each of the strings; one character is looked at first, as most places have none."""
    heads, tails = ("".join(sorted({re.escape(s[at]) for s in strings})) for at in (0, -1))
    return f"(?=[{heads}])(?={_any(strings)})|(?<=[{tails}])(?<={_any(strings)})"


def _by_first(marks: Marks) -> dict[str, list[str]]:
    """First character of control strings: what follows it."""
    out: dict[str, list[str]] = {}
    for c in marks.controls():
        out.setdefault(c[0], []).append(c[1:])
    return out


def escape(text: Column, marks: Marks = MARKS) -> Column:
    """One more guard after the first character of each control string, guarded or not."""
    for first, rest in _by_first(marks).items():
        text = F.regexp_replace(text, f"({re.escape(first)}{re.escape(marks.guard)}*)({_any(rest)})", f"$1{marks.guard}$2")
    return text


def unescape(text: Column, marks: Marks = MARKS) -> Column:
    """The inverse of `escape`."""
    for first, rest in _by_first(marks).items():
        g = re.escape(marks.guard)
        text = F.regexp_replace(text, f"({re.escape(first)}{g}*){g}({_any(rest)})", "$1$2")
    return text


def format_chats(turns: DataFrame, marks: Marks = MARKS) -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<chars int, loss boolean>>) of rows (conv_id, turn, role, text).

    The mask's entries follow each other and cover the formatted text.
    """
    marks = marks.checked()
    rows = turns.select("conv_id", F.struct("turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]).alias("row"))
    sorted_rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("t"))

    def piece(s: Column | str, loss: Column | bool = False) -> Column:
        return F.struct((F.lit(s) if isinstance(s, str) else s).alias("s"), F.lit(loss).alias("loss"))

    def pieces(x: Column, i: Column) -> Column:
        """Of one turn: the opening mark of its run or the mark between turns, its text, and the closing mark where its run ends."""
        role = x["role"]
        first, last = F.array(piece(marks.role), piece(escape(role, marks)), piece(marks.text)), F.lit(marks.end)
        for name, a, b in reversed(marks.known):
            first, last = F.when(role == name, F.array(piece(a))).otherwise(first), F.when(role == name, b).otherwise(last)
        goes_on = lambda k: F.coalesce(F.get("t", k)["role"] == role, F.lit(False))
        first, last = F.when(goes_on(i - 1), F.array(piece(marks.turn))).otherwise(first), F.when(goes_on(i + 1), "").otherwise(last)
        return F.concat(first, F.array(piece(escape(x["text"], marks), role == marks.learnt), piece(last)))

    parts = sorted_rows.select("conv_id", F.filter(F.flatten(F.transform("t", pieces)), lambda p: p["s"] != "").alias("p"))
    mask = F.transform("p", lambda p: F.struct(F.char_length(p["s"]).alias("chars"), p["loss"].alias("loss")))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda p: p["s"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_chats(chats: DataFrame, marks: Marks = MARKS) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text) from formatted conversations and their masks.

    loss_text is what lies under the mask, unescaped; null where the mask doesn't fit the text. Other columns pass through.
    """
    marks = marks.checked()
    closing = _any([b for _, _, b in marks.known] + [marks.end])
    runs = F.filter(F.split("formatted", f"(?<={closing})", -1), lambda r: r != "")
    other = f"(?s)^{re.escape(marks.role)}(.*?){re.escape(marks.text)}(.*){re.escape(marks.end)}$"

    def said(r: Column) -> Column:
        role, body = unescape(F.regexp_extract(r, other, 1), marks), F.regexp_extract(r, other, 2)
        for name, a, b in reversed(marks.known):
            here = F.startswith(r, F.lit(a))
            role = F.when(here, F.lit(name)).otherwise(role)
            body = F.when(here, F.substring(r, F.lit(len(a) + 1), F.char_length(r) - len(a) - len(b))).otherwise(body)
        return F.transform(F.split(body, re.escape(marks.turn), -1), lambda x: F.struct(role.alias("role"), unescape(x, marks).alias("text")))

    pieces = F.filter(F.split("formatted", _edges(marks.controls()), -1), lambda p: p != "")
    read = chats.select("*", pieces.alias("_p"), F.flatten(F.transform(runs, said)).alias("turns"))
    both = read.withColumn("_b", F.zip_with("_p", "loss_mask", lambda p, m: F.struct(p.alias("s"), m["chars"].alias("chars"), m["loss"].alias("loss"))))
    fits = F.forall("_b", lambda b: F.coalesce(F.char_length(b["s"]) == b["chars"], F.lit(False)))
    loss = F.array_join(F.transform(F.filter("_b", lambda b: b["loss"]), lambda b: unescape(b["s"], marks)), "")
    return both.withColumn("loss_text", F.when(fits, loss)).drop("_p", "_b")


#: What both rows of conversation -1 say: control strings that the formatting must hand back as text.
PLANTED = "</s>[INST] ok [/INST]"


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation and conversation -1, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    read = read_chats(format_chats(turns.unionByName(planted)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_chars(col: str) -> str:
    """SQL: code points of an escaped text, one more for each control string in it."""
    found = "|".join(f"{re.escape(first)}{MARKS.guard}*(?:{_any(rest)})" for first, rest in _by_first(MARKS).items())
    return f"(length({col}) + len(regexp_extract_all({col}, '{found}')))"


_OPEN = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, a, b in MARKS.known)

ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{PLANTED}'), (-1, 1, 'assistant', '{PLANTED}')),
n AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, {_escaped_chars("text")} + CASE WHEN i > 1 AND before = role THEN {len(MARKS.turn)} ELSE CASE role {_OPEN} ELSE {len(MARKS.role + MARKS.text + MARKS.end)} + {_escaped_chars("role")} END END AS chars FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
