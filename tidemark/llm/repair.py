"""Operator 13, conversation structure repair: the cheapest edits that give each conversation a legal sequence of roles.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Its rows are edited in order: Keep costs 0, Rerole to user
or assistant 1, Delete 2, Insert an empty turn of user or assistant 5; blank rows and repeated ones must be deleted, and a truncated
row that isn't deleted costs 5 more. A* searches the lattice of (rows done, role reached): the heuristic is the sum over the rows
left of what none of them can avoid, 2 for a mandatory deletion and 2 for a truncated row (its deletion, the cheaper way). It is
consistent, and nodes leave the heap by (cost + heuristic, audit), so the first legal end is the cheapest and, among equals, has the
audit (the edits' initials in order) that is least in ASCII. The role of each edit follows from the audit: what may come next is one
of user and assistant, except that a system turn may be kept in the first place.

Rows are shuffled twice: without texts to find the edits (a conversation is two bytes a row there, and its nodes), then with texts,
sorted behind the row that carries the conversation's edits. Tasks stream over both, so no conversation's texts are ever held.

Defined results: rows go by turn (nulls first), then role, then SHA-256 of the text, so equal rows are neighbours; null role or text
is one space; rows without a conv_id are one conversation; texts are equal if their SHA-256 is; other columns are left out; an empty
table gives no rows. A conversation without rows has zeros and an empty audit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The ASCII white space and the ends of sentences of the contract.
BLANK = r"^[\x20\x09-\x0D]*\z"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"
LEGAL = {"su", "ua", "au"}
_NAMES = {"u": "user", "a": "assistant"}
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FAULTS = {"b": "blank", "d": "duplicate", "t": "truncated"}


# --- the search --------------------------------------------------------------------------------------------------


class _Node:
    """An audit as a path in the tree of audits, so that two of them are compared without writing them out.

    `jump` points further up, as in a skew-binary list: the place where two audits part is found in a logarithmic number of steps.
    """

    __slots__ = ("up", "jump", "depth", "edit", "total", "cost", "row", "state")

    def __init__(self, up: _Node | None, edit: str, total: int, cost: int, row: int, state: str):
        self.up, self.edit, self.total, self.cost, self.row, self.state = up, edit, total, cost, row, state
        if up is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = up.depth + 1
            far = up.jump
            self.jump = far.jump if up.depth - far.depth == far.depth - far.jump.depth else up

    def __lt__(self, other: _Node) -> bool:
        if self.total != other.total:
            return self.total < other.total
        a, b = _at(self, min(self.depth, other.depth)), _at(other, min(self.depth, other.depth))
        if a is b:
            return self.depth < other.depth
        while a.up is not b.up:
            a, b = (a.up, b.up) if a.jump is b.jump else (a.jump, b.jump)
        return a.edit < b.edit


def _at(n: _Node, depth: int) -> _Node:
    while n.depth > depth:
        n = n.jump if n.jump.depth >= depth else n.up
    return n


def _next(state: str) -> str:
    """The role that may follow: state is the last role's initial, empty at the start."""
    return "a" if state == "u" else "u"


def repair(initials: str, faults: str) -> tuple[int, str]:
    """(cost, audit) for rows given by their roles' initials (any other character than s, u, a: illegal) and faults (b, d, t or a space)."""
    n = len(initials)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (min(DELETE, TRUNCATED) if faults[i] == "t" else DELETE if faults[i] != " " else 0)
    heap, done = [_Node(None, "", left[0], 0, 0, "")], set()
    while heap:
        node = heapq.heappop(heap)
        i, state = node.row, node.state
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ("", "a"):
            return node.cost, _audit(node)
        after = _next(state)
        steps = [("I", INSERT, i, after)]
        if i < n:
            steps.append(("D", DELETE, i + 1, state))
            if faults[i] not in "bd":
                more = TRUNCATED if faults[i] == "t" else 0
                steps.append(("R", REROLE + more, i + 1, after))
                if initials[i] == after or initials[i] == "s" and state == "":
                    steps.append(("K", KEEP + more, i + 1, initials[i]))
        for edit, price, row, to in steps:
            if (row, to) not in done:
                heapq.heappush(heap, _Node(node, edit, node.cost + price + left[row], node.cost + price, row, to))
    raise AssertionError("a legal end can always be reached by deletions")


def _audit(node: _Node) -> str:
    out = []
    while node.up is not None:
        out.append(node.edit)
        node = node.up
    return "".join(reversed(out))


def roles(audit: str, kept: Iterator[str]) -> Iterator[str | None]:
    """The role after each edit (None: deleted); `kept` gives the row's own role for each edit but Insert."""
    state = ""
    for edit in audit:
        own = None if edit == "I" else next(kept)
        if edit == "D":
            yield None
            continue
        new = own if edit == "K" else _NAMES[_next(state)]
        state = new[0]
        yield new


# --- tables ------------------------------------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) of the contract's damage, by crc32 of `conv_id:turn` modulo 20; dropped rows keep their conversation."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def reports(turns: DataFrame) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, dropped): gaps, faults, illegal neighbours, cost and audit."""
    text = F.col("text")
    fault = F.when(text.rlike(BLANK), "b").when(text.rlike(WHOLE), " ").otherwise("t")
    codes = turns.select("conv_id", "turn", "role", _digest().alias("digest"), fault.alias("fault"), "dropped")
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"conv_id {kind}, {_REPORT}")

    def run(batches):
        arrow = _arrow(schema)
        one, out, last = None, [], None
        for batch in batches:
            for conv, turn, role, digest, flaw, dropped in zip(*(c.to_pylist() for c in batch.columns)):
                if one is None or conv != last:
                    if one is not None:
                        out.append((last, *one.report()))
                    one, last = _Conversation(), conv
                if not dropped:
                    one.add(turn, role, digest, flaw)
            yield _batch(out, arrow)
            out = []
        if one is not None:
            yield _batch([(last, *one.report())], arrow)

    return codes.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest").mapInArrow(run, schema)


class _Conversation:
    """What a report needs of rows that come in order."""

    def __init__(self):
        self.seen, self.initials, self.faults, self.illegal = set(), [], [], 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role: str, digest: bytes, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault != "b" and (role, digest) in self.seen:
            fault = "d"
        elif fault != "b":
            self.seen.add((role, digest))
        first = role[:1]
        if self.initials:
            self.illegal += self.initials[-1] + first not in LEGAL
        self.initials.append(first)
        self.faults.append(fault)

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        plain = "".join(x if x in ("s", "u", "a") else "?" for x in self.initials)
        return gaps, *(self.faults.count(k) for k in _FAULTS), self.illegal, *repair(plain, "".join(self.faults))


def repaired(turns: DataFrame) -> DataFrame:
    """The edits in order: (conv_id, step, edit, role, text) after each edit, null role and text where a row is deleted.

    Step 0 of each conversation holds its report (the other columns, null elsewhere). The rows of a conversation follow each other in
    one partition, in order.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = [f.split() for f in _REPORT.split(", ")]
    report = reports(turns).selectExpr("conv_id", "0 AS own", "CAST(NULL AS BIGINT) AS turn", "'' AS role", "CAST(NULL AS STRING) AS text", *[n for n, _ in fields])
    rows = turns.filter("not dropped").selectExpr("conv_id", "1 AS own", "turn", "role", "text", *[f"CAST(NULL AS {k.upper().replace('LONG', 'BIGINT')}) AS {n}" for n, k in fields])
    schema = T.StructType.fromDDL(f"conv_id {kind}, step long, edit string, role string, text string, {_REPORT}")

    def run(batches):
        arrow = _arrow(schema)
        none = (None,) * len(fields)
        conv, audit, at, state, step = None, "", 0, "", 0

        def inserts():
            nonlocal at, state, step
            while at < len(audit) and audit[at] == "I":
                state = _next(state)
                at, step = at + 1, step + 1
                yield conv, step, "I", _NAMES[state], "", *none

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == 0:
                    out += inserts()
                    conv, audit, at, state, step = row[0], row[-1], 0, "", 0
                    out.append((conv, 0, None, None, None, *row[5:]))
                    continue
                out += inserts()
                edit, role, text = audit[at], row[3], row[4]
                at, step = at + 1, step + 1
                if edit == "D":
                    role = text = None
                else:
                    role = _NAMES[_next(state)] if edit == "R" else role
                    state = role[0]
                out.append((conv, step, edit, role, text, *none))
            yield _batch(out, arrow)
        out = list(inserts())
        if out:
            yield _batch(out, arrow)

    both = report.unionByName(rows).withColumn("digest", _digest())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "own", "turn", "role", "digest").drop("digest").mapInArrow(run, schema)


def with_digests(edits: DataFrame) -> DataFrame:
    """One row for each conversation of `repaired`: its report and SHA-256 of the repaired `role:text`, newline-joined.

    Reads each partition of `edits` in its order, so it must come straight from `repaired`.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"conv_id {kind}, {_REPORT}, repaired_sha256 string")

    def run(batches):
        arrow = _arrow(schema)
        report, sha, empty = None, None, True
        for batch in batches:
            out = []
            for conv, step, _, role, text, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if step == 0:
                    if report:
                        out.append((*report, sha.hexdigest()))
                    report, sha, empty = (conv, *rest), hashlib.sha256(), True
                elif role is not None:
                    sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                    empty = False
            yield _batch(out, arrow)
        if report:
            yield _batch([(*report, sha.hexdigest())], arrow)

    return edits.mapInArrow(run, schema)


def op13_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation after the contract's damage: its faults, the cheapest repair and a digest of the result."""
    return with_digests(repaired(damage(table(spark, sf_dir, "conversations"))))
