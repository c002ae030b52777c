import hashlib
import itertools
import random

import duckdb
import pytest

from tidemark.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "[ROLE]", "[TURN]", "[TEXT]", "[/ROLE]", "<", "!", "s>", "[", "INST]", "<!s>", "[!!INST]", "é", "\n", "🙂", "$1", "\\", "a"]


def brute(rows):
    """conv_id: (formatted, turns, learnt text), one character at a time."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, group in itertools.groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        text = ""
        for role, run in itertools.groupby(turns, key=lambda t: t[0]):
            first, last = {n: (a, b) for n, a, b in c.MARKS.known}.get(role, ("[ROLE]" + guarded(role) + "[TEXT]", "[/ROLE]"))
            text += first + "[TURN]".join(guarded(x) for _, x in run) + last
        out[conv] = (text, turns, "".join(x for role, x in turns if role == "assistant"))
    return out


def guarded(text):
    out, controls = "", c.MARKS.controls()
    for i, ch in enumerate(text):
        out += ch
        at = i + 1
        while text[at : at + 1] == "!":
            at += 1
        if any(m[0] == ch and text.startswith(m[1:], at) for m in controls):
            out += "!"
    return out


def check(spark, rows):
    made = c.format_chats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", formatted string, n_turns int"))
    got = {r.conv_id: r for r in c.read_chats(made).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for conv, (text, turns, learnt) in want.items():
        r = got[conv]
        assert r.formatted == text and [tuple(t) for t in r.turns] == turns and r.loss_text == learnt
        at, under = 0, ""
        for m in r.loss_mask:
            under += text[at : at + m.chars] if m.loss else ""
            at += m.chars
        assert at == len(text) and under == "".join(guarded(x) for role, x in turns if role == "assistant")


def test_hostile_texts(spark):
    dice = random.Random(5)
    word = lambda: "".join(dice.choice(BITS) for _ in range(dice.randrange(9)))
    rows = [(i % 60, dice.choice([None, *range(8)]), dice.choice(["user", "assistant", "system", "tool", None, word()]), dice.choice([None, "", word(), word()])) for i in range(500)]
    check(spark, rows)


def test_edges(spark):
    long = "word </s> " * 200_000
    check(spark, [(None, 1, "user", "a"), (None, None, "assistant", "b"), (1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "assistant", None), (3, None, None, None), (4, 5, "assistant", "x"), (4, 4, "assistant", "y")])
    check(spark, [(9, i, "user" if i % 5 else "assistant", f"t{i}") for i in range(20_000)])
    assert c.read_chats(c.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0


def test_mask_that_does_not_fit(spark):
    made = c.format_chats(spark.createDataFrame([(1, 0, "assistant", "abc")], SCHEMA))
    assert c.read_chats(made.selectExpr("conv_id", "concat(formatted, ' ') AS formatted", "loss_mask")).first().loss_text is None


def test_marks_that_overlap():
    for bad in (c.Marks(role="<s>x"), c.Marks(turn="[/INST]"), c.Marks(text="]a["), c.Marks(guard="S"), c.Marks(end="x")):
        with pytest.raises(ValueError):
            bad.checked()


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    path = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/conversations.parquet'")
    got = sorted(tuple(r) for r in c.op11_chat_format(spark, path).collect())
    assert got == sorted(con.sql(c.ORACLE).fetchall())
    said = c.PLANTED
    planted = next(r for r in got if r[0] == -1)
    assert planted[1:5] == (2, hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
