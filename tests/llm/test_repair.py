import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repair as r

SCHEMA = "conv_id long, turn long, role string, text string"
PRICE = {"K": 0, "R": 1, "D": 2, "I": 5}


def every_edit(initials, faults, inserts):
    """All edits of a few rows with up to `inserts` insertions: (cost, audit, role initials)."""
    if inserts:
        for new in "ua":
            for cost, audit, out in every_edit(initials, faults, inserts - 1):
                yield cost + 5, "I" + audit, new + out
    if not initials:
        yield 0, "", ""
        return
    rest = list(every_edit(initials[1:], faults[1:], inserts))
    for cost, audit, out in rest:
        yield cost + 2, "D" + audit, out
        if faults[0] not in "bd":
            more = 5 * (faults[0] == "t")
            yield cost + more, "K" + audit, initials[0] + out
            for new in "ua":
                yield cost + 1 + more, "R" + audit, new + out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("  bdt")), max_size=4))
def test_search_against_all_edits(rows):
    initials, faults = "".join(a for a, _ in rows), "".join(b for _, b in rows)
    best = min((c, a) for c, a, out in every_edit(initials, faults, 3) if re.fullmatch("(s?(ua)+)?", out))
    assert r.repair(initials, faults) == best


def table_method(initials, faults):
    """The least (cost, audit) of each state, row by row."""
    best = {"": (0, "")}
    for i in range(len(initials) + 1):
        for state in ("", "s", "u", "a") * 2:
            if state in best:
                to, found = ("a" if state == "u" else "u"), (best[state][0] + 5, best[state][1] + "I")
                best[to] = min(best.get(to, found), found)
        if i == len(initials):
            return min(best[s] for s in ("", "a") if s in best)
        new = {}
        for state, (cost, audit) in best.items():
            steps, more = [(2, "D", state)], 5 * (faults[i] == "t")
            if faults[i] not in "bd":
                steps.append((1 + more, "R", "a" if state == "u" else "u"))
                if initials[i] == ("a" if state == "u" else "u") or (initials[i], state) == ("s", ""):
                    steps.append((more, "K", initials[i]))
            for price, edit, to in steps:
                found = (cost + price, audit + edit)
                new[to] = min(new.get(to, found), found)
        best = new


def test_search_on_long_rows():
    dice = random.Random(3)
    for n in (0, 1, 7, 40, 300):
        for _ in range(20):
            initials, faults = "".join(dice.choices("suax", (1, 6, 6, 1), k=n)), "".join(dice.choices(" bdt", (12, 1, 1, 1), k=n))
            assert r.repair(initials, faults) == table_method(initials, faults)
    cost, audit = r.repair("ua" * 20_000, " " * 40_000)
    assert cost == 0 and audit == "K" * 40_000


def brute(rows):
    """The whole operator for plain rows, with the contract's damage."""
    space = " \t\n\x0b\x0c\r"
    convs = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        there = convs.setdefault(conv, [])
        if kind:
            there += [(turn is not None, turn or 0, "user" if kind == 4 else role, hashlib.sha256(text.encode()).digest(), text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, there in convs.items():
        there.sort()
        seen, faults = set(), ""
        for _, _, role, _, text in there:
            faults += "b" if not text.strip(space) else "d" if (role, text) in seen else " " if text.strip(space)[-1] in ".!?" else "t"
            seen.add((role, text))
        turns = {t for known, t, *_ in there if known}
        initials = [x[2][:1] for x in there]
        cost, audit = table_method([x or "?" for x in initials], faults)
        said, state, own = [], "", iter(there)
        for edit in audit:
            row = None if edit == "I" else next(own)
            if edit == "D":
                continue
            role = row[2] if edit == "K" else "assistant" if state == "u" else "user"
            state = role[0]
            said.append(f"{role}:{row[4] if row else ''}")
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_query(spark):
    for sf in ("0.001", "0.01"):
        rows = pq.read_table(f"/root/testdata/sf{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"])
        got = {x.conv_id: tuple(x)[1:] for x in r.op13_repair(spark, f"/root/testdata/sf{sf}").collect()}
        assert got == brute(zip(*(c.to_pylist() for c in rows.columns)))


def test_edges(spark):
    dice = random.Random(11)
    texts = ["a.", "b!", "c", "", " \t\n", None, "a.", " \u0085", "why? \n", "é🙂.", "word. " * 100_000]
    rows = [(dice.choice([None, *range(60)]), dice.choice([None, *range(9), 40]), dice.choice(["user", "assistant", "system", "tool", "", None, "User", "s"]), dice.choice(texts)) for _ in range(700)]
    rows += [(500, i, "user" if i % 2 == 0 else "assistant", "hot.") for i in range(3000)] + [(501 + i, i, "user", "x") for i in range(40)]
    df = spark.createDataFrame([(*x, "e", 1) for x in rows], SCHEMA + ", audit string, step int").repartition(7)
    got = {x.conv_id: tuple(x)[1:] for x in r.with_digests(r.repaired(r.damage(df))).collect()}
    assert got == brute(rows)
    assert r.with_digests(r.repaired(r.damage(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_edits_are_a_table(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a.", False), (1, 1, "user", "b.", False), (2, 0, "assistant", "", False), (3, 0, "user", "a.", True)], SCHEMA + ", dropped boolean")
    got = [(x.conv_id, x.step, x.edit, x.role, x.text) for x in r.repaired(rows).collect() if x.step]
    assert sorted(got) == [(1, 1, "K", "user", "a."), (1, 2, "R", "assistant", "b."), (2, 1, "D", None, None)]
