"""Conversation repair: audits against enumeration of all edits, blocks against whole conversations, damage, odd input."""
import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from riskloom.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute(initials, marks, inserts=2):
    """Least (cost, audit) over every sequence of edits with up to ``inserts`` new turns at each place."""
    best = None
    choices = []
    for i, (c, m) in enumerate(zip(initials, marks)):
        row = [("D", 4, "")]
        if m not in "bd":
            more = 3 if m == "t" else 0
            row += [("K", more, c), ("R", 3 + more, "u"), ("R", 3 + more, "a")]
        choices.append(row)
    gaps = ["".join(p) for n in range(inserts + 1) for p in itertools.product("ua", repeat=n)]
    for picks in itertools.product(*choices):
        for new in itertools.product(gaps, repeat=len(initials) + 1):
            turns = new[0] + "".join(p[2] + g for p, g in zip(picks, new[1:]))
            if LEGAL.fullmatch(turns):
                cost = sum(p[1] for p in picks) + 3 * sum(map(len, new))
                audit = "I" * len(new[0]) + "".join(p[0] + "I" * len(g) for p, g in zip(picks, new[1:]))
                if best is None or (cost, audit) < best:
                    best = (cost, audit)
    return best


def test_least_cost_and_ascii_least_audit_equal_enumeration():
    for n in range(0, 4):
        for initials in itertools.product("suax", repeat=n):
            rng = random.Random(repr(initials))
            marks = "".join(rng.choice("..tbd") for _ in initials)
            assert R.cheapest("".join(initials), marks) == brute("".join(initials), marks), (initials, marks)


def test_longer_rows_against_enumeration_with_one_insert_a_place():
    rng = random.Random(5)
    for _ in range(25):
        n = 5
        initials = "".join(rng.choice("suuaa") for _ in range(n))
        marks = "".join(rng.choice("...td") for _ in range(n))
        got, want = R.cheapest(initials, marks), brute(initials, marks, inserts=1)
        assert got <= want and (got == want or "II" in got[1])


def test_blocks_give_the_same_as_one_dynamic_program():
    rng = random.Random(9)
    for _ in range(200):
        n = rng.randint(1, 40)
        initials = "".join(rng.choice("suauax ") for _ in range(n))
        marks = "".join(rng.choice("....tbd") for _ in range(n))
        whole = R.cheapest(initials, marks, block=10_000)
        for block in (1, 2, 3, 7):
            assert R.cheapest(initials, marks, block=block) == whole, (initials, marks, block)


def test_turns_of_an_audit_are_legal_and_long_conversations_finish():
    rng = random.Random(2)
    n = 20_000
    initials = "".join(rng.choice("suauax") for _ in range(n))
    marks = "".join(rng.choice("....tbd") for _ in range(n))
    cost, audit = R.cheapest(initials, marks)
    rows, roles = R.turns_of(audit, initials)
    left = "".join(role[:1] or initials[row] for row, role in zip(rows, roles))
    assert LEGAL.fullmatch(left) and sum(c != "I" for c in audit) == n
    kept = [row for row in rows if row >= 0]
    assert kept == sorted(set(kept)) and not any(marks[row] in "bd" for row in kept)
    assert cost == sum({"D": 4, "I": 3, "R": 3, "K": 0}[c] for c in audit) + 3 * sum(marks[row] == "t" for row in kept)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(key.encode()) % 20
        held = out.setdefault(conv, [])
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        held += [(turn is not None, turn or 0, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return {k: [(t if has else None, r, x) for has, t, r, x in sorted(v)] for k, v in out.items()}


def expected(rows):
    out = {}
    for conv, turns in damaged(rows).items():
        seen, marks = set(), ""
        for _, role, text in turns:
            core = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            marks += "b" if not core else "d" if (role, text) in seen else "." if core[-1] in ".!?" else "t"
            seen.add((role, text))
        initials = "".join((role[:1] or " ") for _, role, _ in turns)
        cost, audit = R.cheapest(initials, marks)
        keep, roles = R.turns_of(audit, initials)
        lines = [f"{new or turns[i][1]}:{'' if i < 0 else turns[i][2]}" for i, new in zip(keep, roles)]
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def many_rows():
    rng = random.Random(4)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", "", None])
            text = rng.choice(["Done.", "what?  ", "cut off", "", " \t", None, "same.", "same.", "x.\n", "é!"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 2, None]), role, text))
    return rows + rows[:40] + [(500, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(1500)]


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
            for r in R.report(R.repaired(df)).collect()}


def test_whole_query_against_plain_python(spark):
    rows = many_rows()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7)) == expected(rows)


def test_conversation_that_loses_all_rows(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark.createDataFrame([(conv, 0, "user", "hi.")], SCHEMA)) == {
        conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table_and_clashing_columns(spark):
    assert R.report(R.repaired(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = many_rows()[:200]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("rows", "plan", "audit", "faults", "copies", "DRAW", "cost", "turns"):
        df = df.withColumn(c, F.lit("x"))
    assert got(df) == expected(rows)
