"""Conversation structure repair: the cheapest edits, chosen by scalar big-integer weights.

Rows are damaged (``damage``) and gathered per conversation, in turn order, by DataFrame operations.  A small function
per conversation then finds the cheapest edits that give role initials ``(s?(ua)+)?``.  It runs a dynamic program over a
DAG of four states (nothing yet, after the system turn, after a user turn, after an assistant turn) and one layer a row.

The weight of a way through the DAG is one integer: the high digits are its cost, the low digits its audit letters, one
fixed-width digit per place from the left, zeros where the audit has ended.  The smallest integer is then the cheapest
way, and among equal costs the one whose audit comes first in ASCII order (the letters' digits ascend as they do, a
shorter audit before its extensions).  Every decision is a plain minimum of integers.

Long conversations are cut into blocks of ``BLOCK`` rows so that the integers stay short; the costs behind a block are
carried in, its letters are not needed.  That is exact: two ways through a block with equal letters end in the same state
(the states are deterministic), and as every block ends in a row's letter, none is a proper beginning of another.

Defined results: null conv_id, turn, role and text count as one space in the damage rule and in the texts; a null turn
stands first and is left out of gaps; rows of one turn go by role, then text; an unknown role can only be deleted or
given a new role; repeated rows are duplicates like others; a conversation that loses all rows has zeros, an empty audit
and the hash of the empty string; an empty table gives none; other columns are ignored.  One conversation must fit one
cell, as its hash needs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the contract.
DAMAGE_MODULUS, COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 20, 3, 4, 3, 3
DROP, EMPTY, UNSTOP, REPEAT, TO_USER = 0, 1, 2, 3, 4

#: Digits of the letters: their ASCII order is D < I < K < R; 0 is the end.
LETTERS = " DIKR"
DIGIT = {c: i for i, c in enumerate(LETTERS)}
DIGIT_BITS = 3

START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> the role that a new or re-roled turn gets there, and the state after it.
NEXT_ROLE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}

BLOCK = 256
NEVER = 1 << 60


# ---- damage ------------------------------------------------------------------------------------------------

def shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped, 2: repeated) for every row."""
    draw = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(DAMAGE_MODULUS))
    text = (F.when(F.col("draw") == EMPTY, "").when(F.col("draw") == UNSTOP, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return (conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), draw.alias("draw"))
            .select("conv_id", "turn", F.when(F.col("draw") == TO_USER, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"),
                    F.when(F.col("draw") == DROP, 0).when(F.col("draw") == REPEAT, 2).otherwise(1).alias("copies")))


def gathered(rows: DataFrame) -> DataFrame:
    """conv_id, rows array<struct<turn, role, text>> after damage, in turn order."""
    one = F.struct("turn", "role", "text", "copies")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    spread = F.flatten(F.transform("rows", lambda r: F.array_repeat(F.struct(
        r["turn"].alias("turn"), r["role"].alias("role"), r["text"].alias("text")), r["copies"])))
    return whole.select("conv_id", spread.alias("rows"))


# ---- the cheapest edits ------------------------------------------------------------------------------------

def faults(blank: list[bool], cut: list[bool], same: list[str]) -> str:
    """First fault per row: b(lank), d(uplicate), t(runcated) or '.'; ``same`` is equal for equal role and text."""
    seen, out = set(), []
    for is_blank, is_cut, key in zip(blank, cut, same):
        out.append("b" if is_blank else "d" if key in seen else "t" if is_cut else ".")
        seen.add(key)
    return "".join(out)


class Weights:
    """Integers of one block: cost above ``width`` bits, letters below, first letter highest."""

    def __init__(self, rows: int):
        self.width = DIGIT_BITS * (3 * rows + 2)             # at most two inserts before a row, two at the end
        self.low = (1 << self.width) - 1

    def of_cost(self, cost: int) -> int:
        return cost << self.width

    def cost(self, weight: int) -> int:
        return weight >> self.width

    def edit(self, letter: str, cost: int, rest: int) -> int:
        """Weight of ``letter`` before the way ``rest``: its letters move one place to the right."""
        letters = rest & self.low
        return rest - letters + (cost << self.width) + (DIGIT[letter] << self.width - DIGIT_BITS) + (letters >> DIGIT_BITS)

    def letters(self, weight: int) -> str:
        out, place = [], self.width
        while place:
            place -= DIGIT_BITS
            digit = weight >> place & 7
            if not digit:
                break
            out.append(LETTERS[digit])
        return "".join(out)


def with_inserts(w: Weights, base: list[int]) -> list[int]:
    """Values of the four states when empty turns may come first (more than two never pay)."""
    def insert(rest):
        return w.edit("I", COST_INSERT, rest)

    user = min(base[USER], insert(base[ASSISTANT]))
    return [min(base[START], insert(user)), min(base[SYSTEM], insert(user)), user,
            min(base[ASSISTANT], insert(base[USER]))]


def solve_block(initials: str, marks: str, after: list[int], last: bool) -> tuple[list[int], list[str]]:
    """Cost and letters per state at the block's start; ``after``: costs per state behind the block."""
    w = Weights(len(initials))
    value = [w.of_cost(c) for c in after]
    if last:
        value = with_inserts(w, value)
    for initial, mark in zip(reversed(initials), reversed(marks)):
        base = []
        for state in range(4):
            best = w.edit("D", COST_DELETE, value[state])
            if mark not in "bd":
                more = COST_TRUNCATED if mark == "t" else 0
                if (state, initial) in KEEP:
                    best = min(best, w.edit("K", more, value[KEEP[state, initial]]))
                best = min(best, w.edit("R", COST_REROLE + more, value[NEXT_ROLE[state][1]]))
            base.append(best)
        value = with_inserts(w, base)
    return [w.cost(v) for v in value], [w.letters(v) for v in value]


def follow(state: int, letters: str, initials: str) -> int:
    """State after ``letters``; ``initials`` are those of the rows they use."""
    rows = iter(initials)
    for letter in letters:
        initial = None if letter == "I" else next(rows)
        if letter == "K":
            state = KEEP[state, initial]
        elif letter != "D":
            state = NEXT_ROLE[state][1]
    return state


def cheapest(initials: str, marks: str, block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) for rows with these role initials (one character each) and faults."""
    if not initials:
        return 0, ""
    after, last, solved = [0, NEVER, NEVER, 0], True, []
    for start in reversed(range(0, len(initials), block)):
        piece = initials[start:start + block]
        after, letters = solve_block(piece, marks[start:start + block], after, last)
        solved.append((piece, letters))
        last = False
    state, audit = START, []
    for piece, letters in reversed(solved):
        audit.append(letters[state])
        state = follow(state, letters[state], piece)
    return after[START], "".join(audit)


def turns_of(audit: str, initials: str) -> tuple[list[int], list[str]]:
    """Row number (-1: inserted) and new role ('': kept) of every turn the audit leaves."""
    state, row, rows, roles = START, 0, [], []
    for letter in audit:
        if letter in "RI":
            role, state = NEXT_ROLE[state]
            rows.append(-1 if letter == "I" else row)
            roles.append(role)
        elif letter == "K":
            state = KEEP[state, initials[row]]
            rows.append(row)
            roles.append("")
        row += letter != "I"
    return rows, roles


PLAN = T.StructType([T.StructField("faults", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
                     T.StructField("keep", T.ArrayType(T.IntegerType())), T.StructField("roles", T.ArrayType(T.StringType()))])


@F.pandas_udf(PLAN)
def plan_edits(initials: pd.Series, blank: pd.Series, cut: pd.Series, same: pd.Series) -> pd.DataFrame:
    out = []
    for i, b, c, s in zip(initials, blank, cut, same):
        marks = faults(b, c, s)
        cost, audit = cheapest(i, marks)
        out.append((marks, cost, audit, *turns_of(audit, i)))
    return pd.DataFrame(out, columns=["faults", "cost", "audit", "keep", "roles"])


def initial(role: Column) -> Column:
    """First character; a space where there is none, so that every row has one."""
    return F.when(role == "", " ").otherwise(F.substring(role, 1, 1))


def repaired(conversations: DataFrame) -> DataFrame:
    """Per conv_id: rows after damage, their faults, cost and audit of the cheapest edits, turns left (role, text)."""
    space = r"\x20\x09-\x0D"
    rows = gathered(damage(conversations))
    planned = rows.withColumn("plan", plan_edits(
        F.array_join(F.transform("rows", lambda r: initial(r["role"])), ""),
        F.transform("rows", lambda r: ~r["text"].rlike(f"[^{space}]")),
        F.transform("rows", lambda r: ~r["text"].rlike(rf"[.!?][{space}]*\z")),
        F.transform("rows", lambda r: F.sha2(F.concat(F.length(r["role"]).cast("string"), F.lit(":"), r["role"], r["text"]), 256))))
    left = F.transform(F.arrays_zip("plan.keep", "plan.roles"), lambda p: F.struct(
        F.when(p["roles"] != "", p["roles"]).otherwise(F.get(F.col("rows"), p["keep"])["role"]).alias("role"),
        F.when(p["keep"] < 0, "").otherwise(F.get(F.col("rows"), p["keep"])["text"]).alias("text")))
    return planned.select("conv_id", "rows", "plan.faults", "plan.cost", "plan.audit", left.alias("turns"))


def report(made: DataFrame) -> DataFrame:
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    pair = F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda i: F.concat(
        initial(F.element_at("rows", i)["role"]), initial(F.element_at("rows", i + 1)["role"])))
    wrong = F.size(F.filter(pair, lambda p: ~p.isin("su", "ua", "au")))

    def fault(mark):
        return (F.length("faults") - F.length(F.replace("faults", F.lit(mark), F.lit("")))).cast("long")

    return made.select(
        "conv_id",
        F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long").alias("gaps"),
        fault("b").alias("blank"), fault("d").alias("duplicate"), fault("t").alias("truncated"),
        F.when(F.size("rows") > 1, wrong).otherwise(0).cast("long").alias("illegal"),
        "cost", "audit",
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


#: Forward over the rows; a state's way is 'cost|audit' as text with a fixed-width cost, so the least text wins.
ORACLE = r"""
WITH RECURSIVE bits(i, c, n) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM bits WHERE n < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE n = 8),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), drawn AS (
  SELECT given.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
           lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 20 AS draw
  FROM given, crc
), rows AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE draw <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nr FROM rows
), marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '.' END AS mark,
         role[1] AS ini, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY nr) AS before
  FROM placed
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE mark = 'b') AS blank, count(*) FILTER (WHERE mark = 'd') AS duplicate,
         count(*) FILTER (WHERE mark = 't') AS truncated,
         count(*) FILTER (WHERE nr > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(nr) AS n
  FROM marked GROUP BY conv_id
), way AS (
  SELECT conv_id, 0::BIGINT AS nr, {'c': 0, 't': '', 'o': ''} AS s, NULL::STRUCT(c INTEGER, t VARCHAR, o VARCHAR) AS y,
         NULL::STRUCT(c INTEGER, t VARCHAR, o VARCHAR) AS u, NULL::STRUCT(c INTEGER, t VARCHAR, o VARCHAR) AS a FROM stats
  UNION ALL
  SELECT conv_id, nr,
         CASE WHEN s IS NOT NULL THEN {'c': s.c + 4, 't': s.t || 'D', 'o': s.o} END,
         list_min(list_filter([CASE WHEN y IS NOT NULL THEN {'c': y.c + 4, 't': y.t || 'D', 'o': y.o} END,
                               CASE WHEN s IS NOT NULL AND ok AND ini = 's' THEN {'c': s.c + x, 't': s.t || 'K', 'o': s.o || chr(10) || role || ':' || text} END], lambda e: e IS NOT NULL)),
         list_min(list_filter([CASE WHEN u2 IS NOT NULL THEN {'c': u2.c + 4, 't': u2.t || 'D', 'o': u2.o} END,
                               CASE WHEN ok AND s IS NOT NULL THEN {'c': s.c + x + k, 't': s.t || l, 'o': s.o || chr(10) || ur || ':' || text} END,
                               CASE WHEN ok AND y IS NOT NULL THEN {'c': y.c + x + k, 't': y.t || l, 'o': y.o || chr(10) || ur || ':' || text} END,
                               CASE WHEN ok AND a2 IS NOT NULL THEN {'c': a2.c + x + k, 't': a2.t || l, 'o': a2.o || chr(10) || ur || ':' || text} END], lambda e: e IS NOT NULL)),
         list_min(list_filter([CASE WHEN a2 IS NOT NULL THEN {'c': a2.c + 4, 't': a2.t || 'D', 'o': a2.o} END,
                               CASE WHEN ok AND u2 IS NOT NULL THEN {'c': u2.c + x + ka, 't': u2.t || la, 'o': u2.o || chr(10) || ar || ':' || text} END], lambda e: e IS NOT NULL))
  FROM (
    SELECT b.*, m.role, m.text, m.ini, m.mark NOT IN ('b', 'd') AS ok, CASE WHEN m.mark = 't' THEN 3 ELSE 0 END AS x,
           CASE WHEN m.ini = 'u' THEN 0 ELSE 3 END AS k, CASE WHEN m.ini = 'u' THEN 'K' ELSE 'R' END AS l, CASE WHEN m.ini = 'u' THEN m.role ELSE 'user' END AS ur,
           CASE WHEN m.ini = 'a' THEN 0 ELSE 3 END AS ka, CASE WHEN m.ini = 'a' THEN 'K' ELSE 'R' END AS la, CASE WHEN m.ini = 'a' THEN m.role ELSE 'assistant' END AS ar
    FROM (
      SELECT conv_id, nr + 1 AS nr, s, y, u2,
             list_min(list_filter([a, CASE WHEN u2 IS NOT NULL THEN {'c': u2.c + 3, 't': u2.t || 'I', 'o': u2.o || chr(10) || 'assistant:'} END], lambda e: e IS NOT NULL)) AS a2
      FROM (
        SELECT *, list_min(list_filter([u,
                 CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 't': s.t || 'I', 'o': s.o || chr(10) || 'user:'} END,
                 CASE WHEN y IS NOT NULL THEN {'c': y.c + 3, 't': y.t || 'I', 'o': y.o || chr(10) || 'user:'} END,
                 CASE WHEN a IS NOT NULL THEN {'c': a.c + 3, 't': a.t || 'I', 'o': a.o || chr(10) || 'user:'} END], lambda e: e IS NOT NULL)) AS u2
        FROM way
      )
    ) b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.nr = b.nr
  )
), closed AS (
  SELECT w.conv_id, list_min(list_filter([w.s, w.a,
           CASE WHEN w.u IS NOT NULL THEN {'c': w.u.c + 3, 't': w.u.t || 'I', 'o': w.u.o || chr(10) || 'assistant:'} END,
           CASE WHEN w.y IS NOT NULL THEN {'c': w.y.c + 6, 't': w.y.t || 'II', 'o': w.y.o || chr(10) || 'user:' || chr(10) || 'assistant:'} END], lambda e: e IS NOT NULL)) AS best
  FROM way w JOIN stats t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.nr
), ids AS (SELECT DISTINCT conv_id FROM given)
SELECT i.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(t.blank, 0)::BIGINT AS blank,
       coalesce(t.duplicate, 0)::BIGINT AS duplicate, coalesce(t.truncated, 0)::BIGINT AS truncated,
       coalesce(t.illegal, 0)::BIGINT AS illegal, coalesce(c.best.c, 0)::BIGINT AS cost, coalesce(c.best.t, '') AS audit,
       sha256(coalesce(substr(c.best.o, 2), '')) AS repaired_sha256
FROM ids i LEFT JOIN stats t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
     LEFT JOIN closed c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
"""
