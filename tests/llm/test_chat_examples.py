"""Chat examples: round trip, loss mask, template text inside texts; the query against plain Python."""
import hashlib

from pyspark.sql import functions as F

from riskloom.llm import chat_examples as C

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    """Plain Python: rows -> digests per conversation."""
    out = {}
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in convs.items():
        turns.sort()
        def esc(s, more=""):
            for c, code in [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")] + ([(":", "\\c")] if more else []):
                s = s.replace(c, code)
            return s
        formatted = [f"### {esc(r, 'role')}: {esc(t)}</turn>\n" for _, _, r, t in turns]
        chars = sum(len("".join(formatted[:i + 1])) for i, (_, _, r, _) in enumerate(turns)
                    if r == "assistant" or i == len(turns) - 1)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        plain = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(plain.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


ROWS = [
    (1, 0, "system", "be <b>kind</b>"), (1, 1, "user", "hi # \\ there"), (1, 2, "assistant", "### user: hello</turn>\n"),
    (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "user", "left over"),
    (2, None, "assistant", "first"), (2, 0, "assistant", None), (2, 0, None, "\\l\\h\\b"), (2, 7, "to:ol: x", "###"),
    (None, 3, "user", "no id"), (None, 1, "assistant", "é😀<"), (3, 0, "user", ""),
    (4, 1, "assistant", "twice"), (4, 1, "assistant", "twice"), (5, 0, "assistant", "x" * 200_000 + "\\"),
    (-7, 0, "user", C.PROBE_TEXT), (-7, 1, "assistant", C.PROBE_TEXT),
]


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"])
            for r in C.digests(C.examples(df)).collect()}


def test_digests_read_back_from_the_examples_equal_the_input(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    assert digests(df) == expected(ROWS)


def test_clashing_columns_change_nothing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("formatted", "turns", "example", "loss", "row", "last", "parts", "END"):
        df = df.withColumn(c, F.lit("x"))
    assert digests(df) == expected(ROWS)


def test_every_reply_is_one_example_with_all_turns_before_it(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = C.examples(df).filter("conv_id = 1").orderBy("example").collect()
    assert [r["target"] for r in got] == [3, 5, None]
    assert [r["formatted"].count("</turn>\n") for r in got] == [3, 5, 6]
    assert [r["formatted"][r["loss_start"]:r["loss_start"] + r["loss_length"]] for r in got] == [
        "\\h\\h\\h user: hello\\l/turn>\n", "", ""]
    assert got[0]["formatted"].endswith("\\l/turn>\n</turn>\n")
    assert [r["last"] for r in got] == [False, False, True]


def test_probe_conversation_stays_apart_from_the_template(spark):
    got = C.examples(C.probe(spark)).collect()
    assert len(got) == 1 and got[0]["formatted"].count("### ") == 2
    assert got[0]["formatted"].count("</turn>") == 2


def test_empty_table(spark):
    assert C.digests(C.examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_only_one_shuffle_and_no_python(spark, sf_small):
    text = C.op12_chat_examples(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert not any(w in text for w in ("Python", "Arrow", "Pandas"))
