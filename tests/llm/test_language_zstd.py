import random

from pyspark.sql import functions as F

from riskloom.llm import language_zstd as lz
from riskloom.llm.common import crc_of_id

WORDS = {"aa": "the of and house river stone green walking under morning".split(),
         "bb": "der die und haus fluss stein grün gehend unter morgen".split(),
         "cc": "le la et maison rivière pierre vert marchant sous matin".split()}


def docs_of(n, seed=1):
    rng = random.Random(seed)
    langs = sorted(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]]) for _ in range(rng.randint(6, 80)))) for i in range(n)]


def test_held_out_accuracy_and_odd_rows(spark, make_docs):
    pairs = docs_of(600)
    odd = [(9001, None), (9002, ""), (9003, "123 !! __"), (9004, "THE*** HOUSE!!! " * 30_000), (0, pairs[0][1]), (None, pairs[1][1])]
    lang = lambda i: None if i is None or i > 9000 else sorted(WORDS)[i % 3]
    docs = make_docs(pairs + odd, extra=True, lang=lang)
    contents = lz.dictionaries(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    assert sorted(contents) == sorted(WORDS) and all(len(v) <= lz.DICTIONARY for v in contents.values())
    got = lz.identify(docs, contents).collect()
    assert len(got) == len(pairs + odd) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 9000 and crc_of_id(r.doc_id) % 5 == 0]
    assert sum(r.lang_pred == lang(r.doc_id) for r in held) >= 0.99 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[9001].lang_pred == by[9002].lang_pred == by[9003].lang_pred == "und" and by[9004].lang_pred == "aa"
    assert by[None].lang_pred == "bb"


def test_narrow_margin_is_rejected():
    coders = lz.compressors({"x": b"one two three " * 50, "y": b"uno due tre " * 50})
    assert lz.classify("one two three one three two two one", coders)[0] == "x"
    assert lz.classify("zzz qqq", coders)[2]
    assert lz.classify("anything", []) == ("und", 0.0, True)
    assert lz.classify("anything", lz.compressors({"x": b"one two"})) == ("x", 1.0, False)


def test_sum_over_whole_text():
    coders = lz.compressors({"x": b"one two three four " * 50, "y": b"uno due tre quattro " * 50})
    text = "one two " * 3000 + "uno due tre quattro tre due " * 30_000       # most of it lies after the first blocks
    assert lz.classify(text, coders)[0] == "y"


def test_empty_table(spark, make_docs):
    assert lz.dictionaries(make_docs([]), F.lit(True)) == {}
    assert lz.identify(make_docs([]), {}).count() == 0
    assert lz.identify(make_docs([(1, "a")]), {}).first().lang_pred == "und"


def test_dictionary_draws_on_all_ids(spark, make_docs, monkeypatch):
    """A dictionary that holds a fifth of its sample has documents of low and high ids."""
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:03d}")
    monkeypatch.setattr(lz, "DICTIONARY", 800)
    content = lz.dictionaries(make_docs([(i, f"{name(i)} river house stone.") for i in range(200)], lang=lambda i: "aa"), F.lit(True))["aa"]
    found = [i for i in range(200) if name(i).encode() + b" " in content]
    assert len(content) == 800 and min(found) < 50 and max(found) >= 150 and 30 <= len(found) <= 45
