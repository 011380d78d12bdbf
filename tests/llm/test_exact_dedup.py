import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm import exact_dedup

PAIRS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (7, "x" * 200_000), (8, "x" * 200_000),
         (4, " a b"), (6, "a b"), (None, "a b"), (9, "a b"), (3, "a\tb")] + [(100 + i, "hot text") for i in range(400)]


def brute(pairs):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in pairs]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    return sorted((str(i), str(min(x for x in groups[t] if x is not None)), len(groups[t]),
                   hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("floor", [2, 10_000])
def test_matches_brute_force(make_docs, monkeypatch, weak, floor):
    monkeypatch.setattr(exact_dedup, "hot_floor", lambda n: floor)
    one_digit = lambda t: F.unhex(F.lpad(F.substring(F.sha2(t, 256), 1, 1), 2, "0"))  # noqa: E731  texts collide
    digest = one_digit if weak else exact_dedup.sha256_digest
    got = exact_dedup.dedup(make_docs(PAIRS, extra=True), digest).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(PAIRS)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})           # one of each text, repeated rows included
    assert all(r.doc_id == r.keep_id for r in kept)


def test_stage_and_empty(make_docs):
    out = exact_dedup.keep_one(make_docs(PAIRS))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 6, 7, 100]
    assert exact_dedup.dedup(make_docs([])).count() == 0
    assert exact_dedup.keep_one(make_docs([])).count() == 0
    assert [r.kept for r in exact_dedup.dedup(make_docs([(None, "a"), (None, "a")])).collect()].count(True) == 1


def test_many_equal_rows_keep_one_without_a_window(spark, make_docs):
    pairs = [(5, "same")] * 10_000 + [(None, "same")] * 300 + [(None, "only null")] * 40 + [(i, "other") for i in (9, 8, 8)]
    out = exact_dedup.dedup(make_docs(pairs))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == len(pairs)
    kept = [(r.doc_id, r.group_size) for r in rows if r.kept]
    assert sorted(kept, key=str) == sorted([(5, 10_300), (None, 40), (8, 3)], key=str)


def test_all_columns_of_the_input_stay(make_docs):
    docs = make_docs(PAIRS, extra=True)
    out = exact_dedup.keep_one(docs)
    assert out.columns == docs.columns
    assert all(r["_sha"] == r["sha"] == r["_QUALITY"] == "x" for r in out.collect())
