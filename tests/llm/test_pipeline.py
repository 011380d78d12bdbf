"""The pipeline against a plain version of every stage, each on the rows its predecessor kept."""
import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from riskloom.llm import genetic_packing, ngram_join, quality_gam, toxic_passages
from riskloom.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_match_brute_force(spark, sf_small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_duplicates", "near_duplicates", "packing"]
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stored(stage(spark, docs, sf_small), name)
        if name == "toxicity":
            model = toxic_passages.fit(docs, labels, toxic_passages.train_rows())
            want = sorted(r.doc_id for r in rows if toxic_passages.judge(model, r.text)["score"] < .5)
        elif name == "quality":
            model = quality_gam.fit(docs, labels, quality_gam.train_rows())
            scores = model.score(np.array([quality_gam.features(r.text) for r in rows]))
            want = sorted(r.doc_id for r, s in zip(rows, scores) if s >= quality_gam.THRESHOLD)
        elif name == "exact_duplicates":
            first = {}
            for r in sorted(rows, key=lambda r: r.doc_id):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
            want = sorted(first.values())
        elif name == "near_duplicates":
            rows.sort(key=lambda r: r.doc_id)
            sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := (r.text or "").split()) else frozenset() for r in rows]
            by, root = defaultdict(set), {i: i for i in range(len(rows))}
            for i, s in enumerate(sets):
                for g in s:
                    by[g].add(i)
            pairs = {(i, j) for m in by.values() for i in m for j in m if i < j}
            changed = True
            linked = [(i, j) for i, j in pairs if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
            while changed:
                changed = False
                for i, j in linked:
                    low = min(root[i], root[j])
                    changed |= root[i] != low or root[j] != low
                    root[i] = root[j] = low
            want = sorted(r.doc_id for i, r in enumerate(rows) if root[i] == i)
        else:
            packed = out.collect()
            assert sorted({r.doc_id for r in packed}) == ids(docs)
            bins = defaultdict(int)
            for r in packed:
                bins[r.sequence_id] += r.length
            assert max(bins.values()) <= genetic_packing.CAPACITY
            assert len(bins) <= -(-sum(bins.values()) // genetic_packing.CAPACITY) + 1
            break
        assert out.columns == COLUMNS
        assert ids(out) == want, name
        assert 0 < len(want) <= len(rows)
        docs = out


def test_run_on_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_with_odd_rows(spark, make_docs, tmp_path):
    pairs = [(1, None), (2, ""), (3, "same text of five words here"), (4, "same  text of five words here"), (None, "a b c"), (3, "same text of five words here"),
             (6, "long " * 50_000)]
    make_docs(pairs, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {1, 3, None, 6}
    assert ngram_join.THRESHOLD == 0.8 and ngram_join.WORDS == 5
