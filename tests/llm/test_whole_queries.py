"""Whole results of op4, op5, op6 and op9 on given tables against plain loops over the fitted tables."""
import bisect
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from riskloom.llm import language_zstd as lz
from riskloom.llm import quality_gam as qg
from riskloom.llm import toxic_passages as tp
from riskloom.llm import vector_shards as vs
from riskloom.llm.common import crc_of_id, doc_remainder

SF = "/root/testdata/sf0.001"


def read(sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()
    assert len({i for i, _ in rows}) == len(rows) > 50
    return dict(rows)


@pytest.fixture(scope="module")
def texts():
    return read(SF)


def tables(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def plain_segments(steps):
    """The best segment of all (of several the shortest), then those of the rest on either side."""
    if not len(steps):
        return []
    sums = np.concatenate([[0.0], np.cumsum(steps)])
    gains = np.where(np.triu(np.ones((len(steps), len(steps)), bool)), sums[None, 1:] - sums[:-1, None], -np.inf)
    top = gains.max()
    i, j = min(np.argwhere(gains >= top - 1e-12).tolist(), key=lambda at: at[1] - at[0])
    j += 1
    if top <= 1e-12:
        return []
    return plain_segments(steps[:i]) + [top] + plain_segments(steps[j:])


def plain_token(model, word):
    if word in model.scores:
        return model.scores[word]
    return next((model.stems[word[:k]] for k in tp.STEMS if len(word) > k and word[:k] in model.stems), 0.0)


def test_op4(spark):
    sf = "/root/testdata/sf0.01"                         # the smallest table has too few toxic labels for a model
    texts = read(sf)
    docs, labels = tables(spark, sf)
    model = tp.fit(docs, labels, tp.train_rows())
    got = {r.doc_id: r for r in tp.op4_toxic_passages(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = tp.tokens(t)
        odds = [plain_token(model, w) for w in words]
        steps, at = [], 0                                # unscored words between scored ones only drift: one step
        for k in (k for k, v in enumerate(odds) if v):
            steps += [-tp.DRIFT * (k - at), odds[k] - tp.DRIFT]
            at = k + 1
        pieces = plain_segments(np.array(steps))
        score = 0.0
        if model.fitted:
            evidence = (tp.sum_statistic(sorted((model.lam * s - math.log(max(1, len(words))) for s in pieces), reverse=True))
                        if pieces else tp.NO_SEGMENT)
            score = 1 / (1 + math.exp(-max(-60.0, min(60.0, model.curve[0] + model.curve[1] * evidence))))
        assert got[i].score == pytest.approx(score, abs=1e-6), i
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (crc_of_id(i) % 5 == 0)
    assert 0 < sum(r.predicted for r in got.values()) < len(got)


def test_op5(spark, texts):
    docs, labels = tables(spark)
    model = qg.fit(docs, labels, qg.train_rows())
    got = {r.doc_id: r for r in qg.op5_quality_gam(spark, SF).collect()}
    assert got.keys() == texts.keys() and model.fitted and model.pairs
    for i, t in texts.items():
        x = [float(v) for v in qg.features(t)]
        margin = model.intercept + sum(float(table[bisect.bisect_right(list(e), v)]) for v, e, table in zip(x, model.edges, model.tables))
        for (a, b), table in zip(model.pairs, model.pair_tables):
            margin += float(table[bisect.bisect_right(list(model.pair_edges[a]), x[a])][bisect.bisect_right(list(model.pair_edges[b]), x[b])])
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))), abs=1e-9), i
        assert got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (crc_of_id(i) % 4 == 2)


def test_op9(spark, texts):
    docs, _ = tables(spark)
    contents = lz.dictionaries(docs, doc_remainder(F.col("doc_id"), 5) != 0)
    got = {r.doc_id: r for r in lz.op9_language_zstd(spark, SF).collect()}
    assert got.keys() == texts.keys() and len(contents) > 1
    for i, t in texts.items():
        raw = lz.letters(t).encode()
        if not raw:
            assert got[i].lang_pred == "und"
            continue
        sizes = {}
        for lang in sorted(contents):
            level = lz.SHORT_LEVEL if len(raw) <= lz.SHORT else lz.LEVEL
            held = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            coder = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(raw[k:k + lz.BLOCK])) for k in range(0, len(raw), lz.BLOCK))
        best = min(sizes, key=lambda k: (sizes[k], k))
        rest = [s for k, s in sizes.items() if k != best]
        assert got[i].lang_pred == best, i
        assert got[i].score == pytest.approx(1 / (1 + sum(math.exp(-min(60.0, (s - sizes[best]) / 2)) for s in rest)), abs=1e-12)


def test_op6(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text FROM read_parquet('{sf}/documents.parquet')").fetchall()
    frame = vs.op6_vector_shards(spark, sf).toPandas()
    want = sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in rows)
    assert sorted(zip(frame.doc_id, frame["size"], frame.text_crc32)) == want
    con = duckdb.connect()
    con.register("placed", frame)
    con.register("docs", con.execute(f"SELECT doc_id, coalesce(text, '') AS text FROM read_parquet('{sf}/documents.parquet')").df())
    least, most, shards, odd = con.execute("""
        SELECT min(bytes), max(bytes), count(*), sum(CASE WHEN first <> 0 OR last <> n - 1 OR slots <> n THEN 1 ELSE 0 END)
        FROM (SELECT shard, sum(size) AS bytes, count(*) AS n, min(slot) AS first, max(slot) AS last, count(DISTINCT slot) AS slots
              FROM placed GROUP BY shard)""").fetchone()
    assert shards == vs.SHARDS and odd == 0 and most <= 1.05 * least, (least, most)
    split = con.execute("""
        SELECT count(*) FROM (SELECT text, sum(size) AS bytes, count(*) AS n, count(DISTINCT shard) AS homes
                              FROM placed JOIN docs USING (doc_id) GROUP BY text),
                             (SELECT sum(size) / 24 AS bytes_mean, count(*) / 24 AS rows_mean FROM placed)
        WHERE homes > 1 AND bytes <= ? * bytes_mean AND n <= ? * rows_mean""", [vs.WHOLE * .9, vs.WHOLE * .9]).fetchone()[0]
    assert split == 0
    law = defaultdict(int)
    for x in frame.law:
        law[x] += 1
    assert dict(law) == {"bytes": len(rows)}
