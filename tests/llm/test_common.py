"""Draws by 64-bit hashes: no share is empty, and draws with different salts are independent."""
import pytest
from pyspark.sql import functions as F

from riskloom.llm import language_zstd, quality_gam, toxic_passages
from riskloom.llm.common import draw_limit, drawn


@pytest.mark.parametrize("n", [10 ** 9, 10 ** 12, 10 ** 15])
@pytest.mark.parametrize("bound", [language_zstd.MAX_DOCS, quality_gam.MAX_LABELLED, toxic_passages.MAX_CALIBRATION])
def test_bounded_samples_of_huge_tables_are_not_empty(n, bound):
    accepted = draw_limit(bound / n) + (1 << 63) + 1                     # hashes of 2^64 that are taken
    assert accepted > 0 and abs(accepted / 2 ** 64 * n - bound) <= 0.01 * bound


def test_limits_at_the_ends():
    assert draw_limit(1.0) == (1 << 63) - 1 and draw_limit(0.0) == -(1 << 63) and draw_limit(5.0) == (1 << 63) - 1


def test_salts_draw_independently(spark):
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    first = ids.filter(drawn(0.1, "fit"))
    assert abs(first.count() - 20_000) < 600
    assert abs(first.filter(drawn(0.1, "calibrate")).count() - 2_000) < 200
    assert first.filter(drawn(F.lit(draw_limit(0.1)), "fit")).count() == first.count()
