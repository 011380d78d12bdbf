"""Helpers shared by the corpus operators: shared-folder tables, skew-safe lookups, portable hashes."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir

#: A group counts as hot when it holds at least this share of all rows, so at most 1 / HOT_SHARE groups are hot.
HOT_SHARE = 1e-4


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: the lineage ends there, lost executors
    re-read files, and both readers of the result see the same rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskloom-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_floor(n_rows: int) -> int:
    """Smallest size of a hot group: no more than 1 / HOT_SHARE groups can reach it."""
    return max(2, int(n_rows * HOT_SHARE) + 1)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with one row per group.  Groups of at least ``hot_floor`` rows are joined by
    broadcast (their number is bounded by 1 / HOT_SHARE whatever the data); the others by shuffle, where
    no key brings more rows than that floor.  ``rows`` is read twice: pass a stored table."""
    floor = hot_floor(n_rows)
    hot = F.broadcast(groups.filter(F.col(size) >= floor))
    cold = groups.filter(F.col(size) < floor)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def drawn(share: float | Column, salt: str) -> Column:
    """Condition that holds for ``share`` of all ids, by a 64-bit hash of doc_id: the same ids in every run.  Draws
    with different salts are independent."""
    limit = F.lit(draw_limit(share)) if isinstance(share, float) else share
    return F.xxhash64(F.col("doc_id"), F.lit(salt)) <= limit


def draw_limit(share: float) -> int:
    """Largest signed 64-bit hash a draw of ``share`` accepts; the least share accepts one hash in 2^64."""
    return max(-(1 << 63), min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63) - 1))


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names) beside the given key columns; select("row.*") unpacks."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])


def crc_of_id(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode())
