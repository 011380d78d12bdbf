"""Exact deduplication, skew-safe and JVM-only.

Stages: (1) every task combines its own rows of equal text; (2) the survivors are merged by digest, hot
digests spread over salts; (3) the salt winners of hot digests are combined globally.  The full normalised
text is part of the grouping key at every stage, so two texts with one digest never merge.  Hot digests are
those with at least ``HOT_SHARE`` of all rows, hence bounded in number; only their text is shuffled twice.

Defined results: a null text counts as empty; a null doc_id never wins against a number; of repeated rows
(same id and text) exactly one is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_groups, hot_floor, packed, stored

SALTS = 32


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; nothing is trimmed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def winners(docs: DataFrame, light: DataFrame, n_rows: int, digest=sha256_digest) -> DataFrame:
    """One row per distinct normalised text: _digest, _text, keep_id, group_size.

    ``light`` holds (doc_id, _digest) of the same rows; its counts tell which digests are hot."""
    hot = (light.groupBy("_digest").agg(F.count("*").alias("_n")).filter(F.col("_n") >= hot_floor(n_rows))
           .select("_digest", F.lit(True).alias("_hot")))
    rows = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("_text"))
    rows = rows.withColumn("_digest", digest(F.col("_text"))).join(F.broadcast(hot), "_digest", "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0))
    salted = (rows.withColumn("_salt", salt)
              .groupBy("_digest", "_salt", "_text")                       # partial aggregation: the local stage
              .agg(F.min("doc_id").alias("_id"), F.count("*").alias("_n"), F.max("_hot").alias("_hot")))
    cold = salted.filter(F.col("_hot").isNull()).select(
        "_digest", "_text", F.col("_id").alias("keep_id"), F.col("_n").alias("group_size"))
    spread = (salted.filter(F.col("_hot")).groupBy("_digest", "_text")
              .agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size")))
    return cold.unionByName(spread)


def dedup(docs: DataFrame, digest=sha256_digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every input row."""
    docs = docs.select("doc_id", "text")
    text = normalised(F.col("text"))
    columns = ["doc_id", digest(text).alias("_digest"), F.monotonically_increasing_id().alias("_row")]
    if digest is not sha256_digest:
        columns.append(F.sha2(text, 256).alias("text_sha256"))
    light = stored(docs.select(*columns), "dedup-light")
    n_rows = light.count()
    groups = winners(docs, light, n_rows, digest)
    # of repeated rows (same id and text) one is kept: its number comes out of partial minima, no window over copies
    first = light.groupBy("_digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_keep"))
    slim = stored(groups.drop("_text").join(first, "_digest"), "dedup-groups")
    if slim.groupBy("_digest").count().filter("count > 1").isEmpty():
        rows = attach_groups(light, slim, "_digest", "group_size", n_rows)
        kept = F.col("_row") == F.col("_keep")
    else:                                              # different texts share a digest: compare whole texts again
        rows = (docs.select("doc_id", text.alias("_text")).withColumn("_digest", digest(F.col("_text")))
                .withColumn("text_sha256", F.sha2("_text", 256))
                .join(groups, ["_digest", "_text"]))
        one = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("group_size")) == 1
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & one
    if "text_sha256" not in rows.columns:
        rows = rows.withColumn("text_sha256", F.lower(F.hex("_digest")))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns (the pipeline stage)."""
    held = dedup(docs).filter("kept").select(F.col("doc_id").alias("keep"), "text_sha256")
    rows = packed(docs, id=F.col("doc_id"), sha=F.sha2(normalised(F.col("text")), 256))
    joined = rows.join(held, rows["id"].eqNullSafe(held["keep"]) & (rows["sha"] == held["text_sha256"]), "left_semi")
    return joined.dropDuplicates(["id", "sha"]).select("row.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size,
       t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
