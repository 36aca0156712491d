"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id has no fold (null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet under the shared checkpoint folder and read it.

    A lost executor loses nothing of it, and every later use reads the table
    instead of running the plan again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/vitrine-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, id_col: str, groups: dict, group_col: Column, per_group: int) -> DataFrame:
    """About ``per_group`` rows of each group, chosen by a hash of the id.

    ``groups`` maps each group value to its row count, so the kept share falls
    as the table grows and the sample stays bounded by ``per_group`` rows a
    group (within the spread of a binomial draw). The same ids are chosen in
    every run, and no shuffle or sort is needed.
    """
    ticket = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("vitrine-sample")), F.lit(1_000_000))
    keep = F.lit(False)
    for value, count in groups.items():
        limit = min(1_000_000, int(1_000_000 * per_group / max(1, count)))
        keep = keep | ((group_col == F.lit(value)) & (ticket < F.lit(limit)))
    return df.where(keep)
