"""Reading the Parquet tables of a data folder and the small shared helpers of all operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Python's str.strip() drops among the ASCII characters, as a Java character class.
BLANKS = r"[\s\x{85}\x{a0}\x{3000}]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def one_form(c: Column | str) -> Column:
    """An id with outer white space dropped and exactly one pair of angle brackets; null for a null or blank id."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(c, rf"^(?:{BLANKS}|<)+|(?:{BLANKS}|>)+$", "")
    return F.when(F.length(bare) > 0, F.concat(F.lit("<"), bare, F.lit(">")))


def clean(c: Column) -> Column:
    """A column's text with outer white space dropped."""
    return F.regexp_replace(c, rf"^{BLANKS}+|{BLANKS}+$", "")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. One of our own is set only where none is named, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or f"file://{os.path.abspath('spark-warehouse')}/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
