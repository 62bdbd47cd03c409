"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import shared_dir

SPACE = r"[\x20\x09-\x0D]+"
WORD_SPACE = b" \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The maximal runs of characters other than the space and U+0009 to U+000D; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def packed(df: DataFrame) -> DataFrame:
    """The whole row as one column ``row``: columns an operator adds beside it can't clash with the caller's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def text_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its id and text, never null. Rows that agree in both are the same document twice."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but ``parts``: reruns agree."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write to the folder that all executors share and read back: what follows starts from files that
    survive a lost executor, and what led to them runs once."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most ``rows`` rows; otherwise Spark joins it by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
