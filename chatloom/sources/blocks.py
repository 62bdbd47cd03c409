"""Tables of positioned text blocks, the output of a text reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import BLOCK


def place_blocks(raw: DataFrame, floor: float = 0.5) -> DataFrame:
    """Drop blocks below the score floor or without text; add edges and centre of the four corners."""
    xs, ys = F.transform("box", lambda p: p[0]), F.transform("box", lambda p: p[1])
    mean = lambda v: (F.aggregate(v, F.lit(0), lambda a, x: a + x) / F.size(v)).cast("int")
    return (raw.withColumn("text", strip(F.coalesce("text", F.lit(""))))
            .withColumn("score", F.coalesce("score", F.lit(0.0)))
            .filter((F.col("score") >= floor) & (F.col("text") != ""))
            .select("frame_id", "seq", "text", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"),
                    mean(xs).alias("cx"), mean(ys).alias("cy"), "score"))


def read_blocks(spark: SparkSession, path: str, floor: float = 0.5, fmt: str = "parquet") -> DataFrame:
    reader = spark.read if fmt == "parquet" else spark.read.schema(BLOCK)
    return place_blocks(reader.format(fmt).load(path), floor)
