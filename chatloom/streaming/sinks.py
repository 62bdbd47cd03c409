"""Running streams to tables: exactly-once files, resume, and the ledger."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import null_safe_join
from ..schema import LEDGER
from ..session import settle
from ..sources.sinks import ledger_rows

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_durable_state(spark: SparkSession) -> None:
    """State on local disk with changes in the checkpoint: needed by the stateful operators."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def start_to_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                   every: str = "1 minute") -> StreamingQuery:
    """Append to parquet. A rerun with the same ``checkpoint`` continues where the last one stopped and
    writes no row twice."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)
    return w.outputMode("append").start()


def run_to_files(stream: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> DataFrame:
    """Process everything that is there, then read the result."""
    spark = stream.sparkSession
    q = start_to_files(stream, path, checkpoint)
    q.awaitTermination(timeout) if timeout else q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """What ``upsert_ledger`` has written, nothing if that is not there yet. ``bucket`` prunes folders."""
    schema = f"{LEDGER}, batch_id bigint, bucket int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def new_ledger_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """What ``rows`` add to a ledger: of each name its failures up to its first success, and that success. Rows that the ledger has
    already (a replay, a repeat) and whatever follows a success add nothing."""
    columns = ["name", "status", "messages", "error", "at"]
    done = known.filter("status = 'done'").select("name").distinct()
    fresh = null_safe_join(null_safe_join(rows.select(*columns).distinct(), known.select(*columns), columns, "left_anti"), done, ["name"], "left_anti")
    # a time that is not known comes before all others
    order = F.struct(F.col("at").isNotNull().alias("dated"), F.col("at"), F.col("messages"))
    first = fresh.filter("status = 'done'").groupBy("name").agg(F.min(order).alias("_first"))
    placed = null_safe_join(fresh.withColumn("_order", order), first, ["name"], "left")
    early = F.col("_first").isNull() | (F.struct("_order.dated", "_order.at") <= F.struct("_first.dated", "_first.at"))
    return placed.filter(F.when(F.col("status") == "done", F.col("_order") == F.col("_first")).otherwise(early)).select(*columns)


def upsert_ledger(results: DataFrame, path: str, checkpoint: str, timeout: int | None = None, buckets: int = 64) -> None:
    """Append results to the ledger batch by batch: a failed name is tried again, a name that is done stays done.

    The ledger lies in folders by a hash of the name, and a batch reads only the folders of its own names. What a batch adds depends on
    the rows alone (``new_ledger_rows``), so it may be replayed after a crash, and results that arrive in time order leave the same
    ledger however they are cut into batches."""
    spark = results.sparkSession

    def append(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("name"), F.lit(buckets)).cast("int")
        rows = settle(ledger_rows(batch).withColumn("bucket", bucket), "results")
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]    # at most ``buckets``
        if touched:
            known = read_ledger(spark, path).filter(F.col("bucket").isin(touched))
            new = settle(new_ledger_rows(rows, known), "new-rows")      # read in full before the folder changes
            # a folder's rows come from one task, or a few where it is large: else every task writes a file to every folder
            (new.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("bucket", bucket).hint("rebalance", "bucket")
             .write.mode("append").partitionBy("bucket").parquet(path))

    q = (results.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination(timeout) if timeout else q.awaitTermination()
