"""Transcripts, report tables and the progress ledger."""

from __future__ import annotations

import itertools
import os
import shutil
import uuid
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folder_name
from ..operators.transcript import transcript_lines


def write_transcript(messages: DataFrame, path: str, chat: str = "chat", files: int | None = None,
                     mode: str = "errorifexists", heads: DataFrame | None = None) -> None:
    """Readable transcripts as text, one folder per chat (a safe name and a digest of the full one). Rows are ranged by (chat, time), so a large chat
    becomes several files whose names follow its order. ``heads`` (``report.head_lines``) come first. To a new folder of a shared
    file system, tasks write the files themselves: Spark's writer starts three processes a file there, to set its mode and its checksum's."""
    lines = transcript_lines(messages, [chat]).withColumn("head_no", F.lit(None).cast("int"))
    if heads is not None:
        lines = lines.unionByName(heads.select(chat, "head_no", "line"), allowMissingColumns=True)
    lines = lines.withColumn("_folder", folder_name(F.coalesce(F.col(chat).cast("string"), F.lit(""))))
    order = [F.col("_folder"), F.col(chat), F.col("head_no").asc_nulls_last(), F.col("at"), F.col("seq"), F.col("part")]
    ranged = lines.repartitionByRange(files, *order) if files else lines.repartitionByRange(*order)
    text = ranged.sortWithinPartitions(*order).select(F.col("_folder").alias("chat"), F.col("line").alias("value"))
    local = _file_path(messages.sparkSession, path)
    if local and not os.path.exists(local):
        _write_folders(text, local)
    else:
        text.write.mode(mode).partitionBy("chat").text(path)


def _file_path(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder that Spark takes to be on a file system of the machines; None for other stores."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _write_folders(text: DataFrame, path: str) -> None:
    """(chat, value), sorted within partitions, as what ``partitionBy("chat").text`` writes. Each try of a task has a folder of its own; those of the
    tries that Spark took are moved into place, chat by chat, when all tasks are done."""
    job = uuid.uuid4().hex
    temporary = f"{path}/_temporary"

    def write(batches):
        tried, part, chat, out = f"{temporary}/{uuid.uuid4().hex}", TaskContext.get().partitionId(), None, None
        try:
            for b in batches:
                for name, rows in itertools.groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), itemgetter(0)):
                    if name != chat:
                        if out:
                            out.close()
                        os.makedirs(f"{tried}/chat={name}", exist_ok=True)
                        chat, out = name, open(f"{tried}/chat={name}/part-{part:05d}-{job}.txt", "a", encoding="utf-8", newline="\n")
                    out.writelines(f"{line or ''}\n" for _, line in rows)
        finally:
            if out:
                out.close()
        if out:
            yield pa.RecordBatch.from_pydict({"tried": [tried]})

    os.makedirs(temporary)
    try:
        for r in text.mapInArrow(write, "tried string").collect():
            for folder in os.listdir(r["tried"]):
                _move(f"{r['tried']}/{folder}", f"{path}/{folder}")
    except BaseException:
        shutil.rmtree(path, ignore_errors=True)
        raise
    shutil.rmtree(temporary)
    open(f"{path}/_SUCCESS", "w").close()


def _move(folder: str, to: str) -> None:
    """A chat that lies in several partitions has files from each."""
    if not os.path.exists(to):
        os.rename(folder, to)
    else:
        for file in os.listdir(folder):
            os.rename(f"{folder}/{file}", f"{to}/{file}")


def write_report_tables(report: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One table per report section (overview, speakers, keywords, sections, conclusions, timeline, images)."""
    for name, table in report.items():
        table.write.mode(mode).format(fmt).save(f"{path.rstrip('/')}/{name}")


def ledger_rows(results: DataFrame, error_chars: int | None = None) -> DataFrame:
    """Results (name, messages, error, at) as ledger rows; error texts are cut to ``error_chars`` if that is given."""
    error = F.substring("error", 1, error_chars) if error_chars else F.col("error")
    failed = F.col("error").isNotNull()
    return results.select(
        "name", F.when(failed, "error").otherwise("done").alias("status"),
        F.when(~failed, F.col("messages").cast("long")).alias("messages"),
        error.alias("error"), "at")


def ledger_append(results: DataFrame, path: str, error_chars: int | None = None) -> None:
    ledger_rows(results, error_chars).write.mode("append").parquet(path)
