"""Chat files as a data source of Spark: ``spark.read.format("chats")`` and ``spark.readStream.format("chats")``.

Where Spark's JSON reader is at hand, ``chats.read_chats`` does the same inside the JVM. The plug-in is for sources that only a Python
client can list or fetch: subclass ``ChatSource``, give it another ``list_parts`` and ``fetch``, and register it under its own name.
Registered sources take part in ``registry.extract`` like any other.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .chats import ROWS_PER_PART
from .registry import register_source

MESSAGE = ("chat string, seq bigint, kind string, text string, img_path string, box array<int>, time_label string, ts timestamp_ntz, "
           "screen_idx int, speaker string, side string, chat_name string, fingerprint string")
#: Bytes of files that share a task, unless ``taskBytes`` says otherwise.
TASK_BYTES = 64 << 20
STORED_TIME = re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}")


@dataclass(frozen=True)
class Part:
    """Something to fetch: its name, size and place in the order of arrival."""

    name: str
    size: int
    arrived: int


@dataclass
class Task(InputPartition):
    parts: list[Part]


def _time(stored) -> datetime | None:
    text = str(stored or "")[:19]
    try:
        return datetime.strptime(text, "%Y-%m-%d %H:%M:%S") if STORED_TIME.fullmatch(text) else None
    except ValueError:
        return None


def message_rows(document: dict, rows_per_part: int) -> Iterator[tuple]:
    """The messages of one stored chat, with the defaults of ``chats.explode_messages``."""
    chat, start = document.get("name") or "", (document.get("part") or 0) * rows_per_part
    for place, m in enumerate(document.get("messages") or [], start + 1):
        text = lambda c, d="": d if m.get(c) is None else m[c]  # noqa: B023, E731
        yield (chat, place, text("kind", "text"), text("text"), text("img_path"), text("box", [0, 0, 0, 0]), text("time_label"),
               _time(m.get("timestamp")), text("screen_idx", 0), text("speaker"), text("side"), text("chat_name"), text("fingerprint"))


class ChatSource(DataSource):
    """Options: ``path`` (a folder or file, any address that pyarrow's file systems read), ``multiLine`` (one document per file, default
    true, else a document per line), ``rowsPerPart``, ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "chats"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema) -> DataSourceReader:
        return ChatReader(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChatStreamReader(self)

    def _files(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def list_parts(self) -> list[Part]:
        """What there is to fetch, in order of arrival. Names that start with a dot or underscore are not chats."""
        from pyarrow import fs

        files, path = self._files()
        found = files.get_file_info(path)
        infos = [found] if found.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
        parts = [Part(i.path, i.size, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File and i.base_name[0] not in "._"]
        return sorted(parts, key=lambda p: (p.arrived, p.name))

    def fetch(self, part: Part) -> Iterator[dict]:
        """The documents of a part."""
        files, _ = self._files()
        with files.open_input_stream(part.name) as f:
            text = f.read().decode()
        whole = str(self.options.get("multiLine", "true")).lower() == "true"
        for piece in [text] if whole else text.splitlines():
            if piece.strip():
                yield json.loads(piece)

    def tasks(self, parts: list[Part]) -> list[Task]:
        """Parts packed into tasks of bounded size; a larger part is a task of its own."""
        most, out, room = int(self.options.get("taskBytes", TASK_BYTES)), [], 0
        for p in parts:
            if not out or p.size > room:
                out.append(Task([]))
                room = most
            out[-1].parts.append(p)
            room -= p.size
        return out

    def rows(self, task: Task, chats: frozenset | None = None) -> Iterator[tuple]:
        per = int(self.options.get("rowsPerPart", ROWS_PER_PART))
        for part in task.parts:
            for document in self.fetch(part):
                if chats is None or (document.get("name") or "") in chats:
                    yield from message_rows(document, per)


class ChatReader(DataSourceReader):
    def __init__(self, source: ChatSource):
        self.source, self.chats = source, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Chat names are settled here (needs spark.sql.python.filterPushdown.enabled): other documents give no rows."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("chat",):
                yield f
            else:
                self.chats = frozenset(wanted if self.chats is None else wanted & self.chats)

    def partitions(self) -> list[Task]:
        return self.source.tasks(self.source.list_parts())

    def read(self, partition: Task) -> Iterator[tuple]:
        yield from self.source.rows(partition, self.chats)


class ChatStreamReader(DataSourceStreamReader):
    """Offsets name the last part that was read, by arrival and name. A part that turns up with an earlier arrival is not read."""

    def __init__(self, source: ChatSource):
        self.source = source

    def initialOffset(self) -> dict:
        return {"arrived": -1, "name": ""}

    def latestOffset(self) -> dict:
        parts = self.source.list_parts()
        return {"arrived": parts[-1].arrived, "name": parts[-1].name} if parts else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Task]:
        at = lambda o: (o["arrived"], o["name"])
        return self.source.tasks([p for p in self.source.list_parts() if at(start) < (p.arrived, p.name) <= at(end)])

    def read(self, partition: Task) -> Iterator[tuple]:
        yield from self.source.rows(partition)

    def commit(self, end: dict) -> None:
        pass


def use_chat_source(spark: SparkSession, source: type[ChatSource] = ChatSource) -> str:
    """Make a source known to Spark and to ``registry.extract``; gives its name."""
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def read(session: SparkSession, path: str, **options) -> DataFrame:
        return session.read.format(source.name()).options(**options).load(path)

    register_source(source.name(), read)
    return source.name()
