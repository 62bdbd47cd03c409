"""Chat sources by name. Anything that yields the message columns can be plugged in."""

from __future__ import annotations

from datetime import datetime
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import filter_time_window
from .chats import read_chats

Reader = Callable[..., DataFrame]
REQUIRED = ("chat", "seq", "kind", "text", "ts", "speaker", "side")
_READERS: dict[str, Reader] = {}


def register_source(name: str, reader: Reader) -> None:
    """``reader(spark, **options)`` gives a DataFrame with at least the REQUIRED columns."""
    _READERS[name] = reader


def source_names() -> list[str]:
    return sorted(_READERS)


def extract(spark: SparkSession, source: str, chats: list[str] | None = None, window: str = "",
            as_of: datetime | None = None, **options) -> DataFrame:
    """Messages of the named chats (all if none are named) inside the time window, which needs ``as_of``."""
    if window and as_of is None:
        raise ValueError("a time window needs as_of, the moment it counts back from")
    if source not in _READERS:
        raise KeyError(f"no chat source {source!r}; registered: {source_names()}")
    m = _READERS[source](spark, **options)
    missing = [c for c in REQUIRED if c not in m.columns]
    if missing:
        raise ValueError(f"source {source!r} lacks columns {missing}")
    if chats:
        m = m.filter(F.col("chat").isin(*chats))
    return filter_time_window(m, window, as_of) if window else m


register_source("chat_files", read_chats)
