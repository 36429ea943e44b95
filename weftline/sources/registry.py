"""Registry of frontends: each turns its source into the statement model."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

Frontend = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self._frontends: dict[str, Frontend] = {}
        self._suffixes: dict[str, str] = {}

    def register(self, language: str, suffixes: tuple[str, ...], frontend: Frontend) -> None:
        if language in self._frontends:
            raise ValueError(f"frontend {language!r} is registered already")
        for s in suffixes:
            if s != s.lower() or not s.startswith("."):
                raise ValueError(f"suffix {s!r} must be lower case and start with a dot")
            if s in self._suffixes:
                raise ValueError(f"suffix {s!r} belongs to {self._suffixes[s]!r}")
        self._frontends[language] = frontend
        self._suffixes |= dict.fromkeys(suffixes, language)

    def languages(self) -> list[str]:
        return sorted(self._frontends)

    def select(self, path: str, language: str | None = None) -> Frontend:
        """By explicit id, else by the path's suffix."""
        name = language or self._suffixes.get(PurePosixPath(path).suffix.lower())
        if name not in self._frontends:
            raise ValueError(f"no frontend for {language or path!r}")
        return self._frontends[name]


def default() -> Registry:
    from weftline.sources import mlang, tables

    r = Registry()
    r.register("m", (".m",), mlang.read)
    r.register("events", (".events",), tables.read_events)
    r.register("conversations", (".conversations",), tables.read_conversations)
    return r
