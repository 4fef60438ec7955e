"""Sources and sinks of the streams outside Spark: a platform's updates by update_id, and results that go out once per batch.

Both talk to a client that options name as `package.module:factory`; the factory gets the options. A client of updates
has fetch(offset, limit), which gives updates (dicts) from an update_id on, in order, and keeps them until confirm(offset).
A client of results has publish(batch, part, messages), where a repeated (batch, part) replaces the earlier one.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators import relational
from .jobs import UPDATE

LIMIT = 10_000


def client_of(options: dict[str, str]):
    """The client that the options name."""
    module, _, factory = options["client"].partition(":")
    return getattr(importlib.import_module(module), factory)(dict(options))


class FolderUpdates:
    """Updates from JSON lines in a folder, for tests and replays of a recorded stream."""

    def __init__(self, options: dict[str, str]):
        self.path = Path(options["path"])

    def fetch(self, offset: int, limit: int) -> list[dict]:
        lines = [json.loads(line) for file in sorted(self.path.glob("*.json")) for line in file.read_text().splitlines() if line.strip()]
        return sorted((u for u in lines if u["update_id"] >= offset), key=lambda u: u["update_id"])[:limit]

    def confirm(self, offset: int) -> None:
        pass


class FolderResults:
    """Results as JSON lines, a file per batch and part, for tests."""

    def __init__(self, options: dict[str, str]):
        self.path = Path(options["path"])

    def publish(self, batch: int, part: int, messages: list[str]) -> None:
        self.path.mkdir(parents=True, exist_ok=True)
        (self.path / f"{batch}-{part}.json").write_text("\n".join(messages))


class _UpdateReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.client, self.limit = client_of(options), int(options.get("limit", LIMIT))
        self.start = int(options.get("start", 0))

    def initialOffset(self) -> dict:
        return {"update_id": self.start}

    def _rows(self, found: list[dict]) -> Iterator[tuple]:
        return iter([(u["update_id"], json.dumps(u, ensure_ascii=False)) for u in found])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self.client.fetch(start["update_id"], self.limit)
        return self._rows(found), {"update_id": found[-1]["update_id"] + 1} if found else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        found, at = [], start["update_id"]
        while at < end["update_id"]:
            more = [u for u in self.client.fetch(at, self.limit) if u["update_id"] < end["update_id"]]
            if not more:
                break
            found += more
            at = more[-1]["update_id"] + 1
        return self._rows(found)

    def commit(self, end: dict) -> None:
        self.client.confirm(end["update_id"])


class UpdateSource(DataSource):
    """Streaming source `updates`: update_id and the update as JSON; its offset is the next update_id, confirmed once a batch is done."""

    @classmethod
    def name(cls) -> str:
        return "updates"

    def schema(self) -> str:
        return "update_id long, value string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _UpdateReader(self.options)


@dataclass
class _Part(WriterCommitMessage):
    token: str
    messages: list[str]


class _ResultWriter(DataSourceStreamWriter):
    """Tasks hand their messages over with their commit; the batch goes out, part by part, only when all of them have."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def write(self, iterator) -> WriterCommitMessage:
        return _Part(uuid.uuid4().hex, [row[0] for row in iterator])

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        client = client_of(self.options)
        for part, own in enumerate(m for m in messages if m is not None and m.messages):
            client.publish(batchId, part, own.messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        pass


class ResultSink(DataSource):
    """Streaming sink `results` of one column of messages (text)."""

    @classmethod
    def name(cls) -> str:
        return "results"

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _ResultWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(UpdateSource)
    spark.dataSource.register(ResultSink)


def platform_updates(spark: SparkSession, client: str, **options: str) -> DataFrame:
    """Updates with text (update_id, at, text, ref), each once: a query that starts again goes on after the last batch it finished."""
    register(spark)
    raw = spark.readStream.format("updates").options(client=client, **options).load()
    return relational.accepted(raw.select(F.from_json("value", UPDATE).alias("u")).select("u.*"))
