"""A stream of frame messages from an append-only log, and what is done with bad ones.

A log is a folder of files, its shards, to which producers append one JSON object a line. The source hands lines on as
they are, with shard and position; parsing is Spark's work. The offset of a stream is the byte in each shard up to which
whole lines are there, so a line that is still being written waits, and a restart goes on where the last checkpoint ended.

The folder must be one that the driver and all executors reach by the same path (a mounted share, as the broker's address
would be); Python opens the files. A shard's part of a batch is one task, cut at ``max_bytes`` into several.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import usable_messages

#: Bytes of a shard that one task reads.
MAX_BYTES = 64 << 20
_BLOCK = 1 << 16
#: What a message holds; images are base64, the pose an object or its text.
FIELDS = ("ts", "content", "depth", "camera_pose")


@dataclass
class ShardRange(InputPartition):
    path: str
    shard: str
    start: int
    end: int


def whole_lines(path: str, known: int = 0) -> int:
    """The byte after the last line end of a file, not before ``known``."""
    at = os.path.getsize(path)
    with open(path, "rb") as f:
        while at > known:
            begin = max(known, at - _BLOCK)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return known


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, max_bytes: int):
        self.folder, self.max_bytes, self.last = folder, max_bytes, {}

    def initialOffset(self) -> dict:
        return {"shards": {}}

    def latestOffset(self) -> dict:
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".jsonl"))
        self.last = {n: whole_lines(os.path.join(self.folder, n), self.last.get(n, 0)) for n in names}
        return {"shards": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for shard, last in end["shards"].items():
            first, path = start["shards"].get(shard, 0), os.path.join(self.folder, shard)
            out += [ShardRange(path, shard, a, min(a + self.max_bytes, last)) for a in range(first, last, self.max_bytes)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Lines that begin in the range; the last one may end after it."""
        assert isinstance(partition, ShardRange)
        with open(partition.path, "rb") as f:
            f.seek(max(0, partition.start - 1))
            if partition.start and f.read(1) != b"\n":
                f.readline()  # begun in the range before
            while (at := f.tell()) < partition.end:
                line = f.readline()
                if line.strip():
                    yield partition.shard, at, line.decode("utf-8", "replace").rstrip("\r\n")

    def commit(self, end: dict) -> None:
        pass


class MessageLog(DataSource):
    """``spark.readStream.format("message_log").load(folder)``, once registered; option ``max_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return "shard string, position long, message string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        folder = self.options.get("path")
        if not folder or not os.path.isdir(folder):
            raise ValueError(f"no folder of messages: {folder!r}")
        return _Reader(folder, int(self.options.get("max_bytes", MAX_BYTES)))


def read_messages(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The stream of a log's messages: shard, position and the four fields as text, null where a line has none or is no object."""
    spark.dataSource.register(MessageLog)
    raw = spark.readStream.format("message_log").option("max_bytes", str(max_bytes)).load(folder)
    return parsed_messages(raw)


def parsed_messages(raw: DataFrame) -> DataFrame:
    return raw.select("shard", "position", "message", *[F.get_json_object("message", f"$.{n}").alias(n) for n in FIELDS])


def store_messages(messages: DataFrame, good: str, bad: str):
    """The stream's writer, to be given a checkpoint and started: frames that can be used to ``good``, others whole to ``bad``.

    Each batch writes a folder of its own name, anew if it is replayed, so nothing is lost or doubled whatever stops it. Images are
    decoded from base64; text that is not base64 makes a message bad.
    """

    def store(batch: DataFrame, number: int) -> None:
        image = lambda n: F.expr(f"try_to_binary({n}, 'base64')")
        usable, rest = usable_messages(batch.withColumns({"content": image("content"), "depth": image("depth")}))
        usable.drop("message").write.mode("overwrite").parquet(f"{good}/batch={number}")
        rest.select("shard", "position", "message").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return messages.writeStream.foreachBatch(store)


def append_messages(path: str, messages: list[dict]) -> None:
    """Add messages to a shard, as a producer does."""
    with open(path, "a", encoding="utf-8") as f:
        f.write("".join(json.dumps(m) + "\n" for m in messages))
