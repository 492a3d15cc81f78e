"""Topics as a streaming source and sink of their own: partitions, offsets, commits. ``spark.dataSource.register(Topics)`` makes the format ``topic``.

A topic is a folder (any that pyarrow's file systems open by its URI) with a folder for each partition; a segment there is a Parquet
file named by its first offset and its number of messages. Readers see whole segments only, as a segment appears by a rename.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

#: What a reader gives: where a message stands, and the message.
READ = "part int, off long, key string, value string, retry_count int, not_before long, origin string"
#: What a writer takes: a message without its place.
WRITTEN = ["key", "value", "retry_count", "not_before", "origin"]
_ARROW = pa.schema([("key", pa.string()), ("value", pa.string()), ("retry_count", pa.int32()), ("not_before", pa.int64()), ("origin", pa.string())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def segments(store: fs.FileSystem, root: str) -> dict[int, list[tuple[int, int, str]]]:
    """(first offset, messages, path) of each partition's segments, in order."""
    out: dict[int, list[tuple[int, int, str]]] = {}
    for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder, _, name = f.path.rpartition("/")
        part = folder.rpartition("/")[2]
        if f.is_file and part.startswith("part=") and name.endswith(".parquet"):
            first, n = name[:-8].split("-")
            out.setdefault(int(part[5:]), []).append((int(first), int(n), f.path))
    return {p: sorted(own) for p, own in out.items()}


@dataclass
class Range(InputPartition):
    """Offsets of one partition, the end exclusive."""

    part: int
    start: int
    end: int

    def __init__(self, part: int, start: int, end: int):
        super().__init__(None)
        self.part, self.start, self.end = part, start, end


class TopicReader(DataSourceStreamReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit
        self._seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"0": 0}

    def latestOffset(self) -> dict:
        """The end of each partition, at most ``limit`` messages beyond what was handed out."""
        ends = {str(p): own[-1][0] + own[-1][1] for p, own in segments(*opened(self.path)).items()} or {"0": 0}
        if self.limit:
            ends = {p: min(e, self._seen.get(p, 0) + self.limit) for p, e in ends.items()}
        return ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._seen = dict(end)
        return [Range(int(p), start.get(p, 0), e) for p, e in end.items() if e > start.get(p, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.path)
        for first, n, path in segments(store, root).get(partition.part, []):
            low, high = max(partition.start, first), min(partition.end, first + n)
            if low < high:
                rows = pq.read_table(path, filesystem=store, partitioning=None).slice(low - first, high - low)
                places = [pa.array([partition.part] * len(rows), pa.int32()), pa.array(range(low, high), pa.int64())]
                for i, name in enumerate(("part", "off")):
                    rows = rows.add_column(i, name, places[i])
                yield from rows.to_batches()

    def commit(self, end: dict) -> None:
        """Offsets are kept by the query's checkpoint; the topic keeps its messages for other readers."""


@dataclass
class Written(WriterCommitMessage):
    """Segments that a task wrote aside: partition, messages, path."""

    files: list[tuple[int, int, str]]


class TopicWriter(DataSourceStreamWriter):
    """Tasks write segments aside; the commit of a batch names them, once, by a plan that is stored before anything moves."""

    def __init__(self, path: str, parts: int, name: str):
        self.path, self.parts, self.name = path, parts, name

    def write(self, iterator: Iterator) -> Written:
        store, root = opened(self.path)
        held: dict[int, list[dict]] = {}
        files: list[tuple[int, int, str]] = []

        def flush(part: int) -> None:
            rows = held.pop(part)
            path = f"{root}/_aside/{uuid.uuid4().hex}.parquet"
            store.create_dir(f"{root}/_aside", recursive=True)
            pq.write_table(pa.Table.from_pylist(rows, _ARROW), path, filesystem=store)
            files.append((part, len(rows), path))

        for row in iterator:
            part = zlib.crc32((row["key"] or "").encode()) % self.parts
            held.setdefault(part, []).append({c: row[c] for c in WRITTEN})
            if len(held[part]) >= 10_000:
                flush(part)
        for part in sorted(held):
            flush(part)
        return Written(files)

    def commit(self, messages: list, batchId: int) -> None:
        store, root = opened(self.path)
        plan = f"{root}/_batches/{self.name}-{batchId}.json"
        if not store.get_file_info(plan).is_file:
            ends = {p: own[-1][0] + own[-1][1] for p, own in segments(store, root).items()}
            moves = []
            for part, n, path in sorted(f for m in messages if m is not None for f in m.files):
                first = ends.get(part, 0)
                ends[part] = first + n
                moves.append((path, f"{root}/part={part}/{first:020d}-{n}.parquet"))
            store.create_dir(f"{root}/_batches", recursive=True)
            with store.open_output_stream(plan + ".tmp") as out:
                out.write(json.dumps(moves).encode())
            store.move(plan + ".tmp", plan)
        else:
            self.abort(messages, batchId)
        with store.open_input_stream(plan) as stored:
            moves = json.loads(stored.read())
        for source, to in moves:
            if store.get_file_info(source).is_file:
                store.create_dir(to.rpartition("/")[0], recursive=True)
                store.move(source, to)

    def abort(self, messages: list, batchId: int) -> None:
        store, _ = opened(self.path)
        for m in messages:
            for *_, path in m.files if m is not None else []:
                if store.get_file_info(path).is_file:
                    store.delete_file(path)


class Topics(DataSource):
    """Options: ``path``; for readers ``maxPerTrigger`` (messages of a partition in a batch, 0: all); for writers ``parts`` and ``writer``,
    a name that no other query uses on the topic. One query writes to a topic at a time, as offsets follow each other."""

    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return READ

    def streamReader(self, schema) -> TopicReader:
        return TopicReader(self.options["path"], int(self.options.get("maxPerTrigger", 0)))

    def streamWriter(self, schema, overwrite: bool) -> TopicWriter:
        return TopicWriter(self.options["path"], int(self.options.get("parts", 1)), self.options["writer"])
