"""Append-only NDJSON logs as a stream: a byte offset per file, rotation, bad lines and repeated records."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: What a record of the query log holds.
QUERY_LOG = (
    "query_id string, queried_at string, client_id string, mode string, line string, direction_code string, boarding_int_id bigint, boarding_text_id string, "
    "boarding_station_name string, alighting_int_id bigint, alighting_text_id string, alighting_station_name string, predicted_wait_mean double, predicted_wait_p50 double, "
    "predicted_wait_p80 double, predicted_wait_p90 double, predicted_in_vehicle_mean double, predicted_total_p50 double, predicted_total_p80 double, "
    "predicted_total_p90 double, predictor_version string, success boolean, error_reason string"
)
HEAD, TAIL = 256, 1 << 16


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` and the path on it; a path without scheme is a local one."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Stretch(InputPartition):
    """Lines of ``path`` that begin in ``begin`` to ``end``; ``begin`` itself is the start of a line if ``whole``."""

    path: str
    begin: int
    end: int
    whole: bool


class LogReader(DataSourceStreamReader):
    """The offset is, for each file, how far it was read (always the end of a line) and a checksum of its first bytes.

    A file that has become shorter, or begins with other bytes, was rotated: it is read from its start again. Lines without
    an end wait for it. Much new data is dealt out in stretches of ``stretch`` bytes, cut at lines.
    """

    def __init__(self, folder: str, names: list[str], stretch: int):
        self.folder, self.names, self.stretch = folder, names, stretch

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = _open(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        logs = [f for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"]
        return {f.path: self._state(fs, f.path, f.size) for f in sorted(logs, key=lambda f: f.path)}

    def _state(self, fs: pafs.FileSystem, path: str, size: int) -> list[int]:
        with fs.open_input_file(path) as file:
            width = min(HEAD, size)
            head = zlib.crc32(file.read_at(width, 0))
            end, at = 0, size
            while at > 0 and not end:
                begin = max(0, at - TAIL)
                last = file.read_at(at - begin, begin).rfind(b"\n")
                end, at = (begin + last + 1 if last >= 0 else 0), begin
            return [end, width, head]

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        fs, _ = _open(self.folder)
        out = []
        for path, (upto, _, _) in sorted(end.items()):
            since, width, head = start.get(path, (0, 0, 0))
            if since:
                with fs.open_input_file(path) as file:
                    same = since <= upto and zlib.crc32(file.read_at(width, 0)) == head
                since = since if same else 0
            cuts = range(since, upto, self.stretch)
            out += [Stretch(path, b, min(b + self.stretch, upto), b == since) for b in cuts]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        fs, _ = _open(self.folder)
        with fs.open_input_file(partition.path) as file:
            at = partition.begin
            file.seek(at if partition.whole else at - 1)
            if not partition.whole:
                # the line that reaches into this stretch belongs to the one before, unless it ended just there
                at += len(_line(file)) - 1
            while at < partition.end:
                line = _line(file)
                if not line:
                    return
                at += len(line)
                if (row := self._row(line)) is not None:
                    yield row

    def _row(self, line: bytes) -> tuple | None:
        try:
            record = json.loads(line.decode("utf-8"))
        except ValueError:
            return None
        if not isinstance(record, dict):
            return None
        return tuple(None if record.get(n) is None else str(record[n]).lower() if isinstance(record[n], bool) else str(record[n]) for n in self.names)

    def commit(self, end: dict) -> None:
        pass


def _line(file) -> bytes:
    """The rest of the current line, its end included."""
    parts = []
    while True:
        begin = file.tell()
        piece = file.read(8192)
        stop = piece.find(b"\n")
        if stop >= 0:
            file.seek(begin + stop + 1)
            return b"".join([*parts, piece[: stop + 1]])
        if not piece:
            return b"".join(parts)
        parts.append(piece)


class LogSource(DataSource):
    """``spark.readStream.format("ndjson_log")`` with options path, fields (comma-joined) and stretch (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "ndjson_log"

    def schema(self) -> str:
        return ", ".join(f"`{n}` string" for n in self._names())

    def _names(self) -> list[str]:
        return self.options["fields"].split(",")

    def streamReader(self, schema: T.StructType) -> LogReader:
        return LogReader(self.options["path"], self._names(), int(self.options.get("stretch", str(64 << 20))))


def query_log(spark: SparkSession, folder: str, late: str = "30 days", stretch: int = 64 << 20) -> DataFrame:
    """The query log of ``folder`` as a stream of typed records, each id once (``late`` bounds how long ids are remembered).

    Missing stop numbers are 0 and missing success is false; records without an id or a time are left out.
    """
    fields = T.StructType.fromDDL(QUERY_LOG)
    spark.dataSource.register(LogSource)
    raw = spark.readStream.format("ndjson_log").option("path", folder).option("fields", ",".join(fields.names)).option("stretch", str(stretch)).load()
    typed = raw.select(*[F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in fields])
    typed = typed.withColumns({"queried_at": F.expr("try_cast(queried_at as timestamp)"), "boarding_int_id": F.coalesce("boarding_int_id", F.lit(0)), "alighting_int_id": F.coalesce("alighting_int_id", F.lit(0)), "success": F.coalesce("success", F.lit(False))})
    return typed.where("query_id is not null and queried_at is not null").withWatermark("queried_at", late).dropDuplicatesWithinWatermark(["query_id"])
