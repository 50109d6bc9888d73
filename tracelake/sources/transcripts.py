"""Transcripts as a stream: the lines that agents append to files, from where the stream has got to in each file."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LINES = "session_id string, line long, t long, value string"
#: Bytes that are looked at or given on at a time; bytes of a file that one task reads.
BLOCK, SHARE = 1 << 20, 1 << 27


@dataclass
class Part(InputPartition):
    path: str
    begin: int
    end: int


def _whole(file: pa.NativeFile, size: int) -> int:
    """Bytes up to the end of the last whole line."""
    at = size
    while at > 0:
        lo = max(0, at - BLOCK)
        file.seek(lo)
        if (cut := file.read(at - lo).rfind(b"\n")) >= 0:
            return lo + cut + 1
        at = lo
    return 0


class Reader(DataSourceStreamReader):
    """Offsets are bytes by file. A file that is shorter than before is another one, and is read from its beginning."""

    def __init__(self, folder: str):
        self.folder = folder

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, path = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return system, [f for f in found if f.is_file and f.path.endswith(".jsonl")]

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, found = self._files()
        out = {}
        for f in found:
            with system.open_input_file(f.path) as file:
                out[f.path] = _whole(file, f.size)
        return dict(sorted(out.items()))

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for path, to in end.items():
            begin = start.get(path, 0)
            begin = 0 if to < begin else begin
            parts += [Part(path, lo, min(lo + SHARE, to)) for lo in range(begin, to, SHARE)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """The lines that begin within the part."""
        system, _ = fs.FileSystem.from_uri(self.folder)
        session = posixpath.basename(part.path).removesuffix(".jsonl")
        t = system.get_file_info(part.path).mtime
        seconds = int(t.timestamp()) if t else None
        with system.open_input_file(part.path) as file:
            at = part.begin
            if at:  # the line at a part's beginning is its own only if the one before has ended
                file.seek(at - 1)
                while (piece := file.read(BLOCK)) and (cut := piece.find(b"\n")) < 0:
                    at += len(piece)
                at += cut if piece else 0
            rest = b""
            while at < part.end:
                file.seek(at + len(rest))
                piece = file.read(BLOCK)
                block = rest + piece
                if not piece:
                    return
                cut = block.rfind(b"\n") + 1
                rest = block[cut:]
                if not cut:
                    continue
                places, texts, lo = [], [], 0
                for text in block[: cut - 1].split(b"\n"):
                    if at + lo < part.end:
                        places.append(at + lo)
                        texts.append(text.decode("utf-8", "replace"))
                    lo += len(text) + 1
                at += cut
                yield pa.RecordBatch.from_arrays([pa.array([session] * len(places)), pa.array(places, pa.int64()), pa.array([seconds] * len(places), pa.int64()), pa.array(texts, pa.string())], ["session_id", "line", "t", "value"])

    def commit(self, end: dict) -> None:
        pass


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader(self.options["path"])


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """``session_id, line, t, value`` of the ``.jsonl`` files under a folder, as a path or URI that pyarrow can open.

    ``line`` is where the line begins, in bytes; ``t`` is when its file was last changed. The stream's checkpoint is the cursor:
    after a restart it goes on at the byte it had got to in each file. A line counts once its end is written; new files are found
    by themselves. A file that has become shorter is taken as a new one. ``hooks.transcript`` makes thoughts of the lines.
    """
    spark.dataSource.register(Transcripts)
    return spark.readStream.format("transcripts").option("path", folder if "://" in folder else f"file://{folder}").load()
