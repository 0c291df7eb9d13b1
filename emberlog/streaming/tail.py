"""A streaming source that follows growing files: every trigger brings the whole lines appended since the one before.

The offset of the stream says for every file how many bytes have been read, so a restarted query goes on where its checkpoint
stands. Bytes are dealt out to tasks in ranges; nothing but the names, sizes and ends of files passes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from emberlog.sources.files import file_system

LINES = "source_file string, block_start bigint, block_length bigint, raw string"
#: Bytes in a task's range, bytes read at once, and bytes at a file's start by which it is known again.
SPLIT, PIECE, HEAD = 16 << 20, 1 << 20, 1024


class Range(InputPartition):
    """Bytes of a file; its lines are those that start here, and the last one is read to its end."""

    def __init__(self, path: str, start: int, end: int, last: int):
        self.path, self.start, self.end, self.last = path, start, end, last


def _last_line_end(file, size: int) -> int:
    """Where the last line feed ends, read from the back; 0 if there is none."""
    end = size
    while end > 0:
        start = max(0, end - PIECE)
        file.seek(start)
        found = file.read(end - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        end = start
    return 0


def _head(file, size: int) -> str:
    file.seek(0)
    return hashlib.sha256(file.read(min(size, HEAD))).hexdigest()[:16]


class Tail(DataSourceStreamReader):
    """Offsets: ``{"files": {path: {"end": bytes read, "head": digest of the first HEAD of them}}}``.

    A file that became shorter than what was read of it, or no longer starts with the same bytes, was replaced and is read from
    its start again. A file that is gone is forgotten, and what it held unread is lost. A line without its line feed yet is left
    for a later trigger.
    """

    def __init__(self, path: str, from_end: bool, split: int):
        self.path, self.from_end, self.split, self.seen = path, from_end, split, {}

    def _now(self) -> dict:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        listed = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        files = {f.path: (f.size, f.mtime_ns) for f in listed if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}
        before, self.seen = self.seen, {}
        for name, state in sorted(files.items()):  # unchanged files are not opened again
            if name in before and before[name][0] == state:
                self.seen[name] = before[name]
                continue
            with system.open_input_file(name) as file:
                end = _last_line_end(file, state[0])
                self.seen[name] = state, {"end": end, "head": _head(file, end)}
        return {"files": {name: at for name, (_, at) in self.seen.items()}}

    def initialOffset(self) -> dict:
        return self._now() if self.from_end else {"files": {}}

    def latestOffset(self) -> dict:
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = []
        for path, now in sorted(end["files"].items()):
            before = start["files"].get(path, {"end": 0})
            first = before["end"] if before["end"] and self._follows(path, before, now) else 0
            ranges += [Range(path, a, min(a + self.split, now["end"]), now["end"]) for a in range(first, now["end"], self.split)]
        return ranges

    def _follows(self, path: str, before: dict, now: dict) -> bool:
        """Whether ``now`` goes on from ``before``."""
        if now["end"] < before["end"] or before["end"] >= HEAD:
            return now["end"] >= before["end"] and now["head"] == before["head"]
        try:
            with file_system(self.path)[0].open_input_file(path) as file:
                return _head(file, before["end"]) == before["head"]
        except FileNotFoundError:
            return True  # a batch of before planned again

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa

        def batch(data: bytes) -> pa.RecordBatch:
            lines = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
            texts = pa.array([line.decode("utf-8", "replace") for line in lines if line.strip()], pa.string())
            same = [pa.array([v] * len(texts), t) for v, t in ((partition.path, pa.string()), (partition.start, pa.int64()), (partition.end - partition.start, pa.int64()))]
            return pa.RecordBatch.from_arrays([*same, texts], ["source_file", "block_start", "block_length", "raw"])

        try:
            opened = file_system(self.path)[0].open_input_file(partition.path)
        except FileNotFoundError:
            return
        with opened as file:
            inside, held = partition.start == 0, b""
            at = max(0, partition.start - 1)
            file.seek(at)
            while data := file.read(min(PIECE, partition.last - at)):
                at += len(data)
                if not inside:  # the line that is open where the range starts belongs to the one before
                    ends = data.find(b"\n")
                    if ends < 0:
                        continue
                    inside, data = True, data[ends + 1:]
                held += data
                first = at - len(held)
                if first >= partition.end:
                    return
                if at < partition.end:
                    done = held.rfind(b"\n") + 1
                else:  # up to the end of the line that the range's last byte is in
                    done = held.find(b"\n", partition.end - 1 - first) + 1
                if done:
                    yield batch(held[:done])
                    held = held[done:]
                    if at >= partition.end:
                        return


class TailSource(DataSource):
    """Options: ``path`` (a folder or a file), ``fromEnd`` (only lines written from now on), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "emberlog_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> Tail:
        return Tail(self.options["path"], self.options.get("fromEnd", "false").lower() == "true", int(self.options.get("splitBytes", SPLIT)))


def follow_lines(spark: SparkSession, path: str, from_end: bool = False, split_bytes: int = SPLIT) -> DataFrame:
    """Streaming lines appended to the files of a folder (or to one file): ``source_file, block_start, block_length, raw``.

    Blank lines are left out, bytes that are no UTF-8 become replacement characters, files whose names start with a dot or an
    underscore are not read. ``from_end`` starts at the end of the files there are. A block is a range of bytes, so the lines
    of a file are in order of ``block_start`` and then of their place in it. A file that got shorter, or starts with other
    bytes than before, is read from its start again.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format(TailSource.name()).option("path", path).option("fromEnd", str(from_end).lower()).option("splitBytes", split_bytes)
    return reader.load().select("source_file", "block_start", "block_length", F.col("raw"))
