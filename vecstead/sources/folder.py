"""Folders of embedding files as a data source: `spark.read.format("embedding_folder").load(folder)`, and a writer.

Reading lists the folder once, takes seed, dim and bitrate from the files' names, and plans splits of whole files, so many
small files share a task and each file keeps its own header and width. Writing makes a file for each (seed, dim, bitrate),
beside its place, and moves all files to their places when every task is done, so readers never see a part of a file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "embedding_folder"
SCHEMA = "file string, seed int, dim int, bitrate int, rank bigint, word string, vec array<double>"
#: Bytes of files that one task reads, at least one file; rows that are parsed at once.
SPLIT, ROWS = 32 << 20, 4096
_FIELDS = {"seed": "seed", "dim": "dim", "bitrate": "br"}
_ARROW = pa.schema([("file", pa.string()), ("seed", pa.int32()), ("dim", pa.int32()), ("bitrate", pa.int32()), ("rank", pa.int64()), ("word", pa.string()), ("vec", pa.list_(pa.float64()))])


def name_fields(name: str) -> dict[str, int | None]:
    """seed, dim and bitrate as a file's name has them (`seed_1234`, `dim_50`, `br_4`), else None."""
    found = {k: re.search(rf"(?:^|_){tag}_(\d+)", name) for k, tag in _FIELDS.items()}
    return {k: int(m[1]) if m else None for k, m in found.items()}


def file_name(stem: str, seed: int | None, dim: int | None, bitrate: int | None) -> str:
    parts = [f"{_FIELDS[k]}_{v}" for k, v in (("seed", seed), ("dim", dim), ("bitrate", bitrate)) if v is not None]
    return "_".join([stem, *parts]) + ".txt"


def parsed(lines: Iterator[str], name: str) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(first rank, words, vectors) of a file's lines, ROWS at a time.

    A first line of two tokens is a header and dropped. The first other line fixes the width; of each line the last that
    many tokens are numbers and what stands before is the word. Fewer tokens raise.
    """
    width, rank, words, numbers = None, 0, [], []
    for number, line in enumerate(lines):
        line = line.rstrip()
        if number == 0 and len(line.split()) == 2:
            continue
        tokens = line.split(" ")
        if width is None:
            width = len(line.split()) - 1
        if len(tokens) < width or width < 0:
            raise ValueError(f"too few numbers in {name}: {line[:80]}")
        words.append(" ".join(tokens[: len(tokens) - width]))
        numbers.append(tokens[len(tokens) - width :] if width else [])
        if len(words) == ROWS:
            yield rank, words, np.array(numbers, dtype=np.float64)
            rank, words, numbers = rank + len(words), [], []
    if words:
        yield rank, words, np.array(numbers, dtype=np.float64).reshape(len(words), -1)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class FolderReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Files]:
        files, folder = filesystem(self.path)
        listed = sorted((x.path, x.size) for x in files.get_file_info(pafs.FileSelector(folder)) if x.type == pafs.FileType.File and not x.base_name.startswith(("_", ".")))
        splits, held, size = [], [], 0
        for path, n in listed:
            if held and size + n > self.split:
                splits.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*splits, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        import io

        files, _ = filesystem(self.path)
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            fields = name_fields(name)
            with files.open_input_stream(path) as stream, io.TextIOWrapper(stream, encoding="utf-8", newline="\n") as lines:
                for rank, words, z in parsed(lines, name):
                    n = len(words)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]) if z.shape[1] else np.zeros(n + 1), pa.int32()), pa.array(z.reshape(-1)))
                    same = [pa.array([fields[k]] * n, pa.int32()) for k in _FIELDS]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), *same, pa.array(np.arange(rank, rank + n)), pa.array(words, pa.string()), vec], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class FolderWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.stem = options["path"], options.get("stem", "emb")
        self.header, self.overwrite, self.run = options.get("header", "false").lower() == "true", overwrite, uuid.uuid4().hex

    def _beside(self, folder: str) -> str:
        return f"{folder}/_writing-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's files: rows of a file come one after another, in the order of their ranks."""
        files, folder = filesystem(self.path)
        task = f"{self._beside(folder)}/{uuid.uuid4().hex}"
        files.create_dir(task, recursive=True)
        names: dict[str, int] = {}
        out, key, last = None, None, -1
        try:
            for batch in iterator:
                columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("seed", "dim", "bitrate", "rank", "word", "vec")}
                for seed, dim, bitrate, rank, word, vec in zip(*columns.values()):
                    name = file_name(self.stem, seed, dim, bitrate)
                    if name != key:
                        if out:
                            out.close()
                        if name in names:
                            raise ValueError(f"rows of {name} don't stand together: sort by seed, dim, bitrate and rank within partitions")
                        names[name], key, last = len(names), name, -1
                        out = files.open_output_stream(f"{task}/{name}")
                    if rank < last:
                        raise ValueError(f"rows of {name} aren't in the order of their ranks")
                    last = rank
                    out.write((" ".join([word, *(f"{x:.6f}" for x in vec)]) + "\n").encode())
        finally:
            if out:
                out.close()
        return Written(tuple(f"{task.rsplit('/', 1)[-1]}/{n}" for n in names))

    def commit(self, messages: list[Written | None]) -> None:
        """Moves every file to its place; a name that two tasks wrote, or one that stands there already, raises first."""
        files, folder = filesystem(self.path)
        made = [n for m in messages if m for n in m.names]
        plain = [n.rsplit("/", 1)[-1] for n in made]
        if len(set(plain)) < len(plain):
            self.abort(messages)
            raise ValueError("several tasks wrote one file: repartition by seed, dim and bitrate")
        there = {x.base_name: x.path for x in files.get_file_info(pafs.FileSelector(folder)) if x.type == pafs.FileType.File}
        if not self.overwrite and set(plain) & set(there):
            self.abort(messages)
            raise ValueError(f"files stand there already: {sorted(set(plain) & set(there))[:3]}")
        for old in there.values() if self.overwrite else ():
            files.delete_file(old)
        for n in made:
            if self.header:
                self._with_header(files, f"{self._beside(folder)}/{n}")
            files.move(f"{self._beside(folder)}/{n}", f"{folder}/{n.rsplit('/', 1)[-1]}")
        files.delete_dir(self._beside(folder))

    def _with_header(self, files: pafs.FileSystem, path: str) -> None:
        rows, width = 0, 0
        with files.open_input_stream(path) as lines:
            for part in iter(lambda: lines.read(1 << 20), b""):
                if not rows and not width:
                    width = len(part.split(b"\n", 1)[0].split()) - 1
                rows += part.count(b"\n")
        with files.open_input_stream(path) as old, files.open_output_stream(f"{path}.with") as new:
            new.write(f"{rows} {width}\n".encode())
            for part in iter(lambda: old.read(1 << 20), b""):
                new.write(part)
        files.move(f"{path}.with", path)

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = filesystem(self.path)
        if files.get_file_info(self._beside(folder)).type == pafs.FileType.Directory:
            files.delete_dir(self._beside(folder))


class EmbeddingFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options), overwrite)


def read_folder(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """(file, seed, dim, bitrate, rank, word, vec) of all embedding files of a folder, `split` bytes of files a task."""
    spark.dataSource.register(EmbeddingFolder)
    return spark.read.format(NAME).option("split", split).load(folder)


def write_folder(embs: DataFrame, folder: str, stem: str = "emb", header: bool = False, mode: str = "append") -> None:
    """Writes `embs` (seed, dim, bitrate, rank, word, vec; the first three may be null) as a file for each key; all appear at once or none."""
    embs.sparkSession.dataSource.register(EmbeddingFolder)
    key = ["seed", "dim", "bitrate"]
    rows = embs.selectExpr("cast(null as string) as file", *(f"cast({k} as int) as {k}" for k in key), "rank", "word", "vec")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "rank")
    rows.write.format(NAME).option("stem", stem).option("header", str(header).lower()).mode(mode).save(folder)
