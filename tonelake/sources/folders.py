"""Audio files with the lyrics beside them, as a data source whose input partitions are folders.

    spark.dataSource.register(AudioFolders)
    spark.read.format("audio_folders").load("s3://bucket/music")

One pass lists a folder and reads what lies next to its audio files. Paths are opened by ``pyarrow.fs``,
so local folders and object stores are alike; every worker must reach them.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tonelake.rules import AUDIO_EXTENSIONS
from tonelake.session import settle

SCHEMA = "filepath string, file_mtime double, base string, source string, text string"
#: Fixed value: sidecar files, the first that exists counts.
SIDECARS = {".lrc": "sidecar_lrc", ".txt": "sidecar_txt"}
#: Folders are opened on the driver until there are so many, then tasks go on.
FOLDERS = 256
ROWS = 512


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; a plain absolute path is local."""
    return pafs.FileSystem.from_uri(path if ":/" in path else posixpath.abspath(path))


def split_extension(name: str) -> tuple[str, str]:
    """A leading dot is no extension."""
    base, dot, extension = name.rpartition(".")
    return (base, dot + extension) if dot and base.strip(".") else (name, "")


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, root: str, texts: bool, folders: int):
        self.root, self.texts, self.folders = root, texts, folders

    def partitions(self) -> list[Folder]:
        """Whole folders once there are enough of them; of those that were opened to get there, their own files only."""
        fs, root = open_path(self.root)
        opened, level = [], [root]
        while level and len(opened) + len(level) < self.folders:
            below = [f.path for path in level for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.Directory]
            opened, level = opened + level, sorted(below)
        return [Folder(p, False) for p in opened] + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        fs, _ = open_path(self.root)
        waiting, rows = [partition.path], []
        while waiting:
            infos = fs.get_file_info(pafs.FileSelector(waiting.pop()))
            if partition.deep:
                waiting += [f.path for f in infos if f.type == pafs.FileType.Directory]
            files = {f.path: f for f in infos if f.type == pafs.FileType.File}
            for path, info in files.items():
                folder, name = posixpath.split(path)
                base, extension = split_extension(name)
                if extension[1:].lower() in AUDIO_EXTENSIONS:
                    base = posixpath.join(folder, base)
                    rows.append((path, info.mtime.timestamp() if info.mtime else None, base, *self.sidecar(fs, base, files)))
                if len(rows) == ROWS:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    def sidecar(self, fs: pafs.FileSystem, base: str, files: dict) -> tuple[str | None, str | None]:
        """Source and text of the first sidecar that can be read; an empty one counts."""
        for extension, source in SIDECARS.items():
            if base + extension in files:
                if not self.texts:
                    return source, None
                with fs.open_input_stream(base + extension) as f:
                    raw = f.read()
                try:
                    return source, raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
        return None, None

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.float64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split(" ")[0] for c in SCHEMA.split(", ")])


class AudioFolders(DataSource):
    """Options: ``path``; ``texts``, false for the listing without sidecar texts; ``folders``, how many input partitions to aim at."""

    @classmethod
    def name(cls) -> str:
        return "audio_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("texts", "true").lower() == "true", int(self.options.get("folders", FOLDERS)))


def read_folders(spark: SparkSession, root: str, texts: bool = True, folders: int = FOLDERS) -> DataFrame:
    """``filepath, file_mtime, base, source, text`` of the audio files below ``root``; the last two of the lyrics beside them, if any."""
    spark.dataSource.register(AudioFolders)
    return spark.read.format("audio_folders").option("texts", str(texts).lower()).option("folders", str(folders)).load(root)


def write_files(rows: DataFrame, root: str) -> int:
    """Write ``rows`` (path below ``root``, text) as files of their own from the tasks; returns how many. A rerun writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_path(root)
        made: set[str] = set()
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                full = posixpath.join(top, path.lstrip("/"))
                if posixpath.dirname(full) not in made:
                    fs.create_dir(posixpath.dirname(full))
                    made.add(posixpath.dirname(full))
                with fs.open_output_stream(full) as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    written = settle(rows.select("path", "text").mapInArrow(run, "n long"), "written-files")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
