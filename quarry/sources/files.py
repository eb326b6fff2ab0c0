"""Many small files, one a row. Spark's writers give every file a folder of its own where its name matters, and on a local disk
start several programs for each to set its rights; here tasks write the files themselves, a thousand keys to a folder. Spark's
readers have the driver hold the list of all files; here tasks list the folders, and the list is a table like any other."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quarry.sources.shared import BATCH_BYTES, bound_batches, stored

#: What opening a file costs, as so many bytes read: Spark's own 4 MB leave a few small files to a task.
OPEN_BYTES = 64 << 10
#: Bytes and files that a task reads, about, and names that it lists at once.
TASK_BYTES, TASK_FILES, NAMES = 64 << 20, 10_000, 10_000


def bound_opens(spark: SparkSession) -> None:
    """Lowers the session's cost of opening a file to OPEN_BYTES, if it is higher, so that a task reads many small files."""
    if _bytes(spark, key := "spark.sql.files.openCostInBytes") > OPEN_BYTES:
        spark.conf.set(key, str(OPEN_BYTES))


def _bytes(spark: SparkSession, key: str) -> int:
    said = spark.conf.get(key).strip().lower().removesuffix("b")
    power = "kmgtp".find(said[-1:]) + 1 if said[-1:] else 0
    return int(said[:-1] if power else said) << 10 * power


def _encoded(text: str, encoding: str) -> bytes:
    """Text and a line end, as Java's writers encode them."""
    return b"\xfe\xff" + f"{text}\n".encode("utf-16-be") if encoding == "UTF-16" else f"{text}\n".encode(encoding, "replace")


def _writer(path: str, key: str, encoding: str, extension: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = fs.FileSystem.from_uri(path)
        task, made, number = TaskContext.get().partitionId(), set(), 0
        for b in batches:
            for k, text in zip(b.column(key).to_pylist(), b.column("text").to_pylist(), strict=True):
                folder = f"{top}/{key}={k[:-3] or 0}"
                if folder not in made:
                    disk.create_dir(folder, recursive=True)
                    made.add(folder)
                # a key may come twice; the same task writes the same names again if it is repeated
                with disk.open_output_stream(f"{folder}/{k}-{task}-{number}.{extension}", compression=None) as out:
                    out.write(_encoded(text or "", encoding))
                number += 1
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["n"])

    return run


def _reachable(path: str) -> bool:
    try:
        fs.FileSystem.from_uri(path)
        return True
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False


def write_files(rows: DataFrame, path: str, key: str, encoding: str, extension: str) -> None:
    """One file a row, in the order of their keys if those have one length: the column text and a line end. A store that
    Arrow doesn't know is left to Spark's writer, with a folder a row."""
    rows = rows.select(F.col(key).cast("string").alias(key), "text").where(F.col(key).isNotNull())
    if _reachable(path):
        rows.mapInArrow(_writer(path, key, encoding, extension), "n long").agg(F.sum("n")).collect()
    else:
        plain = {"quote": "", "escape": "", "sep": "\u0001", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        rows.write.mode("append").partitionBy(key).options(encoding=encoding, extension=extension, **plain).csv(path)


def key_in(path: Column | str) -> Column:
    """The number that a file of write_files has as its key."""
    return F.regexp_extract(path, r"(\d+)(?:/part-[^/]*|-\d+-\d+\.[a-z]+)$", 1).cast("long")


class Folder(NamedTuple):
    """A folder that tasks can open: its address as Spark writes it, and what Arrow opens of it."""

    address: str
    uri: str
    path: str

    def disk(self) -> tuple[fs.FileSystem, str]:
        return (fs.LocalFileSystem(), self.path) if self.uri.startswith("file:") else fs.FileSystem.from_uri(self.uri)


def reachable_folder(spark: SparkSession, folder: str) -> Folder | None:
    """A folder that is there and that Arrow can open; None of a pattern, a file, or a store that Arrow doesn't know."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        uri = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toUri()
        host = f"//{uri.getRawAuthority()}" if uri.getRawAuthority() else ""
        at = Folder(f"{uri.getScheme()}:{host}{uri.getRawPath().rstrip('/')}", uri.toASCIIString(), uri.getPath())
        disk, top = at.disk()
        return at if disk.get_file_info(top).type == fs.FileType.Directory else None
    except (pa.ArrowInvalid, OSError, NotImplementedError, Py4JJavaError):
        return None


def _hidden(name: str) -> bool:
    """What Spark's file sources leave out."""
    kept = name.startswith(("_metadata", "_common_metadata"))
    return not kept and (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _quoted(name: str) -> str:
    """A name as it is in an address, as Java quotes it; bytes that aren't UTF-8 are quoted too."""

    def one(found: re.Match) -> str:
        c = found[0]
        if c > "~" and not "\udc80" <= c <= "\udcff" and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc"):
            return c
        return "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogateescape"))

    return re.sub(r"[^A-Za-z0-9_.!~'()*,;:$&+=@/-]", one, name)


def _entries(disk: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, whether it is a folder, size); of a local disk one by one, however many there are."""
    if not isinstance(disk, fs.LocalFileSystem):
        yield from ((i.base_name, i.type == fs.FileType.Directory, i.size or 0) for i in disk.get_file_info(fs.FileSelector(folder)))
        return
    with os.scandir(folder) as found:
        for x in found:
            try:
                yield x.name, x.is_dir(), x.stat().st_size
            except FileNotFoundError:  # gone meanwhile, or a link to nothing
                continue


def _lister(at: Folder) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = at.disk()
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.bool_(), pa.int64()), strict=True)], names=["path", "folder", "size"])
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for name, folder, size in _entries(disk, top.rstrip("/") + unquote(path, errors="surrogateescape") or "/"):
                    if not _hidden(name):
                        rows.append((f"{path}/{_quoted(name)}", folder, size))
                    if len(rows) == NAMES:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return run


def files_below(spark: SparkSession, at: Folder, names: str) -> DataFrame:
    """path (quoted, from the folder on) and size of the files below a folder whose names fit a pattern, as Spark's sources
    find them. A level of folders is listed by tasks, then the next one."""
    level, found = spark.createDataFrame([("",)], "path string"), []
    while True:
        rows = stored(level.mapInArrow(_lister(at), "path string, folder boolean, size long"), "listing")
        found.append(rows.where("not folder").select("path", "size"))
        folders = rows.where("folder").select("path")
        if not (n := folders.count()):
            break
        level = folders.repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "path")
    fits = spark._jvm.org.apache.hadoop.fs.GlobPattern(names).compiled().pattern()
    name = F.url_decode(F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B")))
    return reduce(DataFrame.unionByName, found).where(name.rlike(rf"(?s)\A(?:{fits})\z"))


def dealt(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """Files (path) in as many tasks as sizes (size), of the same or more files, ask for."""
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return files.repartition(max(n // TASK_FILES, total // TASK_BYTES, min(n, files.sparkSession.sparkContext.defaultParallelism), 1), "path")


def with_content(files: DataFrame, at: Folder) -> DataFrame:
    """files (path and others) with content, their bytes, in batches of BATCH_BYTES or one file."""
    bound_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = at.disk()
        for b in batches:
            held, size, start = [], 0, 0
            paths = b.column("path").to_pylist()
            for k, path in enumerate(paths):
                with disk.open_input_file(top.rstrip("/") + unquote(path, errors="surrogateescape")) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or k == len(paths) - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(start, len(held)).columns, pa.array(held, pa.binary())], names=[*b.schema.names, "content"])
                    held, size, start = [], 0, k + 1

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))
