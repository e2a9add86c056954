"""File trees and snapshots as (path, text) tables."""

from __future__ import annotations

import contextlib
import functools
import itertools
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hushscan.functions import content as C, paths as P
from hushscan.operators.cluster import materialise
from hushscan.operators.detect import DEFAULT
from hushscan.operators.ordered import carry_forward
from hushscan.options import Options


_LISTED = "path string, location string, length long"
_ENTRIES = _LISTED + ", is_folder boolean"
_PAGE = 10_000
_BATCH_BYTES = 16 << 20
#: bytes of files that one task reads
TASK_BYTES = 128 << 20
#: opening a file costs about as much as reading this
_OPEN_BYTES = 256 << 10
_READERS_PER_CORE = 4


def filesystem(root: str):
    """The file system of a folder and the folder's name in it."""
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def _entries(root: str, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(location, length, is_folder) of what stands in a folder; links to folders are not followed."""
    from pyarrow import fs

    system, _ = filesystem(root)
    if isinstance(system, fs.LocalFileSystem):
        with contextlib.suppress(OSError), os.scandir(folder) as found:  # read page by page
            for e in found:
                with contextlib.suppress(OSError):
                    if e.is_dir(follow_symlinks=False):
                        yield e.path, 0, True
                    elif e.is_file():
                        yield e.path, e.stat().st_size, False
        return
    for e in system.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True)):
        yield e.path, e.size or 0, not e.is_file


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, location, length) of every file below ``root``, hidden names included.

    Spark's own file listing leaves out names starting with ``.`` or ``_``, which
    are ordinary sources here.  The tree is read level by level: the folders of
    a level are rows, dealt out over tasks, and what a task finds it hands on
    in pages.  The driver knows how many levels there are and no names.
    """
    _, base = filesystem(root)
    base = base.rstrip("/")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("location").to_pylist():
                found = _entries(root, folder)
                while page := list(itertools.islice(found, _PAGE)):
                    places, sizes, folders = zip(*page)
                    names = [p[len(base) + 1 :] for p in places]
                    yield pa.record_batch(
                        [pa.array(names), pa.array(places), pa.array(sizes, pa.int64()), pa.array(folders)],
                        names=["path", "location", "length", "is_folder"],
                    )

    tasks = spark.sparkContext.defaultParallelism * _READERS_PER_CORE
    frontier, levels = spark.createDataFrame([(base,)], "location string"), []
    while True:
        level = materialise(frontier.repartition(tasks, "location").mapInArrow(expand, _ENTRIES))
        levels.append(level.where("NOT is_folder").drop("is_folder"))
        frontier = level.where("is_folder").select("location")
        if not frontier.limit(1).count():
            return functools.reduce(DataFrame.unionAll, levels)


def _binary_head(head: bytes, strict: bool) -> bool:
    """``content.looks_binary`` for the first bytes of a file."""

    def valid(data: bytes) -> bool:
        try:
            data.decode()
        except UnicodeDecodeError:
            return False
        return True

    first = head[: C.SNIFFED_BYTES]
    return b"\0" in first or not any(valid(head[: C.SNIFFED_BYTES + more]) for more in range(1 if strict else 4))


def _dealt(paths: DataFrame) -> DataFrame:
    """The files in reading tasks of about equally many bytes."""
    cost = F.coalesce("length", F.lit(0)) + _OPEN_BYTES
    total = paths.agg(F.sum(cost).alias("b")).first().b or 0
    tasks = max(paths.sparkSession.sparkContext.defaultParallelism * _READERS_PER_CORE, -(-total // TASK_BYTES))
    rows = paths.select("path", "location", cost.alias("cost"), F.lit(0).alias("all"))
    placed = carry_forward(rows, ["all"], "location", {}, {"so_far": F.col("cost")})
    share = F.floor((F.col("so_far") - F.col("cost")) * tasks / F.lit(max(total, 1)))
    return placed.select("path", "location", share.alias("share")).repartition(tasks, "share")


def read_contents(paths: DataFrame, root: str, skip_binary: bool = False, strict_sniff: bool = False) -> DataFrame:
    """(path, content, error) for listed files; one that cannot be read has an error and no content.

    With ``skip_binary`` the first KiB of a file is read and judged before the
    rest, and a binary file gives no row.
    """

    def read(batches):
        system, _ = filesystem(root)
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        names, contents, errors, held = [], [], [], 0
        for batch in batches:
            for name, location in zip(batch.column("path").to_pylist(), batch.column("location").to_pylist()):
                data, error = None, None
                try:
                    with system.open_input_stream(location) as stream:
                        data = stream.read(C.SNIFFED_BYTES + 3)
                        if skip_binary and _binary_head(data, strict_sniff):
                            continue
                        data += stream.read()
                except OSError as problem:
                    data, error = None, str(problem) or type(problem).__name__
                names.append(name)
                contents.append(data)
                errors.append(error)
                held += len(data or b"")
                if held >= _BATCH_BYTES:
                    yield pa.record_batch([names, contents, errors], schema=schema)
                    names, contents, errors, held = [], [], [], 0
        yield pa.record_batch([names, contents, errors], schema=schema)

    return _dealt(paths).mapInArrow(read, "path string, content binary, error string")


def accepted_path(
    path: Column,
    options: Options = DEFAULT,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    no_ignore: bool = False,
) -> Column:
    """The rules a directory walk or a history scan applies to a path."""
    keep = P.is_selected(
        path, (*include, *options.include_patterns), (*exclude, *options.ignore_paths)
    )
    if not no_ignore:
        keep = keep & ~P.in_skipped_directory(path) & ~P.is_meta_file(path, options.meta_files)
    return keep


def read_files(
    spark: SparkSession,
    root: str,
    options: Options = DEFAULT,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    no_ignore: bool = False,
    explicit: bool = False,
    strict_sniff: bool = False,
) -> DataFrame:
    """(path, text, error) of the text files under ``root``.

    Path rules run on the listing, so rejected files are never opened, and of a
    binary file only the first KiB is read.  A file that cannot be read is a row with an error and a null text, so an
    incomplete scan can be told from a clean one.
    ``explicit`` marks a root that is a single file, which bypasses every rule.
    """
    if explicit:
        name = root.rstrip("/").rsplit("/", 1)[-1]
        _, location = filesystem(root)
        single = spark.createDataFrame([(name, location, 0)], _LISTED)
        return read_contents(single, root).select("path", C.decode_text(F.col("content")).alias("text"), "error")
    listed = list_files(spark, root)
    chosen = listed.where(accepted_path(F.col("path"), options, include, exclude, no_ignore))
    read = read_contents(chosen, root, skip_binary=True, strict_sniff=strict_sniff)
    return read.select("path", C.decode_text(F.col("content")).alias("text"), "error")


def select_files(
    files: DataFrame,
    options: Options = DEFAULT,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    no_ignore: bool = False,
) -> DataFrame:
    """Path rules over any table with a ``path`` and optionally ``is_explicit``."""
    keep = accepted_path(F.col("path"), options, include, exclude, no_ignore)
    if "is_explicit" in files.columns:
        keep = F.col("is_explicit") | keep
    return files.where(keep)


def staged_texts(
    snapshot: DataFrame,
    options: Options = DEFAULT,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    no_ignore: bool = False,
) -> DataFrame:
    """Candidate snapshot ``(path, content, change_type)`` -> strict texts.

    Added, copied and modified entries only; content with a NUL or invalid
    UTF-8 is left out whole and newlines stay as they are.
    """
    keep = P.is_selected(F.col("path"), include, exclude)
    if not no_ignore:
        keep = keep & ~P.is_meta_file(F.col("path"), options.meta_files)
    return (
        snapshot.where(F.col("change_type").isin("A", "C", "M") & keep)
        .select("path", C.decode_strict(F.col("content")).alias("text"))
        .where(F.col("text").isNotNull())
    )


def changed_files(new: DataFrame, old: DataFrame, path: str = "path", version: str = "version") -> DataFrame:
    """Rows of ``new`` whose path is absent from ``old`` or has another version.

    One equi anti-join on (path, version): the old side ships no content.
    """
    before = old.select(F.col(path).alias("_path"), F.col(version).alias("_version"))
    same = (F.col(path) == F.col("_path")) & (F.col(version) == F.col("_version"))
    return new.join(before, same, "left_anti")


def diff_texts(
    new: DataFrame,
    old: DataFrame,
    options: Options = DEFAULT,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    no_ignore: bool = False,
    strict_sniff: bool = False,
) -> DataFrame:
    """Whole current text of files that changed; both sides ``(path, version[, content])``."""
    keep = P.is_selected(F.col("path"), include, exclude)
    if not no_ignore:
        keep = keep & ~P.is_meta_file(F.col("path"), options.meta_files)
    changed = changed_files(new.where(keep), old)
    return changed.where(~C.looks_binary(F.col("content"), strict_sniff)).select(
        "path", C.decode_text(F.col("content")).alias("text")
    )
