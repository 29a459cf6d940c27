"""Files as content units: listed on the driver, read and judged by Spark."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as X
from ..operators import paths


@dataclass(frozen=True)
class WalkOptions:
    """What a walk skips."""

    ignored_paths: tuple[str, ...] = ()
    ignored_directories: tuple[str, ...] = X.IGNORED_DIRECTORIES
    ignored_filenames: tuple[str, ...] = X.IGNORED_FILENAMES
    ignored_extensions: tuple[str, ...] = X.IGNORED_EXTENSIONS
    follow_symlinks: bool = False
    max_depth: int | None = None
    max_bytes: int = X.MAX_FILE_BYTES
    max_files: int = X.MAX_FILES


@dataclass
class Walk:
    """Files found, entries skipped with their reason, errors (path, code, reason), and whether the limit cut it."""

    root: str
    files: list[tuple[str, str, int]] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    errors: list[tuple[str, str, str]] = field(default_factory=list)
    truncated: bool = False


def _clean(path: str) -> str:
    return "/".join(s for s in path.replace("\\", "/").split("/") if s not in ("", ".", ".."))


def _suffix(name: str) -> str:
    at = name.rfind(".")
    return name[at:].lower() if 0 < at < len(name) - 1 else ""


def _covered(path: str, entries: Sequence[str]) -> bool:
    return any(path == e or path.startswith(e + "/") for e in entries)


def walk(root: str, options: WalkOptions = WalkOptions()) -> Walk:
    """List a folder in sorted order. Symbolic links are skipped, or followed within the root; a folder is seen once."""
    real_root = os.path.realpath(root)
    out = Walk(real_root)
    if not os.path.isdir(real_root):
        out.errors.append((root, "root-not-a-directory", "not a folder"))
        return out
    seen = {(os.stat(real_root).st_dev, os.stat(real_root).st_ino)}
    todo = [("", real_root)]
    while todo:
        relative, folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            out.errors.append((relative, "vanished" if isinstance(e, FileNotFoundError) else "unreadable", type(e).__name__))
            continue
        below = []
        for e in entries:
            path = _clean(f"{relative}/{e.name}") or e.name
            skip = lambda reason, path=path: out.skipped.append((path, reason))
            try:
                is_link = e.is_symlink()
                if is_link and not options.follow_symlinks:
                    skip("symlink")
                    continue
                target = os.path.realpath(e.path) if is_link else e.path
                if is_link and os.path.commonpath([target, real_root]) != real_root:
                    skip("symlink-outside-root")
                    continue
                info = os.stat(target)
            except OSError:
                skip("vanished")
                continue
            folder_here = stat.S_ISDIR(info.st_mode)
            if _covered(path, options.ignored_paths):
                skip("ignored-path")
            elif folder_here and (e.name in options.ignored_directories or e.name.endswith(X.IGNORED_DIRECTORY_SUFFIXES)):
                skip("ignored-directory")
            elif not folder_here and e.name in options.ignored_filenames:
                skip("ignored-filename")
            elif not folder_here and _suffix(e.name) in options.ignored_extensions:
                skip("ignored-extension")
            elif options.max_depth is not None and path.count("/") + folder_here > options.max_depth:
                skip("ignored-depth")
            elif folder_here:
                if (info.st_dev, info.st_ino) in seen:
                    skip("circular-symlink")
                else:
                    seen.add((info.st_dev, info.st_ino))
                    below.append((path, target))
            elif not stat.S_ISREG(info.st_mode):
                skip("not-a-regular-file")
            elif info.st_size > options.max_bytes:
                skip("too-large")
            elif len(out.files) >= options.max_files:
                out.truncated = True
            else:
                out.files.append((path, target, info.st_size))
        todo += reversed(below)
    if out.truncated:
        out.errors.append(("", "too-many-files", f"only the first {options.max_files} files are read"))
    out.files.sort()
    out.skipped.sort()
    return out


def judged(contents: DataFrame, max_bytes: int = X.MAX_FILE_BYTES, keep: Sequence[str] = ()) -> DataFrame:
    """contents (path, content, length, and columns to keep) to path, text, size, code: the text, or why there is none.

    Without content there is neither. A column read_code tells why a file could not be read.
    """
    verdict = paths.verdict(F.col("content"))
    code = F.when(F.col("length") > max_bytes, "too-large").otherwise(paths.error_code(verdict))
    code = F.coalesce(code, F.when(~F.is_valid_utf8(F.col("content").cast("string")), "invalid-encoding"))
    if "read_code" in contents.columns:
        code = F.coalesce(F.col("read_code"), code)
    text = F.when(code.isNull(), F.regexp_replace(F.col("content").cast("string"), "^\ufeff", ""))
    return contents.select("path", text.alias("text"), F.col("length").alias("size"), code.alias("code"), *keep)


#: Bytes of files that a task aims at, and that one batch of contents aims at.
TASK_BYTES, BATCH_BYTES = 64_000_000, 8_000_000
CONTENTS = "path string, content binary, length long, read_code string"


def _content(file: str, most: int) -> tuple[bytes | None, int | None, str | None]:
    """Up to most + 1 bytes of a file, its length, and why it can't be read."""
    try:
        with open(file, "rb") as f:
            content = f.read(most + 1)
            return content, max(len(content), os.fstat(f.fileno()).st_size) if len(content) > most else len(content), None
    except FileNotFoundError:
        return None, None, "vanished"
    except IsADirectoryError:
        return None, None, "is-directory"
    except OSError:
        return None, None, "read-failed"


def read_files(spark: SparkSession, files: Sequence[tuple[str, str, int]], max_bytes: int = X.MAX_FILE_BYTES) -> DataFrame:
    """A walk's files (path, file, size) as path, text, size, code. Names are taken literally; a file that can't be read is a row
    with its code. Workers open the files, so on a cluster they lie on a mount that all share."""
    if not files:
        return spark.createDataFrame([], "path string, text string, size long, code string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for path, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append((path, *_content(file, max_bytes)))
                held += len(rows[-1][1] or b"")
                if held >= BATCH_BYTES:
                    yield _contents(rows)
                    rows, held = [], 0
        if rows:
            yield _contents(rows)

    slices = max(spark.sparkContext.defaultParallelism, sum(size for _, _, size in files) // TASK_BYTES + 1)
    listed = spark.createDataFrame([(path, file) for path, file, _ in files], "path string, file string").repartition(min(slices, len(files)))
    return judged(listed.mapInArrow(run, CONTENTS), max_bytes)


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int64(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in CONTENTS.split(", ")])


def as_units(read: DataFrame) -> DataFrame:
    """Readable files as units; a unit's id is its path."""
    return read.where("code is null").select(F.col("path").alias("unit_id"), "path", "text", F.lit("file").alias("source_kind"), F.lit(None).cast("string").alias("commit"), F.lit(None).cast("long").alias("commit_time"))


def text_table(df: DataFrame, id_column: str, text_column: str, name: str) -> DataFrame:
    """Any table with a text column as units; the path is name/id."""
    return df.select(F.col(id_column).alias("unit_id"), F.concat(F.lit(name + "/"), F.col(id_column).cast("string")).alias("path"), F.col(text_column).cast("string").alias("text"))
