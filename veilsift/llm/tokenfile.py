"""Token ids as flat unsigned integer files with 64-bit document offsets, written by Spark tasks and memory-mapped.

Documents are range-partitioned by doc_id and sorted, so files in partition order hold ascending ids. A partition gives
three files: `.bin` (ids, unsigned 16-bit where the vocabulary has at most 65,536 ids, else 32-bit), `.idx` (documents +
1 unsigned 64-bit offsets in ids, from 0) and `.ids` (signed 64-bit doc_ids, and a byte each: 1 if it is not null). The
partition's base, the number of ids before it, is a prefix sum over the partitions' totals.

File names hold the task attempt, and only files that a successful task reported are read, so a retried task leaves at
most an orphan. Nulls: a null text is empty (the end id alone); null doc_ids come first. Documents with equal ids are
ordered by text. Repeated rows stay. An empty table gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir, ship
from .tokens import encoder

#: Documents a file on average, and the most files.
FILE_DOCS, FILES = 4096, 20_000


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> list[tuple[str, int, int]]:
    """Write docs (doc_id, text) to folder; per file in order: name, documents, ids."""
    spark = docs.sparkSession
    ship(spark)
    files = min(FILES, max(1, -(-docs.count() // FILE_DOCS)))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encode = encoder(tokenizer)
        kind = "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        fs, path = _store(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.{kind[1:]}"
        ids: list[int | None] = []
        offsets, out = [0], None
        for b in batches:
            for doc_id, found in zip(b.column(0).to_pylist(), encode.encode(t or "" for t in b.column(1).to_pylist())):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}.bin")
                data = np.frombuffer(found + end, "<u4")
                out.write(data.astype(kind).tobytes())
                ids.append(doc_id)
                offsets.append(offsets[-1] + len(data))
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{path}/{name}.idx") as f:
            f.write(np.array(offsets, "<u8").tobytes())
        with fs.open_output_stream(f"{path}/{name}.ids") as f:
            f.write(np.array([d or 0 for d in ids], "<i8").tobytes() + np.array([d is not None for d in ids], "u1").tobytes())
        yield pa.record_batch([pa.array([task.partitionId()], pa.int32()), [name], [len(ids)], [offsets[-1]]], ["part", "name", "docs", "ids"])

    sorted_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sorted_docs = sorted_docs.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = sorted_docs.mapInArrow(run, "part int, name string, docs long, ids long").collect()  # a row a file
    return [(r.name, r.docs, r.ids) for r in sorted(rows)]


def _mapped(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file's numbers: memory-mapped where the store is a file system, else read whole."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """A row a document of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    ship(spark)
    base, rows = 0, []
    for name, _, ids in files:
        rows.append((name, base))
        base += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = _mapped(fs, f"{path}/{name}.bin", f"<{name.rpartition('.')[2]}")
                offsets = _mapped(fs, f"{path}/{name}.idx", "<u8").astype(np.int64)
                n = len(offsets) - 1
                raw = _mapped(fs, f"{path}/{name}.ids", "u1")
                ids, there = raw[: 8 * n].view("<i8"), raw[8 * n :].astype(bool)
                crc = [zlib.crc32(tokens[a:z].astype("<u4").tobytes()) for a, z in zip(offsets[:-1], offsets[1:])]
                yield pa.record_batch([pa.array(ids, mask=~there), pa.array(offsets[:-1] + start), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    manifest = spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)))
    return manifest.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the files, by default to the cluster's shared folder, and read them back."""
    folder = folder or scratch_dir(docs.sparkSession)
    return read(docs.sparkSession, folder, write(docs, tokenizer, end_id, folder))
