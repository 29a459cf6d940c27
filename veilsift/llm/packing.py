"""Vector bin packing of documents into training sequences by the dot-product heuristic (Panigrahy et al. 2011).

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens. The open sequence takes, among the
pieces that fit all three, the one whose demand vector has the greatest weighted dot product with what is left; weights
are the average demands. Documents longer than a sequence give full sequences first. When nothing fits and more than
SLACK tokens are left, the best piece is cut to fill the gap; a sequence that still stays open (the last of a shard, or
one at its segment limit) is split at powers of two, where no padding is due.

Packing runs where the text is tokenized: a task packs shards of SHARD_DOCS documents or SHARD_TOKENS tokens, so
memory is bounded, nothing is shuffled, and a lost executor's tasks give the same rows again. sequence_id is the task's
partition number times 2^33 plus a counter.

A document's first token bears no loss (nothing predicts it); all others do. Null texts are empty (the end id alone),
null ids stay null, repeated rows are packed each, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship
from .tokens import CACHE_WORDS, encoder

SHARD_DOCS, SHARD_TOKENS = 4096, 4_000_000
#: Tokens of padding that are not worth a cut.
SLACK = 16


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 512
    loss: int = 4096


#: doc, start, length
Piece = tuple[int, int, int]


def _loss(start: np.ndarray | int, length: np.ndarray | int) -> np.ndarray | int:
    return length - (start == 0)


class _Pool:
    """Pieces still to be placed, as growing arrays."""

    def __init__(self, doc: np.ndarray, start: np.ndarray, length: np.ndarray):
        room = 2 * len(doc) + 16
        self.doc, self.start, self.length = (np.zeros(room, np.int64) for _ in range(3))
        self.n = self.left = len(doc)
        self.doc[: self.n], self.start[: self.n], self.length[: self.n] = doc, start, length
        self.alive = np.zeros(room, bool)
        self.alive[: self.n] = True
        self.vector = np.zeros((room, 3))
        self.vector[: self.n] = np.stack([length, np.ones(self.n), _loss(start, length)], 1)

    def take(self, i: int) -> Piece:
        self.alive[i] = False
        self.left -= 1
        return int(self.doc[i]), int(self.start[i]), int(self.length[i])

    def compact(self) -> None:
        """Drop what is placed."""
        keep = np.flatnonzero(self.alive)
        for name in ("doc", "start", "length", "vector"):
            old = getattr(self, name)
            old[: len(keep)] = old[keep]
        self.alive[:] = False
        self.alive[: len(keep)] = True
        self.n = len(keep)

    def put(self, doc: int, start: int, length: int) -> None:
        if self.n == len(self.doc):
            self.compact()
        i, self.n = self.n, self.n + 1
        self.doc[i], self.start[i], self.length[i], self.alive[i] = doc, start, length, True
        self.vector[i] = length, 1, _loss(start, length)
        self.left += 1


def pack(lengths: list[int], limits: Limits = Limits(), cut: bool = True) -> list[list[Piece]]:
    """Sequences of pieces that cover each document's tokens once. Without cut, documents over a limit alone are cut."""
    most = min(limits.tokens, limits.loss)
    size = np.array(lengths, np.int64)
    full = size // most
    out = [[(d, k * most, most)] for d in np.flatnonzero(full) for k in range(full[d])]
    rest = np.flatnonzero(size % most)
    pool = _Pool(rest, full[rest] * most, size[rest] % most)
    limit = np.array([limits.tokens, limits.segments, limits.loss], float)
    weight = pool.vector[: pool.n].mean(0) / limit / limit if pool.n else np.zeros(3)
    while pool.left:
        free, sequence = limit.copy(), []
        if pool.left < pool.n * 0.7:
            pool.compact()
        while pool.left:
            v = pool.vector[: pool.n]
            fits = pool.alive[: pool.n] & (v <= free).all(1)
            score = np.where(fits, v @ (weight * free), -1.0)
            i = int(score.argmax())
            if fits[i]:
                free -= v[i]
                sequence.append(pool.take(i))
                continue
            room = int(min(free[0], free[2]))
            if not cut or free[0] <= SLACK or free[1] < 1 or room <= 0:
                break
            i = int(np.where(pool.alive[: pool.n], v @ (weight * free), -1.0).argmax())
            if pool.length[i] <= room:  # fits but for its loss; a shorter room can't help
                break
            doc, start, length = pool.take(i)
            free -= np.array([room, 1, _loss(start, room)])
            sequence.append((doc, start, room))
            pool.put(doc, start + room, length - room)
        out.extend(_at_powers(sequence, limits.tokens) if cut and free[0] > SLACK else [sequence])
    return out


def _at_powers(sequence: list[Piece], full: int) -> list[list[Piece]]:
    """The sequence split into ones whose lengths are powers of two."""
    out: list[list[Piece]] = []
    total = sum(p[2] for p in sequence)
    queue = list(reversed(sequence))
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        part: list[Piece] = []
        while want:
            doc, start, length = queue.pop()
            if length > want:
                queue.append((doc, start + want, length - want))
                length = want
            part.append((doc, start, length))
            want -= length
        out.append(part)
    return out


FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), cache_words: int = CACHE_WORDS, keep_cache: bool = True) -> DataFrame:
    """docs (doc_id, text) to one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    cache_words: words whose ids a worker keeps, which sets its memory; keep_cache: whether it keeps them, and the tokenizer,
    for its next task.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cache_words).encode
        sequence = TaskContext.get().partitionId() << 33
        ids: list[object] = []
        data: list[bytes] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, ids, data, tokens
            rows: list[list] = [[] for _ in FIELDS]
            for pieces in pack([len(x) // 4 for x in data], limits):
                at = 0
                for doc, start, length in pieces:
                    values = (ids[doc], start, length, zlib.crc32(memoryview(data[doc])[4 * start : 4 * (start + length)]), len(data[doc]) // 4, sequence, at)
                    for column, value in zip(rows, values):
                        column.append(value)
                    at += length
                sequence += 1
            ids, data, tokens = [], [], 0
            yield pa.record_batch([pa.array(rows[0], id_type), *(pa.array(r, pa.int64()) for r in rows[1:])], FIELDS)

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for doc_id, found in zip(b.column(0).to_pylist(), encode(t or "" for t in b.column(1).to_pylist())):
                ids.append(doc_id)
                data.append(found + end)
                tokens += len(data[-1]) // 4
                if len(ids) >= SHARD_DOCS or tokens >= SHARD_TOKENS:
                    yield from flush()
        if ids:
            yield from flush()
        if not keep_cache:
            del encode
            encoder.cache_clear()
            give_back()

    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{f} long" for f in FIELDS[1:])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
