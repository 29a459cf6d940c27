"""Hierarchical Pitman-Yor language model (Teh 2006), its Chinese-restaurant seating sampled by Gibbs.

Every word follows the word before it. That word, hashed whole to one of CONTEXTS classes, names the context restaurant;
all context restaurants share one parent, whose base is uniform over the training vocabulary and one unknown word. A
restaurant's customers of a dish are its counts; each table of a context restaurant sends one customer to the parent.
With more distinct words than CONTEXTS, words that share a class share a restaurant.

Sampling is blocked by dish: all customers of a dish in a restaurant are reseated at once, the number of tables drawn
from its exact conditional (generalised Stirling numbers) up to EXACT customers, and by seating them in turn beyond;
what the dish itself sends to the parent is left out of its base, and held fixed while it is reseated.
Everything a word needs (its counts in all contexts, its tables there and at the parent) is on one row, and words are
dealt by hash, so a sweep needs no shuffle; only the restaurants' totals (CONTEXTS numbers) are summed over tasks between
the two rounds, and follow each task's own changes within a round. The first round burns in; then each level's discount
and strength are drawn from their posterior given the seating, on a grid; the second round burns in further and then
keeps SAMPLES seatings, whose predictive probabilities are averaged.

Counts are of all training texts; a task packs its counts by the part they go to. Scoring looks up the most frequent
words' rows (by their counts over all texts, at most HEAD_ENTRIES, broadcast) where the text is; the other words go,
packed, to the tasks that hold their rows, which send back sums per document. Words are
known by XXH64.

A hot word is counted per task before it is shuffled and has at most CONTEXTS entries. Nulls: a null text has the end
token alone; a null doc_id is not held out. Repeated rows count and are scored each. Without training texts N and V are 0
and every token is unknown with probability 1. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, give_back, settle, ship

CONTEXTS, SAMPLES = 1 << 16, 4
#: Discount and strength of the context restaurants and of the parent in the first round; then they are drawn from GRID.
LEAF, ROOT = (0.8, 5.0), (0.8, 10.0)
GRID = np.arange(1, 20) / 20, np.geomspace(0.1, 1000, 17)
BURN_IN, MORE_BURN_IN, EXACT = 3, 2, 60
HEAD_ENTRIES, HEAD_WORDS = 1_500_000, 250_000
#: Words of a worker's cache, characters of text handled at once, and count rows a task aims at.
CACHE, BLOCK_BYTES, ROWS_A_TASK = 400_000, 2_000_000, 500_000
#: Tokens that a task holds before it counts them, and weights that it draws from at once.
HELD_TOKENS, SEATED = 2_000_000, 400_000
FOLDS, HELD = 7, 2
#: Ends a document; no UTF-8 text holds this byte.
END = b"\xff"


class Lexicon(dict):
    """Words to places in arrays of their hash, their class as a context, and what `describe` adds; bounded by CACHE.

    `flush` is called before places are given anew.
    """

    def __init__(self, flush: Callable[[], None] = lambda: None, describe: Callable[[np.ndarray], np.ndarray] | None = None):
        super().__init__()
        self.flush, self.describe = flush, describe
        self.new: list[bytes] = []
        self.hash, self.context, self.extra = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place; new ones are described."""
        if len(self) > CACHE:
            self.flush()
            self.clear()
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        added, self.new = self.new, []
        if added:
            n = len(self) - len(added)
            while len(self) > len(self.hash):
                self.hash, self.context, self.extra = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.context, self.extra))
            mine = slice(n, len(self))
            self.hash[mine] = np.fromiter(map(xxhash.xxh64_intdigest, added), np.uint64, len(added)).view(np.int64)
            self.context[mine] = np.fromiter(map(context_of, added), np.int64, len(added))
            if self.describe:
                self.extra[mine] = self.describe(self.hash[mine])
        return out


def context_of(word: bytes) -> int:
    """The restaurant that a word's follower enters; 0 after a document's end."""
    return 0 if word == END else 1 + xxhash.xxh32_intdigest(word) % (CONTEXTS - 1)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


#: Bits of a document's number in a block, and places of a lexicon, where packed in one number with others.
DOC_BITS, PLACES = 14, 1 << 28


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and to - at < 1 << DOC_BITS and (to == at or size + len(texts[to]) <= BLOCK_BYTES):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def tokens(texts: list[bytes], lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens, ends included: place in the lexicon, context, and the text's number."""
    words = (b" " + END + b" ").join([*texts, b""]).lower().split()
    place = lexicon.places(words)
    contexts = lexicon.context[place]
    last = place == lexicon.get(END, -1)
    document = np.cumsum(last) - last
    return place, np.concatenate([[0], contexts[:-1]]) if len(contexts) else contexts, document


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and how long they are."""
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(ordered)))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(start) else np.zeros(0, np.int64)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def freeing(run: Batches) -> Batches:
    """run, whose memory the worker gives back when the task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, and where groups start in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


COUNTS = "part int, hash binary, size binary, context binary, n binary"


def counts(docs: DataFrame, parts: int) -> DataFrame:
    """Counts of training tokens, summed within tasks: a row holds some words of a part, how many contexts each has, and
    for all of these in turn the context and the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ready: list[pa.RecordBatch] = []

        def flush() -> None:
            if not held:
                return
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            start, n = runs(keys)
            keys, n = keys[start], n.astype("<i4")
            context = (keys % CONTEXTS).astype("<u2")
            keys //= CONTEXTS
            first, size = runs(keys)
            word, size, entry = keys[first] % PLACES, size.astype("<i4"), np.append(first, len(keys))
            edge, many = runs(keys[first] // PLACES)
            hashes, to = lexicon.hash[word], lexicon.extra[word[edge]]
            made = [(int(p), *_bytes(hashes[x:y], size[x:y], context[entry[x] : entry[y]], n[entry[x] : entry[y]])) for p, x, y in zip(to, edge, edge + many)]
            part, *rest = zip(*made)
            ready.append(pa.record_batch([pa.array(part, pa.int32()), *(pa.array(x, pa.binary()) for x in rest)], names(COUNTS)))

        lexicon = Lexicon(flush, lambda hashes: part_of(hashes, parts))
        for b in batches:
            texts = _texts(b.column(0))
            for a, z in _blocks(texts):
                place, context, _ = tokens(texts[a:z], lexicon)
                held.append((lexicon.extra[place] * PLACES + place) * CONTEXTS + context)
                if sum(map(len, held)) > HELD_TOKENS:
                    flush()
                yield from ready
                ready.clear()
        flush()
        yield from ready

    return docs.select("text").mapInArrow(freeing(run), COUNTS)


# -- seating


def stirling(most: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t), c and t from 0 to most."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, most + 1):
        for t in range(1, c + 1):
            s[c, t] = np.logaddexp(s[c - 1, t - 1], s[c - 1, t] + np.log(c - 1 - t * discount) if c - 1 > t * discount else -np.inf)
    return s


def seat(c: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish: c its customers, others the restaurant's tables of other dishes, base its probability above."""
    out = np.minimum(c, 1)
    sizes = np.bincount(np.minimum(c, EXACT + 1), minlength=EXACT + 2)
    for size in np.flatnonzero(sizes[: EXACT + 1])[0 if not sizes[0] else 1 :]:
        if size < 2:
            continue
        rows = np.flatnonzero(c == size)
        for at in range(0, len(rows), step := SEATED // size):
            r = rows[at : at + step]
            # log weight of t tables: the strength's rising factorial, the base's power, the Stirling number
            steps = np.log((strength + discount * (others[r, None] + np.arange(size))) * base[r, None])
            weight = np.cumsum(steps, 1) + table[size, 1 : size + 1]
            weight += rng.gumbel(size=weight.shape)
            out[r] = 1 + weight.argmax(1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        n, a = c[many].astype(float), (strength + discount * others[many]) * base[many]
        t, at = np.ones(len(many)), np.ones(len(many))
        live = np.arange(len(many))
        while len(live):  # draw how many customers come before the next one who opens a table
            rise = a[live] + discount * t[live] * base[many[live]]
            left = at[live] - discount * t[live]
            grown = np.exp(np.minimum(100.0, rng.exponential(size=len(live)) / np.maximum(rise, 1e-12)))
            nxt = np.floor(left * grown + discount * t[live]) + 1
            at[live] = np.maximum(at[live] + 1, nxt)
            live = live[at[live] <= n[live]]
            t[live] += 1
        out[many] = t.astype(np.int64)
    return out


@dataclass
class Totals:
    """Of all words: customers and tables of each context, customers and tables of the parent, words."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float
    words: int
    leaf: tuple[float, float]
    root: tuple[float, float]


@dataclass
class Shard:
    """Some words' rows: entries (word, context, count) in order of words, and tables."""

    hash: np.ndarray
    word: np.ndarray
    context: np.ndarray
    n: np.ndarray
    tables: np.ndarray
    root: np.ndarray

    def __post_init__(self) -> None:
        # single customers always have one table; only the others are reseated
        self.many = np.flatnonzero(self.n > 1)
        self.customers = np.bincount(self.context, self.n, CONTEXTS)
        self.seated = np.bincount(self.context, self.tables, CONTEXTS)
        self.sent = np.bincount(self.word, self.tables, len(self.hash)).astype(np.int64)

    def sums(self) -> np.ndarray:
        """Customers of each context, tables of each, parent's customers and tables, words."""
        return np.concatenate([self.customers, self.seated, [self.sent.sum(), self.root.sum(), len(self.hash)]])

    def evidence(self) -> np.ndarray:
        """What the seating says of the discounts (see draw), of context restaurants and of the parent."""
        return np.concatenate([_evidence(self.n, self.tables), _evidence(self.sent, self.root)])

    def sweep(self, totals: Totals, rng: np.random.Generator, leaf: np.ndarray, top: np.ndarray) -> None:
        """Reseat every dish once; totals follow."""
        (discount, strength), (root_discount, root_strength) = totals.leaf, totals.root
        base = 1.0 / (totals.words + 1)
        m, context, word = self.many, self.context[self.many], self.word[self.many]
        old = self.tables[m]
        # the parent without the customers that this dish sends, nor the tables that they hold on average
        others = self.sent[word] - old
        root = self.root[word] * (others / self.sent[word])
        above = (others - root_discount * root + (root_strength + root_discount * (totals.root_tables - self.root[word] + root)) * base) / (root_strength + totals.root_customers - old)
        new = seat(self.n[m], np.maximum(0, totals.tables[context] - old), above, discount, strength, leaf, rng)
        self.tables[m] = new
        change = np.bincount(context, new - old, CONTEXTS)
        self.seated = self.seated + change
        totals.tables = totals.tables + change
        self.sent = self.sent + np.bincount(word, new - old, len(self.hash)).astype(np.int64)
        totals.root_customers += float((new - old).sum())
        r = np.flatnonzero(self.sent > 1)
        root = np.minimum(self.sent, 1)
        root[r] = seat(self.sent[r], np.maximum(0, totals.root_tables - self.root[r]), np.full(len(r), base), root_discount, root_strength, top, rng)
        totals.root_tables += float(root.sum() - self.root.sum())
        self.root = root


def _totals(sums: np.ndarray, scale: float = 1.0, leaf: tuple[float, float] = LEAF, root: tuple[float, float] = ROOT) -> Totals:
    sums = sums * scale
    return Totals(sums[:CONTEXTS], sums[CONTEXTS : 2 * CONTEXTS], float(sums[-3]), float(sums[-2]), int(sums[-1]), leaf, root)


#: Numbers of an _evidence vector.
EVIDENCE = (EXACT + 1) ** 2 + 3


def _evidence(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many dishes have c customers at t tables; of those above EXACT customers their number, the tables beyond the
    first, and the logarithms of customers."""
    small = c <= EXACT
    few = np.bincount(c[small] * (EXACT + 1) + t[small], minlength=(EXACT + 1) ** 2)
    return np.concatenate([few, [(~small).sum(), (t[~small] - 1).sum(), np.log(c[~small]).sum()]])


_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def draw(evidence: np.ndarray, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """Discount and strength of a level from their posterior given the seating, on GRID (flat prior).

    Dishes above EXACT customers count by the leading term of their Stirling numbers.
    """
    few, (many, more, logs) = evidence[:-3].reshape(EXACT + 1, EXACT + 1), evidence[-3:]
    c, n_c = np.unique(customers[customers > 0], return_counts=True)
    t, n_t = np.unique(tables[tables > 0], return_counts=True)
    weight = np.empty((len(GRID[0]), len(GRID[1])))
    for i, d in enumerate(GRID[0]):
        dishes = (few * np.where(few > 0, stirling(EXACT, d), 0.0)).sum() - many * math.lgamma(1 - d) - more * math.log(d) - logs * d
        for j, strength in enumerate(GRID[1]):
            opened = (n_t * ((t - 1) * math.log(d) + _log_gamma(strength / d + t) - math.lgamma(strength / d + 1))).sum()
            seated = (n_c * (_log_gamma(strength + c) - math.lgamma(strength + 1))).sum()
            weight[i, j] = dishes + opened - seated
    i, j = np.unravel_index((weight + rng.gumbel(size=weight.shape)).argmax(), weight.shape)
    return float(GRID[0][i]), float(GRID[1][j])


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


SHARD = "part int, hash binary, word binary, context binary, n binary, tables binary, root binary"
KINDS = ("<i8", "<i4", "<u2", "<i8", "<i4", "<i4")


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Shard]]:
    for b in batches:
        for k in range(b.num_rows):
            part, *raw = (b.column(i)[k].as_py() for i in range(7))
            arrays = [np.frombuffer(x, kind).astype(np.int64) for x, kind in zip(raw, KINDS)]  # own, writable arrays
            yield part, Shard(*arrays)


def _shard_row(part: int, s: Shard, kinds: tuple[str, ...] = KINDS) -> list:
    return [part, *_bytes(*(a.astype(k) for a, k in zip((s.hash, s.word, s.context, s.n, s.tables, s.root), kinds)))]


def build(count_rows: DataFrame, parts: int) -> DataFrame:
    """Counts to shards, one a task, after a first seating round that only knows its own share of the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], [], []]
        part = -1
        for b in batches:
            for k in range(b.num_rows):
                part = b.column(0)[k].as_py()
                for i, x in enumerate(held):
                    x.append(b.column(i + 1)[k].as_py())
        if part < 0:
            return
        h, size, c, n = (np.frombuffer(b"".join(x), t) for x, t in zip(held, ("<i8", "<i4", "<u2", "<i4")))
        held.clear()
        h, c, n = np.repeat(h, size), c.astype(np.int64), n.astype(np.int64)
        order, start = grouped(h, c)
        h, c, n = h[order][start], c[order][start], np.add.reduceat(n[order], start)
        words, word = np.unique(h, return_inverse=True)
        shard = Shard(words, word, c, n, np.ones(len(n), np.int64), np.ones(len(words), np.int64))
        leaf, top = stirling(EXACT, LEAF[0]), stirling(EXACT, ROOT[0])
        rng = np.random.default_rng(part)
        for _ in range(BURN_IN):  # words are dealt at random: their totals times the tasks estimate all
            shard.sweep(_totals(shard.sums(), parts), rng, leaf, top)
        row = _shard_row(part, shard)
        yield pa.record_batch([pa.array(row[:1], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], names(SHARD))

    return count_rows.repartitionById(parts, F.col("part")).mapInArrow(freeing(run), SHARD)


#: Tasks that add up the sums of all others; the driver gets one vector of each.
SUM_TASKS = 4


def _vectors(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    for v in b.column(0):
        yield np.frombuffer(v.as_buffer(), "<f8")


def _added(rows: DataFrame, width: int, vectors: Callable[[pa.RecordBatch], Iterator[np.ndarray]] = _vectors) -> np.ndarray:
    """The sum of the rows' vectors, added as they stream by in each task, then in SUM_TASKS tasks.

    One Python worker a task: chained ones would each keep their memory.
    """

    def add(of: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> Batches:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                for v in of(b):
                    total += v
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["v"])

        return freeing(run)

    sums = rows.mapInArrow(add(vectors), "v binary").repartition(SUM_TASKS).mapInArrow(add(_vectors), "v binary").collect()
    return sum((np.frombuffer(bytes(r.v), "<f8") for r in sums), np.zeros(width))


def _sum_rows(shards: DataFrame) -> np.ndarray:
    """The shards' evidence() and sums(), added up."""
    return _added(shards, 2 * EVIDENCE + 2 * CONTEXTS + 3, lambda b: (np.concatenate([s.evidence(), s.sums()]) for _, s in _shards([b])))


MODEL = "part int, hash binary, count binary, above binary, first binary, context binary, bonus binary, sums binary"


Level = tuple[float, float]


def draws(totals: np.ndarray) -> tuple[Level, Level]:
    """Discount and strength of the context restaurants and of the parent after the first round."""
    now, rng = _totals(totals[2 * EVIDENCE :]), np.random.default_rng(11)
    leaf = draw(totals[:EVIDENCE], now.customers, now.tables, rng)
    return leaf, draw(totals[EVIDENCE : 2 * EVIDENCE], np.array([now.root_customers]), np.array([now.root_tables]), rng)


def sample(shards: DataFrame, totals: np.ndarray, hyper: tuple[Level, Level]) -> DataFrame:
    """The second round: rows of words (hash, count, the parent's numerators of each sample), of their entries (context,
    customers less discounted tables, averaged over samples), and the contexts' customers with the other sums of each sample."""
    start, leaf_at, root_at = totals[2 * EVIDENCE :], *hyper

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, top = stirling(EXACT, leaf_at[0]), stirling(EXACT, root_at[0])
        for part, s in _shards(batches):
            rng = np.random.default_rng(1_000_003 + part)
            now = _totals(start, 1.0, leaf_at, root_at)
            for _ in range(MORE_BURN_IN):
                s.sweep(now, rng, leaf, top)
            above, tables, sums = [], np.zeros(len(s.many)), []
            for _ in range(SAMPLES):
                s.sweep(now, rng, leaf, top)
                above.append(s.sent - root_at[0] * s.root)
                tables += s.tables[s.many] / SAMPLES
                sums.append(s.sums()[CONTEXTS:])
            bonus = s.n - leaf_at[0]
            bonus[s.many] = s.n[s.many] - leaf_at[0] * tables
            count = np.bincount(s.word, s.n, len(s.hash))
            first = np.searchsorted(s.word, np.arange(len(s.hash) + 1))
            row = _bytes(s.hash, count.astype("<i8"), np.stack(above, 1).astype("<f4"), first.astype("<i4"), s.context.astype("<u2"), bonus.astype("<f4"), np.concatenate([s.customers, *sums]))
            yield pa.record_batch([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names(MODEL))

    return shards.mapInArrow(freeing(run), MODEL)


REPLY = "block long, doc_ids binary, place binary, tokens binary, known binary, base binary, score binary"


@dataclass
class Predictive:
    """What turns a word's row into probabilities: the totals of each sample."""

    customers: np.ndarray
    tables: np.ndarray
    root_customers: np.ndarray
    root_tables: np.ndarray
    words: int
    tokens: float
    leaf: Level
    root: Level

    @staticmethod
    def of(sums: np.ndarray, hyper: tuple[Level, Level]) -> Predictive:
        customers, each = sums[:CONTEXTS], sums[CONTEXTS:].reshape(SAMPLES, -1)
        return Predictive(customers, each[:, :CONTEXTS], each[:, -3], each[:, -2], int(each[0, -1]), float(customers.sum()), *hyper)

    @cached_property
    def back_off(self) -> np.ndarray:
        """Per sample and context, the weight of the parent."""
        return (self.leaf[1] + self.leaf[0] * self.tables) / (self.leaf[1] + self.customers)

    def log10(self, bonus: np.ndarray, context: np.ndarray, numerator: Callable[[int], np.ndarray | float]) -> np.ndarray:
        """Averages the samples one by one; numerator(k) is the words' numerator in the parent of sample k."""
        above = np.zeros(len(context))
        for k in range(SAMPLES):
            new = (self.root[1] + self.root[0] * self.root_tables[k]) / (self.words + 1)
            above += self.back_off[k][context] * (numerator(k) + new) / ((self.root[1] + self.root_customers[k]) * SAMPLES)
        above += bonus / (self.leaf[1] + self.customers[context])
        return np.log10(above)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.words + 1))


@dataclass
class Rows:
    """Some words' rows, in order of hash."""

    hash: np.ndarray
    count: np.ndarray
    above: np.ndarray
    entry: np.ndarray
    bonus: np.ndarray

    @staticmethod
    def of(hash: np.ndarray, count: np.ndarray, above: np.ndarray, first: np.ndarray, context: np.ndarray, bonus: np.ndarray) -> Rows:
        word = np.repeat(np.arange(len(hash)), np.diff(first))
        return Rows(hash, count, above, word * CONTEXTS + context, bonus)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words, and which are there."""
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return at, self.hash[at] == hashes

    def score(self, at: np.ndarray, there: np.ndarray, context: np.ndarray, p: Predictive) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities by the model and by the base."""
        if not len(self.hash):
            return p.log10(np.zeros(len(at)), context, lambda k: 0.0), p.base(np.zeros(len(at)))
        key = at * CONTEXTS + context
        e = np.minimum(np.searchsorted(self.entry, key), len(self.entry) - 1)
        bonus = np.where(there & (self.entry[e] == key), self.bonus[e], 0.0)
        del key, e
        return p.log10(bonus, context, lambda k: np.where(there, self.above[at, k], 0.0)), p.base(np.where(there, self.count[at], 0))


def _model_rows(raw: list[bytes]) -> Rows:
    h, count, above, first, context, bonus = (np.frombuffer(x, k) for x, k in zip(raw, ("<i8", "<i8", "<f4", "<i4", "<u2", "<f4")))
    return Rows.of(h, count, above.reshape(-1, SAMPLES), first.astype(np.int64), context.astype(np.int64), bonus)


#: Steps of a histogram of words' counts: eight to each doubling.
STEPS = 512


def _step(count: np.ndarray) -> np.ndarray:
    return np.minimum(STEPS - 1, (8 * np.log2(count)).astype(np.int64))


def _head(model: DataFrame) -> Rows:
    """The most frequent words' rows: all whose counts reach the least step at which HEAD_ENTRIES and HEAD_WORDS hold them."""

    def measure(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for k in range(b.num_rows):
            count, first = (np.frombuffer(b.column(i)[k].as_py(), t) for i, t in enumerate(("<i8", "<i4")))
            step = _step(count)
            yield np.concatenate([np.bincount(step, np.diff(first), STEPS), np.bincount(step, minlength=STEPS)])

    entries, words = _added(model.select("count", "first"), 2 * STEPS, measure).reshape(2, STEPS)
    above = (np.cumsum(entries[::-1])[::-1] <= HEAD_ENTRIES) & (np.cumsum(words[::-1])[::-1] <= HEAD_WORDS)
    least = int(above.argmax()) if above.any() else STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw = [b.column(i)[k].as_py() for i in range(1, 7)]
                h, count, above, first, context, bonus = (np.frombuffer(x, t) for x, t in zip(raw, ("<i8", "<i8", "<f4", "<i4", "<u2", "<f4")))
                order = np.flatnonzero(_step(count) >= least)
                size = np.diff(first)[order]
                pick = spread(first[:-1][order], size)
                row = _bytes(h[order], count[order], above.reshape(-1, SAMPLES)[order], np.concatenate([[0], np.cumsum(size)]).astype("<i4"), context[pick], bonus[pick])
                yield pa.record_batch([pa.array([x], pa.binary()) for x in row], ["hash", "count", "above", "first", "context", "bonus"])

    got = model.mapInArrow(freeing(run), "hash binary, count binary, above binary, first binary, context binary, bonus binary").toArrow()
    shards = [_model_rows([got.column(i)[k].as_py() for i in range(6)]) for k in range(got.num_rows)]
    if not shards:
        return _model_rows([b"", b"", b"", np.zeros(1, "<i4").tobytes(), b"", b""])
    h = np.concatenate([s.hash for s in shards])
    order = np.argsort(h)
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    base = np.concatenate([[0], np.cumsum([len(s.hash) for s in shards])])
    entry = np.concatenate([rank[s.entry // CONTEXTS + b] * CONTEXTS + s.entry % CONTEXTS for s, b in zip(shards, base)])
    by = np.argsort(entry)
    return Rows(h[order], np.concatenate([s.count for s in shards])[order], np.concatenate([s.above for s in shards])[order], entry[by], np.concatenate([s.bonus for s in shards])[by])


def _sample_sums(model: DataFrame) -> np.ndarray:
    """The samples' sums over all shards."""
    return _added(model.select("sums"), CONTEXTS + SAMPLES * (CONTEXTS + 3))


FOUND = "block long, part int, doc_ids binary, place binary, hash binary, size binary, context binary, n binary, tokens binary, known binary, base binary, score binary"


def _looked_up(docs: DataFrame, head: Rows, p: Predictive, parts: int) -> DataFrame:
    """Per block of documents: one row of sums over head words (with doc_ids), and a row for each part with other words: the
    words, how many pairs of context and document each has, and these with their counts. The first kind goes to any part."""
    shared = docs.sparkSession.sparkContext.broadcast((head, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, predictive = shared.value

        def describe(hashes: np.ndarray) -> np.ndarray:
            """A word's head row, or the shard that holds it, as -1 - shard."""
            at, there = rows.find(hashes)
            return np.where(there, at, -1 - part_of(hashes, parts))

        lexicon = Lexicon(describe=describe)
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            texts = _texts(b.column(1))
            ids = b.column(0).to_pylist()
            for a, z in _blocks(texts):
                place, context, d = tokens(texts[a:z], lexicon)
                row, n = lexicon.extra[place], z - a
                head = row >= 0
                # head words by (row, context, document), each pair scored once
                # a block of one long text has no document number to pack, but maybe more words
                bits = DOC_BITS if n > 1 else 0
                order = np.sort(((row[head] * CONTEXTS + context[head]) << bits) | d[head])
                own, key = order & ((1 << bits) - 1), order >> bits
                start, length = runs(key)
                key = key[start]
                score, base = rows.score(key // CONTEXTS, np.ones(len(key), bool), key % CONTEXTS, predictive)
                sums = [np.bincount(d, minlength=n), np.bincount(own, minlength=n), np.bincount(own, np.repeat(base, length), n), np.bincount(own, np.repeat(score, length), n)]
                made: list[list] = [[block, block % parts, np.array([0 if i is None else i for i in ids[a:z]], "<i8").tobytes() + bytes(i is not None for i in ids[a:z]), *[b""] * 5, *_bytes(*(s.astype(k) for s, k in zip(sums, ("<i8", "<i8", "<f8", "<f8"))))]]
                rest = ~head
                # other words by part: their ranks in that order, then context and document
                there = np.zeros(len(lexicon), bool)
                there[place[rest]] = True
                word = np.flatnonzero(there)
                word = word[np.argsort(-1 - lexicon.extra[word], kind="stable")]
                rank = np.zeros(len(lexicon), np.int64)
                rank[word] = np.arange(len(word))
                order = np.sort((rank[place[rest]] * CONTEXTS + context[rest] << bits) | d[rest])
                start, many = runs(order)
                order = order[start]
                own, key = order & ((1 << bits) - 1), order >> bits
                own, context, many = own.astype("<u2"), (key % CONTEXTS).astype("<u2"), many.astype("<u4")
                first, size = runs(key // CONTEXTS)
                word, entry, size = word[key[first] // CONTEXTS], np.append(first, len(key)), size.astype("<u4")
                hashes, to = lexicon.hash[word], -1 - lexicon.extra[word]
                edge, width = runs(to)
                for x, y in zip(edge, edge + width):
                    pairs = slice(entry[x], entry[y])
                    made.append([block, int(to[x]), b"", *_bytes(own[pairs], hashes[x:y], size[x:y], context[pairs], many[pairs]), *[b""] * 4])
                columns = list(zip(*made))
                yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[2:])], names(FOUND))
                block += 1

    return docs.select("doc_id", "text").mapInArrow(freeing(run), FOUND)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The shard of a word."""
    return ((hashes.view(np.uint64) >> np.uint64(17)) % np.uint64(parts)).astype(np.int64)


def scored(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD, F.lit(False))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(1 << 17, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (20 * ROWS_A_TASK) + 1))
    settle(spark)
    shards = durable(build(counts(texts.where(~held), parts), parts))
    settle(spark)
    totals = _sum_rows(shards)
    hyper = draws(totals)
    model = durable(sample(shards, totals, hyper))
    p = Predictive.of(_sample_sums(model), hyper)
    found = _looked_up(texts, _head(model), p, parts)
    settle(spark)
    shared = spark.sparkContext.broadcast(p)

    def tail(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        """Sums over the words that a shard holds, per block that asked."""
        mine = [_model_rows([b.column(i)[k].as_py() for i in range(1, 7)]) for b in rows.to_batches() for k in range(b.num_rows)]
        own = mine[0] if mine else _model_rows([b"", b"", b"", np.zeros(1, "<i4").tobytes(), b"", b""])
        out: list[list] = []
        for b in asked.to_batches():
            for k in range(b.num_rows):
                block, doc_ids, place, h, size, c, n, *sums = (b.column(i)[k].as_py() for i in range(11))
                if doc_ids:
                    out.append([block, doc_ids, b"", *sums])
                    continue
                d, h, size, c, n = (np.frombuffer(x, t).astype(np.int64) for x, t in zip((place, h, size, c, n), ("<u2", "<i8", "<u4", "<u2", "<u4")))
                at, there = (np.repeat(x, size) for x in own.find(h))
                score, base = own.score(at, there, c, shared.value)
                docs_here, inverse = np.unique(d, return_inverse=True)
                sums = (np.bincount(inverse, n * there), np.bincount(inverse, n * base), np.bincount(inverse, n * score))
                out.append([block, b"", *_bytes(docs_here.astype("<u4")), b"", *_bytes(sums[0].astype("<i8"), sums[1], sums[2])])
        columns = list(zip(*out)) or [()] * 7
        return pa.table([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[1:])], names(REPLY))

    asked = found.select("block", "doc_ids", "place", "hash", "size", "context", "n", "tokens", "known", "base", "score", "part")
    everything = asked.groupBy("part").cogroup(model.drop("sums").groupBy("part")).applyInArrow(tail, REPLY)

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        parts_of = {}
        later: list[tuple[bytes, ...]] = []
        for r in rows.to_pylist():
            if r["doc_ids"]:
                parts_of = r
            else:
                later.append((r["place"], r["known"], r["base"], r["score"]))
        n = len(parts_of["tokens"]) // 8
        ids, there = np.frombuffer(parts_of["doc_ids"][: 8 * n], "<i8"), np.frombuffer(parts_of["doc_ids"][8 * n :], "u1") > 0
        known, base, score = (np.frombuffer(parts_of[k], t).copy() for k, t in (("known", "<i8"), ("base", "<f8"), ("score", "<f8")))
        for place, k, bs, sc in sorted(later):
            at = np.frombuffer(place, "<u4")
            known[at] += np.frombuffer(k, "<i8")
            base[at] += np.frombuffer(bs, "<f8")
            score[at] += np.frombuffer(sc, "<f8")
        return pa.table([pa.array(ids, mask=~there), pa.array(np.frombuffer(parts_of["tokens"], "<i8")), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = everything.groupBy("block").applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(int(p.tokens)).cast("long").alias("train_tokens"), "base_score", "score")
