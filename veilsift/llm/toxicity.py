"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

Strings are a text's words (lower-cased, ASCII punctuation dropped, a mark for the beginning), and runs of single
characters joined ("i d i o t"). Two strings' kernel is the number of common subsequences of three symbols, each
weighted by DECAY to the power of the symbols it spans in both (Lodhi et al. 2002), spans up to SPAN, normalised to 1
for equal strings. So inserted characters and gaps lower a likeness but don't end it. A string's features are its
kernel values with the landmarks times K^(-1/2) of the landmarks (Nyström).

Labels are of documents, read as bags of sentences: a sentence's margin is that of its most toxic string, and a
document's score weighs its TOP greatest margins (a chance likeness seldom comes twice), so learning alternates between choosing each toxic document's witness string and
fitting a linear machine on witnesses against all strings of clean documents (MI-SVM; Andrews et al. 2002). Landmarks
are strings that cover the toxic documents (greedily, by how much more often toxic documents hold them) and the most
frequent clean strings. A quarter of the sample only fits the logistic curve from margins to score.

The model is fitted in one task from a bounded sample, TRAIN_TOXIC and TRAIN_CLEAN labelled documents in hash order of
their ids; it is a few MB and comes back to the driver. Every text is scored whole, in one pass without a shuffle.

Nulls: a null text is empty; a text without strings scores as its intercept (near 0). Labels that are null, or whose
documents are missing, are not used; a document with several labels is toxic if one says so. Without documents of both
labels to learn from, every score is 0. Of repeated ids the least text is learned from; repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship

TRAIN_TOXIC, TRAIN_CLEAN = 1200, 1500
LANDMARKS, NEUTRAL = 96, 32
DECAY, SPAN = 0.75, 8
#: Symbols of a string compared at once; longer ones are cut into overlapping pieces.
PIECE = 32
ROUNDS, COST = 4, 10.0
#: Strings of less kernel value, or margin, by a bound of their norm (no two equal subsequences) keep that bound as norm.
NEAR, NEAR_MARGIN = 0.2, -0.6
#: Clean strings with less likeness to every landmark are learned from as one string without any.
FAR = 0.15
CLEAN, STRICT = 20.0, 5.0
#: Margins of a text that its score weighs, and the largest that counts.
TOP, CUT = 3, 3.0
THRESHOLD = 0.7
CACHE = 250_000
#: Strings that learning handles at once, and strings whose subsequences are listed at once.
SLICE, LISTED = 20_000, 1024

SPACED = re.compile(rb"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D\x80-\xff][\x20\x09-\x0D]+){2,}[^\x20\x09-\x0D\x80-\xff](?![^\x20\x09-\x0D])")
EDGE = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())

#: Symbols: 0 none, 1 the beginning, letters, digits, other ASCII, then classes of code points beyond.
_ASCII = np.zeros(128, np.int64)
for _c in range(128):
    _ch = chr(_c)
    _ASCII[_c] = 2 + _c - 97 if "a" <= _ch <= "z" else 28 + _c - 48 if "0" <= _ch <= "9" else 38
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def strings(text: bytes) -> list[bytes]:
    """The strings of a text."""
    lower = text.lower() if text.isascii() else text.decode().lower().encode()
    return lower.split() + [b"".join(run.split()) for run in SPACED.findall(lower)]


def core(word: bytes) -> bytes:
    """A string without its ASCII punctuation: outer marks, and separators put between characters."""
    return word.translate(None, EDGE)


def _symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the words as rows of symbols, and the word each belongs to."""
    pieces: list[str] = []
    owner: list[int] = []
    for i, w in enumerate(words):
        s = "\x00" + w.decode()
        for at in range(0, max(1, len(s) - PIECE // 2), PIECE // 2):
            pieces.append(s[at : at + PIECE])
            owner.append(i)
    flat = "".join(p.ljust(PIECE, "\U0010ffff") for p in pieces)
    points = np.frombuffer(flat.encode("utf-32-le"), "<u4").reshape(-1, PIECE).astype(np.int64)
    out = np.where(points < 128, _ASCII[np.minimum(points, 127)], 39 + points % 24)
    out[points == 0] = 1
    out[points == 0x10FFFF] = 0
    return out, np.array(owner, np.int64)


def _whole(word: bytes) -> np.ndarray:
    """A word as one row of symbols, whatever its length."""
    points = np.frombuffer(("\x00" + word.decode()).encode("utf-32-le"), "<u4").astype(np.int64)
    out = np.where(points < 128, _ASCII[np.minimum(points, 127)], 39 + points % 24)
    out[0] = 1
    return out[None, :]


def _grams(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Codes of the three-symbol subsequences of each span, where they are, and their weight."""
    for a, b in OFFSETS:
        n = max(0, symbols.shape[1] - b)
        x, y, z = symbols[:, :n], symbols[:, a : a + n], symbols[:, b : b + n]
        yield (x << 12) | (y << 6) | z, z > 0, DECAY ** (b + 1)


@dataclass
class Kernel:
    """Kernel values of strings with landmarks."""

    landmarks: list[bytes]
    place: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        place = np.zeros(1 << 18, np.int32)
        rows: list[dict[int, float]] = []
        for w in self.landmarks:
            found: Counter[int] = Counter()
            for code, there, weight in _grams(_whole(w)):
                for c in code[there].tolist():
                    found[c] += weight
            rows.append(found)
        codes = sorted(set().union(*rows)) if rows else []
        place[codes] = np.arange(1, len(codes) + 1)
        self.place = place
        self.weight = np.zeros((len(codes) + 1, max(1, len(rows))), np.float32)
        for j, found in enumerate(rows):
            norm = max(1e-12, sum(v * v for v in found.values())) ** 0.5
            for c, v in found.items():
                self.weight[place[c], j] = v / norm

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """A row a word: its greatest kernel value with each landmark, over its pieces."""
        out = np.zeros((len(words), self.weight.shape[1]), np.float32)
        for at in range(0, len(words), LISTED):
            symbols, owner = _symbols(words[at : at + LISTED])
            raw = np.zeros((len(symbols), out.shape[1]), np.float32)
            norm = np.zeros(len(symbols))
            for code, there, weight in _grams(symbols):
                norm += there.sum(1) * weight**2
                row, col = np.nonzero(self.place[code] * there)
                if len(row):
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    raw[row[first]] += weight * np.add.reduceat(self.weight[self.place[code[row, col]]], first)
            near = np.flatnonzero(raw.max(1) >= NEAR * np.sqrt(norm))
            norm[near] = _norms(symbols[near])
            raw /= np.sqrt(np.maximum(norm, 1e-12)).astype(np.float32)[:, None]
            np.maximum.at(out, owner + at, raw)
        return out


def _norms(symbols: np.ndarray) -> np.ndarray:
    """Each row's squared norm, equal subsequences added up."""
    codes, weights = [], []
    for code, there, weight in _grams(symbols):
        r, c = np.nonzero(there)
        codes.append((r << 18) | code[r, c])
        weights.append(np.full(len(r), weight))
    code, weight = np.concatenate(codes), np.concatenate(weights)
    order = np.argsort(code)
    code, weight = code[order], weight[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    sums = np.add.reduceat(weight, first) if len(first) else weight
    return np.bincount(code[first] >> 18, sums * sums, len(symbols))


def variants(word: bytes, rng: np.random.Generator) -> list[bytes]:
    """The word with an inserted and a doubled character, for learning."""
    s = word.decode()
    if len(s) < 5:
        return []
    at = int(rng.integers(1, len(s)))
    fill = "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]
    return [f"{s[:at]}{fill}{s[at:]}".encode(), f"{s[:at]}{s[at - 1] * 2}{s[at:]}".encode()]


def svm(sides: list[tuple[np.ndarray, float, np.ndarray]]) -> np.ndarray:
    """Linear machine of squared hinge loss by Newton steps over (rows with a column of ones, label, weights of rows)."""
    width = sides[0][0].shape[1]
    w = np.zeros(width)
    ridge = np.eye(width)
    ridge[-1, -1] = 1e-3

    def loss(v: np.ndarray) -> float:
        return float(v @ ridge @ v / 2 + COST * sum((weight * np.maximum(0, 1 - y * _margins(z, v)) ** 2).sum() for z, y, weight in sides))

    now = loss(w)
    for _ in range(50):
        left, right = ridge.copy(), np.zeros(width)
        for z, y, weight in sides:
            active = np.flatnonzero(y * _margins(z, w) < 1)
            for at in range(0, len(active), SLICE):
                some = active[at : at + SLICE]
                za = z[some].astype(float)
                left += 2 * COST * (za * weight[some, None]).T @ za
                right += 2 * COST * y * (za.T @ weight[some])
        target = np.linalg.solve(left, right)
        step = 1.0
        while step > 1e-4 and loss(w + step * (target - w)) > now:
            step /= 2
        w = w + step * (target - w)
        before, now = now, loss(w)
        if before - now < 1e-6 * max(1.0, before):
            break
    return w


def _margins(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.empty(len(z))
    for at in range(0, len(z), SLICE):
        out[at : at + SLICE] = z[at : at + SLICE].astype(float) @ w
    return out


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray
    intercept: float
    #: Of a text's greatest margins and of 1.
    curve: np.ndarray = field(default_factory=lambda: np.array([1.0] + [0.0] * TOP))

    def __post_init__(self) -> None:
        # the machine is linear in the kernel values, so each subsequence has one weight
        self.table = (self.kernel.weight @ self.weights).astype(np.float32)[self.kernel.place]

    def margins(self, words: list[bytes]) -> np.ndarray:
        """The greatest margin of each word's pieces."""
        out = np.full(len(words), -np.inf)
        for at in range(0, len(words), LISTED):
            symbols, owner = _symbols(words[at : at + LISTED])
            raw, norm = np.zeros(len(symbols)), np.zeros(len(symbols))
            for code, there, weight in _grams(symbols):
                raw += weight * (self.table[code] * there).sum(1)
                norm += there.sum(1) * weight**2
            near = np.flatnonzero(raw >= (NEAR_MARGIN - self.intercept) * np.sqrt(norm))
            norm[near] = _norms(symbols[near])
            np.maximum.at(out, owner + at, raw / np.sqrt(np.maximum(norm, 1e-12)) + self.intercept)
        return out

    def scores(self, tops: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(tops @ self.curve[:-1] + self.curve[-1], -500, 500)))


def _curve(tops: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights of the greatest margins, none negative (targets smoothed as by Platt 1999, Newton steps)."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    balance = np.where(toxic, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * len(toxic)
    x = np.concatenate([tops, np.ones((len(tops), 1))], 1)
    prior = np.array([1.0] * TOP + [0.0])
    v = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -500, 500)))
        g = x.T @ (balance * (p - target)) + 1e-2 * (v - prior)
        h = (x * (balance * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(TOP + 1)
        step = np.linalg.solve(h, g)
        v = v - step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        v[:TOP] = np.maximum(v[:TOP], 0.05)
    margins = tops @ v[:TOP]
    # THRESHOLD falls in the middle of the margins that part the labels best, clean documents counting STRICT times
    cuts = np.unique(margins)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    caught = 1 - np.searchsorted(np.sort(margins[toxic]), cuts) / max(n1, 1)
    wrong = 1 - np.searchsorted(np.sort(margins[~toxic]), cuts) / max(n0, 1)
    good = caught - STRICT * wrong
    best = cuts[good >= good.max() - 1e-12]
    return np.append(v[:TOP], np.log(THRESHOLD / (1 - THRESHOLD)) - (best[0] + best[-1]) / 2)


def _choose(toxic: list[tuple[bytes, ...]], clean: Counter[bytes], n_clean: int) -> tuple[list[bytes], dict[bytes, float]]:
    """Strings that cover the toxic documents, and how much likelier toxic documents hold each."""
    count: Counter[bytes] = Counter()
    for s in toxic:
        count.update(s)
    odds = {w: np.log((c + 0.5) / (len(toxic) + 1)) - np.log((clean[w] + 0.5) / (n_clean + 1)) for w, c in count.items() if len(w) > 2}
    odds = {w: o for w, o in odds.items() if o > 1}
    holders: dict[bytes, list[int]] = {}
    for i, s in enumerate(toxic):
        for w in s:
            if w in odds:
                holders.setdefault(w, []).append(i)
    # each document's share goes down as chosen strings cover it, so that all kinds of toxic words are seen
    share = np.ones(len(toxic))
    chosen: list[bytes] = []
    heap = [(-odds[w] * len(h), w) for w, h in holders.items()]
    heapify(heap)
    while heap and len(chosen) < LANDMARKS - NEUTRAL:
        _, best = heappop(heap)
        fresh = odds[best] * float(share[holders[best]].sum())
        if heap and fresh < -heap[0][0]:  # gains only fall: look again when its turn comes
            heappush(heap, (-fresh, best))
            continue
        if fresh < 0.05:
            break
        chosen.append(best)
        share[holders[best]] *= 0.5
    return chosen, odds


def train(texts: list[bytes], toxic: list[bool]) -> Model | None:
    """A model of labelled texts; None if a label is missing."""
    same: dict[bytes, bytes] = {}
    bags = [tuple({same.setdefault(c, c) for c in map(core, strings(t)) if c}) for t in texts]  # a set takes ten times as much
    del same
    fit = [i for i in range(len(bags)) if i % 4 != 3] if len(bags) >= 40 else list(range(len(bags)))
    bad, good = [bags[i] for i in fit if toxic[i]], [bags[i] for i in fit if not toxic[i]]
    if not bad or not good:
        return None
    clean: Counter[bytes] = Counter()
    for s in good:
        clean.update(s)
    chosen, odds = _choose(bad, clean, len(good))
    neutral = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if len(w) > 2][:NEUTRAL]
    landmarks = list(dict.fromkeys([*chosen, *neutral])) or [b"a"]
    kernel = Kernel(landmarks)
    gram = kernel(landmarks).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = (vectors / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    negatives = sorted(clean)
    ones = lambda k: np.concatenate([k.astype(float) @ root, np.ones((len(k), 1))], 1).astype(np.float32)
    near, n_far = [ones(np.zeros((1, len(landmarks))))], 0
    for at in range(0, len(negatives), SLICE):
        kn = kernel(negatives[at : at + SLICE])
        far = kn.max(1) < FAR
        near.append(ones(kn[~far]))
        n_far += int(far.sum())
    zn = np.concatenate(near)
    del near, kn, far
    negative_weight = np.append(float(n_far), np.ones(len(zn) - 1))
    negative_weight /= negative_weight.sum()
    known = sorted(w for w in set().union(*bad) if len(w) > 2)
    kp = kernel(known)
    close = kp.max(1) >= FAR  # others can't be witnesses
    known = [w for w, c in zip(known, close) if c]
    zp = ones(kp[close])
    at = {w: i for i, w in enumerate(known)}
    candidates = [sorted(w for w in s if w in at) for s in bad]
    del kp
    start = np.array([odds.get(w, 0.0) for w in known])
    first = np.zeros(len(known))
    for s in candidates:  # at first, each document's likeliest string
        if s:
            first[max((at[w] for w in s), key=lambda i: (start[i], -i))] += 1
    witness = first
    v = np.zeros(zn.shape[1])
    rng = np.random.default_rng(11)
    for last in [False] * (ROUNDS - 1) + [True]:
        rows = np.flatnonzero(witness)
        zw, cw = zp[rows], witness[rows]
        if last:  # witnesses with inserted characters teach tolerance
            made = [(x, witness[i] / 3) for i in rows for x in variants(known[i], rng) if x not in clean]
            if made:
                zw, cw = np.concatenate([zw, ones(kernel([x for x, _ in made]))]), np.concatenate([cw, [c for _, c in made]])
        # clean strings together weigh CLEAN times as much as the witnesses
        v = svm([(zw, 1.0, cw), (zn, -1.0, CLEAN * max(1.0, cw.sum()) * negative_weight)])
        margin = _margins(zp, v)
        witness = np.zeros(len(known))
        for s in candidates:
            if s:
                own = np.array([at[w] for w in s])
                witness[own[margin[own].argmax()]] += 1
    model = Model(kernel, (root @ v[:-1]).astype(np.float32), float(v[-1]))
    held = [i for i in range(len(bags)) if i % 4 == 3] if len(bags) >= 40 else fit
    scorer = Scorer(model)
    model.curve = _curve(scorer.tops([texts[i] for i in held]), np.array([toxic[i] for i in held]))
    return model


class Scorer:
    """Scores of texts; margins of strings are kept up to CACHE."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, float] = {}

    def tops(self, texts: list[bytes]) -> np.ndarray:
        """The TOP greatest margins of each text's strings; missing ones are the intercept, all are cut to +-CUT."""
        out = np.full((len(texts), TOP), self.model.intercept)
        at = 0
        while at < len(texts):
            bags, size = [], 0
            while at + len(bags) < len(texts) and size < 2_000_000:
                bags.append(strings(texts[at + len(bags)]))
                size += len(texts[at + len(bags) - 1])
            new = set().union(*bags).difference(self.known)
            if len(self.known) + len(new) > CACHE:
                self.known, new = {}, set().union(*bags)
            bare = {w: core(w) for w in new}
            distinct = sorted(set(bare.values()))
            margin = dict(zip(distinct, self.model.margins(distinct).tolist()))
            margin[b""] = self.model.intercept
            self.known |= {w: margin[c] for w, c in bare.items()}
            look = self.known.__getitem__
            for i, bag in enumerate(bags):
                own = np.fromiter(map(look, bag), float, len(bag))
                if len(own) > TOP:
                    own = np.partition(own, len(own) - TOP)[-TOP:]
                out[at + i, : len(own)] = np.sort(own)[::-1]
            at += len(bags)
        return np.clip(out, -CUT, CUT)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return self.model.scores(self.tops(texts))


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled documents whose crc32(doc_id) mod 3 is not 1."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    sample = marked.where("toxic = 1").orderBy(order, "doc_id").limit(TRAIN_TOXIC).unionByName(marked.where("toxic = 0").orderBy(order, "doc_id").limit(TRAIN_CLEAN))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, t, y == 1) for b in batches for d, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()))
        shuffled = np.random.default_rng(7).permutation(len(rows))
        model = train([rows[i][1] for i in shuffled], [rows[i][2] for i in shuffled])
        del rows
        give_back()
        if model:
            yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # one text an id, the least: repeated ids must not grow the one task that learns
    chosen = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text").repartition(1)
    made = chosen.mapInArrow(run, "model binary").collect()  # one row
    return pickle.loads(bytes(made[0].model)) if made else None


def add_scores(docs: DataFrame, model: Model | None, keep: dict[str, Column]) -> DataFrame:
    """The kept columns and score of each row of docs (text)."""
    ship(docs.sparkSession)
    source = docs.select(F.col("text").cast("string").alias("text"), *[c.alias(k) for k, c in keep.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for b in batches:
            texts = [t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()]
            scores = scorer(texts) if scorer else np.zeros(len(texts))
            yield pa.record_batch([*b.columns[1:], pa.array(scores)], [*b.schema.names[1:], "score"])
        del scorer
        give_back()

    return source.mapInArrow(run, source.drop("text").schema.add("score", "double"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) to doc_id, held_out, score, predicted."""
    out = add_scores(docs, fit(docs, labels), {"doc_id": docs["doc_id"]})
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """The rows of docs that are not judged toxic, with all their columns; training: the documents to learn from."""
    model = fit(docs if training is None else training, labels)
    return add_scores(docs, model, {"t_doc": F.struct(*[docs[c] for c in docs.columns])}).where(F.col("score") < THRESHOLD).select("t_doc.*")
