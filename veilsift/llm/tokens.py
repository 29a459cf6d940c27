"""Token ids of texts by a public tokenizer file, encoded word by word through a bounded cache.

The tokenizer drops white space and no token spans it, so a text's ids are its words' ids in order. Only spaces and line
feeds are cut at; other white space stays inside a piece and is left to the tokenizer.

A word of plain letters (below U+0250) and trailing punctuation is two tokenizer pieces, so its ids are those of its
lower-case letters and of its punctuation. Such letters need no normalizing or splitting: a copy of the tokenizer
without those steps encodes them, many words in one text; a word's ids end where a token ends with the end-of-word suffix.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
from tokenizers import Tokenizer

#: Words kept in a worker's cache, the longest kept (characters), and the characters of text encoded at a time.
CACHE_WORDS, CACHE_CHARS, BLOCK_CHARS = 1_200_000, 40, 2_000_000
#: Words given to the tokenizer at once, and words of plain letters joined to a text.
ENCODED_AT_ONCE, JOINED = 20_000, 5_000
TAIL, PLAIN = ".,;:!?#*$%&|<>", "\u0250"


class Encoder:
    """Ids as bytes: little-endian unsigned 32-bit."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        bare = json.loads(self.tokenizer.to_str())
        steps = (bare["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = [{"type": "WhitespaceSplit"}, *(s for s in steps if s["type"] == "ByteLevel")]
        bare |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": split}, "added_tokens": []}
        self.letters = Tokenizer.from_str(json.dumps(bare))
        suffix = bare["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.letters.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {"": b""}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        block: list[list[str]] = []
        chars = 0
        for text in texts:
            block.append(text.replace("\n", " ").split(" "))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from self._block(block)
                block, chars = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[str]]) -> Iterator[bytes]:
        words = set().union(*block)
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > self.cache_words:
            self.forget()
            new = list(words.difference(self.known))
        bare = [w.rstrip(TAIL) for w in new]
        low = [c.lower() for c in bare]
        plain = [c.isalpha() and (b.isascii() or max(b) < PLAIN > max(c)) for b, c in zip(bare, low)]
        self.known |= _ids(self.tokenizer, list({w[len(b) :] if p else w for w, b, p in zip(new, bare, plain)}.difference(self.known)))
        self.cores |= _joined_ids(self.letters, self.ends, list(set(compress(low, plain)).difference(self.cores)))
        known, cores = self.known, self.cores
        known |= {w: cores[c] + known[w[len(b) :]] for w, b, c, p in zip(new, bare, low, plain) if p}
        look = known.__getitem__
        yield from [b"".join(map(look, text)) for text in block]
        if len(known) > self.cache_words:
            self.forget()
        for w in [w for w in new if len(w) > CACHE_CHARS]:
            known.pop(w, None)
            cores.pop(w.rstrip(TAIL).lower(), None)


def _ids(tokenizer: Tokenizer, words: list[str]) -> dict[str, bytes]:
    out: dict[str, bytes] = {}
    for at in range(0, len(words), ENCODED_AT_ONCE):  # encodings hold far more than ids
        some = words[at : at + ENCODED_AT_ONCE]
        flat, cuts = [], [0]
        for e in tokenizer.encode_batch_fast(some, add_special_tokens=False):
            flat += e.ids
            cuts.append(len(flat) * 4)
        data = np.array(flat, "<u4").tobytes()
        out |= {w: data[a:z] for w, a, z in zip(some, cuts, cuts[1:])}
    return out


def _joined_ids(tokenizer: Tokenizer, ends: np.ndarray, words: list[str]) -> dict[str, bytes]:
    """Like _ids, for words without white space; ends: which ids end a word."""
    out: dict[str, bytes] = {}
    for at in range(0, len(words), JOINED):
        some = words[at : at + JOINED]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        cuts = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
        if len(cuts) != len(some):  # a word that ends in no such token
            out |= _ids(tokenizer, some)
            continue
        data = ids.tobytes()
        out |= {w: data[a:z] for w, a, z in zip(some, [0, *cuts], cuts)}
    return out


@lru_cache(maxsize=2)
def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One encoder a worker process, file and size of cache."""
    return Encoder(path, cache_words)
