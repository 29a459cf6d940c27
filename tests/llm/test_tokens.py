import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilsift.llm import packing, tokenfile, tokens

PATH = P.path("word_bpe_49k.json")
ODD = ["", " ", "a", "It's THE end\n\nof  it", "tab\there\x0bvt\x0cff\rcr\x1cfs\x1fus", "nbsp x em　cjk 漢字", "é café́ ̸x", "<|endoftext|> x<|startoftext|>y", "İSTANBUL ΣΑΣ ß", "\U0001f600 12345 a1b2", "don't we'll  I'd'"]


def plain(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_word_by_word_is_the_whole_encoding():
    own, tok = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in [*ODD, " ".join(ODD), "x" * 5000]:
        assert np.frombuffer(next(own.encode([text])), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


LETTERS = st.text(st.sampled_from("aZzİıſŉßẞKÅéÉ.,!?:;'# 1\u0130\u024f\u0250"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), LETTERS))
def test_word_by_word_on_any_text(text):
    own, tok = tokens.encoder(PATH), Tokenizer.from_file(PATH)
    assert np.frombuffer(next(own.encode([text])), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_plain_words_with_marks_need_few_encodings(monkeypatch):
    """Words of letters and marks were each given to the whole tokenizer, and letters one by one."""
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}word{tail}" for i in range(400)) for tail in ("", "###", "$%&", "|<>*")]
    given_words, encode = [], tokens._ids
    monkeypatch.setattr(tokens, "_ids", lambda tokenizer, words: given_words.extend(words) or encode(tokenizer, words))
    monkeypatch.setattr(tokens, "JOINED", 7)
    own, tok = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert len(given_words) <= 4
    own.forget()
    own.ends[:] = False  # ends unknown: one by one
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_small_cache(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 12)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    own, tok = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["a b c d e f g h", "a b", "h i j k", "x" * 50 + " a", ""] * 2
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def covered(lengths, sequences):
    got = defaultdict(list)
    for s in sequences:
        for d, a, n in s:
            assert n > 0
            got[d].append((a, n))
    for d, size in enumerate(lengths):
        at = 0
        for a, n in sorted(got[d]):
            assert a == at
            at += n
        assert at == size


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60), st.integers(1, 64), st.booleans())
def test_packing_covers_and_keeps_limits(lengths, segments, cut):
    limits = packing.Limits(64, segments, 50)
    out = packing.pack(lengths, limits, cut)
    covered(lengths, out)
    for s in out:
        assert sum(n for *_, n in s) <= 64 and len(s) <= segments
        assert sum(n - (a == 0) for _, a, n in s) <= 50


def test_little_padding():
    rng = np.random.default_rng(0)
    lengths = rng.lognormal(6, 1.2, 2000).astype(int).tolist()
    out = packing.pack([max(1, n) for n in lengths])
    used = [sum(n for *_, n in s) for s in out]
    pad = sum(4096 - u for u in used if u & (u - 1))
    assert pad < 0.005 * sum(used)
    assert sum(map(len, out)) < 1.5 * len(lengths)


def rows(spark, extra=()):
    texts = [*ODD, None, "word " * 9000, "same", "same"]
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "twin", "x"), (None, "no id", "x"), *extra]
    return data, spark.createDataFrame(data, "doc_id long, text string, length string")


def test_packed_rows(spark):
    data, df = rows(spark)
    out = packing.packed(df.repartition(3), PATH, 2).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id, r.doc_tokens].append(r)
    want = defaultdict(int)
    for d, t, _ in data:
        want[d, len(plain(t))] += 1
    assert {k: sum(r.length for r in v) for k, v in by.items()} == {k: k[1] * n for k, n in want.items()}
    single = {d: plain(t) for d, t, _ in data if d != 3 and d is not None}
    for r in out:
        if r.doc_id in single:
            assert r.ids_crc32 == zlib.crc32(np.array(single[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    place = defaultdict(list)
    for r in out:
        place[r.sequence_id].append((r.offset, r.length))
    for v in place.values():
        at = 0
        for a, n in sorted(v):
            assert a == at
            at += n
        assert at <= 4096
    assert packing.packed(df.where("false"), PATH, 2).count() == 0


@pytest.mark.parametrize("per_file", [1, 3, 4096])
def test_files_round_trip(spark, tmp_path, monkeypatch, per_file):
    monkeypatch.setattr(tokenfile, "FILE_DOCS", per_file)
    data, df = rows(spark)
    out = tokenfile.round_trip(df.repartition(4), PATH, 2, f"file://{tmp_path}/t").orderBy("start").collect()
    want, at = [], 0
    for d, t, _ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain(t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in out] == want
    assert tokenfile.round_trip(df.where("false"), PATH, 2, f"{tmp_path}/e").count() == 0
