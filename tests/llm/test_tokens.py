"""Packing and encoding against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixture_docs import corpus, empty, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from latentforge.llm import lexicon, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
ODD = ["it's 12 o'clock", "a\x0bb\x0cc\x1cd\x1fe\x85f\xa0g h", "<|startoftext|>x<|endoftext|> y",
       "Σας ΣΑΣ ΟΔΟΣ", "é ́x", "中文字 текст ñandú", "a--b!!c  d\r\ne", "​ ﻿",
       "🙂🙃 x🙂y", "İstanbul ǅ ﬁ", "'s 't we'll I'm", "1234 5.6", "\x00\x01"]


def rows_with_odd():
    rows = corpus()
    extra = [(1000 + i, t, "en", "s", None, None, "u", None, None, "z") for i, t in enumerate(ODD)]
    return rows + extra


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def test_encoding_equals_library(spark):
    rows = rows_with_odd()
    got = sorted(tuple(r) for r in lexicon.transduced(frame(spark, rows), PATH, 30).collect()
                 if r[0] is not None)
    want = []
    for r in rows:
        if r[0] is None:
            continue
        ids = ids_of(r[1])
        text = TOK.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_word_encoder_on_any_text(text):
    enc = lexicon.lexicon_encoder(lexicon.Transducer.compile(["the", "of"], [ids_of("the"), ids_of("of")]), TOK)
    data = np.frombuffer(text.encode(), np.uint8)
    block = lexicon.blocks(lexicon.pa.array([text]))
    block = next(iter(block))
    assert (block.data == data).all()
    rows, first = enc.rows(block)
    assert enc.ids_of(rows, first)[0].tolist() == ids_of(text)
    assert enc.text_of(rows, first)[0].tobytes()[:-1].decode() == TOK.decode(
        ids_of(text), skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzAZéÉßÿÿþÞ×÷ªº²'sStrevmld09.,<|>!-#\xad\xa1ŸΣİ"),
               min_size=1, max_size=12))
def test_plain_words_as_the_library(word):
    from latentforge.llm.word_tokens import has_plain_rules, library_ids
    assert has_plain_rules(TOK)
    assert library_ids(TOK)([word, word.upper()]) == [ids_of(word), ids_of(word.upper())]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abzAÉßÿ×²'stl09.,<|>!-#\xa1Σİ\n中\x1f"),
                        max_size=8), max_size=12))
def test_words_in_bulk_as_the_library(words):
    from latentforge.llm.word_tokens import library_ids
    ids, lens = library_ids(TOK).flat(words)
    want = [ids_of(w) for w in words]
    assert lens.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_runs_are_forgotten_beyond_a_bound(monkeypatch):
    from latentforge.llm import word_tokens
    monkeypatch.setattr(word_tokens, "MAX_RUNS", 6)
    enc = word_tokens.library_ids(TOK)
    for words in (["one", "two", "Σ", "three!"], ["four", "one-two", ""], [f"w{i}" for i in range(9)]):
        assert enc(words) == [ids_of(w) for w in words]


def test_transducer_is_minimal_and_numbers_words():
    words = sorted({a + b for a in ("walk", "talk", "jump", "") for b in ("", "ed", "ing", "s", "er")} - {""})
    t = lexicon.Transducer.compile(words, [[i, i + 1] for i in range(len(words))])
    t = lexicon.Transducer.mapped(*t.dump())
    probe = words + ["wal", "walkx", "x", "jumpin", "a" * 60, "", "edd"]
    data, off = lexicon.column_bytes(lexicon.pa.array(probe))
    number = t.find(data, off)
    assert number[:len(words)].tolist() == list(range(len(words))) and (number[len(words):] == -1).all()
    # "walk" and "talk" share all that follows, and every ending is one state
    assert len(t.final) <= 22
    plain = lexicon.Transducer.mapped(*lexicon.Transducer.compile([], []).dump())
    assert (plain.find(data, off) == -1).all()


def check_pieces(rows, got):
    """Pieces rebuild every document; returns the sequences' segments."""
    segments = {}
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        segments.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in rows:
        if r[0] is None:
            continue
        ids = [*ids_of(r[1]), 1]
        mine = sorted(by_doc[r[0]], key=lambda x: x.piece)
        copies = sum(1 for x in rows if x[0] == r[0])
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k:k + 4096], "<u4").tobytes()
            same = [x for x in mine if x.piece == k // 4096]
            assert len(same) == copies
            for x in same:
                assert (x.start, x.length, x.ids_crc32) == (k, len(part) // 4, zlib.crc32(part))
    for parts in segments.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return segments


def test_packing_round_trip(spark):
    rows = rows_with_odd()
    got = packing.best_fit_packing(frame(spark, rows), PATH).collect()
    segments = check_pieces(rows, got)
    total = sum(length for parts in segments.values() for _, length in parts)
    assert len(segments) <= -(-total // 4096) + 2


def test_matrices_round_trip(spark):
    rows = rows_with_odd()
    got = packing.packed_matrices(frame(spark, rows), PATH).collect()
    want = sorted(zlib.crc32(np.array([*ids_of(r[1]), 1][k:k + 4096], "<u4").tobytes())
                  for r in rows for k in range(0, len(ids_of(r[1])) + 1, 4096))
    found = []
    for r in got:
        ids = np.frombuffer(r.ids, f"<u{packing.id_width(PATH)}").astype("<u4")
        assert len(ids) == 4096 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens:].any()
        for a, b, start in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], r.starts, strict=True):
            found.append(zlib.crc32(ids[a:b].tobytes()))
            assert (a in r.position_resets) == (start == 0)
    assert sorted(found) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(1, 6))
def test_best_fit_is_best_fit(lengths, open_bins):
    where, offset = packing.best_fit(lengths, 50, open_bins)
    bins, done = {}, 0
    for need, b, at in zip(lengths, where, offset, strict=True):
        fits = [f for f in bins.values() if f >= need]
        if b in bins:
            assert bins[b] == min(fits) and at == 50 - bins[b]
        else:
            assert not fits and at == 0
            if len(bins) == open_bins:  # the fullest was closed
                bins.pop(min(bins, key=lambda x: (bins[x], -x)))
            bins[b] = 50
        bins[b] -= need
        if not bins[b]:
            del bins[b]
        done += 1
    assert done == len(lengths)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_decreasing(lengths):
    where, offset = packing.best_fit_decreasing(lengths, 64)
    free = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free.values() if f >= lengths[i]]
        if fits:
            assert free[where[i]] == min(fits)
        else:
            assert where[i] not in free
            free[where[i]] = 64
        assert offset[i] == 64 - free[where[i]]
        free[where[i]] -= lengths[i]


def test_empty_tables(spark):
    assert packing.best_fit_packing(empty(spark), PATH).count() == 0
    assert packing.packed_matrices(empty(spark), PATH).count() == 0
    assert lexicon.transduced(empty(spark), PATH).count() == 0


def test_write_packed(spark, tmp_path):
    import random
    docs = spark.createDataFrame([(i, prose(random.Random(i), 300)) for i in range(30)],
                                 "doc_id long, text string")
    packing.write_packed(docs, PATH, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).agg({"n_tokens": "sum"}).first()[0] == sum(
        len(ids_of(prose(random.Random(i), 300))) + 1 for i in range(30))


@pytest.mark.parametrize("n", [1, 7])
def test_packers_do_not_share_sequences(spark, monkeypatch, n):
    monkeypatch.setattr(packing, "PACKER_TOKENS", 20_000 // n)
    check_pieces(corpus(), packing.best_fit_packing(frame(spark, corpus()), PATH).collect())
