"""BPE encoding through a minimal acyclic transducer of frequent words.

The words with at least a ``LEXICON``-th of all occurrences (at most ``LEXICON``
words, then) are compiled, with their ids as outputs, into an automaton that
shares prefixes and suffixes: each transition carries how many words come before
those that pass it, so the sum along a word's path is its number in the lexicon,
and that number indexes its ids. The automaton is a few flat arrays (sorted transition keys, targets,
sums), written to one file that a worker maps into memory; a block's distinct
words walk it in lock step by binary search. Words it does not know are merged
exactly by the tokenizer itself. Decoding joins the tokens of the ids.

Counting words is one grouped sum over the whole corpus; the lexicon changes
the speed, never the ids. Edge cases: null text counts as empty (no ids, empty
decoded text); repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textblock import Prefix, blocks, column_bytes
from .word_tokens import WordEncoder, library_ids, load_tokenizer

#: words in the transducer: bounds its size (about 40 bytes a word) on the
#: driver, in the broadcast and in a worker
LEXICON = 50_000
#: longer words are never compiled (bounds the walk)
LONGEST = 40


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each batch with their counts."""
    for batch in batches:
        for block in blocks(batch.column("text"), 4 << 20):
            start, end, _ = block.words()
            key, index, n = np.unique(Prefix(block.data).ranges(start, end), return_index=True,
                                      return_counts=True)
            short = end[index] - start[index] <= LONGEST
            s, e, n = start[index][short], end[index][short], n[short]
            off = np.zeros(len(s) + 1, np.int32)
            np.cumsum(e - s, out=off[1:])
            at = np.repeat(s - off[:-1], e - s) + np.arange(off[-1])
            word = pa.Array.from_buffers(pa.string(), len(s), [
                None, pa.py_buffer(off), pa.py_buffer(block.data[at])])
            yield pa.record_batch([word, pa.array(n.astype(np.int64))], names=["word", "n"])


def frequent_words(docs: DataFrame, limit: int = LEXICON) -> list[str]:
    """Words with at least a ``limit``-th of all occurrences, which at most
    ``limit`` words can have."""
    counts = materialize(
        docs.select("text").mapInArrow(word_counts, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r[0] for r in counts.filter(F.col("n") * limit >= F.lit(total))
                  .select("word").collect())


class Transducer:
    """Minimal acyclic automaton of words, numbered in sorted order."""

    def __init__(self, keys: np.ndarray, target: np.ndarray, before: np.ndarray,
                 final: np.ndarray, root: int, id_off: np.ndarray, ids: np.ndarray):
        self.keys, self.target, self.before, self.final = keys, target, before, final
        self.root, self.id_off, self.ids = root, id_off, ids

    @classmethod
    def compile(cls, words: Sequence[str], outputs: Sequence[Sequence[int]]) -> Transducer:
        """Sorted words are added one by one; the part of the last word that
        no later word can extend is replaced by an equal state already kept."""
        ids = {w.encode("utf-8"): o for w, o in zip(words, outputs, strict=True)}
        kept: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def settle(node: list) -> int:
            shape = (node[0], tuple(node[1]))
            if shape not in kept:
                kept[shape] = len(states)
                states.append(shape)
            return kept[shape]

        path, last = [[False, []]], b""
        order = sorted(ids)
        for word in [*order, None]:
            common = 0
            if word is not None:
                while common < min(len(word), len(last)) and word[common] == last[common]:
                    common += 1
            while len(path) > common + 1:
                done = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            if word is None:
                break
            path.extend([False, []] for _ in word[common:])
            path[-1][0] = True
            last = word
        root = settle(path[0])
        below = np.zeros(len(states), np.int64)
        keys, target, before = [], [], []
        for s, (final, out) in enumerate(states):  # children come before parents
            total = int(final)
            for byte, t in out:
                keys.append(s * 256 + byte)
                target.append(t)
                before.append(total)
                total += int(below[t])
            below[s] = total
        flat = [np.asarray(ids[w], np.uint32) for w in order]
        return cls(np.asarray(keys, np.int64), np.asarray(target, np.int64),
                   np.asarray(before, np.int64), np.asarray([f for f, _ in states], np.uint8), root,
                   np.concatenate(([0], np.cumsum([len(x) for x in flat], dtype=np.int64))),
                   np.concatenate(flat) if flat else np.zeros(0, np.uint32))

    PARTS = ("keys", "target", "before", "final", "id_off", "ids")

    def dump(self) -> tuple[bytes, list]:
        """The arrays in one byte string, and where each lies in it."""
        raw, table = b"", [("root", self.root)]
        for name in self.PARTS:
            a = np.ascontiguousarray(getattr(self, name))
            raw += b"\0" * (-len(raw) % 8)
            table.append((name, a.dtype.str, len(a), len(raw)))
            raw += a.tobytes()
        return raw, table

    @classmethod
    def mapped(cls, raw: bytes, table: list) -> Transducer:
        """Memory-maps the arrays from a file that lasts as long as the map."""
        fd, name = tempfile.mkstemp(prefix="lexicon-")
        with os.fdopen(fd, "wb") as f:
            f.write(raw)
        whole = np.memmap(name, np.uint8, "r") if raw else np.zeros(0, np.uint8)
        os.unlink(name)
        parts = {n: whole[at:at + k * np.dtype(d).itemsize].view(d) for n, d, k, at in table[1:]}
        return cls(root=table[0][1], **parts)

    def find(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Numbers of the words ``data[off[i]:off[i + 1]]`` (-1: not known)."""
        n = len(off) - 1
        number, state = np.zeros(n, np.int64), np.full(n, self.root, np.int64)
        size = np.diff(off)
        known = size <= LONGEST
        live = np.flatnonzero(known & (size > 0))
        step = 0
        while len(live):
            key = state[live] * 256 + data[off[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(live), bool)
            known[live[~hit]] = False
            live, at = live[hit], at[hit]
            number[live] += self.before[at]
            state[live] = self.target[at]
            step += 1
            live = live[size[live] > step]
        known &= self.final[state] > 0
        return np.where(known, number, -1)


def lexicon_encoder(lexicon: Transducer, tok) -> WordEncoder:
    """Encodes by the transducer, and by exact merging what it does not know."""
    merge = library_ids(tok)

    def encode(words: Sequence[str]) -> list:
        data, off = column_bytes(pa.array(words, pa.string()))
        number = lexicon.find(data, off)
        unseen = np.flatnonzero(number < 0)
        merged = iter(merge([words[i] for i in unseen.tolist()]))
        return [next(merged) if k < 0 else known[k] for k in number.tolist()]

    flat, off = lexicon.ids.tolist(), lexicon.id_off.tolist()
    known = [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    shown = [(tok.id_to_token(i) or "") + " " for i in range(tok.get_vocab_size())]
    return WordEncoder(encode, pieces=shown.__getitem__)


def transduced(docs: DataFrame, tokenizer: str, limit: int = LEXICON) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document."""
    spark = docs.sparkSession
    words = frequent_words(docs, limit)
    lexicon = Transducer.compile(words, library_ids(load_tokenizer(tokenizer))(words))
    shipped = spark.sparkContext.broadcast(lexicon.dump())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = lexicon_encoder(Transducer.mapped(*shipped.value), load_tokenizer(tokenizer))
        for batch in batches:
            for block in blocks(batch.column("text"), 1 << 19):
                rows, first = enc.rows(block)
                ids, off = enc.ids_of(rows, first)
                text, text_off = enc.text_of(rows, first)
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                n = np.diff(off)
                text = memoryview(text)
                yield pa.record_batch([
                    batch.column("doc_id").slice(block.row0, block.n), pa.array(n),
                    pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in
                              zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string()),
                    pa.array([hashlib.sha256(text[a:max(a, b - 1)]).hexdigest() for a, b in
                              zip(text_off[:-1].tolist(), text_off[1:].tolist(), strict=True)],
                             pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
