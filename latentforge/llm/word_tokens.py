"""Token ids of whole texts, word by word, for a public word-level BPE file.

The vocabularies of this kind drop white space and never merge across it, so
the ids of a text are the ids of its white-space-separated words end to end.
A block is therefore reduced to its distinct words (by 64-bit fingerprint of
their bytes), each is encoded once per worker, and ids are gathered by array
indexing. ``WordEncoder`` keeps what a worker has seen in flat arrays and
forgets all of it when they pass ``MAX_WORDS`` (bounded memory, same results).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa

from .textblock import Block, Prefix

MAX_WORDS = 500_000


def load_tokenizer(path: str):
    """The tokenizer of a file, without truncation or padding."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


#: fixed values: the pre-tokenizer's pattern in the file, the same pattern for
#: lines of lower-case words of printable ASCII and Latin-1 letters, and what
#: makes a word another one
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\n|[^\na-z0-9ß-öø-ÿ]+")
ODD_PLACE = re.compile(r"[^\x21-\x7EÀ-ÖØ-öø-ÿ\n]|<\|")
MAX_RUNS = 300_000


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself
    where it is printable, else the next code point from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


def has_plain_rules(tok) -> bool:
    """Whether the file normalises and splits as ``PLAIN_RUNS`` assumes."""
    d = json.loads(tok.to_str())
    steps = [n.get("type") for n in (d.get("normalizer") or {}).get("normalizers", [])]
    parts = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (steps == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
            and parts[0].get("pattern") == {"Regex": FILE_PATTERN}
            and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
            and all(t["content"].startswith("<|") for t in d.get("added_tokens", [])))


class Flat:
    """Byte or id strings end to end, appended in amortised time."""

    def __init__(self, dtype):
        self.values, self.used = np.zeros(1 << 16, dtype), 0
        self.start, self.length, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def extend(self, values: np.ndarray, lens: np.ndarray) -> None:
        """Adds strings: their values end to end, and their lengths."""
        need, rows = self.used + len(values), self.n + len(lens)
        if need > len(self.values):
            self.values = np.concatenate([self.values[:self.used],
                                          np.zeros(2 * need - self.used, self.values.dtype)])
        if rows > len(self.start):
            grow = np.zeros(2 * rows - self.n, np.int64)
            self.start = np.concatenate([self.start[:self.n], grow])
            self.length = np.concatenate([self.length[:self.n], grow])
        self.values[self.used:need] = values
        self.start[self.n:rows] = self.used + np.cumsum(lens) - lens
        self.length[self.n:rows] = lens
        self.used, self.n = need, rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``rows`` end to end, and their lengths."""
        lens = self.length[rows]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[rows] - (ends - lens), lens) + np.arange(total)
        return self.values[at], lens


class LibraryIds:
    """Ids of words as the tokenizer gives them.

    Words of printable ASCII and Latin-1 letters are split here by the file's
    own rules, all words of a call at once, and their runs are merged by the
    tokenizer's model, each run once; every other word goes through the whole
    tokenizer."""

    def __init__(self, tok):
        self.tok, self.model, self.plain = tok, tok.model, has_plain_rules(tok)
        self.symbol = {i: c for i, c in enumerate(byte_symbols())}
        self.reset()

    def reset(self) -> None:
        # the line break between two words is a run without ids
        self.slot, self.runs = {"\n": 0}, Flat(np.uint32)
        self.runs.extend(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def whole(self, words: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(list(words), add_special_tokens=False)]

    def __call__(self, words: Sequence[str]) -> list[list[int]]:
        if not self.plain:
            return self.whole(words)
        ids, lens = self.flat(words)
        ends = np.cumsum(lens).tolist()
        listed = ids.tolist()
        return [listed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def flat(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` end to end, and how many each has."""
        words = list(words)
        odd = self.odd(words) if self.plain else range(len(words))
        given = [words[i] for i in odd]
        for i in odd:
            words[i] = ""
        ids, lens = self.merged(words)
        if not given:
            return ids, lens
        got = self.whole(given)
        lens[odd] = np.fromiter(map(len, got), np.int64, len(got))
        is_odd = np.zeros(len(words), bool)
        is_odd[odd] = True
        out, at = np.zeros(int(lens.sum()), np.uint32), np.repeat(is_odd, lens)
        out[~at] = ids
        out[at] = np.fromiter(chain.from_iterable(got), np.uint32, int(at.sum()))
        return out, lens

    def odd(self, words: list[str]) -> list[int]:
        """Places of the words that are left to the whole tokenizer."""
        text = "\n".join(words)
        if text.count("\n") != max(0, len(words) - 1):
            return [i for i, w in enumerate(words) if "\n" in w or ODD_PLACE.search(w)]
        places = [m.start() for m in ODD_PLACE.finditer(text)]
        first = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        return np.unique(np.searchsorted(first, places, "right")).tolist()

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``flat`` of plain and empty words."""
        found = PLAIN_RUNS.findall("\n".join(words).lower())
        fresh = set(found).difference(self.slot)
        if len(self.slot) + len(fresh) > MAX_RUNS:
            self.reset()
            fresh = set(found).difference(self.slot)
        if fresh:
            tokenize, symbol = self.model.tokenize, self.symbol
            got = [[t.id for t in tokenize(
                run if run.isascii() else run.encode("utf-8").decode("latin-1").translate(symbol))]
                for run in fresh]
            n = len(self.slot)
            self.slot.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            lens = np.fromiter(map(len, got), np.int64, len(got))
            self.runs.extend(np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens)
        rows = np.fromiter(map(self.slot.__getitem__, found), np.int64, len(found))
        ids, lens = self.runs.gather(rows)
        of = np.cumsum(rows == 0)
        return ids, np.bincount(of, lens, minlength=len(words)).astype(np.int64)


def library_ids(tok) -> LibraryIds:
    return LibraryIds(tok)


def words_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The byte ranges as strings."""
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=off[1:])
    at = np.repeat(start - off[:-1], end - start) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.string(), len(start), [
        None, pa.py_buffer(off), pa.py_buffer(data[at])]).to_pylist()


class WordEncoder:
    """Ids of blocks, and decoded text where ``pieces`` gives what each id
    adds to it."""

    def __init__(self, encode: Callable[[Sequence[str]], list[list[int]]],
                 pieces: Callable[[int], str] | None = None):
        self.encode, self.pieces = encode, pieces
        self.reset()

    def reset(self) -> None:
        self.slot: dict[int, int] = {}
        self.ids, self.text = Flat(np.uint32), Flat(np.uint8)

    def rows(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """``(row of each word, first word of each document)``."""
        start, end, first = block.words()
        keys, index, inverse = np.unique(Prefix(block.data).ranges(start, end),
                                         return_index=True, return_inverse=True)
        if len(self.slot) + len(keys) > MAX_WORDS:
            self.reset()
        listed = keys.tolist()
        fresh = [i for i, k in enumerate(listed) if k not in self.slot]
        if fresh:
            words = words_at(block.data, start[index[fresh]], end[index[fresh]])
            n = len(self.slot)
            self.slot.update(zip([listed[i] for i in fresh], range(n, n + len(fresh)), strict=True))
            if self.pieces is None and isinstance(self.encode, LibraryIds):
                self.ids.extend(*self.encode.flat(words))
            else:
                got = self.encode(words)
                lens = np.fromiter(map(len, got), np.int64, len(got))
                self.ids.extend(np.fromiter(chain.from_iterable(got), np.uint32,
                                            int(lens.sum())), lens)
            if self.pieces is not None:
                texts = ["".join([self.pieces(i) for i in x]).encode("utf-8") for x in got]
                self.text.extend(np.frombuffer(b"".join(texts), np.uint8),
                                 np.fromiter(map(len, texts), np.int64, len(texts)))
        rows = np.fromiter(map(self.slot.__getitem__, listed), np.int64, len(listed))
        return rows[inverse], first

    def ids_of(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: document i has ``ids[offsets[i]:offsets[i + 1]]``."""
        ids, lens = self.ids.gather(rows)
        return ids, np.concatenate(([0], np.cumsum(lens)))[first]

    def text_of(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded bytes, each token followed by a space, and offsets."""
        text, lens = self.text.gather(rows)
        return text, np.concatenate(([0], np.cumsum(lens)))[first]
