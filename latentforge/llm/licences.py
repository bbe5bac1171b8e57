"""Licence scan: windows of a text against licence templates by the Dice
coefficient over word bigrams.

A text is its lower-case words of letters and digits; a window is any run of
them, wherever lines end, and is compared as a multiset of word bigrams with
each template:

    dice = 2 * shared / (bigrams of window + bigrams of template)

A template of m bigrams can only reach ``THRESHOLD`` t with a window of n
bigrams where m t / (2 - t) <= n <= m (2 - t) / t, and of these m t / (2 - t)
have to be shared: the text's bigrams are looked up once in one index of all
templates, and only templates that share so many with the whole text go on.
The best window starts and ends with a shared bigram. A start is left out when
even all matching bigrams after it, counted without their multiplicity in the
template, cannot reach t (one pass from the right); for the others the running
count gives the best end. Per template the best windows that do not overlap are
taken, until none of at least t is left. The work per text is linear in its
words, times the window length at the starts that remain.

The templates are a table given by the caller, with one text or several per
licence; the registered query uses that of ``licence_templates``: whole licence
texts, standard headers and short forms. Given ``names``, a short template only
matches where those of its words that are names or have digits stand too.

Of overlapping matches one goes that is beaten in Dice and in shared bigrams;
so does a notice of another licence which the enclosing match's template itself
quotes (GPL texts name the AGPL and LGPL).

Edge cases: null and empty texts have no match; windows and templates of one
word have the word itself as their only item; ties take the first template by
name; repeated rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_templates import NAMES, NOTICES, TEMPLATES  # noqa: F401

THRESHOLD = 0.8
WORDS = re.compile(r"[^\W_]+")
#: templates of at most so many bigrams are short
SHORT = 24
#: templates of more bigrams are looked through for licences they quote
LONG = 96
#: room for rounding in bounds that only leave windows out
EPS = 1e-6


def bigrams(text: str) -> Counter:
    words = WORDS.findall(text.lower())
    if len(words) == 1:
        return Counter(words)
    return Counter(zip(words, words[1:], strict=False))


def lowered(text: str) -> str:
    """Lower case, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.replace("\u0130", "i").lower()


class Templates:
    """Templates in order of size, and the index of their bigrams."""

    def __init__(self, texts: dict[str, str | tuple[str, ...]], threshold: float = THRESHOLD,
                 names: frozenset[str] = frozenset()):
        rows = [(sum(b.values()), name, b) for name, forms in texts.items()
                for t in ((forms,) if isinstance(forms, str) else forms) if (b := bigrams(t))]
        self.rows = sorted(rows, key=lambda r: (r[0], r[1]))
        self.sizes, self.threshold = [r[0] for r in self.rows], threshold
        self.single: dict[str, str] = {}
        self.word: dict[str, int] = {}
        self.must: list[list[int]] = []
        at: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, (m, name, grams) in enumerate(self.rows):
            one = next(iter(grams))
            if isinstance(one, str):
                self.single[one] = min(name, self.single.get(one, name))
                self.must.append([])
                continue
            for (a, b), c in grams.items():
                pair = (self.word.setdefault(a, len(self.word) + 1),
                        self.word.setdefault(b, len(self.word) + 1))
                at.setdefault(pair, []).append((k, c))
            self.must.append([] if m > SHORT else sorted(
                {self.word[w] for g in grams for w in g
                 if names and (w in names or any(map(str.isdigit, w)))}))
        self.base = len(self.word) + 1
        pairs = sorted(at, key=lambda p: p[0] * self.base + p[1])
        self.keys = np.array([a * self.base + b for a, b in pairs], np.int64)
        self.ptr = np.cumsum([0, *(len(at[p]) for p in pairs)])
        entries = np.array([e for p in pairs for e in at[p]], np.int64).reshape(-1, 2)
        self.owner, self.count = entries[:, 0], entries[:, 1]
        gram = np.repeat(np.arange(len(pairs)), np.diff(self.ptr))
        order = np.argsort(self.owner, kind="stable")
        cut = np.searchsorted(self.owner[order], np.arange(len(self.rows) + 1))
        self.own = [(gram[order[a:b]], self.count[order[a:b]])
                    for a, b in zip(cut[:-1], cut[1:], strict=True)]
        m = np.array(self.sizes, float)
        self.need = np.ceil(m * threshold / (2 - threshold) - EPS)

    def best(self, passage: Counter) -> tuple[float, str] | None:
        """Highest Dice of at least the threshold, and its template."""
        n, t, found = sum(passage.values()), self.threshold, None
        for k in range(bisect_left(self.sizes, n * t / (2 - t)),
                       bisect_right(self.sizes, n * (2 - t) / t)):
            m, name, grams = self.rows[k]
            shared = sum(min(c, grams[g]) for g, c in passage.items() if g in grams)
            dice = 2 * shared / (n + m)
            if dice >= t and (found is None or (-dice, name) < (-found[0], found[1])):
                found = (dice, name)
        return found

    def windows(self, words: list[str]) -> list[tuple[int, int, int, float, int]]:
        """``(first word, last word, template, dice, shared)`` of each
        template's best windows that do not overlap."""
        ids = np.fromiter((self.word.get(w, 0) for w in words), np.int64, len(words))
        pos = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        code = ids[pos] * self.base + ids[pos + 1]
        gram = np.searchsorted(self.keys, code)
        hit = gram < len(self.keys)
        hit[hit] = self.keys[gram[hit]] == code[hit]
        pos, gram = pos[hit], gram[hit]
        if not len(pos):
            return []
        kinds, times = np.unique(gram, return_counts=True)
        n = self.ptr[kinds + 1] - self.ptr[kinds]
        entry = np.repeat(self.ptr[kinds] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[entry], minlength=len(self.rows),
                             weights=np.minimum(self.count[entry], np.repeat(times, n)))
        out = []
        for k in np.flatnonzero((shared >= self.need) & (shared > 0)).tolist():
            if all((ids == w).any() for w in self.must[k]):
                own, cap = self.own[k]
                j = np.minimum(np.searchsorted(own, gram), len(own) - 1)
                mine = own[j] == gram
                out += [(a, b, k, d, c) for a, b, d, c in self.fit(
                    k, pos[mine], gram[mine], cap[j[mine]],
                    [np.flatnonzero(ids == w) for w in self.must[k]])]
        return out

    def fit(self, k: int, p: np.ndarray, gram: np.ndarray, cap: np.ndarray,
            must: list[np.ndarray]) -> list[tuple[int, int, float, int]]:
        """Best windows of one template, whose bigrams stand at ``p``."""
        m, t, size = self.sizes[k], self.threshold, len(p)
        # a place counts in a window that starts after place ``prev``: there
        # the bigram is not yet there as often as the template has it
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        rank = np.arange(size) - np.searchsorted(g, g)
        prev = np.full(size, -1)
        old = rank >= cap[order]
        prev[order[old]] = order[np.flatnonzero(old) - cap[order[old]]]
        at = np.arange(size)
        far = np.searchsorted(p, p + ceil(m * (2 - t) / t + EPS))
        near = at.copy()
        for places in must:  # the window's last word is word p + 1
            nxt = np.searchsorted(places, p)
            last = np.append(places, np.iinfo(np.int64).max)[nxt]
            near = np.maximum(near, np.searchsorted(p, last - 1))
        ends = 2.0 * (at + 1) - t * (p + 1)
        top = np.maximum.accumulate(ends[::-1])[::-1]
        starts = np.flatnonzero((top - (2.0 * at - t * p) >= t * m - EPS)
                                & (far - at >= self.need[k]) & (near < far))
        free, limit, out = np.ones(size, bool), np.full(size, size), []
        while len(starts):
            found = []
            for s in starts.tolist():
                e = min(far[s], limit[s])
                if e - s < self.need[k] or near[s] >= e:
                    continue
                count = np.cumsum(prev[s:e] < s)
                dice = 2 * count / (p[s:e] - p[s] + 1 + m)
                dice[:near[s] - s] = 0
                b = int(dice.argmax())
                if dice[b] >= t:
                    found.append((-float(dice[b]), s, s + b, int(count[b])))
            blocked = []
            for d, s, e, c in sorted(found):
                if free[s] and free[s:e + 1].all():
                    free[s:e + 1] = False
                    out.append((int(p[s]), int(p[e]) + 1, -d, c))
                else:
                    blocked.append(s)
            shut = np.flatnonzero(~free)
            starts = np.array([s for s in sorted(blocked) if free[s]], np.int64)
            if len(starts):
                limit[starts] = np.append(shut, size)[np.searchsorted(shut, starts)]
        return out


def scan_text(text: str, templates: Templates,
              quoted: dict[int, set[str]] | None = None) -> list[tuple[int, int, str, float]]:
    """``(start, end, licence, dice)`` of the windows that match, without
    those that another match makes needless. ``quoted`` has the licences that
    a template's own text names."""
    low = lowered(text)
    words = WORDS.findall(low)
    found = [(a, b, templates.rows[k][1], d, c, k) for a, b, k, d, c in templates.windows(words)]
    if templates.single and not templates.single.keys().isdisjoint(words):
        found += [(i, i, templates.single[w], 1.0, 1, -1) for i, w in enumerate(words)
                  if w in templates.single]
    if not found:
        return []
    found.sort(key=lambda x: (x[0], -x[1]))
    gone, active = set(), []
    for i, x in enumerate(found):
        active = [j for j in active if found[j][1] >= x[0]]
        for j in active:
            y = found[j]
            # ranked by Dice, then evidence, name and place
            a, b = sorted((i, j), key=lambda q: (-found[q][3], -found[q][4], found[q][2], q))
            if found[a][4] >= found[b][4]:
                gone.add(b)
            for inner, outer in ((i, j), (j, i)):
                v, w = found[inner], found[outer]
                if (quoted and v[2] != w[2] and w[0] <= v[0] and v[1] <= w[1]
                        and v[4] < w[4] and v[2] in quoted.get(w[5], ())):
                    gone.add(inner)
        active.append(i)
    spans = [w.span() for w in WORDS.finditer(low)]
    return [(spans[x[0]][0], spans[x[1]][1], x[2], x[3])
            for i, x in enumerate(found) if i not in gone]


def quotes(texts: dict[str, str | tuple[str, ...]], templates: Templates) -> dict[int, set[str]]:
    """The other licences whose notices stand in a long template's own text."""
    rows: dict[tuple[str, int], list[int]] = {}
    for k, (m, name, _) in enumerate(templates.rows):
        rows.setdefault((name, m), []).append(k)
    out: dict[int, set[str]] = {}
    for name, forms in texts.items():
        for text in (forms,) if isinstance(forms, str) else forms:
            m = sum(bigrams(text).values())
            if m > LONG:
                words = WORDS.findall(lowered(text))
                named = {templates.rows[k][1] for _, _, k, _, c in templates.windows(words) if c < m / 2}
                named |= {templates.single[w] for w in words if w in templates.single}
                for k in rows[name, m]:
                    out.setdefault(k, set()).update(named - {name})
    return out


@lru_cache(maxsize=2)
def index(texts: tuple[tuple[str, str | tuple[str, ...]], ...], threshold: float,
          names: frozenset[str]) -> Templates:
    """Built once per Python worker, not per task."""
    return Templates(dict(texts), threshold, names)


MATCHES = "array<struct<start:int,end:int,licence:string,dice:double>>"


def scan_licences(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_matches, licences`` (sorted names), ``best_dice`` (null
    without a match) and ``matches`` (character spans) per document."""
    chosen = templates if templates is not None else TEMPLATES
    names = NAMES if templates is None else frozenset()
    table = tuple(chosen.items())
    quoted = quotes(chosen, index(table, threshold, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index(table, threshold, names)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                   ("licence", pa.string()), ("dice", pa.float64())]))
        for batch in batches:
            out = [[dict(zip(("start", "end", "licence", "dice"), m, strict=True))
                    for m in scan_text(t.as_py() or "", known, quoted)] for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, kind)],
                                  names=["doc_id", "matches"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, f"doc_id long, matches {MATCHES}")
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.array_sort(F.array_distinct("matches.licence")).alias("licences"),
        F.array_max("matches.dice").alias("best_dice"), "matches")
