"""Language model, language id, host rules and licence scan."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixture_docs import corpus, empty, frame, prose

from latentforge.llm import host_rules, language_id, licences, maxent_lm
from latentforge.llm.textblock import U

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), ""]


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_lm_counts_and_base(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "FREQUENT", 20)  # most counts come by the join
    rows = corpus()
    c = Counter(t for r in rows if crc(r[0]) % 10 for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    got = defaultdict(list)
    for r in maxent_lm.score_corpus(frame(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for r in rows:
        t = tokens(r[1])
        for x in got[r[0]]:
            assert x.held_out == (crc(r[0]) % 10 == 0) and x.train_tokens == n
            assert x.n_tokens == len(t) and x.n_known == sum(c[w] > 0 for w in t)
            base = sum(np.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in t)
            assert abs(x.base_score - base) < 1e-6 * max(1, abs(base))
            assert x.score < 0


def patterned(head):
    """A sequence with a pattern, and a model of it with so many types in its head."""
    rng = np.random.default_rng(0)
    words = maxent_lm.mix(np.arange(1, 60, dtype=np.uint64) * maxent_lm.GOLDEN)
    seq = np.array([words[(i * 7) % 59] if rng.random() < .8 else words[rng.integers(59)]
                    for i in range(40000)])
    types, counts = np.unique(seq, return_counts=True)
    top = sorted(zip(types.view(np.int64).tolist(), counts.tolist(), strict=True), key=lambda x: -x[1])
    tail = np.zeros((2, maxent_lm.CLASSES * maxent_lm.SLOTS), np.int64)
    for t, n in top[head:]:
        tail[:, maxent_lm.cluster(np.array([t]).view(U))[0]] += n, 1
    return seq, types, counts, maxent_lm.Model(top[:head], tail, 1 << 10)


@pytest.mark.parametrize("head", [59, 20])
def test_lm_is_a_distribution_and_learns(head):
    """Probabilities over all words and an unseen one per cluster sum to one;
    training on a patterned sequence beats its unigram."""
    seq, types, counts, model = patterned(head)
    ctx = maxent_lm.contexts(seq, np.array([0, len(seq)]))
    before = model.log10(seq, model.numbers(seq), ctx).sum()
    seen = np.zeros(model.weights.size, np.int64)
    model.observe(seen, seq, ctx)
    model.weights = model.update(0, seen.reshape(-1, maxent_lm.SLOTS)).astype(np.float32)
    after = model.log10(seq, model.numbers(seq), ctx).sum()
    assert after > (0.7 if head == 59 else 0.71) * before
    k = maxent_lm.CLASSES * maxent_lm.SLOTS
    unseen = np.arange(k, dtype=np.uint64) << U(64 - maxent_lm.CLUSTER_BITS)
    words = np.concatenate([types, unseen])
    n = np.concatenate([counts, np.zeros(k)])
    for place in (0, 500):
        p = model.log10(words, model.numbers(words), np.repeat(ctx[:, place:place + 1], len(words), 1))
        p += np.where(model.numbers(words) == 0, np.log10(n + .1), 0)
        assert abs((10.0 ** p).sum() - 1) < 1e-3


def test_lm_update_is_the_gradient_of_the_likelihood():
    """Observed minus expected counts are the slopes of the log likelihood."""
    seq, _, _, model = patterned(20)
    seq = seq[:400]
    ctx = maxent_lm.contexts(seq, np.array([0, len(seq)]))
    seen = np.zeros(model.weights.size, np.int64)
    model.observe(seen, seq, ctx)
    seen = seen.reshape(-1, maxent_lm.SLOTS)
    step = model.update(0, seen).astype(float)
    model.weights = model.weights.astype(np.float64)

    def likelihood():
        return model.log10(seq, model.numbers(seq), ctx).sum() / maxent_lm.LOG10E

    for level in (model.head, model.tail):
        for row in (level.class_first, level.class_first + level.class_rows):
            r = row + int(np.argmax(seen[row:row + 300].sum(1)))
            for s in np.argsort(-seen[r])[:3]:
                # the step is RATE * log((o + DAMP) / (e + DAMP))
                expected = (seen[r, s] + maxent_lm.DAMP) / np.exp(step[r, s] / maxent_lm.RATE) - maxent_lm.DAMP
                model.weights[r, s] = 1e-2
                up = likelihood()
                model.weights[r, s] = -1e-2
                slope = (up - likelihood()) / 2e-2
                model.weights[r, s] = 0
                assert abs(slope - (seen[r, s] - expected)) < 0.02 * (1 + seen[r, s])


def test_lm_score_equals_brute_force(spark, monkeypatch):
    """Scores replayed token by token with dictionaries; the same in any layout."""
    monkeypatch.setattr(maxent_lm, "FREQUENT", 60)
    monkeypatch.setattr(maxent_lm, "FAN_IN", 2)
    monkeypatch.setattr(maxent_lm, "TOKENS_A_ROW", 0.002)
    rows = corpus()
    got = [{r.doc_id: r.score for r in maxent_lm.score_corpus(frame(spark, rows).repartition(p)).collect()
            if r.doc_id is not None} for p in (1, 7)]
    learn = [tokens(r[1]) for r in rows if crc(r[0]) % 10]
    c = Counter(t for x in learn for t in x)
    n, s = sum(c.values()), maxent_lm.SLOTS

    def fingerprints(x):
        block = maxent_lm.Block(0, np.frombuffer(" ".join(x[:-1]).encode(), np.uint8),
                                np.array([0, len(" ".join(x[:-1]).encode())]))
        return maxent_lm.tokens(block)[0]

    of = {w: int(f) for x in learn for w, f in zip(x, fingerprints(x), strict=True)}
    ranked = sorted((w for w in c if c[w] * 60 >= n),
                    key=lambda w: (-c[w], int(np.array(of[w], U).view(np.int64))))[:s * s - 1]
    head = {of[w]: (i + 1, c[w]) for i, w in enumerate(ranked)}
    known = {of[w]: k for w, k in c.items()}
    mass = [np.full(s * s, 1e-12), np.full(s * s, .1)]
    mass[0][:len(ranked) + 1] = .1
    for f, k in known.items():
        if f in head:
            mass[0][head[f][0]] += k
        else:
            mass[0][0] += k
            mass[1][f >> 54] += k + .1
    size = maxent_lm.rows_for(n)

    def mixed(x):
        return int(maxent_lm.mix(np.array([x], U))[0])

    def cells(x):
        """Per token its (level, factor, class, row of each feature, slot)."""
        f = fingerprints(x)
        ctx = maxent_lm.contexts(f, np.array([0, len(f)]))
        for i, w in enumerate(int(v) for v in f):
            hs = [int(h) for h in ctx[:, i]]
            for level, leaf in [(0, head[w][0] if w in head else 0)] + [(1, w >> 54)] * (w not in head):
                a, b = divmod(leaf, s)
                share = mass[level].reshape(s, s).sum(1)
                own = max(int(share[a] / share.sum() * size), 1)
                yield w, level, None, [(h >> 24) % size for h in hs], a
                yield w, level, a, [(mixed(h) >> 24) % own for h in hs], b

    seen = defaultdict(Counter)
    for x in learn:
        for _, level, cls, at, slot in cells(x):
            for r in at:
                seen[level, cls, r][slot] += 1

    def prior(level, cls):
        m = mass[level].reshape(s, s)
        m = m.sum(1) if cls is None else m[cls]
        return m / m.sum()

    for r in rows[::4]:
        if r[0] is None:
            continue
        x, total, last = tokens(r[1]), 0.0, None
        for w, level, cls, at, slot in cells(x):
            p = prior(level, cls)
            logit = np.log(p)
            for a in at:
                o = np.array([seen[level, cls, a][j] for j in range(s)], float)
                logit += .5 * np.log((o + 1) / (o.sum() * p + 1))
            total += (logit[slot] - np.log(np.exp(logit).sum())) / np.log(10)
            if level == 1 and cls is not None:
                total += np.log10((known.get(w, 0) + .1) / mass[1][w >> 54])
        for g in got:
            if sum(q[0] == r[0] for q in rows) == 1:
                assert abs(g[r[0]] - total) < 2e-3 * max(1, abs(total))
    assert got[0].keys() == got[1].keys()
    if len({r[0] for r in rows}) == len(rows):
        assert all(abs(got[0][i] - got[1][i]) < 1e-6 * max(1, abs(got[0][i])) for i in got[0])


def test_lm_beats_base_on_held_out(spark):
    import random
    rows = [(i, prose(random.Random(i), 200) + (" uno dos tres" * 40 if i % 2 else " eins zwei" * 60))
            for i in range(300)]
    got = maxent_lm.score_corpus(spark.createDataFrame(rows, "doc_id long, text string")
                                 .repartition(4)).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_lm_edges_and_growing_rows(spark):
    """Empty tables give no rows; repeated rows score alike; rows grow with the tokens."""
    assert maxent_lm.score_corpus(frame(spark, [])).count() == 0
    got = maxent_lm.score_corpus(frame(spark, corpus()[:20] * 2)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)].add(round(r.score, 6))
    assert len(got) == 40 and all(len(v) == 1 for v in by.values())
    sizes = [maxent_lm.rows_for(n) for n in (0, 10 ** 6, 10 ** 8, 10 ** 10, 10 ** 13)]
    assert sizes[0] == maxent_lm.FEWEST_ROWS and sizes[-1] == maxent_lm.MOST_ROWS
    assert sizes[2] > sizes[1] == sizes[0] and sizes == sorted(sizes)


def test_gru_gradient():
    """Backpropagation through time equals finite differences."""
    rng = np.random.default_rng(0)
    net = language_id.ByteGRU(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, 256, (6, 5))
    mask = (np.arange(6)[:, None] < rng.integers(1, 7, 5)).astype(np.float64)
    y = rng.integers(0, 3, 5)
    g = net.gradients(x, mask, y)
    for name in ("uf", "ub", "o", "c", "xf"):
        flat = net.p[name].reshape(-1)
        for at in rng.integers(0, flat.size, 4) if name != "xf" else [int(x[0, 0]) * 12 + 3]:
            kept = flat[at]
            flat[at] = kept + 1e-3
            net.gradients(x, mask, y)
            up = net.loss
            flat[at] = kept - 1e-3
            net.gradients(x, mask, y)
            flat[at] = kept
            assert abs((up - net.loss) / 2e-3 - g[name].reshape(-1)[at]) < 2e-3


def languages(n):
    import random
    sounds = {"en": "the thing ing and shower wh", "fr": "eau ouè la les été ç", "de": "sch ü ung der ß ich"}
    rows = []
    for i in range(n):
        lang = list(sounds)[i % 3]
        rng = random.Random(i)
        rows.append((i, " ".join(rng.choice(sounds[lang].split()) + rng.choice(["a", "e", "n"])
                                 for _ in range(rng.randint(3, 150))), lang))
    return rows


def test_language_id_held_out(spark):
    rows = languages(240)
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !", "fr"), (1003, "the thing " * 9000, None),
             (None, "der schung", "de")]
    got = language_id.identify(spark.createDataFrame(
        rows + extra, "doc_id long, text string, lang string").repartition(3)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(extra)
    held = [r for r in rows if crc(r[0]) % 4 == 2]
    assert all(by[r[0]].held_out == (crc(r[0]) % 4 == 2) for r in rows)
    assert np.mean([by[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en" and all(0 <= r.score <= 1 for r in got)


def test_language_id_without_labels(spark):
    got = language_id.identify(spark.createDataFrame(
        [(1, "some text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    one = language_id.identify(spark.createDataFrame(
        [(i, "some text", "en") for i in range(9)], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in one} == {"en"}


def test_every_byte_is_covered():
    data = np.arange(200, dtype=np.uint8)
    off = np.array([0, 0, 5, 5 + language_id.SEGMENT, 200])
    start, end, doc = language_id.segments(data, off)
    seen = np.concatenate([np.arange(a, b) for a, b in zip(start, end, strict=True)])
    assert seen.tolist() == list(range(200)) and set(doc.tolist()) == {1, 2, 3}


def measure(text):
    w = WORD.findall(text or "")
    wins = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if wins[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_host_rules_measures(spark):
    rows = [*corpus(), (500, "a # b $$ | c <x> " * 30, "en", None, None, None, "", "", "", "")]
    got = host_rules.apply_host_rules(frame(spark, rows), ["doc_id", "text", "kept"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                r.base_failed) == measure(r.doc.text)
        assert not (r.kept and r.base_failed)


def test_host_verdict_is_shrunk(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "short"
    rows = [(1, bad, "tiny")]  # one failure of one: shrunk below the threshold
    rows += [(100 + i, bad if i % 10 else good, "spam") for i in range(200)]
    for h in range(8):
        rows += [(1000 * (h + 1) + i, bad if i % 10 == 0 else good, f"h{h}") for i in range(100)]
    rows += [(2, good, "tiny2")]
    got = host_rules.apply_host_rules(
        spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()
    by = {r.host: r for r in got}
    assert by["=spam"].host_rejected and not by["=h0"].host_rejected
    assert 0.1 < by["=tiny"].host_rate < 1 and 0 < by["=tiny2"].host_rate < 0.5
    assert not any(r.kept for r in got if r.host == "=spam")
    assert all(r.kept for r in got if r.host == "=h0" and not r.failed)


def test_host_rules_edges(spark):
    assert host_rules.apply_host_rules(empty(spark), ["doc_id"]).count() == 0
    docs = frame(spark, corpus())
    out = host_rules.keep_quality(docs)
    assert out.columns == docs.columns
    assert all(not measure(r.text)[5] for r in out.collect())


def brute_dice(a, b):
    x, y = licences.bigrams(a), licences.bigrams(b)
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_size_bounds_lose_no_match(threshold):
    import random
    rng = random.Random(1)
    known = licences.Templates(licences.NOTICES, threshold)
    for _ in range(400):
        words = rng.choice(list(licences.NOTICES.values())).split()
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(words))
            words[k:k + 1] = rng.choice([[], ["extra"], [words[k], "more"]])
            words = words or ["x"]
        text = " ".join(words)
        best = max((brute_dice(text, t), name) for name, t in licences.NOTICES.items())
        got = known.best(licences.bigrams(text)) if licences.bigrams(text) else None
        assert (got is None) == (best[0] < threshold)
        assert got is None or got[0] == best[0]


def test_licence_scan(spark):
    rows = [(1, "Some prose here.\nReleased under the MIT License.\nMore."), (2, None), (3, ""),
            (4, "prose " * 20000 + "\nThis work is   licensed under the GNU General\tPublic License, version 3."),
            (5, "Licensed under the\nApache License, Version 2.0."), (6, "nothing"),
            (7, "Released under the MIT License.\n\nAll rights reserved."), (7, "x"), (None, "MIT")]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    names = {r.doc_id: list(r.licences) for r in got if r.n_matches}
    assert names == {1: ["MIT"], 4: ["GPL-3.0"], 5: ["Apache-2.0"], 7: ["MIT", "proprietary"]}
    assert all(r.best_dice is None for r in got if not r.n_matches)
    assert licences.scan_licences(empty(spark)).count() == 0


def test_licences_that_no_fixture_has(spark):
    """Bodies, headers, short forms, the Creative Commons family."""
    isc = licences.TEMPLATES["ISC"][-1]
    epl = licences.TEMPLATES["EPL-1.0"][-1]
    texts = {
        "MIT": licences.TEMPLATES["MIT"][-1], "ISC": "Copyright 2020 X\n\n" + isc,
        "EPL-1.0": epl.replace("Contributor", "Author"), "EPL-2.0": "Eclipse Public License - v 2.0",
        "Unlicense": licences.TEMPLATES["Unlicense"][-1], "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "CC-BY-ND-3.0": "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 "
                        "Unported License.",
        "CC-BY-NC-SA-2.5": "CC BY-NC-SA 2.5", "CC-BY-NC-ND-4.0": licences.TEMPLATES["CC-BY-NC-ND-4.0"][-1],
        "BSD-2-Clause": licences.TEMPLATES["BSD-2-Clause"][-1], "Zlib": licences.TEMPLATES["Zlib"][-1],
        "AGPL-3.0": licences.TEMPLATES["AGPL-3.0"][-1], "GPL-2.0": licences.TEMPLATES["GPL-2.0"][-1]}
    rows = [(i, t) for i, t in enumerate(texts.values())]
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = list(texts)
    assert len(got) == len(rows)
    for r in got:
        best = max(r.matches, key=lambda m: (m.dice, m.end - m.start))
        assert best.licence == names[r.doc_id] and best.dice > .9


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_windows_equal_brute_force(threshold):
    import random
    rng = random.Random(2)
    forms = {"a": "one two three one two four", "b": "two three", "c": "five one two one two one"}
    known = licences.Templates(forms, threshold)
    for _ in range(300):
        words = [rng.choice("one two three four five".split()) for _ in range(rng.randint(2, 24))]
        got = known.windows(words)
        for k, (_, name, _) in enumerate(known.rows):
            best = max(brute_dice(" ".join(words[i:j]), forms[name])
                       for i in range(len(words)) for j in range(i + 2, len(words) + 1))
            mine = sorted((x for x in got if x[2] == k), key=lambda x: x[0])
            assert bool(mine) == (best >= threshold)
            assert not mine or max(x[3] for x in mine) == best
            assert all(x[1] <= y[0] for x, y in zip(mine, mine[1:]))
            for a, b, _, dice, _ in mine:
                assert dice == brute_dice(" ".join(words[a:b + 1]), forms[name])


def test_notices_inside_lines_and_across_them(spark):
    rows = [("Copyright 2020 Foo Inc. All rights reserved.", "proprietary", "All rights reserved"),
            ("Released under the MIT License. See LICENSE file.", "MIT", "Released under the MIT License"),
            ("words " * 5000 + "and licensed under the Apache License, Version 2.0, by " + "them " * 5000,
             "Apache-2.0", "licensed under the Apache License, Version 2.0"),
            ("A line, and\nthis work is licensed under the GNU General\nPublic License, version 3. "
             "More\nlines.", "GPL-3.0",
             "this work is licensed under the GNU General\nPublic License, version 3"),
            ("Foo License, Version 2.0", None, None), ("\u0130 MIT License", "MIT", "MIT License"),
            (licences.TEMPLATES["GPL-3.0"][-1].replace("\n", " "), "GPL-3.0", None)]
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    for r in licences.scan_licences(docs).collect():
        text, name, span = rows[r.doc_id]
        assert list(r.licences) == ([name] if name else [])
        if span:
            assert text[r.matches[0].start:r.matches[0].end] == span and r.best_dice == 1
