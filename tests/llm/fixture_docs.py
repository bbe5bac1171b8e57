"""Small documents with the cases that the operators must handle."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "kept boolean, uid string, digest string, host string, id string")
WORDS = ("the of and river stone light paper house garden window train music bread winter "
         "summer north south green yellow seven eight market street doctor teacher").split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "s", "ing", "é"]))
                    for _ in range(n))


def corpus(seed=0, n=40):
    """Prose, exact copies, near copies at many distances, shared passages,
    periodic texts, multi-byte characters, odd white space, nulls, ties."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 220)) for _ in range(n)]
    base = prose(rng, 160)
    for k in range(14):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = rng.choice(WORDS).upper() + str(k)
        texts.append(" ".join(words))
    passage = prose(rng, 90)
    for _ in range(6):
        texts.append(prose(rng, rng.randint(1, 60)) + "\n" + passage + " " + prose(rng, 20))
    texts += [base, base.upper(), base + " end", "a" * 1500, "ab" * 700, "é" * 500, "x" * 399,
              "y" * 400, None, None, "", " \t\n\x0b\f\r ", "one", "One", "one two three four",
              "123 456", "…", prose(rng, 4000), passage, passage + passage,
              "line\nline\nline\n" * 30, "w1 w2 w3 " * 40]
    rows = [(i, t, ("en", "fr")[i % 2], f"src{i % 3}", None, None, "u", None, None, "z")
            for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[45]]  # repeated rows
    rows.append((None, "a text without an id " + prose(rng, 30), None, None, None, True, "", "", "", ""))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
