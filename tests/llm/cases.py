"""Small corpora for the tests of this folder."""

from __future__ import annotations

import random

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, k1 string, k2 string, kept string, size string, node string, root string, "
    "shard string, place string, keep string, digest string, items string, ids string"
)
SPARE = len(DOC_SCHEMA.split(", ")) - 5
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", ","]) for _ in range(n))


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source): near copies, shared passages and lines, and every odd case."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 30), sentence(rng, 6)
    texts = []
    for i in range(n):
        text = sentence(rng, rng.choice([1, 3, 4, 5, 6, 20, 80, 200]))
        if i % 5 == 1 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        if i % 4 == 0:
            text = f"{text} {passage} {sentence(rng, 4)}"
        if i % 3 == 0:
            text = f"{text}\n {line.upper()}\t\n{line}\n\n"
        texts.append(text)
    texts += [texts[3], texts[3], texts[4].replace(" ", "\n\t "), texts[4] + "  ", "", None, " \n\t", "a", "É é — “x”", "\x0b\x0cüñ\n", "ab" * 3000]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src0", "src0", "b", None])) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, texts[3], None, None), (None, "only here and nowhere else at all", "en", "z"), rows[0], rows[0], (rows[1][0], "another text under a known id", "en", "s")]


def documents(spark, rows, parts: int = 3):
    full = [(*r, None if r[1] is None else len(r[1]), *["x"] * SPARE) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA).repartition(parts)


def stripped(text: str | None) -> str:
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def last_if_null(x):
    return (x is None, x or 0)
