"""Exact, near, line and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import linededup, lpf, minhash, recipes
from plumbline.llm.graph import contract
from plumbline.llm.common import Scratch
from tests.llm.cases import corpus, documents, last_if_null, sentence, stripped


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[stripped(r[1])].append(r)
    out = []
    for text, members in groups.items():
        order = sorted(members, key=lambda r: (-len(r[1] or ""), last_if_null(r[0])))
        for i, r in enumerate(order):
            out.append((r[0], order[0][0], len(members), i == 0, hashlib.sha256(text.encode()).hexdigest(), len(text.encode())))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, bits):
    """Also with chunk hashes so short that different chunks share them."""
    rows = corpus(1)
    assert rows_of(recipes.exact_duplicates(documents(spark, rows), bits)) == exact(rows)


def test_exact_duplicates_of_long_texts(spark):
    long = "".join(f"{i} some words {i * i} " for i in range(6000))
    rows = [(1, long, "", ""), (2, long + "x", "", ""), (3, long.replace(" ", "\n"), "", ""), (4, "y" + long, "", ""), (5, "z" * 70_000, "", ""), (6, "z" * 70_001, "", "")]
    assert rows_of(recipes.exact_duplicates(documents(spark, rows))) == exact(rows)


def test_cuts_depend_on_content():
    data = b"".join(b"%d item of a list, " % (i * 7919) for i in range(4000))
    ends = recipes.cut_points(data)
    moved = recipes.cut_points(b"something before" + data)
    assert ends[-1] == len(data) and max(b - a for a, b in zip([0, *ends], ends)) <= 1 << 14
    assert len({x + 16 for x in ends} & set(moved)) > 0.9 * len(ends)


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    best = defaultdict(list)
    for i, r in enumerate(rows):
        best[find(i)].append(r[0])
    least = {k: min(v, key=last_if_null) for k, v in best.items()}
    return sorted(((r[0], len(sets[i]), least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", [2, 3])
def test_near_duplicates(spark, seed):
    rows = corpus(seed, 80)
    assert rows_of(minhash.near_duplicates(documents(spark, rows))) == near(rows)


def test_large_group_of_near_copies_without_their_centre(spark):
    """Copies of one text that are not alike enough among each other in all pairs, and chains of small steps."""
    rng = random.Random(5)
    base = sentence(rng, 300).split(" ")
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(len(words))] = f"new{i}"
        rows.append((i, " ".join(words), "", ""))
    words = sentence(rng, 200).split(" ")
    for i in range(30):
        words[(i * 7) % 200 : (i * 7) % 200 + 2] = [f"step{i}", f"more{i}"]
        rows.append((100 + i, " ".join(words), "", ""))
    assert rows_of(minhash.near_duplicates(documents(spark, rows))) == near(rows)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    scratch = Scratch(spark, "graph")
    found = dict(contract(spark.createDataFrame(edges, "a long, b long"), scratch).collect())
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))


def lines(rows, least, keep_first=False):
    holders, first = defaultdict(set), {}
    for r in sorted(rows, key=lambda r: last_if_null(r[0])):
        for i, x in enumerate((r[1] or "").split("\n")):
            if key(x):
                holders[key(x)].add(r[0])
                first.setdefault(key(x), (r[0], i))
    out = []
    for r in rows:
        all_lines = (r[1] or "").split("\n")
        left = [x for i, x in enumerate(all_lines) if not (key(x) and len(holders[key(x)]) >= least) or keep_first and first[key(x)] == (r[0], i)]
        out.append((r[0], "\n".join(left), len(all_lines), len(all_lines) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 10])
def test_repeated_lines(spark, least):
    rows = corpus(4)
    found = [(a, b or "", c, d) for a, b, c, d in linededup.drop_repeated_lines(documents(spark, rows), least).collect()]
    assert sorted(found, key=str) == lines(rows, least)


def test_first_occurrence_can_stay(spark):
    rows = [(i, f"own {i}\nshared line\n  SHARED line", "", "") for i in range(30)]
    found = [tuple(r) for r in linededup.drop_repeated_lines(documents(spark, rows), 5, keep_first=True).collect()]
    assert sorted(found, key=str) == lines(rows, 5, True)


def repeats(rows):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for d, b in data:
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            least[s] = min(least.get(s, (2, 0)), last_if_null(d))
    out = []
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < last_if_null(d):
                gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def bytes_rows(df):
    return sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in df.collect()), key=str)


@pytest.mark.parametrize("slice_bytes", [lpf.SLICE, 1500])
def test_repeated_bytes(spark, slice_bytes):
    """Also with slices that hold only a few documents."""
    rows = corpus(6)
    assert bytes_rows(lpf.remove_repeats(documents(spark, rows, 4), slice_bytes)) == repeats(rows)


def test_slices_and_segments_agree():
    """The samples of a slice do not depend on how it is cut into segments."""
    text = sentence(random.Random(9), 2000).encode()
    body, ends, skip = np.frombuffer(text, np.uint8), np.array([3000, 3100, len(text)]), np.zeros(3, bool)

    def sampled(step):
        found = {}
        for start in range(0, len(body) - 49, step):
            s = lpf.Segment(body, ends, skip, start, min(start + step, len(body) - 49))
            which = np.arange(len(s.at))
            for at, k, c in zip((s.at + s.base).tolist(), s.key.tolist(), s.context(which).tolist() if len(which) else []):
                found[at] = (k, c)
        return found

    assert sampled(1 << 20) == sampled(500)


@pytest.mark.parametrize("operator", [recipes.exact_duplicates, minhash.near_duplicates, linededup.drop_repeated_lines, lpf.remove_repeats])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).count() == 0


def test_counts_of_copies():
    assert Counter(x[3] for x in exact([(1, "a", "", ""), (1, "a", "", "")])) == {True: 1, False: 1}
