"""Consistent weighted sampling against plain loops and the similarity that it estimates."""

from __future__ import annotations

import hashlib
import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import cws
from tests.llm.cases import corpus, documents, sentence


def weights(text):
    lower = (text or "").lower()
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", lower))


def jaccard(x, y):
    a, b = weights(x), weights(y)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def fingerprints(spark, texts, samples=cws.SAMPLES):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    return [r.samples for r in cws.fingerprints(df, ["i"], samples).orderBy("i").collect()]


def test_collisions_estimate_generalised_jaccard(spark):
    rng = random.Random(6)
    base = sentence(rng, 120)
    words = base.split(" ")
    texts = [base] + [" ".join(words[: 120 - n] + sentence(rng, n).split(" ")) for n in (6, 20, 40, 80)]
    texts += [base + " " + base, " ".join(rng.choice(words) for _ in range(300)), "alpha " * 50 + base, sentence(rng, 3)]
    # 96 samples have a standard error of at most 0.051
    found = fingerprints(spark, texts, 96)
    errors = [sum(a == b for a, b in zip(found[i], found[j])) / 96 - jaccard(texts[i], texts[j]) for i in range(len(texts)) for j in range(i)]
    assert max(map(abs, errors)) < 0.2 and abs(statistics.mean(errors)) < 0.03 and statistics.pstdev(errors) < 0.07


def test_weights_matter_and_order_does_not(spark):
    found = fingerprints(spark, ["a b c", "c\tB  a\n", "a a b c", "A" * 5000, "", None, " \n", "a b c"])
    assert found[0] == found[1] == found[7] != found[2] and found[4:7] == [None] * 3
    assert all(len(x) == cws.SAMPLES for x in found if x is not None)


def expected(rows):
    """Rows of edit_likeness without fingerprints; the order of rows under one doc_id is free."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (name, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        out.append((name, text, text[: len(text) - n] + after[:n], after))
    return out


def test_equals_plain_loops(spark):
    seen, rows = set(), []
    for r in corpus(4, 50):
        if r[0] not in seen:
            seen.add(r[0])
            rows.append(r)
    found = {r.doc_id: r for r in cws.edit_likeness(documents(spark, rows)).collect()}
    want = expected(rows)
    assert len(found) == len(want)
    flat = [t for _, text, made, after in want for t in (text, made, after)]
    samples = iter(fingerprints(spark, flat))
    like = lambda a, b: float(a == b) if a is None or b is None else sum(x == y for x, y in zip(a, b)) / len(a)
    digits = lambda s: "".join(f"{x:07X}" for x in s or [])
    for name, text, made, _ in want:
        own, edit, after = next(samples), next(samples), next(samples)
        r = found[name]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(made.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digits(own), digits(edit))
        assert (r.near_edited, r.near_next) == (pytest.approx(like(own, edit)), pytest.approx(like(own, after)))


def test_repeated_rows_null_ids_and_one_row(spark):
    rows = corpus(4, 30)
    found = cws.edit_likeness(documents(spark, rows)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_chars) for r in found), key=key) == sorted(((r[0], len(r[1] or "")) for r in rows), key=key)
    copies = spark.createDataFrame([(1, "abcdef")] * 3 + [(0, "uvwxyz")], "doc_id long, text string")
    shas = Counter((r.doc_id, r.edited_sha256) for r in cws.edit_likeness(copies).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert shas == {(1, sha("abcdab")): 2, (1, sha("abcduv")): 1, (0, sha("uvwxab")): 1}
    one = cws.edit_likeness(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == [(None, 0, sha(""), "", "", 1.0, 1.0)]
    assert cws.edit_likeness(copies.where("false")).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = cws.fingerprints(docs.withColumn("sha", F.lit(1)), ["doc_id", "sha"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
