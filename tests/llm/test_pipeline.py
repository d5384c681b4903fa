"""The registered queries against SQL, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import random
import time

import pytest

import corpus_pipeline
from plumbline.llm import bpe, minhash, queries
from tests.compare import compare_df, duck
from tests.llm.cases import corpus, sentence
from tests.llm.test_dedup import lines, near


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, message, rows, *_ = compare_df(con, queries.QUERIES[name](spark, sf_dir), queries.ORACLE.get(name), time.time())
    assert ok and rows, message


def frame(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_follow_brute_force(spark, sf_dir):
    docs = frame(spark, corpus(12, 40))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in docs.collect()} - {(r.doc_id, r.text) for r in kept.collect()} >= {r[:2] for r in corpus(12, 40) if not (r[1] or "").strip()}
    rows = [r for r in corpus(12, 40)]
    left = stages["line_dedup"](spark, docs, sf_dir).collect()
    assert sorted(((r.doc_id, r.text or "") for r in left), key=str) == sorted(((a, b) for a, b, *_ in lines(rows, 10)), key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left)
    unique = stages["near_dedup"](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in unique} == {r[0] for r in near(rows) if r[3]}
    clean = stages["decontaminate"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    tokens = stages["bpe_tokens"](spark, docs, sf_dir).collect()
    assert len(tokens) == len(rows) and all(len(r.ids) == 4 * r.n_tokens for r in tokens)


def test_whole_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len({r.doc_id for r in rows}) == len(rows)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_empty_table(spark, sf_dir):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_near_dedup_takes_pairs_from_80_percent_on(spark, sf_dir):
    """Pairs at 0.77 to 0.88: 40 to 80 shingles of which a changed word takes five."""
    rng, rows = random.Random(9), []
    for i in range(40):
        words = sentence(rng, 44 + i).split(" ")
        rows += [(2 * i, " ".join(words), "en", "s"), (2 * i + 1, " ".join([*words[:20], "changed", *words[21:]]), "en", "s")]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), sf_dir).collect()}
    assert kept == {r[0] for r in near(rows, 80) if r[3]} < {r[0] for r in near(rows, 85) if r[3]}
    assert [minhash.matches(p) for p in (85, 80)] == [40, 35] and minhash.matches(100) == minhash.COORDINATES


def test_near_dedup_keeps_one_row_of_each_group(spark, sf_dir):
    """Repeated rows, groups of null ids and different near-alike texts under one id leave one row each."""
    rng = random.Random(4)
    text, other, third = (sentence(rng, 100) for _ in range(3))
    rows = [(i, sentence(rng, 30), "en", "s") for i in range(10)]
    rows += [(None, text, "en", "s"), (None, text, "fr", "s"), (None, text + " more", "en", "s")]
    rows += [(20, other, "en", "s"), (20, other + " more", "en", "s"), (20, "before " + other, "en", "s"), (None, other, "en", "s")]
    rows += [(None, third, "en", "s"), (31, third, "en", "s"), (40, "", "en", "s"), (41, None, "en", "s")]
    found = corpus_pipeline.near_dedup(spark, frame(spark, rows + rows), sf_dir).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted([*range(10), None, 20, 31, 40, 41], key=str)
    assert all((r.doc_id, r.text) in {x[:2] for x in rows} and (r.n_chars is None) == (r.text is None) for r in found)


def test_tokens_are_decoded_again(spark, sf_dir):
    rows = corpus_pipeline.tokens(spark, frame(spark, corpus(12, 20)), sf_dir).collect()
    known = bpe.vocabulary(queries.tokenizer_path())
    assert rows and all(r.decoded_sha256 == hashlib.sha256(known.decode(r.ids).encode()).hexdigest() for r in rows)
