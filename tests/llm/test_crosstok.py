"""Cross-tokenizer alignment against plain loops over tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import crosstok, queries
from tests.llm.cases import corpus, documents
from tests.llm.test_text import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(sides, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text, and the pair counts."""
    from plumbline.llm.bpe import byte_characters

    code = {c: b for b, c in byte_characters().items()}
    found, held = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        a = [(i, bytes(code[c] for c in sides[0].id_to_token(i))) for i in sides[0].encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if sides[1].is_byte(i) else p.replace("▁", " ").encode()) for i in sides[1].encode(text or "") for p in [sides[1].id_to_piece(i)]]
        if not text or any(b"".join(x for _, x in t) != want for t in (a, b)):
            found.append(([], []))
            continue
        a, b = spans(a), spans(b)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [([x[0] for x in a if low <= x[1] < high], [y[0] for y in b if low <= y[1] < high]) for low, high in zip([0, *ends], ends)]
        assert sum(len(g[0]) for g in groups) == len(a) and sum(len(g[1]) for g in groups) == len(b)
        found.append((links, groups))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    rows = []
    for links, groups in found:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links),
                     sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), text))
    return rows, held


def short_corpus():
    rng = random.Random(11)
    rows = [(i, t if t is None or len(t) < 900 else t[:900], *rest) for i, t, *rest in corpus(9, 40)]
    rows += [(1000 + i, "".join(rng.choice(ODD + "▁<s>") for _ in range(rng.randrange(1, 25))), "", "") for i in range(150)]
    return rows + [(2000, "a▁b", "", ""), (2001, "x<|endoftext|>y</s><s>", "", ""), (2002, " ", "", ""), (2003, "x " * 200, "", "")]


@pytest.mark.parametrize(("radix", "run_bytes", "block"), [(64, 48 << 20, 6 << 20), (3, 1500, 4000)])
def test_equals_plain_loops(spark, sides, radix, run_bytes, block):
    """With small blocks and tasks too, so that one radix is merged by several tasks."""
    rows = short_corpus()
    aligned, counts = crosstok.cross_align(documents(spark, rows), *PATHS, "doc_id", "text", "place", radix=radix, run_bytes=run_bytes, block_bytes=block)
    want, held = brute(sides, [r[1] for r in rows])
    found = [((r.doc_id, r.text), tuple(r)[3:]) for r in aligned.collect()]
    key = lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1] or "")
    assert sorted(found, key=key) == sorted((((r[0], r[1]), w) for r, w in zip(rows, want)), key=key)
    assert {(r.a, r.b): r.n for r in counts.collect()} == held


def test_digest_and_empty_table(spark):
    rows = [(1, "alpha beta"), (2, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.groups for r in crosstok.cross_align(docs, *PATHS, "doc_id")[0].collect()}
    digest = {r.doc_id: r.groups for r in crosstok.cross_align(docs, *PATHS, "doc_id", digest=True)[0].collect()}
    assert digest == {1: hashlib.sha256(plain[1].encode()).hexdigest(), 2: "", 3: ""}
    aligned, counts = crosstok.cross_align(docs.where("false"), *PATHS, "doc_id")
    assert aligned.count() == counts.count() == 0


def test_long_texts_have_the_ids_of_the_library(sides, monkeypatch):
    known, rng = crosstok.ByteLevel(PATHS[0]), random.Random(2)
    for text in ("ab " * 2000, " " * 3000, "".join(rng.choice(ODD) for _ in range(3000))):
        want = sides[0].encode(text, add_special_tokens=False).ids
        assert known.encode(text).tolist() == want
        monkeypatch.setattr(crosstok, "LONG", 10)
        assert known.encode(text).tolist() == want
        monkeypatch.undo()


def test_runs_merge_in_chunks(sides, monkeypatch):
    monkeypatch.setattr(crosstok, "CHUNK", 7)
    texts = [r[1] for r in short_corpus()][:60]
    known = crosstok.aligner(*PATHS)
    runs = [list(known.block(texts[i : i + 9]).runs(2)) for i in range(0, len(texts), 9)]
    found = [list(crosstok.merged_counts([h for rows in runs for r, h, _ in rows if r == part])) for part in (0, 1)]
    assert all(x == sorted(x) for x in found) and {(p >> 32, p & 0xFFFFFFFF): n for x in found for p, n in x} == brute(sides, texts)[1]
    assert all((p >> 32) % 2 == part for part in (0, 1) for p, _ in found[part])


def test_packed_columns_come_back():
    for n in (0, 1, 1000):
        x, y = np.arange(n) * 7 - 3, np.arange(n)[::-1].copy()
        assert [c.tolist() for c in crosstok.unpacked(crosstok.packed(x, y), 2)] == [x.tolist(), y.tolist()]


def test_query_columns(spark, sf_dir):
    found = queries.op12(spark, sf_dir)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
