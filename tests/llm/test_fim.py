"""Fill-in-middle against a plain reading of its rules."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fim
from tests.llm.cases import corpus, documents

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(name, text):
    """(n, form, prefix_chars, middle_chars, output), token by token."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{name}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    spm = h[3] % 100 < 80
    return len(tokens), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_equals_the_rules(spark):
    rng = random.Random(5)
    odd = [" ", "\t", "\n", "\x1c", "\x85", "\xa0", "a", "É", "漢", "😀", "<", "P>", "<P", "S>", "<M>"]
    rows = corpus(3) + [(500 + i, "".join(rng.choice(odd) for _ in range(rng.randrange(40))), None, None) for i in range(400)]
    rows += [(900, "word " * 60_000, "", ""), (901, " " * 70_000, "", ""), (902, "x" * 70_000, "", "")]
    done = fim.fill_in_middle(documents(spark, rows), "doc_id", "text", "size", "place")
    back = fim.restore(done.withColumn("held", F.col("output")), "doc_id", "text", "size", "n", "form", "prefix_chars", "middle_chars", "held").collect()
    assert len(back) == len(rows) and {r.form for r in back} == {"plain", "psm", "spm"}
    for r in back:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.held) == plain("" if r.doc_id is None else r.doc_id, r.text), repr(r.text)
        assert r.restored == (r.text or "") and r.size == "x"


def test_empty_table(spark):
    assert fim.restore(fim.fill_in_middle(documents(spark, []), "doc_id"), "form").count() == 0


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_skip_list_reaches_every_rank(fan):
    rng = np.random.default_rng(1)
    for n in (0, 1, fan, fan + 1, fan**2, fan**2 + 1, 500):
        widths = rng.integers(1, 9, n)
        lanes = fim.SkipList(widths, fan)
        assert [lanes.offset(r) for r in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
        assert all(len(x) <= fan for x in lanes.units[-1:]) and [int(u.sum()) for u in lanes.units] == [n] * len(lanes.units)
        with pytest.raises(IndexError):
            lanes.offset(n + 1)
