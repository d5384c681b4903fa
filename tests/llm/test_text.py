"""BPE, language ID, decontamination and sharding."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontam, kdshards, langid, queries
from plumbline.llm.wordhash import WordHashes
from tests.llm.cases import corpus, documents, sentence

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "aAbZ'sStTΣςσİıßÀȩ́́ \n\t\x1c\x1f\x85\xa0​ 　0١½Ⅷ漢字한가ﬁ😀🏽‍_-|<>%$#@!.,\x00\x07힣ǅẞΌ"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, library):
    rng = random.Random(3)
    rows = corpus(7) + [(1000 + i, "".join(rng.choice(ODD) for _ in range(rng.randrange(20))), "", "") for i in range(500)]
    rows += [(2000, "x<|endoftext|>y <|startoftext|><|endoftext", "", ""), (2001, "ab" * 5000, "", ""), (2002, "word " * 3000, "", "")]
    encoded = bpe.encode(documents(spark, rows), PATH, "text", "lang").withColumn("tokens", F.col("ids"))
    found = bpe.decode(encoded, PATH, "text", "tokens").collect()
    assert len(found) == len(rows)
    for r in found:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.tokens, "<u4").tolist() == want, repr(r.text)
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_forced_boundaries_lose_nothing(library):
    known = bpe.Vocabulary(PATH)
    for word in ("zebra", "日本語テキスト", "naïve", "qzxqj", "ab" * 100):
        parts = known.fragments_of(word.encode())
        assert b"".join(parts) == word.encode()
        assert known.fragment((word.encode(), True)) == known.word(word) == known.merge_queued([known.starts[b] for b in word.encode()[:-1]] + [known.ends[word.encode()[-1]]])
    assert len(known.fragments_of("日本語テキスト".encode())) > 1


def test_language_is_told_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op5(spark, sf_dir).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and len(r.text) > 200]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_of_odd_texts(spark):
    rows = corpus(8)
    docs = documents(spark, rows)
    languages = langid.fit(docs.select("text", "lang"))
    assert set(languages.content) == {"en", "fr"}
    found = langid.predict(docs, languages, "doc_id", "text", "k1").collect()
    assert len(found) == len(rows)
    for r in found:
        blank = not re.search(r"[^\W\d_]", r.text or "")
        assert (r.lang_pred == "und") == blank and (not blank or r.rejected)
    assert langid.predict(documents(spark, []), languages, "doc_id").count() == 0
    unlearned = langid.predict(docs, langid.fit(docs.where("false").select("text", "lang")), "doc_id").collect()
    assert {r.lang_pred for r in unlearned} == {"und"}


def test_narrow_margins_are_rejected():
    text = sentence(random.Random(1), 400).encode()
    same = langid.Classifier(langid.Languages({"a": text, "b": text}))
    assert same.predict(text) == ("a", 0.0, True)
    apart = langid.Classifier(langid.Languages({"a": text, "b": b"nothing like it " * 20}))
    assert apart.predict(text)[0] == "a" and not apart.predict(text)[2] and apart.predict(b"") == ("und", 0.0, True)


def test_one_margin_rule_for_texts_of_every_length():
    text = sentence(random.Random(1), 400).encode()
    same = langid.Classifier(langid.Languages({"a": text, "b": text}))
    for size in (1, 30, 199, 200, 2000):
        assert same.predict(text[:size]) == ("a", 0.0, True)


def plain_sizes(content, text):
    """Bytes of a text under one dictionary, every block by a compressor of its own."""
    data = zstandard.ZstdCompressionDict(content.ljust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=langid.LEVEL)
    pack = lambda b: zstandard.ZstdCompressor(
        level=langid.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
    ).compress(b)
    return sum(len(pack(text[i : i + langid.BLOCK])) for i in range(0, len(text), langid.BLOCK))


def test_languages_equal_brute_force_compression(spark):
    """The fewest bytes decide, also for texts of several blocks; the fit takes the text of the least hash in each bucket."""
    rng = random.Random(9)
    speech = {x: [f"{x}{sentence(rng, 3)[::step]}" for _ in range(40)] for x, step in (("en", 1), ("fr", -1), ("de", 2))}
    speak = lambda x, n: " ".join(rng.choice(speech[x]) for _ in range(n))
    rows = [(i, speak(x, n), x, "s") for i, (x, n) in enumerate((x, n) for n in (1, 2, 5, 20, 60) for x in speech for _ in range(4))]
    rows += [(100 + i, speak(x, 40000), x, "s") for i, x in enumerate(speech)]
    rows += [(200 + i, rows[5][1], rows[5][2], "s") for i in range(30)]
    assert all(len(r[1].encode()) > 2 * langid.BLOCK for r in rows[60:63])
    docs = documents(spark, rows)
    languages = langid.fit(docs.where("length(text) < 200000").select("text", "lang"), samples=8, sample_chars=300)
    hashed = docs.where("length(text) < 200000").selectExpr(
        "lang", "xxhash64(text) AS h", "pmod(xxhash64(text, 1), 8) AS bucket", r"trim(regexp_replace(lower(text), '[^\\p{L}\\p{M}]+', ' ')) AS t"
    ).collect()
    least = {}
    for r in hashed:
        least[r.lang, r.bucket] = min(least.get((r.lang, r.bucket), (r.h, r.t)), (r.h, r.t))
    assert languages.content == {x: "\n".join(t[:300] for _, t in sorted(v for k, v in least.items() if k[0] == x)).encode() for x in speech}
    assert next(iter(languages.content)) == rows[5][2]
    order = list(languages.content)
    for r in langid.predict(docs, languages, "doc_id", "text").withColumn("letters", langid.letters(F.col("text"))).collect():
        sizes = [plain_sizes(languages.content[x], r.letters.encode()) for x in order]
        first, second = sorted(sizes)[:2]
        assert r.lang_pred == order[sizes.index(first)] and abs(r.score - (1 - first / second)) < 1e-12
        assert r.rejected == (1 - first / second < langid.MIN_MARGIN)


def words(text):
    return re.findall(r"\w+", text.lower())


def similarity(a, b):
    """Weighted Jaccard of the shingles of two word lists of equal length."""
    span = min(5, len(a))
    x, y = (Counter(tuple(w[i : i + span]) for i in range(len(w) - span + 1)) for w in (a, b))
    shared = (x & y).total()
    return shared / (x.total() + y.total() - shared)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, n)) for i, n in enumerate([3, 8, 12, 20, 30, 45, 60])] + [(7, None), (8, ""), (None, sentence(rng, 15))]
    docs = []
    for i in range(120):
        around = [words(sentence(rng, rng.randrange(40))) for _ in range(2)]
        body = []
        if i % 2:
            body = words(rng.choice([t for _, t in items if t]))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                body[rng.randrange(len(body))] = "other"
        joined = around[0] + body + around[1]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w.title() if i % 3 else w for w in joined), "", ""))
    docs += [(500, None, "", ""), (501, "", "", ""), docs[1], docs[1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks(documents(spark, docs), benchmark, "doc_id", "text").collect()
    want = []
    for d, text, *_ in docs:
        best = {}
        for item, t in items:
            w, v = words(t or ""), words(text or "")
            s = max((similarity(v[j : j + len(w)], w) for j in range(len(v) - len(w) + 1)), default=0) if w else 0
            if s >= 0.8:
                best[str(item) if item is not None else "none"] = s
        if best:
            want.append((d, sorted(best), round(max(best.values()), 9)))
    assert sorted((r.doc_id, r["items"], round(r.best_similarity, 9)) for r in found) == sorted(want) and want


def test_fingerprint_index_finds_everything_within_the_radius():
    rng = np.random.default_rng(0)
    for distance in range(decontam.RADIUS + 1):
        a = rng.integers(0, 256, decontam.BLOCKS, dtype=np.uint8)
        bits = np.unpackbits(a)
        bits[rng.choice(64, distance, replace=False)] ^= 1
        b = np.packbits(bits)
        assert any(decontam.NEAR[a[k], b[k]] for k in range(decontam.BLOCKS))


def test_benchmark_in_blocks(spark):
    items = [(i, sentence(random.Random(i), 20)) for i in range(40)]
    blocks = list(decontam.benchmark_blocks(spark.createDataFrame(items, "item_id long, text string"), 500))
    assert len(blocks) > 3 and sorted(x for b in blocks for x in b) == sorted((str(i), t) for i, t in items)
    nothing = decontam.leaks(documents(spark, corpus(1)), spark.createDataFrame([], "item_id long, text string"), "doc_id")
    assert nothing.count() == 0 and decontam.leaks(documents(spark, []), spark.createDataFrame(items, "item_id long, text string"), "doc_id").count() == 0


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    hashes = WordHashes(b" \t\n\x0b\x0c\r")
    text = ("Some words of DIFFERENT length " * 300 + "x" * 5000 + " end").encode()
    whole = hashes(text)
    assert len(whole) == len(text.split()) and (whole == np.array([hashes(w)[0] for w in text.lower().split()])).all()
    monkeypatch.setattr("plumbline.llm.wordhash.PIECE", 1000)
    assert (hashes(text) == whole).all() and len(hashes(b"")) == len(hashes(b" \n ")) == 0


def check_shards(found, rows, shards, slack):
    assert Counter((r.doc_id, r.text_crc32) for r in found) == Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)
    assert all(r["size"] == len(t) + 16 for r in found for t in [next((x[1] or "").encode() for x in rows if x[0] == r.doc_id and zlib.crc32((x[1] or "").encode()) == r.text_crc32)])
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    sizes = [sum(r["size"] for r in m) for m in by.values()]
    assert max(sizes) - min(sizes) <= slack


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_shards_of_near_equal_bytes(spark, shards):
    rows = [r for r in corpus(10, 200) if len(r[1] or "") < 3000]
    found = kdshards.kd_shards(documents(spark, rows), shards).collect()
    check_shards(found, rows, shards, 8000)


def test_one_point_is_split_too(spark):
    rows = [(i, "the same text", "en", "src0") for i in range(400)]
    check_shards(kdshards.kd_shards(documents(spark, rows), 8).collect(), rows, 8, 29 * 4)
    assert kdshards.kd_shards(documents(spark, rows), None, 29 * 100).select("shard").distinct().count() == 4
    assert kdshards.kd_shards(documents(spark, []), 4).count() == 0


def test_tree_cuts_along_the_widest_dimension(spark):
    rows = kdshards._scaled(spark.createDataFrame([(1, 10, i * 1234567, float(i % 2), float(i)) for i in range(100)], "doc_id long, size long, tie long, d0 double, d1 double"), ["d0", "d1"])
    tree = kdshards.grow(rows.where(F.element_at("coordinates", 1) < (1 << 40)), 4, 2)
    assert tree.dim[1] == 2 and len(tree.leaves()) == 4
