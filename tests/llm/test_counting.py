"""Token counts, whitening and collocations against plain versions."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pavement.llm import collocations, tokencount, whitening

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counted(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "'s's''s 's\n's", "don't  you'll we're 'rest 'llx 'l 'r' 'vex\t\tx", "  a  \n\n b \n", "<|endoftext|>a<|endoftext|> <|endoft",
       "aaaa" * 500, "é" * 100 + "  x  y　", "123 45a6'7", "\x1c\x1d x\x85y​z", " " * 300 + "x", "日本語テキスト" * 30,
       "'" * 9 + "s", "a'rb'vec'r", "\x00\x00 \x00", "'re've'll'd'm't's'S'RE", "x" * 5000 + " " + "=" * 3000 + "\t" * 700]


def test_counts_of_odd_texts(library):
    assert tokencount.Tokenizer(PATH).count(ODD).tolist() == counted(library, ODD)


def test_every_character_in_several_places(library):
    texts = [f"a{c}a {c} {c}{c}1{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000, 7)])]
    assert tokencount.Tokenizer(PATH).count(texts).tolist() == counted(library, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(" 'strevmdlx\n\tAé1.,-字"), max_size=60), max_size=8))
def test_counts_of_random_texts(texts):
    assert tokencount.tokenizer(PATH).count(texts).tolist() == counted(Tokenizer.from_file(PATH), texts)


def test_small_tables_and_blocks_give_the_same(monkeypatch, library):
    rng = np.random.default_rng(5)
    texts = ["".join(chr(c) for c in rng.integers(32, 127, 400)) for _ in range(40)] + ["word and words " * 400, "x" * 900]
    for name, value in (("STATES", 50), ("SLOTS", 1 << 14), ("BLOCK", 300), ("CHUNK", 16), ("STEPS", 5)):
        monkeypatch.setattr(tokencount, name, value)
    assert tokencount.Tokenizer(PATH).count(texts).tolist() == counted(library, texts)


def test_splitter_states_compose():
    s = tokencount.Splitter()
    for a in range(len(s.maps)):
        for b in range(len(s.maps)):
            assert s.maps[s.product[a, b]].tolist() == s.maps[b][s.maps[a]].tolist()


def test_token_columns_with_nulls_and_clashing_names(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "naïve  text", None), (2, "word " * 600, "z"), (2, "word " * 600, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _count string")
    df, name = tokencount.token_counts(docs, PATH)
    got = {(r["doc_id"], r["text"]): tuple(r[name]) for r in df.collect()}
    assert got[(1, None)] == got[(2, "")] == (0, 0, False)
    assert got[(None, "naïve  text")][0] == 12
    assert got[(2, "word " * 600)] == (3000, 601, True)
    assert df.count() == 5 and df.limit(0).count() == 0
    assert tokencount.token_counts(docs.limit(0), PATH)[0].count() == 0


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return x, n, s, centred, values, axes


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(700, 6)) * [1, 2, 3, 4, 5, 6] @ rng.normal(size=(6, 6))).tolist()
    bad = [None, [], [None] * 6, [math.nan] + [0.0] * 5, [math.inf] + [0.0] * 5]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(None, vectors[0], "y"), (0, vectors[0], None)] + [(9000 + i, v, "") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(5)
    got = whitening.whitened(df, components=4, block_rows=32).collect()
    x, n, s, centred, values, axes = plain_whitening(vectors + [vectors[0]] * 2)
    assert len(got) == 4 * n == 4 * 702
    plain = centred @ axes[:, :4] / np.sqrt(values[:4])
    sign = {}
    for r in got:
        at = 700 if r["vec_id"] is None else r["vec_id"]
        k = r["component"] - 1
        if abs(plain[at, k]) > 0.1:
            sign.setdefault(k, math.copysign(1, r["whitened"] * plain[at, k]))
        assert math.isclose(r["whitened"], sign.get(k, 1) * plain[at, k], abs_tol=1e-9) or abs(plain[at, k]) <= 0.1
        assert r["deviation"] == int(((n * x[at].astype(object) - s) ** 2).sum()) and r["n"] == n
        assert math.isclose(r["explained"], values[k] / values.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9
    again = spark.createDataFrame(got).groupBy("component").agg(F.avg("whitened").alias("m"), F.avg(F.col("whitened") ** 2).alias("v"))
    assert all(abs(r["m"]) < 1e-9 and abs(r["v"] - 1) < 1e-9 for r in again.collect())


def test_whitening_of_little(spark):
    schema = "vec_id string, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([("a", [1.0, 2.0])] * 9, schema)).count() == 0
    line = whitening.whitened(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 6.0]), (None, [5.0, 10.0])], schema)).collect()
    assert sorted(((r["vec_id"] or "", r["component"]) for r in line)) == [("", 1), ("a", 1), ("b", 1)]
    with pytest.raises(Exception, match="lengths"):
        whitening.whitened(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0])], schema).coalesce(1))


def test_large_deviations_are_exact():
    centre = whitening.Centre(3, [6_000_000_001, 5])
    x = np.array([[4_000_000_000, 2], [0, 2]], "<i8").tobytes()
    assert centre.deviations(x) == [(3 * 4_000_000_000 - 6_000_000_001) ** 2 + 1, 6_000_000_001 ** 2 + 1]


def plain_collocations(docs, support, most, covered=80):
    f, n = Counter(), Counter()
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i:i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= support}
    around = Counter()
    for (lang, p), c in f.items():
        for part in {p[i:j] for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p)}:
            around[(lang, part)] = max(around[(lang, part)], c)
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and 100 * around[(lang, p)] < covered * a:
            cuts = [(2_000_000 * a // (f[(lang, p[:k])] + f[(lang, p[k:])]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[(lang, p[:k])], f[(lang, p[k:])]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, rows in found.items()
                  for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:most], 1))


def test_collocations_against_plain_counts(spark):
    rng = np.random.default_rng(11)
    words = ["New", "York", "city", "the", "of", "é", "a\x1cb", "𝔘", "z"]
    docs = [(str(rng.choice(["en", "de", "fr"])), " ".join(rng.choice(words, rng.integers(0, 40), p=[.2, .2, .1, .1, .1, .1, .1, .05, .05]))
             .replace("the of", "the, of").replace("z é", "z\té  ")) for _ in range(300)]
    docs += [("en", "one common passage of words! one common passage of words\r" * 3)] * 40 + [(None, "no language here. no language")] * 20
    docs += [("en", None), ("en", ""), (None, None), ("es", " ,. "), ("pt", "rare words")]
    df = spark.createDataFrame([(i, lang, text, 1) for i, (lang, text) in enumerate(docs)], "doc_id long, lang string, text string, n int").repartition(7)
    got = sorted(tuple(r) for r in collocations.collocations(df, support=12, most=25).collect())
    expected = plain_collocations(docs, 12, 25)
    assert got == expected and {r[0] for r in got} >= {"en", "und"}


def test_collocations_of_long_texts_and_small_blocks(spark, monkeypatch):
    text = "alpha beta gamma. " * 700 + "delta " * 900
    df = spark.createDataFrame([("en", text), ("en", text)], "lang string, text string")
    expected = plain_collocations([("en", text)] * 2, 30, 2000)
    assert sorted(tuple(r) for r in collocations.collocations(df).collect()) == expected
    pieces = list(collocations._pieces([b"a b. c", b"", b"d"]))
    assert pieces == [[b"a", b"b", b"\xff", b"c", b"\xff", b"\xff", b"d", b"\xff"]]
    monkeypatch.setattr(collocations, "BLOCK", 50)
    cut = [w for words in collocations._pieces([text.encode()] * 2) for w in words if w != b"\xff"]
    assert cut == re.findall(b"[^ .]+", text.encode()) * 2


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_scores_pass_64_bits(spark):
    a = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(a, a, a), (1, 3, 4)], "a long, l long, r long")
    got = df.select(collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r["s"] for r in got] == [1_000_000, 285_714]
