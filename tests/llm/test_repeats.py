"""Repeated strings against a plain search over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np

from pavement.llm import repeats


def plain(texts):
    data = [(t or "").encode() for t in texts]
    n = repeats.LENGTH
    times = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        hit = np.zeros(len(d) + 1, np.int8)
        for i in range(len(d) - n + 1):
            if times[d[i:i + n]] > 1:
                hit[i:i + n] = 1
        runs = int((np.diff(np.concatenate(([0], hit))) == 1).sum())
        kept = bytes(b for b, h in zip(d, hit) if not h)
        out.append((len(d), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("aeiouéñstrnl") for _ in range(draw.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(draw.randrange(40, 160)) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = [prose(draw.randrange(0, 60)) for _ in range(draw.randrange(1, 4))]
        for _ in range(draw.randrange(0, 3)):
            s = draw.choice(shared)
            a = draw.randrange(0, len(s) // 3)
            parts.insert(draw.randrange(len(parts) + 1), draw.choice([s, s[a:], s[:len(s) - a], s[a:a + 420]]))
        texts.append(draw.choice(["", " ", "\n"]).join(parts))
    long_ = prose(900)
    for _ in range(6):  # near copies: edits at a few places
        words = long_.split(" ")
        for _ in range(draw.randrange(1, 9)):
            words[draw.randrange(len(words))] = word()
        texts.append(" ".join(words[draw.randrange(0, 5):]))
    texts += [texts[0], texts[0], texts[3], None, "", "x" * 399, "y" * 400, "y" * 401, "z" * 3000, "ab" * 700, "abc" * 500 + "d", long_[:400], long_[100:500]]
    texts += [shared[0][:400], "Q" + shared[0][:400], shared[0][:401] + "Z", ("é" * 300) + "t"]
    return texts


def test_against_all_windows(spark):
    texts = corpus()
    rows = [(i, t, "n") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(5)
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.repeats(df).collect()}
    want = plain(texts)
    assert sum(w[1] > 0 for w in want) > 20
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i][:40] if texts[i] else texts[i])


def test_nothing_to_remove(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (1, "short")], "doc_id long, text string")
    assert [r.n_removed for r in repeats.repeats(df).collect()] == [0, 0, 0]
    assert repeats.repeats(df.limit(0)).count() == 0


def test_triggers_are_local():
    draw = random.Random(2)
    body = bytes(draw.randrange(97, 110) for _ in range(2000))
    for width in (32, 180):
        inner = set((repeats.triggers(body, width)).tolist())
        around = repeats.triggers(b"x" * 77 + body + b"y" * 50, width) - 77
        edge = width - 1
        assert {t for t in inner if edge <= t < 2000 - edge - 8} == {t for t in around.tolist() if edge <= t < 2000 - edge - 8}
