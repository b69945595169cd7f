"""Source divergence: term packing and exact shares against brute force."""

import collections
import random
import re

import numpy as np
import pytest

from tarn.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, least=10, top=10):
    docs, groups = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        found = terms(text)
        groups[lang or "", source or ""].update(found)
        docs.update((lang or "", t) for t in set(found))
    out = []
    for lang in {k[0] for k in groups}:
        kept = [t for (g, t), n in docs.items() if g == lang and n >= least]
        share = {}
        for name in [s for g, s in groups if g == lang] + [None]:
            n = collections.Counter()
            for (g, s), c in groups.items():
                if g == lang and name in (s, None):
                    n.update({t: c[t] for t in kept})
            size = sum(n.values()) + 2 * len(kept)
            share[name] = n, {t: 1 + 10**9 * (n[t] + 2) // size for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, (n, p) in share.items():
            if s is None:
                continue
            pair = [(sum(f(p[t], q[t]) for t in kept), o) for o, (_, q) in share.items() if o not in (s, None)]
            term = [(f(p[t], share[None][1][t]), t) for t in kept if n[t] and p[t] > share[None][1][t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked[:most], 1)]
    return sorted(out)


def made(n, rnd):
    words = ["a", "the", "Water", "WATER", "exactly8", "ninechars", "sixteenletterstr", "seventeenletterst", "é", "日本語日本語", "x" * 5000, "ſ", "K", "don't", "a_b", "q1w2"]
    rows = [(" ".join(rnd.choices(words, k=rnd.choice([0, 1, 5, 60]))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "S1", "é", None, "z"])) for _ in range(n)]
    return rows + [(None, "fr", "alone"), ("few words", "it", "one"), ("few", "it", "two"), ("", "en", "no terms"), ("é" * 100_000 + " " + "tail", "en", "s1")]


@pytest.mark.parametrize("block", [2, 256])
def test_audit(spark, block):
    rows = made(400, random.Random(5)) * 2
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(7)
    assert sorted(tuple(r) for r in divergence.audit(df, block=block).collect()) == brute(rows)
    assert divergence.audit(df.limit(0)).collect() == []


def test_audit_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 100)
    text = "one two three four five " * 9
    data, offsets = np.frombuffer((text * 3).encode(), dtype=np.uint8), np.array([0, len(text), len(text), 2 * len(text), 3 * len(text)])
    found = {}
    for g, names, n, docs in divergence._chunk(data, offsets, np.array([0, 0, 1, 1])):
        found |= {(int(k), t): (int(a), int(b)) for k, t, a, b in zip(g, names.to_pylist(), n, docs, strict=True)}
    assert found == {(g, t): (9 * (g + 1), g + 1) for g in (0, 1) for t in ("one", "two", "three", "four", "five")}


def test_radix_order_sorts_as_bytes_do():
    rnd = random.Random(2)
    some = [bytes(rnd.choice(b"az\x80\xff") for _ in range(rnd.randint(1, 16))) for _ in range(3000)]
    data = np.frombuffer(b"".join(some) + bytes(16), dtype=np.uint8)
    size = np.array([len(s) for s in some])
    start = np.cumsum(size) - size
    order = divergence.radix_order(divergence._words(data, start, size, 2))
    assert order.tolist() == sorted(range(len(some)), key=lambda k: some[k])


def test_shares_are_exact_beyond_longs():
    n = np.array([0, 7, 3 * 10**12], dtype=np.int64)
    assert divergence.shares(n, 4 * 10**12 + 1).tolist() == [1 + 10**9 * (k + 2) // (4 * 10**12 + 1) for k in n.tolist()]
    assert divergence.shares(n[:2], 100).tolist() == [1 + 10**9 * (k + 2) // 100 for k in (0, 7)]
