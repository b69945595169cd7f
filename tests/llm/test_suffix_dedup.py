"""Repeat removal against a dictionary of all strings, and the run index against plain sorting."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.llm.rindex import RunIndex, first_owners, suffix_order
from tarn.llm.suffix_dedup import remove_repeats


def brute(rows):
    owner = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            k = b[p:p + 50]
            owner[k] = min(owner.get(k, i), i, key=lambda x: (x is None, x))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if owner[b[p:p + 50]] != i:
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(t, i, "x", b"y") for i, t in rows], "text string, doc_id long, block string, kept binary")
    got = remove_repeats(df.repartition(3), **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    return sorted(((*r[:5], bytes(r[5])) for r in got), key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    passages = [" ".join(rnd.choices(words, k=30)) for _ in range(6)]
    phrase = "the very frequent phrase"  # in different surroundings
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 8)):
            kind = rnd.random()
            parts.append(rnd.choice(passages) if kind < 0.3 else phrase if kind < 0.5 else "ab" * rnd.randint(1, 80) if kind < 0.55 else " ".join(rnd.choices(words, k=12)))
        rows.append((i, " ".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x" * 49), (n + 3, "x" * 50), (n + 4, "x" * 120), (None, passages[0] + phrase), (None, passages[0]), (7, passages[1]), (7, passages[1])]
    return rows


@pytest.mark.parametrize("seed,range_bytes,scatter", [(1, 1 << 20, 1000), (2, 2000, 1000), (3, 700, 2), (4, 1500, 4)])
def test_same_bytes_as_brute_force(spark, seed, range_bytes, scatter):
    rows = corpus(seed)
    assert found(spark, rows, range_bytes=range_bytes, scatter=scatter) == brute(rows)


def test_long_texts_are_read_in_slices(spark):
    rnd = random.Random(5)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(1, long[1_000_000:1_100_000]), (2, long), (3, "z" * 5000), (4, "q" + "z" * 30_000)]
    got = found(spark, rows)
    by = {r[0]: r for r in got}
    assert by[1][2] == 0 and by[2][2:4] == (100_000, 1) and by[2][5].decode() == long[:1_000_000] + long[1_100_000:]
    assert by[3][2] == 0 and by[4][5] == b"q"


def test_no_rows(spark):
    assert found(spark, []) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=20).map(lambda b: bytes(x % 3 * 127 for x in b)), st.integers(0, 9)), min_size=1, max_size=10), st.integers(1, 6))
def test_run_index(strings, depth):
    data = np.frombuffer(b"".join(s for s, _ in strings), dtype=np.uint8)
    size = np.array([len(s) for s, _ in strings])
    start = np.cumsum(size) - size
    assert suffix_order(data, size).tolist() == [x[2] for x in sorted((s[i:], k, start[k] + i) for k, (s, _) in enumerate(strings) for i in range(len(s)))]
    best = {}
    for s, o in strings:
        for i in range(len(s) - depth + 1):
            best[s[i:i + depth]] = min(best.get(s[i:i + depth], o), o)
    want = [best.get(s[i:i + depth]) if i + depth <= len(s) else np.iinfo(np.int64).max for s, _ in strings for i in range(len(s))]
    assert first_owners(data, size, np.array([o for _, o in strings]), depth).tolist() == want


def test_repetitive_strings_have_few_runs():
    base = np.random.default_rng(1).integers(97, 123, 400).astype(np.uint8)
    index = RunIndex(np.tile(base, 100), np.full(100, 400), 50)
    assert len(index.head) < 1000 < index.rows


def test_a_long_string_does_not_have_all_others_sorted_again(monkeypatch):
    rnd = np.random.default_rng(2)
    one = rnd.integers(97, 123, 60)
    size = np.array([60] * 100 + [8000])
    data = np.concatenate([one] * 100 + [rnd.integers(97, 123, 8000)]).astype(np.uint8)
    plain, places = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda a, *x, **y: places.append(len(a)) or plain(a, *x, **y))
    order = suffix_order(data, size)
    assert sum(places) < 4 * len(data)
    text, string = data.tobytes(), np.repeat(np.arange(101), size)
    ends = np.cumsum(size)[string]
    assert order.tolist() == sorted(range(len(data)), key=lambda i: (text[i:ends[i]], string[i]))
