"""Packing into windows of several lengths: every id once, no padding, most rests whole."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import packing, tiers


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(got, rows, tokenizer, windows):
    """Pieces are the documents' ids, each once; sequences are gapless and as long as a window, or a smaller power of two."""
    found = got.collect()
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
        assert len(ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        of_doc[r.doc_id, r.doc_tokens].append((r.start, ids))
        of_seq[r.sequence_id].append((r.offset, r.length, r.sequence_length, r.step_group))
    want = defaultdict(list)
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids)].append(ids)
    assert set(of_doc) == set(want)
    for k, parts in of_doc.items():
        if len(want[k]) == 1:
            parts.sort()
            assert [i for _, p in parts for i in p] == want[k][0]
            assert all(a[0] + len(a[1]) == b[0] for a, b in zip(parts, parts[1:]))
        else:
            assert sum(len(p) for _, p in parts) == sum(map(len, want[k]))
    groups, small = defaultdict(lambda: defaultdict(int)), 0
    for parts in of_seq.values():
        parts.sort()
        at = 0
        for offset, length, size, group in parts:
            assert offset == at and (size, group) == parts[0][2:]
            at += length
        assert at == parts[0][2] and at & (at - 1) == 0
        small += at if at < windows[-1] else 0
        groups[parts[0][3]][at] += 1
    assert small < windows[0]
    totals = [sum(k * n for k, n in g.items()) for g in groups.values()]
    assert not totals or max(totals) - min(totals) < 2 * windows[0]
    return found


def made(n, rnd, sizes):
    words = ["alpha", "Beta!", "<|endoftext|>", "ñandú", "\n", "日本", "x"]
    return [(i, " ".join(rnd.choices(words, k=rnd.choice(sizes)))) for i in range(n)]


@pytest.mark.parametrize("sizes", [[0, 3, 9, 40, 90, 300], [20, 21], [1], [60], [2000], [14, 15, 30]])
def test_pack_tiers(spark, tokenizer, sizes, monkeypatch):
    monkeypatch.setattr(tiers, "STRETCH", 100)
    rows = made(150, random.Random(4), sizes) + [(990, None), (None, "no id"), (991, "")]
    df = spark.createDataFrame([(t, d, 1, 2) for d, t in rows], "text string, doc_id long, length int, key int").repartition(3)
    got = tiers.pack_tiers(df, (64, 32, 16), added=packing.added_tokens(), step=300, keep_ids=True)
    check(got, rows, tokenizer, (64, 32, 16))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group", "ids"]


def test_repeated_rows_one_tier_and_nothing(spark, tokenizer):
    rows = made(40, random.Random(6), [0, 5, 30]) * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(tiers.pack_tiers(df, (64,), added=packing.added_tokens(), keep_ids=True), rows, tokenizer, (64,))
    assert tiers.pack_tiers(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        tiers.pack_tiers(df, (64, 48))


def test_most_rests_are_whole(spark):
    rnd = random.Random(1)
    lengths = [min(2048, int(rnd.lognormvariate(5.5, 1.1)) + 1) for _ in range(20_000)]
    slim = spark.createDataFrame(list(enumerate(lengths)), "key long, length long")
    pieces, seqs = tiers.place(slim)
    per = pieces.groupBy("key").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    assert sorted((r.key, r.length) for r in per.collect()) == list(enumerate(lengths))
    assert per.filter("n = 1").count() > 0.75 * len(lengths)
    assert seqs.agg(F.sum("size")).first()[0] == sum(lengths)


def test_running(spark):
    rows = spark.createDataFrame([(k, k % 7 + 1, k % 3) for k in range(500)], "key long, v long, g long")
    for across in (False, True):
        got = tiers.running(rows, "v", "g", across).collect()
        for g in [None] if across else range(3):
            some = sorted((r for r in got if g in (None, r.g)), key=lambda r: r["at"])
            total = 0
            assert [r["at"] for r in some] == list(range(len(some)))
            for r in some:
                assert r.before == total
                total += r.v
        if across:
            assert [r.g for r in some] == sorted((r.g for r in some), reverse=True)
