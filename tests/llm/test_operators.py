"""The other corpus operators: hand cases, brute force and round trips; nulls, empties, ties and clashing names."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, fingerprint, language, licences, mixing, packing, url_filter, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- exact dedup

TEXTS = [(1, "Same"), (2, "same"), (3, "sÉme"), (4, "séme"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000), (2, "same"), (None, "SAME"), (None, "alone"), (9, "other")]


def brute_groups(rows):
    by = {}
    for d, t in rows:
        by.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for d, t in rows:
        norm = (t or "").translate(LOWER)
        keep = max((x for x in by[norm] if x is not None), default=None)
        out.append((d, keep, len(by[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [None, lambda c: c.substr(1, 1), lambda c: c.substr(1, 0)])
def test_exact_groups(spark, digest):
    df = spark.createDataFrame([(t, d, "n", 5) for d, t in TEXTS * 3], "text string, doc_id long, norm string, salt int").repartition(5)
    assert rows_of(exact_dedup.exact_groups(df, salts=2, digest=digest)) == brute_groups(TEXTS * 3)


def test_exact_keeps_rows(spark):
    df = spark.createDataFrame([(t, d, "n") for d, t in TEXTS[:-4]], "text string, doc_id long, gone_ string")
    assert sorted(r.doc_id for r in exact_dedup.keep_one(df).collect()) == [2, 3, 4, 6, 8]
    assert exact_dedup.exact_groups(df.limit(0)).collect() == []


# ---- fingerprints

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances():
    rnd = random.Random(1)
    pairs = [tuple("".join(rnd.choice("ABC+") for _ in range(rnd.randint(0, 64))) for _ in range(2)) for _ in range(200)]
    assert fingerprint.edit_distances(pairs).tolist() == [distance(*p) for p in pairs]


def test_edited_fingerprints(spark, monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(fingerprint, "BLOCK_BYTES", 4000)
    rows = [(i, "".join(rnd.choice("abcdé fgh") for _ in range(rnd.randint(0, 900)))) for i in range(40)] + [(50, None), (51, ""), (None, "a null id"), (7, "again")]
    df = spark.createDataFrame([(t, d, True, 1) for d, t in rows], "text string, doc_id long, halo boolean, block int").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        h = len(t) // 2
        e = t[:len(t) - h] + u[:h]
        p, q, r = map(fingerprint.fingerprint, (t, e, u))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, float(fingerprint.likeness([(p, q)])[0]), float(fingerprint.likeness([(p, r)])[0])))
    got = rows_of(fingerprint.edited_fingerprints(df))
    assert got == sorted(want, key=str)
    assert fingerprint.edited_fingerprints(df.limit(0)).collect() == []
    plain = {(r[0], r[1], r[2]) for r in rows_of(fingerprint.fingerprints(df))}
    assert plain == {(w[0], w[1], w[3]) for w in want}


def test_fingerprints_tell_edits_from_strangers():
    rnd = random.Random(3)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    near, far = [], []
    for _ in range(40):
        a, b = text(400), text(400)
        w = a.split()
        w[200] = "edited"
        near.append((fingerprint.fingerprint(a), fingerprint.fingerprint(" ".join(w))))
        far.append((fingerprint.fingerprint(a), fingerprint.fingerprint(b)))
    assert fingerprint.likeness(near).min() > 0.8 and fingerprint.likeness(far).max() < 0.2


def test_block_sizes_are_halved_until_signatures_are_long():
    rnd = random.Random(9)
    some = lambda n: "".join(rnd.choice("abcdefghijklmnop \n") for _ in range(n))
    for _ in range(30):  # 50 different windows in 5000 bytes: most have no trigger at the first block size, 192
        assert len(fingerprint.fingerprint((some(49) + "\n") * 100).split(":")[1]) >= fingerprint.AIM // 2
    for n in (1, 20, 100, 143, 145, 1000, 5000, 40_000):
        for text in (some(n), "x" * n, (some(9) * n)[:n]):
            size, one, two = fingerprint.fingerprint(text).split(":")
            assert int(size) == fingerprint.SMALLEST or len(one) >= fingerprint.AIM // 2
            # the definition, window by window
            data, size = text.encode(), int(size)
            for of, got in ((size, one), (2 * size, two)):
                ends = []
                for k in range(n):
                    v = int.from_bytes(data[max(0, k - 6):k + 1], "big")
                    if (((v + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33) % of == of - 1:
                        ends.append(k + 1)
                assert len(got) == min(len(ends), 63) + (n > (ends[:63] or [0])[-1])


# ---- packing

def test_pack(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["alpha", "Beta!", "<|endoftext|>", "ñandú", "\n", "日本"], k=rnd.choice([0, 3, 9, 40, 90])))) for i in range(60)] + [(99, None), (None, "no id"), (3, "again")]
    df = spark.createDataFrame([(t, d, 1, 2) for d, t in rows], "text string, doc_id long, length int, at int").repartition(3)
    got = packing.pack(df, capacity=64, keep_ids=True)
    found = got.collect()
    by_doc = {}
    for d, t in rows:
        by_doc.setdefault(d, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    assert sum(r.length for r in found) == sum(len(x) for v in by_doc.values() for x in v)
    seqs = {}
    for r in found:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
        assert any(x[r.start:r.start + r.length] == ids and (r.piece > 0) == (r.start > 0) for x in by_doc[r.doc_id]) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length, ids))
    for parts in seqs.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) <= 64
    assert len(seqs) <= 1.05 * sum(r.length for r in found) / 64 + 1
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), dtype="<u4").tolist() for r in packing.sequences(got).collect()}
    assert whole == {k: [x for p in v for x in p[2]] for k, v in seqs.items()}
    assert packing.pack(df.limit(0)).collect() == []


def test_packed_ids_are_those_of_tokenizers_at_its_default(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from tarn.llm.queries import QUERIES

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert tok.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    rnd = random.Random(6)
    parts = ["alpha", " Beta!", "<|endoftext|>", "<|endoftext|", "|>", "  ", "\n", "ñandú", "日本", "<", "'s", "7", "\u0301", "<|ENDOFTEXT|>", "\u00a0"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "", None, *("".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    sums = {k: (len(v), zlib.crc32(np.array(v, dtype="<u4").tobytes())) for k, v in want.items()}
    for found in (QUERIES["op4_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.packed(spark, df, "")):
        assert {r.doc_id: (r.length, r.ids_crc32) for r in found.collect()} == sums
    pieces = packing.pieces(df, capacity=7, keep_ids=True, added=packing.added_tokens()).collect()
    got = {k: [] for k in want}
    for r in sorted(pieces, key=lambda r: r.start):
        got[r.doc_id] += np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
    assert got == want


def test_supersteps_are_best_fit_decreasing():
    rnd = random.Random(5)
    for _ in range(50):
        sizes = sorted((rnd.randint(1, 40) for _ in range(rnd.randint(1, 200))), reverse=True)
        gaps = []
        for s in sizes:
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((40 if fit is None else fit) - s)
        steps = packing.supersteps({s: sizes.count(s) for s in set(sizes)}, 40)
        first, _, each, sequence, _ = steps.T
        at = np.arange(len(sizes))
        k = np.searchsorted(first, at, side="right") - 1
        assert len(set((sequence[k] + (at - first[k]) // each[k]).tolist())) == len(gaps)


# ---- mixing

def test_mix(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b", "c", "d", None, "big", "big", "big"]), "w " * rnd.choice([0, 1, 5, 30, 200])) for i in range(800)] + [(900, "a", None), (901, "empty", ""), (None, "b", "x y")]
    df = spark.createDataFrame([(t, s, d, 1, 2.0) for d, s, t in rows], "text string, source string, doc_id long, n int, target double").repartition(4)
    got = mixing.mix(df).collect()
    size = {}
    for d, s, t in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    left, target, names = 1.5 * sum(size.values()), {}, sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    while True:
        free = [s for s in names if s not in target]
        level = (left - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if 2 * size[s] <= weight[s] * level]
        if not over:
            break
        target.update({s: 2.0 * size[s] for s in over})
    target.update({s: weight[s] * level for s in free})
    source = {d: s for d, s, _ in rows}
    assert len(got) == len(rows)
    for s in names:
        own = [r for r in got if source[r.doc_id] == s]
        assert all(r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and r.taken == r.copies * r.size <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 200
    assert rows_of(mixing.mix(df.repartition(2))) == sorted((tuple(r) for r in got), key=str)
    assert mixing.mix(df.limit(0)).collect() == []


# ---- licences

def test_licences(spark):
    mit = dict(licences.WHOLE)["MIT"]
    wrapped = "# Copyright (c) 2020 Someone\n\n" + mit.upper().replace(". ", ".\n").replace("SUBLICENSE", "sub-license") + "\nAll rights reserved.\n"
    notice = "Some words\n  Released under the MIT licence.\nSPDX-License-Identifier: Apache-2.0\nmore"
    rows = [(1, mit), (2, wrapped), (3, mit + " and more"), (4, notice), (5, None), (6, ""), (7, mit)]
    df = spark.createDataFrame([(t, d, "z") for d, t in rows], "text string, doc_id int, licence string")
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan(df).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "Apache-2.0,MIT"), 5: (None, ""), 6: (None, ""), 7: ("MIT", "")}
    plan = licences.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and licences.scan(df.limit(0)).collect() == []


# ---- WARC

def page_rows():
    return [(1, "http://a.org/", "<p>é</p>"), (2, "u v\n\r", "same\r\n\r\nWARC/1.1\r\nx"), (3, None, "same\r\n\r\nWARC/1.1\r\nx"), (4, "d", None), (5, "e", ""), (3, "again", "same\r\n\r\nWARC/1.1\r\nx"), (None, "f", "<p>é</p>")]


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_warc_round_trip(spark, least):
    rows = page_rows()
    df = spark.createDataFrame([(h, u, i, "k") for i, u, h in rows], "html string, url string, page_id long, sha string").repartition(2)
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max(x for x in by[h or ""] if x is not None)
        refers = top if len(by[h or ""]) > 1 and len(data) >= least and i != top else None
        want.append((i, len(data), warc.sha1_base32(data), "revisit" if refers is not None else "response", refers))
    assert rows_of(warc.round_trip(df, least)) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_salvage():
    one, two, three = ((warc.record_text(f"urn:x-page:{k}", "u", f"payload {k} " * 30, None) + "\r\n\r\n").encode() for k in (1, 2, 3))
    ids = lambda found: [r.get("record_id", r.get("reason")) for r in found]
    assert ids(warc.salvage(one + two + three)) == ["urn:x-page:1", "urn:x-page:2", "urn:x-page:3"]
    bad = two.replace(b"payload 2", b"paylaod 2", 1)
    assert [(r["kind"], r["start"], r["stop"]) for r in warc.salvage(one + bad + three)] == [
        ("record", 0, len(one)), ("gap", len(one), len(one + bad)), ("record", len(one + bad), len(one + bad + three))]
    assert [r["kind"] for r in warc.salvage(one[:-30] + two)] == ["gap", "record"]
    assert [r["kind"] for r in warc.salvage(b"junk" + one + b"\x1f\x8b\x08 no member")] == ["gap", "record", "gap"]
    packed = [gzip.compress(x) for x in (one, two, three)]
    assert ids(warc.salvage(b"".join(packed))) == ["urn:x-page:1", "urn:x-page:2", "urn:x-page:3"]
    broken = packed[1][:40] + b"\0\0" + packed[1][42:]
    assert [r["kind"] for r in warc.salvage(packed[0] + broken + packed[2])] == ["record", "gap", "record"]
    assert list(warc.salvage(b"")) == []


# ---- language ID

def test_language(spark):
    vocab = language.Vocabulary(language.vocabulary())
    rng = np.random.default_rng(7)
    probs = rng.random((vocab.size, 3))
    scorer = language.Scorer(vocab, probs / probs.sum(axis=0))

    def brute(word):
        word = "▁" + word
        sums = [np.ones(3)] + [np.zeros(3) for _ in word]
        for j in range(1, len(word) + 1):
            for i in range(j):
                if word[i:j] in vocab.ids:
                    sums[j] = sums[j] + sums[i] * scorer.probs[vocab.ids[word[i:j]]]
                elif j - i == 1:
                    sums[j] = sums[j] + sums[i] * scorer._char(word[i:j])
        return np.log(sums[-1])

    words = ["the", "thé", "日本語", "x", "🙂a", "a" * 46, "a" * 47, "b" * 60]
    assert np.abs(scorer.words(words) - [brute(w) for w in words]).max() < 1e-9
    rows = [(i, ("the cat and the dog" if i % 2 else "der Hund und die Katze") + f" {i}", "en" if i % 2 else "de", "s") for i in range(80)]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (102, "123 !", "en", "s"), (103, "the dog", None, "s"), (None, "die Katze", None, "s"), (104, "w" * 20_000, None, None)]
    df = spark.createDataFrame([(t, d, lang, s, "c") for d, t, lang, s in rows], "text string, doc_id long, lang string, score string, cut string").repartition(3)
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0.5 < got[i].score <= 1 for i in range(80))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(80))
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"] and got[101].score == 0
    none = language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"} and language.identify(df.limit(0)).collect() == []


# ---- URL filters

def test_urls(spark):
    rows = [(1, "http://x.example.org/en/12"), (2, "http://example.org/de/1"), (3, "https://A.Example.ORG/es/?q#f"), (4, "http://notexample.org"), (5, "http://a.com/fr/x"),
            (6, "http://a.com/de/x"), (7, "http://a.net/ads/1"), (8, "http://a.net/ads/policy"), (9, "http://ads.b.net/"), (10, "http://bads.b.net/"), (11, None), (12, ""), (13, "no scheme/ads/"),
            (14, "x://h?utm_source=1"), (15, "x://h/track/a/b.gif"), (16, "x://h/track/a/b.png"), (17, "http://a.net/ads/1://b"), (1, "http://x.example.org/en/12"), (18, "x://org/")]
    df = spark.createDataFrame([(u, p, "r") for p, u in rows], "url string, page_id int, rule string")
    got = url_filter.judge(df)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert by[1] == ("x.example.org", "/en/12", "example.org/en/1", "block") and by[2][2:] == ("org/", "allow") and by[3] == ("a.example.org", "/es/", "example.org/es/", "block")
    assert by[4] == ("notexample.org", "", None, "allow") and by[5][2:] == ("com/fr/", "allow") and by[6][2:] == ("com/de/", "block") and by[18][2:] == ("org/", "allow")
    assert [by[k][3] for k in (7, 8, 9, 10, 13, 14, 15, 16)] == ["block", "allow", "block", "allow", "block", "block", "block", "allow"]
    assert by[11] == by[12] == ("", "", None, "allow") and got.count() == len(rows) and url_filter.judge(df.limit(0)).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_patterns():
    assert url_filter.literal_tokens("&utm_source=") == ["utm", "source"] and url_filter.literal_tokens("ads*x/y*") == []
    assert url_filter.literal_tokens("|http://a^") == ["http", "a"]
