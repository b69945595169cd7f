"""The corpus pipeline against brute force, on a table with repeated and null ids."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from tarn.llm import exact_dedup, language, mixing, near_dedup, packing
from tarn.session import store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    rnd = random.Random(11)
    words = {"en": "the of and to in is that for it with as was on be by this have from or not".split(),
             "de": "der die und das nicht ist von mit sich auf für dem eine auch als nach wie über bei einer".split()}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    sizes = iter(rnd.sample(range(12, 200), 100))
    rows = [(100 + k, text(lang, next(sizes)), lang, source) for k, (lang, source) in enumerate([("en", "a"), ("en", "b"), ("de", "a"), ("de", None)] * 6)]
    a, b, c, d, e, f, g = (text("en", next(sizes)) for _ in range(7))
    near = text("de", 98).split()
    close = [*near]
    close[20] = close[60] = "zwanzig"
    rows += [
        (5, a, "en", "a"), (9, a.upper(), "en", "a"), (5, b, "en", "b"),  # the copy goes, the other text of its id stays
        (7, "123 456 !", "en", "a"), (7, c, "en", "a"),  # one has no letter
        (8, d, "en", "b"), (8, d, "en", "b"), (8, d, "en", "b"),  # repeated rows
        (None, e, "en", "a"), (None, e, "en", "a"), (None, f, "en", "b"), (None, "?", "en", "b"), (None, None, "en", "b"), (None, a, "en", "a"),
        (3, " ".join(near), "de", "a"), (4, " ".join(close), "de", "a"), (4, g, "en", "b"),  # the near copy's id names another text
        (None, " ".join(close[:-1]), "de", "b"), (12, "", "en", "a"),
    ]
    rnd.shuffle(rows)
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]


def plain(df):
    return Counter(map(tuple, df.collect()))


def in_a_language(spark, rows):
    frame = spark.createDataFrame([(k, *r[1:], r[0]) for k, r in enumerate(rows)], "k long, text string, lang string, source string, n_chars long, doc_id long")
    found = language.identify(frame.select("doc_id", "lang", "text", "k"), key_col="k").collect()
    assert sorted(r.k for r in found) == list(range(len(rows)))
    return [rows[r.k] for r in found if r.lang_pred != "und" and r.score >= 0.5]


def without_copies(rows):
    best = {}
    for r in rows:
        norm = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        best[norm] = max(best.get(norm, r), r, key=lambda x: (x[0] is not None, x[0] or 0))
    return list(best.values())


def without_near_copies(rows):
    sets = [(lambda w: {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))})(r[1].lower().split()) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return [min((r for r, x in zip(rows, label) if x == own), key=lambda r: (r[0] is None, r[0] or 0)) for own in set(label)]


def mixed(spark, rows):
    """Ids are made unique in the same order, so that each row can be told from its id."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    frame = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(order)], SCHEMA)
    return [order[r.doc_id] for r in mixing.mix(frame).collect() for _ in range(r.copies)]


def test_stages_decide_by_row(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    brute = [lambda r: in_a_language(spark, r), without_copies, without_near_copies, lambda r: mixed(spark, r)]
    for (name, stage), same in zip(corpus_pipeline.STAGES, brute):
        docs, rows = store(stage(spark, docs, str(tmp_path))), same(rows)
        # equal texts stay in the spelling of the largest id
        assert plain(docs) == Counter(rows), name
        if name == "near_dedup":
            kept = Counter(r[0] for r in rows)
            assert kept[5] == kept[7] == kept[8] == kept[4] == kept[3] == kept[9] == 1 and kept[None] == 2
    assert any(r[0] is None for r in rows)

    encode = packing.encoder(*packing.vocabulary()).encode_ordinary
    want = Counter()
    for r in rows:
        want[r[0]] += len(encode(r[1])) + 1
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
    assert got == want


@pytest.mark.parametrize("keep_one", [exact_dedup.keep_one, near_dedup.keep_one])
def test_one_row_of_a_group_stays(spark, keep_one):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(5, a, 0, 1), (9, a, 0, 1), (5, b, 0, 1), (None, b, 0, 1), (2, "twice", 0, 1), (2, "twice", 0, 1), (None, "x", 0, 1), (None, "x", 0, 1)],
                               "doc_id long, text string, row_ int, `group` int")
    kept = keep_one(df)
    assert kept.columns == df.columns
    first = 9 if keep_one is exact_dedup.keep_one else 5
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(first, a), (5, b), (2, "twice"), (None, "x")], key=str)
    assert keep_one(df.limit(0)).collect() == []


def test_rows_of_files_are_numbered_in_place(spark, tmp_path, monkeypatch):
    """A whole copy of the documents in every stage stayed on disk until the end of the pipeline."""
    from tarn.llm import common

    rows = [(k % 7 if k % 5 else None, f"text {k % 9}", k) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, row_ int").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs, stored = spark.read.parquet(str(tmp_path / "docs")), []
    keep = common.store
    monkeypatch.setattr(common, "store", lambda df: stored.append(df.columns) or keep(df))
    numbered, key = common.keyed(docs)
    assert key == "row__" and numbered.columns == ["doc_id", "text", "row_", "row__"]
    assert not any("text" in columns for columns in stored)
    got = [tuple(r) for r in numbered.collect()]
    assert sorted((r[:3] for r in got), key=str) == sorted(rows, key=str) and len({r[3] for r in got}) == 60
    assert sorted(map(str, numbered.select("text", "row__").collect())) == sorted(map(str, keep(numbered).select("text", "row__").collect()))
    # the same file twice, and anything but a plain read, are copied
    path = str(tmp_path / "docs")
    for df, n in ((spark.read.parquet(path, path), 120), (docs.filter("row_ < 30"), 30), (docs.union(docs), 120), (spark.createDataFrame(rows, docs.schema), 60)):
        stored.clear()
        numbered, key = common.keyed(df)
        assert numbered.select(key).distinct().count() == numbered.count() == n
        assert any("text" in columns for columns in stored)
