"""Audit of how the sources of a language differ in their words, from exact counts.

Terms are counted inside the tasks by length-bucketed packing. A term of at most 8 bytes is one unsigned 64-bit word, one of at
most 16 bytes is two, big-endian and filled with zero bytes (which no term holds), so words sort as their bytes do. Words are
radix-sorted 16 bits at a time and runs of equal ones are counted; the sort is stable and texts come group by group, so the runs
of a term split into its documents and groups. Longer terms go to one bucket per length, sorted by their bytes.

Spark sums the tasks' counts per group and term, then per language and term, where a term's counts in all sources of its language
become one row. Shares and divergences are whole numbers, worked out from those rows: pairs of sources are summed inside the tasks,
so that only a row per pair of sources leaves a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.session import store

from .shingles import arrow_bytes

#: Documents of a language that a term must occur in.
LEAST_DOCS = 10
UNIT = 1_000_000_000
#: Ranks of terms that are reported.
TOP = 10
CHUNK = 8 << 20  # bytes of text whose terms are sorted together; one longer text is a chunk of its own
BLOCK = 256  # sources compared with as many others at a time
CELLS = 1 << 21  # terms times sources held at a time
_TERM = np.zeros(256, dtype=bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, size and text of every term of texts that lie end to end."""
    inside = _TERM[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = cut[0] = cut[-1] = True
    start = np.flatnonzero(inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]])))
    end = np.flatnonzero(inside & (cut[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    return start, end - start, np.searchsorted(offsets, start, side="right") - 1


def _words(padded: np.ndarray, start: np.ndarray, size: np.ndarray, many: int) -> list[np.ndarray]:
    """The terms as ``many`` big-endian words. ``padded`` ends with 16 bytes that are no part of a text."""
    at_every_byte = np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded, strides=(1,))
    out = []
    for w in range(many):
        keep = np.clip(size - 8 * w, 0, 8).astype(np.uint64)
        drop = np.uint64(8) * (np.uint64(8) - keep)
        word = at_every_byte[start + 8 * w].astype(np.uint64)
        out.append(np.where(keep > 0, (word >> np.minimum(drop, np.uint64(56))) << np.minimum(drop, np.uint64(56)), np.uint64(0)))
    return out


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by their words, the first being the most significant: by 16 bits at a time, the least first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if digit.size and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # 16-bit numbers are sorted by radix
    return order


def _counted(changes: np.ndarray, text: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted terms (``changes``: unlike the term before): the first place of each (term, group), its occurrences and texts."""
    new_text = changes | np.concatenate([[True], text[1:] != text[:-1]])
    per_text = np.flatnonzero(new_text)
    new_group = (changes | np.concatenate([[True], group[1:] != group[:-1]]))[per_text]
    first = np.flatnonzero(new_group)
    n = np.add.reduceat(np.diff(np.append(per_text, len(text))), first)
    return per_text[first], n, np.diff(np.append(first, len(per_text)))


def _chunk(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """(group, term, occurrences, texts) of a chunk, as arrays; ``group`` rises from text to text."""
    import pyarrow as pa

    padded = np.concatenate([_LOWER[data], np.zeros(16, dtype=np.uint8)])
    start, size, text = _terms(data, offsets)
    buckets = [(size <= 8, 1), ((size > 8) & (size <= 16), 2)]
    buckets += [(size == length, 0) for length in np.unique(size[size > 16]).tolist()]
    for some, many in buckets:
        at = np.flatnonzero(some)
        if not at.size:
            continue
        if many:
            words = _words(padded, start[at], size[at], many)
            order = radix_order(words)
            changes = np.zeros(len(at), dtype=bool)
            for w in words:
                changes[1:] |= w[order][1:] != w[order][:-1]
        else:
            length = int(size[at[0]])
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, length)[start[at]]).view(f"S{length}")[:, 0]
            order = np.argsort(rows, kind="stable")
            changes = np.zeros(len(at), dtype=bool)
            changes[1:] = rows[order][1:] != rows[order][:-1]
        changes[0] = True
        by = at[order]
        first, n, texts = _counted(changes, text[by], group[text[by]])
        one = by[first]
        ends = np.concatenate([[0], np.cumsum(size[one])])
        flat = np.arange(ends[-1]) - np.repeat(ends[:-1] - start[one], size[one])
        names = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(padded[flat]))
        yield group[text[one]], names, n, texts


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in the texts of a group, and how many of them hold it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def count(batches):
        for b in batches:
            langs, sources = (pc.fill_null(b.column(k), "").to_pylist() for k in (1, 2))
            names = sorted(set(zip(langs, sources, strict=True)))
            number = {name: k for k, name in enumerate(names)}
            group = np.array([number[g] for g in zip(langs, sources, strict=True)], dtype=np.int64)
            by = np.argsort(group, kind="stable")
            texts, group = pc.fill_null(b.column(0), "").cast(pa.large_string()).take(pa.array(by)), group[by]
            data, offsets = arrow_bytes(texts)
            a = 0
            while a < len(group):
                z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
                part = data[offsets[a]:offsets[z]]
                for g, term, n, held in _chunk(part, offsets[a:z + 1] - offsets[a], group[a:z]):
                    pick = [names[k] for k in g.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p[0] for p in pick], pa.string()), pa.array([p[1] for p in pick], pa.string()), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(held, pa.int64())],
                        ["lang", "source", "term", "n", "docs"])
                a = z

    rows = docs.select(*[F.col(f"`{c}`").cast("string").alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    found = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, size) -> np.ndarray:
    """1 + floor(UNIT * (n + 2) / size), exactly. ``size``: occurrences of all terms, plus 2 for each term."""
    if n.size and int(n.max()) > (1 << 62) // UNIT - 2:
        return (1 + UNIT * (n.astype(object) + 2) // np.asarray(size, dtype=object)).astype(np.int64)
    return 1 + UNIT * (n + 2) // size


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _pair_sums(terms: DataFrame, sizes: dict[str, tuple[dict[str, int], np.ndarray]], block: int) -> DataFrame:
    """(lang, a, b, value): divergence of the sources numbered a < b of a language, summed over its terms.

    ``sizes``: of each language, the sources' numbers and their occurrences of all terms, plus 2 for each term.
    """
    import pyarrow as pa

    held = terms.sparkSession.sparkContext.broadcast(sizes)

    def work(batches):
        for whole in batches:
            langs = np.array(whole.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                number, size = held.value[lang]
                mine = whole.filter(pa.array(langs == lang)).column(1)
                step = max(1, CELLS // min(len(size), 2 * block))
                sums: dict[tuple[int, int], np.ndarray] = {}
                for at in range(0, len(mine), step):
                    part = mine.slice(at, step)
                    row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                    source, n = part.flatten().flatten()
                    code = source.dictionary_encode()
                    of = np.array([number[s] for s in code.dictionary.to_pylist()], dtype=np.int64)[code.indices.to_numpy()]
                    n = n.to_numpy()

                    def dense(first):
                        some = (of >= first) & (of < first + block)
                        out = np.zeros((len(part), min(block, len(size) - first)), dtype=np.int64)
                        out[row[some], of[some] - first] = n[some]
                        return shares(out, size[None, first:first + block])

                    for a in range(0, len(size), block):
                        p = dense(a)
                        for b in range(a, len(size), block):
                            q = p if a == b else dense(b)
                            total = np.array([divergence(p[:, [k]], q).sum(axis=0) for k in range(p.shape[1])])
                            sums[a, b] = sums[a, b] + total if (a, b) in sums else total
                for (a, b), total in sums.items():
                    i, j = np.nonzero(np.arange(total.shape[0])[:, None] + a < np.arange(total.shape[1])[None, :] + b)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(i), pa.string()), pa.array(i + a, pa.int32()), pa.array(j + b, pa.int32()), pa.array(total[i, j], pa.int64())], ["lang", "a", "b", "value"])

    parts = terms.select("lang", "counts").mapInArrow(work, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _share(n: str, size: str):
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))) div CAST({size} AS DECIMAL(20, 0))")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: how each source's words differ from other sources' and from the language's.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; a language keeps those in at least ``least_docs``
    of its documents. A group's share of a term is ``1 + floor(10^9 * (n + 2) / (N + 2 V))``, with n occurrences there of N of
    all V kept terms; of shares p and q the divergence is ``floor((p - q)^2 / (p + q))``. Part ``pair``: the sum over all kept terms
    against each other source of the language. Part ``term``: the ``top`` terms of which the group has a larger share than the language.
    Ranks start at 1 by falling value, then by the bytes of the item.

    Null text, lang and source count as empty; an empty one is a lang or source as any other. A group without terms has pairs, and a
    language without kept terms has pairs of value 0. Repeated rows count each; other columns are ignored; no rows give no rows.
    One row per (lang, source) reaches the driver, whereas the answer holds the square of them.
    """
    spark = docs.sparkSession
    cells = term_counts(docs, text_col, lang_col, source_col)
    terms = store(cells.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"),
    ).filter(F.col("docs") >= least_docs).select("lang", "term", "total", "counts"))

    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    present = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct()
    own = terms.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    whole = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_all"))
    found = present.join(own, ["lang", "source"], "left").join(whole, "lang", "left").collect()
    groups, sizes = [], {}
    for r in sorted(found, key=lambda r: (r.lang.encode(), r.source.encode())):
        v = r.v or 0
        number, size = sizes.setdefault(r.lang, ({}, []))
        groups.append((r.lang, r.source, len(number), (r.n or 0) + 2 * v, (r.n_all or 0) + 2 * v))
        number[r.source] = len(number)
        size.append((r.n or 0) + 2 * v)
    known = spark.createDataFrame(groups, "lang string, source string, a int, size long, size_all long")
    sums = _pair_sums(terms, {lang: (number, np.array(size, dtype=np.int64)) for lang, (number, size) in sizes.items()}, block)

    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one, two = known.select("lang", "source", "a"), known.select("lang", F.col("source").alias("item"), F.col("a").alias("b"))
    pairs = one.join(two, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    p, q = F.col("p"), F.col("q")
    cell = terms.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    shared = cell.join(F.broadcast(known), ["lang", "source"]).withColumn("p", _share("n", "size")).withColumn("q", _share("total", "size_all"))
    over = shared.filter(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", place).unionByName(over.select("*", place).filter(F.col("rank") <= top))


AUDIT_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
w AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0) AS n
  FROM g LEFT JOIN c USING (lang, source) LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * w.v) AS p,
  1 + (1000000000::HUGEINT * (k.n + 2)) // (w.n + 2 * w.v) AS q
  FROM s JOIN w USING (lang) JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
