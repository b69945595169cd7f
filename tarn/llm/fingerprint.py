"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the text; where it hits the block size, a chunk ends. Every chunk gives one of 64
characters, so an edit changes the characters near it and leaves the others. A fingerprint has the signatures at a block
size and at its double. The size follows from the text's length and is halved while the signature has less than half of the
characters aimed at; two fingerprints are compared by the edit distance of
their signatures at a block size that both have.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_edges

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SMALLEST, LONGEST, AIM = 3, 64, 48  # smallest block size; characters of a signature at most, and aimed at
COMMON = 4  # characters in a row that two signatures must share to count as alike at all
SCAN = 1 << 20
BLOCK_BYTES = 16 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CODES = np.full(256, LONGEST, dtype=np.uint8)
_CODES[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(64)


def _triggers(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes that hit ``size``: position after the byte, hash. Those that hit the double are among them."""
    hits = []
    for at in range(0, len(data), SCAN):
        from_ = max(0, at - 6)
        b = np.frombuffer(data, dtype=np.uint8, count=min(len(data), at + SCAN) - from_, offset=from_).astype(np.uint64)
        v = b.copy()
        for k in range(1, 7):
            v[k:] |= b[:-k] << np.uint64(8 * k)
        r = ((v + np.uint64(1)) * _MIX) >> np.uint64(33)
        i = np.flatnonzero(r % np.uint64(size) == size - 1)
        i = i[i >= at - from_]
        hits.append((i + from_ + 1, r[i]))
    return tuple(map(np.concatenate, zip(*hits, strict=True))) if hits else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


def _hits(hashes: np.ndarray, size: int) -> np.ndarray:
    return hashes % np.uint64(size) == size - 1


def _short(ends: np.ndarray, length: int) -> bool:
    """Whether a signature of these chunks has less than half of the characters aimed at."""
    return len(ends) + (not len(ends) or ends[-1] < length) < AIM // 2


def _signature(data: bytes, ends: np.ndarray, longest: int) -> str:
    cuts = [0, *ends[:longest - 1].tolist(), len(data)]
    return "".join(ALPHABET[(zlib.crc32(data[a:b]) * 0x9E3779B1 >> 26) & 63] for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def fingerprint(text: str | None) -> str:
    """``block size:signature:signature at the double``; equal texts have equal ones, null counts as empty (``3::``)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = SMALLEST
    while size * AIM < len(data):
        size *= 2
    ends, hashes = _triggers(data, size)
    if size > SMALLEST and _short(ends, len(data)):
        all_ends, all_hashes = _triggers(data, SMALLEST)
        while size > SMALLEST and _short(ends, len(data)):
            size //= 2
            hit = _hits(all_hashes, size)
            ends, hashes = all_ends[hit], all_hashes[hit]
    return f"{size}:{_signature(data, ends, LONGEST)}:{_signature(data, ends[_hits(hashes, 2 * size)], LONGEST)}"


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances of strings of at most 64 characters, for all pairs at once, bit by bit in machine words."""
    n = len(pairs)
    if not n:
        return np.zeros(0, dtype=np.int64)

    def coded(strings):
        out = np.full((n, LONGEST), LONGEST, dtype=np.uint8)
        for row, s in zip(out, strings, strict=True):
            row[:len(s)] = _CODES[np.frombuffer(s.encode(), dtype=np.uint8)]
        return out, np.array([len(s) for s in strings], dtype=np.int64)

    a, la = coded([p[0] for p in pairs])
    b, lb = coded([p[1] for p in pairs])
    rows, one = np.arange(n), np.uint64(1)
    where = np.zeros((n, LONGEST + 1), dtype=np.uint64)
    for j in range(LONGEST):
        where[rows, a[:, j]] |= one << np.uint64(j)
    where[:, LONGEST] = 0
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, dtype=np.uint64)
    last, dist = one << np.maximum(la - 1, 0).astype(np.uint64), la.copy()
    for j in range(int(lb.max(initial=0))):
        eq = where[rows, b[:, j]]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus), plus & xh
        live = (j < lb) & (la > 0)
        dist += live & ((up & last) != 0)
        dist -= live & ((down & last) != 0)
        up = (up << one) | one
        plus, minus = (down << one) | ~(xv | up), up & xv
    return np.where(la == 0, lb, dist)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 for equal ones, 0 without a common block size or ``COMMON`` characters in a row."""
    out, todo, of = np.zeros(len(pairs)), [], []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (p, x1, x2), (q, y1, y2) = ((int(s[0]), s[1], s[2]) for s in (x.split(":"), y.split(":")))
        for s, t in ((x1, y1), (x2, y2)) if p == q else ((x2, y1),) if 2 * p == q else ((x1, y2),) if p == 2 * q else ():
            runs = {s[k:k + COMMON] for k in range(len(s) - COMMON + 1)}
            if any(t[k:k + COMMON] in runs for k in range(len(t) - COMMON + 1)):
                todo.append((s, t))
                of.append(i)
    near = 1 - edit_distances(todo) / np.array([max(len(s), len(t)) for s, t in todo] or [1])[:len(todo)]
    np.maximum.at(out, np.array(of, dtype=np.int64), near)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars and fingerprint of every row, null texts as empty; other columns are ignored."""

    def each(frames):
        for f in frames:
            text = f["text"].fillna("")
            yield f[["doc_id"]].assign(n_chars=text.str.len(), fingerprint=text.map(fingerprint))

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInPandas(each, f"doc_id {rows.schema[0].dataType.simpleString()}, n_chars long, fingerprint string")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) dealt to ranges of ids, each with the row that follows it as ``halo``.

    Ranges hold about BLOCK_BYTES; only their bounds and first ids reach the driver.
    """
    import pyarrow as pa

    edges = block_edges(rows, BLOCK_BYTES)
    n = len(edges) + 1

    def block(ids):  # 0 has the largest ids; null ids come after the smallest
        import pyarrow.compute as pc

        none = pc.is_null(ids).to_numpy(zero_copy_only=False)
        return np.where(none, len(edges), len(edges) - np.searchsorted(edges, pc.fill_null(ids, 0).to_numpy(), side="right"))

    def blocks_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(block(b.column(0)), pa.int32())], ["doc_id", "block"])

    heads = rows.select("doc_id").mapInArrow(blocks_of, "doc_id long, block int").groupBy("block").agg(F.max("doc_id").alias("head")).orderBy("block").collect()
    before = {}  # id (or None) of a block's first row -> the block before it
    for k, r in enumerate(heads):
        before.setdefault(r["head"], []).append(heads[k - 1]["block"])
    numbers = np.array(sorted(k for k in before if k is not None), dtype=np.int64)

    def deal(batches):
        import pyarrow.compute as pc

        for b in batches:
            ids, texts = b.column(0), pc.fill_null(b.column(1), "")
            yield pa.RecordBatch.from_arrays([pa.array(block(ids), pa.int32()), pa.array(np.zeros(len(ids), bool)), ids, texts], ["block", "halo", "doc_id", "text"])
            first = pc.is_in(ids, pa.array(numbers)).to_numpy(zero_copy_only=False)
            if None in before:
                first |= pc.is_null(ids).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(first):
                to = before[ids[i].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([True] * len(to)), pa.array([ids[i].as_py()] * len(to), pa.int64()),
                                                  pa.array([texts[i].as_py()] * len(to), pa.string())], ["block", "halo", "doc_id", "text"])

    dealt = rows.mapInArrow(deal, "block int, halo boolean, doc_id long, text string")
    return dealt.repartition(max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block").sortWithinPartitions(
        "block", "halo", F.col("doc_id").desc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of a version with its second half overwritten by the next document's beginning.

    Documents follow each other by descending id (an integer), the first after the last; a single one follows itself. Null
    ids come last; rows with equal ids follow each other by text. Null texts count as empty: their fingerprint is ``3::``, like
    that of any empty text, and equal fingerprints have the likeness 1. Other columns are ignored; no rows give no rows.
    """

    def work(frames):
        import pandas as pd

        kept = None  # the last row seen, with its fingerprint
        for f in frames:
            rows = [r for r in zip(f["block"].tolist(), f["halo"].tolist(), f["doc_id"].tolist(), f["text"].tolist(), strict=True)]
            prints = [fingerprint(r[3]) for r in rows]
            if kept:
                rows, prints = [kept[0], *rows], [kept[1], *prints]
            if not rows:
                continue
            out = []
            for a, b, x, y in zip(rows, rows[1:], prints, prints[1:], strict=False):
                if a[1] or a[0] != b[0]:
                    continue
                text, half = a[3], len(a[3]) // 2
                edited = text[:len(text) - half] + b[3][:half]
                out.append((a[2], len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), x, fingerprint(edited), y))
            kept = rows[-1], prints[-1]
            if out:
                near = likeness([(r[3], r[4]) for r in out]), likeness([(r[3], r[5]) for r in out])
                yield pd.DataFrame({"doc_id": [None if r[0] is None else int(r[0]) for r in out], "n_chars": [r[1] for r in out], "edited_sha256": [r[2] for r in out],
                                    "fingerprint": [r[3] for r in out], "edited_fingerprint": [r[4] for r in out], "near_edited": near[0], "near_next": near[1]})

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    named = _in_blocks(rows).select("block", "halo", F.col("doc_id").cast("string").alias("doc_id"), "text")
    return named.mapInPandas(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
