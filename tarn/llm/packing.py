"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

Pieces are range-sorted by length, longest first. A superstep takes the pieces of the next length: a successor sweep over the
gaps, smallest sufficient gap first, gives each gap as many of them as fit; the rank among pieces of that length decides
which piece goes where; the gaps are updated and the next superstep follows. Lengths are at most ``capacity``, so equal
pieces and equal gaps form runs, and a superstep moves runs, not rows: the sweeps need the number of pieces per
length (at most ``capacity`` counts) and give at most ``3 * capacity * sqrt(2 * capacity)`` intervals of ranks, whatever
the corpus' size. All rows are then placed from their rank alone, in the partition where the range sort put them.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache_of, positions

CAPACITY, END = 2048, 0


def vocabulary() -> tuple[str, str]:
    """The default vocabulary (as ranks) and the pattern that splits text before its merges."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file, by default that of the default vocabulary: strings that are one id wherever
    they stand, whatever is around them."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token with a condition: {t['content']!r}")
    return {t["content"]: t["id"] for t in tokens}


def encoder(path: str, pattern: str, added: dict[str, int] | None = None):
    """The byte-level BPE of a rank file. Strings of ``added`` are cut out first and get their ids; all else is ordinary text."""
    key = path, pattern, *sorted((added or {}).items())
    held = cache_of("encoder")
    if key not in held:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        held[key] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    return held[key]


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
           vocab: tuple[str, str] | None = None, keep_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Token pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, uint32).

    ``added``: see ``encoder``; without it, no string is more than its text. A text gets the id 0 at its end. Longer ones are cut so that all pieces but the first are full.
    """
    path, pattern = vocab or vocabulary()

    def cut(frames):
        import pandas as pd

        encoding = encoder(path, pattern, added)
        for f in frames:
            out = []
            for doc, text in zip(f["doc_id"].tolist(), f["text"].tolist(), strict=True):
                ids = np.array([*encoding.encode(text or "", allowed_special="all"), END], dtype="<u4")
                first = len(ids) % capacity or capacity
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    data = ids[start:start + (capacity if k else first)].tobytes()
                    out.append((doc, k, start, len(data) // 4, zlib.crc32(data), *((data,) if keep_ids else ())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def supersteps(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Intervals of places in the sort by length: first place, length, pieces per gap, first sequence, offset.

    ``counts``: pieces of each length. Sequences with the same gap form runs of consecutive numbers.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    some, used, place, out = 0, 0, 0, []  # some: bit g is set if there are gaps of size g

    def add(gap: int, first: int, n: int) -> None:
        nonlocal some
        if n and gap:
            gaps.setdefault(gap, []).append((first, n))
            some |= 1 << gap

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = some >> length
            if fits:
                gap = length + (fits & -fits).bit_length() - 1
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    some &= ~(1 << gap)
            else:
                gap, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = gap // length
            full = min(n, left // each)
            if full:
                out.append((place, length, each, first, capacity - gap))
                add(gap - each * length, first, full)
                place, left, first, n = place + full * each, left - full * each, first + full, n - full
            if n and left:  # one gap for the rest; what is left of the run stays as it is
                out.append((place, length, left, first, capacity - gap))
                add(gap - left * length, first, 1)
                place, left, first, n = place + left, 0, first + 1, n - 1
            add(gap, first, n)
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
         vocab: tuple[str, str] | None = None, keep_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Every piece of every document with its sequence_id and offset there.

    Null texts count as empty; an empty text is the single id 0. Rows that repeat an id are documents of their own. Ties in length
    are placed by id (null first) and piece. Other columns are ignored. No rows give no sequences.
    """
    placed = positions(pieces(docs, capacity, id_col, text_col, vocab, keep_ids, added), F.col("length").desc(), F.col("doc_id"), F.col("piece"))
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = placed.sparkSession.sparkContext.broadcast(supersteps(counts, capacity))

    def place(frames):
        first, length, each, sequence, offset = steps.value.T
        for f in frames:
            at = f["at"].to_numpy()
            k = np.searchsorted(first, at, side="right") - 1
            rank = at - first[k]
            yield f.drop(columns="at").assign(sequence_id=sequence[k] + rank // each[k], offset=offset[k] + rank % each[k] * length[k])

    kind = docs.schema[id_col].dataType.simpleString()
    named = placed.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = ", ".join(f"{c} {t}" for c, t in named.dtypes if c != "at")
    return named.mapInPandas(place, f"{schema}, sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast(kind))


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from ``pack(..., keep_ids=True)``: at most ``capacity`` of them a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate(F.col("parts.ids"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"))
