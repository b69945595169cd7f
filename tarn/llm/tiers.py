"""Hierarchical packing of token sequences into windows of several lengths.

A document's ids are cut into pieces as long as the longest window, which fill windows of their own, and a rest. A rest goes to
the tier of the smallest window that holds it and, in all tiers but the smallest, opens such a window. From the longest tier down,
the gaps of a tier's windows are filled by whole rests of shorter tiers: gaps and rests are divided into size classes, and the k-th
rest of a class goes to the k-th gap of the class. What stays unused is laid end to end, as are the gaps that are left: rests are cut
where gaps end, so every window becomes full. What is left after that fills windows of the longest size, and the last few ids
windows of falling powers of two. If there are too few short rests to fill all gaps, the windows with the largest gaps are
given up and their rests are laid end to end as well. So no sequence has any padding, and most rests are whole.

Last, sequences are dealt out to step groups, the longest first and one after the other, so all groups have like numbers of
sequences of each length.

All of that works on rows of a few numbers. Places in an order are counted in about as many parts as a part has rows, by the hash of
a key, so no task sees more than the root of them. The ids of a rest (fewer than a window's) join at the end.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarn.session import store, temporary

from .packing import encoder, vocabulary

TIERS, END = (2048, 1024, 512, 256), 1
#: Size classes of a tier's gaps, finest first.
CLASSES = (32, 8)
#: Tokens of a step group.
STEP = 1 << 19
#: Tokens of the stream whose rests and gaps meet in one task.
STRETCH = 1 << 18


def rests(docs: DataFrame, longest: int, id_col: str, text_col: str, vocab: tuple[str, str], added: dict[str, int] | None, end: int,
          keep_ids: bool) -> DataFrame:
    """(key, doc_id, doc_tokens, start, length, crc, ids): a document's full pieces, with crc (and ids, if they are to be kept), and
    its rest, with ids."""
    import pyarrow as pa

    path, pattern = vocab

    def cut(batches):
        encoding = encoder(path, pattern, added)
        for b in batches:
            doc, tokens, start, length, crc, data = [], [], [], [], [], []
            for k, text in enumerate(b.column(1)):
                ids = np.array([*encoding.encode(text.as_py() or "", allowed_special="all"), end], dtype="<u4")
                full = len(ids) // longest
                for at in range(0, len(ids), longest):
                    some = ids[at:at + longest]
                    whole = at < full * longest
                    crc.append(zlib.crc32(some.tobytes()) if whole else None)
                    data.append(None if whole and not keep_ids else (some if some.max() >= 1 << 16 else some.astype("<u2")).tobytes())
                    doc.append(k)
                    tokens.append(len(ids))
                    start.append(at)
                    length.append(len(some))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(doc, pa.int64())), pa.array(tokens, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "doc_tokens", "start", "length", "crc", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = T.StructType([
        T.StructField("doc_id", rows.schema[0].dataType), *[T.StructField(c, T.LongType()) for c in ("doc_tokens", "start", "length", "crc")],
        T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(cut, kind).withColumn("key", F.monotonically_increasing_id())


def running(rows: DataFrame, value: str | Column, group: str | Column, across: bool = False, key: str = "key") -> DataFrame:
    """``rows`` (with unique ``key``s) with their 0-based place ``at`` and the sum ``before`` of the values before them.

    Both count within ``group``, or ``across`` groups, the largest first. The order within a group is any, but always the same.
    """
    parts = math.isqrt(rows.count()) + 1
    value, group = (F.col(c) if isinstance(c, str) else c for c in (value, group))
    dealt = rows.withColumns({"value_": value.cast("long"), "group_": group.cast("long"), "part_": F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")})
    sums = dealt.groupBy("group_", "part_").agg(F.count("*").alias("n_"), F.sum("value_").alias("s_"))
    so_far = (Window.orderBy(F.desc("group_"), "part_") if across else Window.partitionBy("group_").orderBy("part_")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group_", "part_", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in ("n_", "s_")])
    own = Window.partitionBy("group_", "part_").orderBy(key)
    inside = dealt.withColumns({"at": F.row_number().over(own) - 1, "before": F.sum("value_").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("value_")})
    return (inside.join(sums, ["group_", "part_"])
            .withColumns({"at": F.col("at") + F.col("n_"), "before": F.col("before") + F.col("s_")}).drop("group_", "part_", "value_", "n_", "s_"))


def _fill(windows: DataFrame, pool: DataFrame, step: int) -> DataFrame:
    """(key, length, seq, offset), stored: rests of the pool that fit into gaps as wholes, by size classes ``step`` apart."""
    gaps = running(store(windows.filter(F.col("gap") >= step)), F.lit(1), F.floor(F.col("gap") / step), key="seq").select(
        F.floor(F.col("gap") / step).alias("class"), "at", "seq", (F.col("capacity") - F.col("gap")).alias("offset"))
    docs = running(pool, F.lit(1), F.ceil(F.col("length") / step)).select(F.ceil(F.col("length") / step).alias("class"), "at", "key", "length")
    return store(docs.join(gaps, ["class", "at"]).select("key", "length", "seq", "offset"))


def _laid(pool: DataFrame, slots: DataFrame) -> DataFrame:
    """(key, skip, length, seq, offset): rests (key, before, length) laid end to end over slots (seq, before, size, offset)."""
    import pyarrow as pa

    def stretches(rows, size):
        first, last = F.floor(F.col("before") / STRETCH), F.floor((F.col("before") + F.col(size) - 1) / STRETCH)
        return rows.filter(F.col(size) > 0).withColumn("stretch", F.explode(F.sequence(first, last)))

    def merge(key, left, right):
        import pyarrow.compute as pc

        low = key[0].as_py() * STRETCH
        doc, slot = (t.take(pc.sort_indices(t["before"])) for t in (left, right))
        d, s = doc["before"].to_numpy(), slot["before"].to_numpy()
        begin = np.unique(np.concatenate([d, s, [low]]))
        end = np.append(begin[1:], low + STRETCH)
        keep = (begin >= low) & (begin < low + STRETCH)
        begin, end = begin[keep], np.minimum(end[keep], low + STRETCH)
        i, j = (np.searchsorted(x, begin, side="right") - 1 for x in (d, s))
        keep = (i >= 0) & (j >= 0)
        begin, end, i, j = begin[keep], end[keep], i[keep], j[keep]
        end = np.minimum(end, np.minimum(d[i] + doc["length"].to_numpy()[i], s[j] + slot["size"].to_numpy()[j]))
        keep = end > begin
        begin, end, i, j = begin[keep], end[keep], i[keep], j[keep]
        return pa.table({"key": doc["key"].to_numpy()[i], "skip": begin - d[i], "length": end - begin,
                         "seq": slot["seq"].to_numpy()[j], "offset": slot["offset"].to_numpy()[j] + begin - s[j]})

    one = stretches(pool.select("key", "before", "length"), "length").groupBy("stretch")
    two = stretches(slots.select("seq", "before", "size", "offset"), "size").groupBy("stretch")
    return one.cogroup(two).applyInArrow(merge, "key long, skip long, length long, seq long, offset long")


def _total(rows: DataFrame, column: str) -> int:
    return rows.agg(F.sum(column)).first()[0] or 0


def place(slim: DataFrame, tiers: tuple[int, ...] = TIERS, classes: tuple[int, ...] = CLASSES) -> tuple[DataFrame, DataFrame]:
    """Where rests (key, length; at most ``tiers[0]``) go: (key, skip, length, seq, offset) and the sequences (seq, size).

    ``skip``: ids of the rest before the piece. Pieces of a rest that follow each other in one sequence are yet to be joined.
    """
    spark = slim.sparkSession
    tier = F.coalesce(*[F.when(F.col("length") <= c, F.lit(c)) for c in reversed(tiers)])
    pool = store(slim.select("key", F.col("length").cast("long").alias("length"), tier.cast("long").alias("tier")))
    windows = whole = None
    for capacity in tiers[:-1]:
        own = pool.filter(F.col("tier") == capacity)
        opened = store(own.select(F.col("key").alias("seq"), F.col("tier").alias("capacity"), (F.col("tier") - F.col("length")).alias("gap")))
        laid = own.select("key", "length", F.col("key").alias("seq"), F.lit(0).cast("long").alias("offset"))
        pool = pool.filter(F.col("tier") < capacity)
        for n in classes:
            filled = _fill(opened, pool, max(1, capacity // n))
            if filled.isEmpty():
                continue
            laid = laid.unionByName(filled)
            pool = store(pool.join(filled.select("key"), "key", "left_anti"))
            opened = store(opened.join(filled.select("seq", F.col("length").alias("used")), "seq", "left").select(
                "seq", "capacity", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")))
        windows, whole = (opened, laid) if windows is None else (windows.unionByName(opened), whole.unionByName(laid))
    if windows is None:
        windows = spark.createDataFrame([], "seq long, capacity long, gap long")
        whole = spark.createDataFrame([], "key long, length long, seq long, offset long")

    # keep the windows with the smallest gaps, as many as the rest can fill; at most tiers[0] numbers of windows and ids come here
    have, need, most = _total(pool, "length"), 0, -1
    by_gap = windows.groupBy("gap").agg(F.count("*").alias("n"), F.sum(F.col("capacity") - F.col("gap")).alias("used")).orderBy("gap").collect()
    have += sum(r.used for r in by_gap)
    for r in by_gap:
        need, have = need + r.n * r.gap, have - r.used
        if need > have:
            break
        most = r.gap
    given_up = windows.filter(F.col("gap") > most).select("seq")
    windows = store(windows.filter(F.col("gap") <= most))
    loose = whole.join(given_up, "seq", "left_semi").select("key", "length")
    whole = store(whole.join(given_up, "seq", "left_anti"))
    pool = store(pool.select("key", "length").unionByName(loose))

    gaps, total = _total(windows, "gap"), _total(pool, "length")
    longest, left = tiers[0], total - gaps
    extra = spark.range(left // longest).select((-1 - F.col("id")).alias("seq"), (gaps + F.col("id") * longest).alias("before"), F.lit(longest).cast("long").alias("size"))
    at, tail = total - left % longest, []
    for k in range(longest.bit_length(), -1, -1):
        if left % longest >> k & 1:
            tail.append((-1 - left // longest - len(tail), at, 1 << k))
            at += 1 << k
    extra = extra.unionByName(spark.createDataFrame(tail, "seq long, before long, size long"))
    slots = running(windows, "gap", "capacity", across=True, key="seq").select("seq", "before", F.col("gap").alias("size"), (F.col("capacity") - F.col("gap")).alias("offset"))
    slots = slots.unionByName(extra.select("seq", "before", "size", F.lit(0).cast("long").alias("offset")))
    stream = _laid(running(pool, "length", F.lit(0)), slots)
    pieces = whole.select("key", F.lit(0).cast("long").alias("skip"), "length", "seq", "offset").unionByName(stream)
    return pieces, windows.select("seq", F.col("capacity").alias("size")).unionByName(extra.select("seq", "size"))


def pack_tiers(docs: DataFrame, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text", vocab: tuple[str, str] | None = None,
               added: dict[str, int] | None = None, end: int = END, step: int = STEP, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group and, if asked for, ids (binary,
    uint32) of every piece of every document.

    ``tiers``: window lengths, powers of two from the longest down. A text gets the id ``end`` at its end; null texts count as
    empty, an empty text is that one id. Sequences are full, whatever the documents: their lengths are those of the tiers, or smaller
    powers of two for at most as many ids as one window has. Step groups have about ``step`` tokens each, and tokens that differ
    by less than two of the longest windows. Rows that repeat an id are documents of their own; other columns are ignored; no rows
    give no rows. ``added``: see ``packing.encoder``.
    """
    import pyarrow as pa

    if list(tiers) != sorted({1 << t.bit_length() - 1 for t in tiers}, reverse=True):
        raise ValueError(f"not powers of two that fall: {tiers}")
    spark = docs.sparkSession
    with temporary(spark) as keep:
        parts = keep(rests(docs, tiers[0], id_col, text_col, vocab or vocabulary(), added, end, keep_ids))
        full = parts.filter("crc IS NOT NULL").select("key", "length")
        pieces, seqs = place(parts.filter("crc IS NULL").select("key", "length"), tiers)
        seqs = store(full.select(F.col("key").alias("seq"), F.col("length").alias("size")).unionByName(seqs))
        groups = max(1, -(-_total(seqs, "size") // step))
        dealt = running(seqs, "size", "size", across=True, key="seq").select("seq", "size", F.pmod("at", F.lit(groups)).alias("step_group"))
        zero = F.lit(0).cast("long")
        pieces = full.select("key", zero.alias("skip"), "length", F.col("key").alias("seq"), zero.alias("offset")).unionByName(pieces)
        each = F.struct("skip", "length", "seq", "offset", "size", "step_group")
        placed = keep(pieces.join(dealt, "seq").groupBy("key").agg(F.sort_array(F.collect_list(each)).alias("pieces")))

    fields = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]

    def cut(batches):
        for b in batches:
            doc, out, data = [], [], []
            columns = [b.column(k).to_pylist() for k in range(1, 6)]
            for k, (tokens, start, crc, ids, found) in enumerate(zip(*columns, strict=True)):
                size = sum(p["length"] for p in found)
                values = None if ids is None else np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * size else "<u4").astype("<u4")
                joined: list[dict] = []
                for p in found:
                    last = joined[-1] if joined else None
                    if last and last["seq"] == p["seq"] and last["offset"] + last["length"] == p["offset"]:
                        last["length"] += p["length"]  # cut between two stretches only
                    else:
                        joined.append(p)
                for p in joined:
                    own = None if values is None else values[p["skip"]:p["skip"] + p["length"]].tobytes()
                    doc.append(k)
                    out.append((start + p["skip"], p["length"], zlib.crc32(own) if crc is None else crc, tokens, p["seq"], p["offset"], p["size"], p["step_group"]))
                    data.append(own)
            arrays = [pa.array([r[k] for r in out], pa.int64()) for k in range(len(fields))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), *arrays, *([pa.array(data, pa.binary())] if keep_ids else [])], names)

    names = ["doc_id", *fields, *(["ids"] if keep_ids else [])]
    kind = T.StructType([T.StructField("doc_id", parts.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in fields],
                         *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])
    return parts.join(placed, "key").select("doc_id", "doc_tokens", "start", "crc", "ids", "pieces").mapInArrow(cut, kind)
