"""Removal of long repeats: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Documents are dealt to ranges of ids. A range cuts its texts into segments: runs of 50-byte strings that share their
least 16-byte hash, which is the segments' key. Equal strings share it, so each string is looked at under one key only.

1. Every range sends each of its segments once, by key and digest, with short hashes of the 17 bytes on either side of the key's
   place. Segments of one key have a 50-byte string in common only if one of these agrees. A segment without such a
   relative is settled by its digest: the first range that has it owns it.
2. Related segments are sent, once per range. Those of a group of keys are indexed by the runs of their Burrows-Wheeler
   transform (see ``rindex``), whose matching statistics tell which of their strings are equal, and so the least document
   that has each. If very many ranges have relatives of a segment, its strings are sent one by one instead, dealt out by
   their own hashes, so that no task gets all texts around a frequent phrase.
3. The ranges mark the bytes.

A range never sends a segment or a string twice, however often its documents repeat it. The texts are shuffled once
and read in the three steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_edges
from .rindex import first_owners
from .shingles import _powers, mix

LENGTH, GRAM = 50, 16
RANGE_BYTES = 8 << 20
GROUP_BYTES = 32 << 20  # of text per group of keys
PART_BYTES = 1 << 18  # of segments indexed at a time
SCATTER = 1000  # related segments of a key, beyond which their strings are dealt out one by one
SIDE = (LENGTH - GRAM) // 2  # a string that holds the key's bytes has as many more on one side at least
CHUNK = 1 << 17  # its arrays stay in the processor's cache; a multiple of STRIDE
STRIDE = 4096  # segments end at multiples of this place in their text
NO_ID = np.iinfo(np.int64).max
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
NONE, ANY = 0, 0xFFFF  # in place of a side's hash: too few bytes there; the key's place isn't unique
EARLIER, OPEN, SCATTERED = 1, 2, 3


class Chunk:
    """Segments of some whole texts, or of a slice of a long one: key, name (from key and content), sides, document, first byte, end.

    ``starts``: the number of positions of the slice at which a string may begin.
    """

    def __init__(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, docs: np.ndarray, places: np.ndarray, starts: np.ndarray, sides: bool = False) -> None:
        self.data, n = data, len(data) - LENGTH + 1
        up, down = _powers(len(data) + 1)
        self._sums, self._down = np.zeros(len(data) + 1, dtype=np.uint64), down
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sums[1:])
        empty = np.zeros(0, dtype=np.int64)
        self.key = self.name = empty.astype(np.uint64)
        self.left = self.right = empty.astype(np.uint16)
        self.first = self.end = self.doc = empty
        if n <= 0:
            return
        p = data.astype(np.uint64)
        for width in (1, 2, 4):
            p = p[:-width] | p[width:] << np.uint64(8 * width)
        grams = least = mix(p[:-8] * _K1 ^ mix(p[8:] + _K2))  # of 16 bytes
        for width in (1, 2, 4, 8, 16):
            least = np.minimum(least[:-width], least[width:])
        least = np.minimum(least[:n], least[LENGTH - GRAM - 31:][:n])  # of the 35 that start in 50 bytes
        text = np.repeat(np.arange(len(begins)), ends - begins)[:n]
        at = np.arange(n)
        place = at - begins[text]
        good = (at + LENGTH <= ends[text]) & (place < starts[text])
        cut = np.ones(n, dtype=bool)
        cut[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ((place[1:] + places[text[1:]]) % STRIDE == 0) | ~good[:-1]
        first = np.flatnonzero(cut & good)
        if not first.size:
            return
        stop = np.flatnonzero(good & np.append(cut[1:] | ~good[1:], True))
        self.first, self.end, self.doc = first, stop + LENGTH, docs[text[first]]
        # spread evenly, as least hashes are small
        self.key = mix(least[first] ^ _K2)
        self.name = mix(self.key ^ self.hash(first, self.end))
        if not sides:
            return
        # the key's first and last place in the segment, among the places whose hash is the least of some string
        most, reach = least, LENGTH - GRAM
        for width in (1, 2, 4, 8, 16):
            most = np.maximum(most[:-width], most[width:]) if len(most) > width else most[:0]
        most = np.maximum(most[:-(reach - 31)], most[reach - 31:]) if len(most) > reach - 31 else most[:0]
        peak = np.zeros(len(grams), dtype=bool)
        peak[reach:reach + len(most)] = grams[reach:reach + len(most)] == most
        peak[:reach] = peak[reach + len(most):] = True  # the ends have fewer strings
        peak, value, places = np.flatnonzero(peak), least[first], []
        for at, step in ((np.searchsorted(peak, first), 1), (np.searchsorted(peak, stop + reach, side="right") - 1, -1)):
            todo = np.arange(len(first))
            while (todo := todo[grams[peak[at[todo]]] != value[todo]]).size:
                at[todo] += step
            places.append(peak[at])
        place, unsure = places[0], places[0] != places[1]
        for side, a in (("left", place - SIDE), ("right", place + GRAM)):
            there = (a >= first) & (a + SIDE <= self.end)
            a = np.where(there, a, 0)
            short = (self.hash(a, a + SIDE) % np.uint64(ANY - 1)).astype(np.uint16) + np.uint16(1)
            setattr(self, side, np.where(unsure, ANY, np.where(there, short, NONE)).astype(np.uint16))

    def hash(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[first]) * self._down[first] + (end - first).astype(np.uint64))

    def bytes(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.data[at]


def _chunks(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, sides: bool = False) -> Iterator[tuple[list[int], int, Chunk]]:
    """(texts, place of the first byte in its text, chunk); only a slice of a long text has another place than 0."""
    a, n = 0, len(ids)
    while a < n:
        size = int(offsets[a + 1] - offsets[a])
        if size > CHUNK:
            for place in range(0, size, CHUNK):
                stop = min(size, place + CHUNK + LENGTH - 1)
                yield [a], place, Chunk(data[offsets[a] + place:offsets[a] + stop], np.array([0]), np.array([stop - place]), ids[a:a + 1], np.array([place]), np.array([CHUNK]), sides)
            a += 1
            continue
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        b = a + 1 + next((k for k in range(b - a - 1) if offsets[a + 2 + k] - offsets[a + 1 + k] > CHUNK), b - a - 1)
        begins, ends = offsets[a:b] - offsets[a], offsets[a + 1:b + 1] - offsets[a]
        yield list(range(a, b)), 0, Chunk(data[offsets[a]:offsets[b]], begins, ends, ids[a:b], np.zeros(b - a, dtype=np.int64), ends - begins, sides)
        a = b


def _texts(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and ids of a range's texts; a null id is larger than any other."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from .shingles import arrow_bytes

    text = pc.fill_null(table["text"].cast(pa.large_string()), "").combine_chunks()
    ids = pc.fill_null(table["doc_id"], int(NO_ID)).to_numpy()
    data, offsets = arrow_bytes(text) if len(text) else (np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64))
    return data, offsets, ids


def _sorted_by(*parts: np.ndarray) -> np.ndarray:
    """An order by all of ``parts``, first most significant."""
    return np.lexsort(parts[::-1])


def _fresh(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    out = np.ones(len(values), dtype=bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _joined(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, end to end, and how many each row has."""
    parts = [np.frombuffer(v.as_buffer(), dtype=dtype) for v in column]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)), np.array([len(p) for p in parts], dtype=np.int64)


def _row_slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of a sorted array."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, dtype=np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _segments_of_range(buckets: int):
    """Step 1: every segment of a range once."""
    import pyarrow as pa

    def work(table):
        found = [(c.key, c.name, c.left, c.right) for _, _, c in _chunks(*_texts(table), sides=True)]
        key, name, left, right = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.uint16, np.uint16))
        pick = np.unique(name, return_index=True)[1]
        bucket = (key[pick] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pick, rows = pick[order], _row_slices(bucket[order])
        block = table["block"][0].as_py() if table.num_rows else 0
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
                         **{c: pa.array([v[pick[a:b]].tobytes() for _, a, b in rows], pa.binary()) for c, v in (("keys", key), ("names", name), ("lefts", left), ("rights", right))}})

    return work


def _settle(scatter: int):
    """Step 1, per group of keys: tell the ranges which of their segments are owned by an earlier range or have relatives."""
    import pyarrow as pa

    def work(table):
        key, sizes = _joined(table["keys"], np.uint64)
        name, left, right = (_joined(table[c], t)[0] for c, t in (("names", np.uint64), ("lefts", np.uint16), ("rights", np.uint16)))
        block = np.repeat(table["block"].to_numpy(), sizes)
        order = _sorted_by(key, name, block)
        key, name, left, right, block = key[order], name[order], left[order], right[order], block[order]
        fresh = _fresh(name)
        first = np.flatnonzero(fresh)  # of each different segment
        many = np.diff(np.append(first, len(name)))
        number = np.cumsum(_fresh(key[first])) - 1  # of its key
        related = np.zeros(len(first), dtype=bool)
        for side in (left[first], right[first]):
            by = _sorted_by(number, side)
            twin = (number[by][1:] == number[by][:-1]) & (side[by][1:] == side[by][:-1]) & (side[by][1:] != NONE)
            related[by[1:][twin]] = related[by[:-1][twin]] = True
        keys = int(number[-1]) + 1 if len(number) else 0
        unsure = np.bincount(number, weights=left[first] == ANY, minlength=keys) > 0
        several = np.bincount(number, minlength=keys) > 1
        related |= (unsure & several)[number]
        crowd = np.bincount(number, weights=related * many, minlength=keys)[number] if keys else np.zeros(0)
        per = np.where(related, np.where(crowd > scatter, SCATTERED, OPEN), np.where(many > 1, EARLIER, 0)).astype(np.uint8)
        says = np.repeat(per, many)
        says[first[per == EARLIER]] = 0
        told = np.flatnonzero(says)
        told = told[np.argsort(block[told], kind="stable")]
        rows = _row_slices(block[told])
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([name[told[a:b]].tobytes() for _, a, b in rows], pa.binary()),
                         "says": pa.array([says[told[a:b]].tobytes() for _, a, b in rows], pa.binary())})

    return work


def _told(table) -> tuple[np.ndarray, np.ndarray]:
    """Names, sorted, and what was said of each."""
    keys, _ = _joined(table["keys"], np.uint64)
    says, _ = _joined(table["says"], np.uint8)
    order = np.argsort(keys)
    return keys[order], says[order]


def _find(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Where each value is in ``sorted_keys``, or -1."""
    if not len(sorted_keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == values, at, -1)


def _open_parts(c: Chunk, keys: np.ndarray, says: np.ndarray):
    """Name, key of the group, document, first byte and size of what a chunk must ask about; and the segment it belongs to."""
    at = _find(c.name, keys)
    said = np.where(at >= 0, says[np.maximum(at, 0)] if len(says) else 0, 0)
    whole, apart = np.flatnonzero(said == OPEN), np.flatnonzero(said == SCATTERED)
    count = c.end[apart] - c.first[apart] - LENGTH + 1
    segment = np.repeat(apart, count)
    first = np.repeat(c.first[apart] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    own = c.hash(first, first + LENGTH)
    return (np.concatenate([c.name[whole], own]), np.concatenate([c.key[whole], own]), np.concatenate([c.doc[whole], c.doc[segment]]),
            np.concatenate([c.first[whole], first]), np.concatenate([c.end[whole] - c.first[whole], np.full(len(first), LENGTH)]), said)


def _open_segments(buckets: int):
    """Step 2: the segments with relatives, each once, with the least document that has it."""
    import pyarrow as pa

    def work(key, texts, replies):
        keys, says = _told(replies)
        wanted = keys[says >= OPEN]
        names, groups, docs, sizes, parts = [], [], [], [], []
        if len(wanted):
            for _, _, c in _chunks(*_texts(texts)):
                name, group, doc, first, size, _ = _open_parts(c, keys, says)
                order = _sorted_by(name, doc)
                pick = order[_fresh(name[order])]
                names.append(name[pick])
                groups.append(group[pick])
                docs.append(doc[pick])
                sizes.append(size[pick])
                parts.append(c.bytes(first[pick], size[pick]))
        if not sum(map(len, names)):
            rows = []
        else:
            name, group, doc, size, data = (np.concatenate(x) for x in (names, groups, docs, sizes, parts))
            begin = np.cumsum(size) - size
            order = _sorted_by(name, doc)
            pick = order[_fresh(name[order])]
            bucket = (group[pick] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            pick, rows = pick[by], _row_slices(bucket[by])
            name, group, doc, size, begin = name[pick], group[pick], doc[pick], size[pick], begin[pick]
            data = data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            ends = np.concatenate([[0], np.cumsum(size)])
        block = key[0].as_py()
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
            "names": pa.array([name[a:b].tobytes() for _, a, b in rows], pa.binary()), "groups": pa.array([group[a:b].tobytes() for _, a, b in rows], pa.binary()), "docs": pa.array([doc[a:b].astype(np.int64).tobytes() for _, a, b in rows], pa.binary()),
            "sizes": pa.array([size[a:b].astype(np.int64).tobytes() for _, a, b in rows], pa.binary()), "data": pa.array([data[ends[a]:ends[b]].tobytes() for _, a, b in rows], pa.binary())})

    return work


def _resolve(table):
    """Step 2, per group of keys: the least owner of every string, as runs (name, from, to, owner) for the range that asked."""
    import pyarrow as pa

    name, counts = _joined(table["names"], np.uint64)
    group, _ = _joined(table["groups"], np.uint64)
    doc, _ = _joined(table["docs"], np.int64)
    size, _ = _joined(table["sizes"], np.int64)
    data, _ = _joined(table["data"], np.uint8)
    block = np.repeat(table["block"].to_numpy(), counts)
    schema = {"block": pa.int32(), "names": pa.binary(), "spans": pa.binary()}
    if not len(name):
        return pa.table({k: pa.array([], t) for k, t in schema.items()})
    # equal segments of several ranges are indexed once, for their least document
    order = _sorted_by(group, name, doc)
    fresh = _fresh(name[order])
    one, which = order[fresh], np.empty(len(name), dtype=np.int64)
    which[order] = np.cumsum(fresh) - 1
    begin, some = np.cumsum(size) - size, size[one]
    base = np.cumsum(some) - some
    # some keys at a time, as many as have PART_BYTES
    new = np.flatnonzero(_fresh(group[one]))
    edges = new[_fresh(base[new] // PART_BYTES)]
    spans, of = [], []
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(one)], strict=True):
        part, n = one[lo:hi], some[lo:hi]
        at = np.cumsum(n) - n
        owner = first_owners(data[np.repeat(begin[part] - at, n) + np.arange(int(n.sum()))], n, doc[part], LENGTH)
        string = np.repeat(np.arange(len(part)), n)
        change = (owner[1:] != owner[:-1]) | (string[1:] != string[:-1])
        full = np.repeat(at + n, n) - np.arange(len(owner)) >= LENGTH
        start, stop = np.flatnonzero(full & np.append(True, change)), np.flatnonzero(full & np.append(change | ~full[1:], True)) + 1
        spans.append(np.stack([start - at[string[start]], stop - at[string[start]], owner[start]], axis=1))
        of.append(string[start] + lo)
    spans, of = np.concatenate(spans), np.concatenate(of)
    runs = np.bincount(of, minlength=len(one))
    first_run = np.cumsum(runs) - runs
    # every asker gets the runs of its segment
    by = np.argsort(block, kind="stable")
    many = runs[which[by]]
    asked = np.repeat(by, many)
    run = np.repeat(first_run[which[by]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    keep = spans[run, 2] != doc[asked]  # else the asker knows the owner
    asked, spans = asked[keep], spans[run[keep]]
    rows = _row_slices(block[asked])
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "names": pa.array([name[asked[a:b]].tobytes() for _, a, b in rows], pa.binary()),
                     "spans": pa.array([np.ascontiguousarray(spans[a:b]).tobytes() for _, a, b in rows], pa.binary())})


def _mark(keep_text: bool):
    """Step 3: the bytes to remove from a range's texts."""
    import pyarrow as pa

    def work(key, texts, replies):
        first_kind, second = replies.filter(pa.compute.is_valid(replies["keys"])), replies.filter(pa.compute.is_valid(replies["names"]))
        keys, says = _told(first_kind)
        name, _ = _joined(second["names"], np.uint64)
        spans = _joined(second["spans"], np.int64)[0].reshape(-1, 3)
        order = np.argsort(name, kind="stable")
        name, spans = name[order], spans[order]
        data, offsets, ids = _texts(texts)
        found = []  # of each chunk: first byte, what it asked about, its other segments
        for some, place, c in _chunks(data, offsets, ids):
            *parts, said = _open_parts(c, keys, says)
            own = np.flatnonzero(said <= EARLIER)
            found.append((int(offsets[some[0]]) + place, parts, c.name[own], c.doc[own], c.first[own], c.end[own], said[own]))
        # the least document of the range that has each segment or string
        segment = np.concatenate([x for f in found for x in (f[1][0], f[2])]) if found else np.zeros(0, dtype=np.uint64)
        doc = np.concatenate([x for f in found for x in (f[1][2], f[3])]) if found else np.zeros(0, dtype=np.int64)
        order = _sorted_by(segment, doc)
        segment, doc = segment[order], doc[order]
        new = _fresh(segment)
        segment, least = segment[new], doc[new]
        ends = np.zeros(len(data) + 1, dtype=np.int32)
        for base, (name_, _, doc_, first_, size_), own, own_doc, own_first, own_end, said in found:

            def remove(first, last, base=base):
                np.add.at(ends, base + first, 1)
                np.add.at(ends, base + last, -1)

            gone = (said == EARLIER) | (own_doc > least[_find(own, segment)] if len(own) else False)
            remove(own_first[gone], own_end[gone])
            # strings without a span are owned by the range's least document that has them
            at = np.searchsorted(name, name_)
            many = np.searchsorted(name, name_, side="right") - at
            later = np.flatnonzero(doc_ > least[_find(name_, segment)]) if len(name_) else np.zeros(0, dtype=np.int64)
            remove(first_[later], first_[later] + size_[later])
            of = np.repeat(np.arange(len(name_)), many)
            k = np.repeat(at - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            hit = spans[k, 2] < doc_[of]
            remove(first_[of[hit]] + spans[k[hit], 0], first_[of[hit]] + spans[k[hit], 1] + LENGTH - 1)
        gone = np.cumsum(ends[:-1]) > 0
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            g = gone[a:b]
            kept = data[a:b][~g].tobytes()
            starts = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            out.append((b - a, int(g.sum()), starts, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
        return pa.table({"doc_id": texts["doc_id"], "n_bytes": pa.array([o[0] for o in out], pa.int64()), "n_removed": pa.array([o[1] for o in out], pa.int64()),
                         "n_spans": pa.array([o[2] for o in out], pa.int64()), "kept_sha256": pa.array([o[3] for o in out], pa.string()), "kept": pa.array([o[4] for o in out], pa.binary())})

    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True,
                   range_bytes: int = RANGE_BYTES, scatter: int = SCATTER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the bytes that stay) of every row.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id (an integer); strings don't
    cross documents, and are judged on the input. Of equal documents all but the first go wholly, if they have 50
    bytes. Null texts count as empty; shorter texts lose nothing. Rows with equal ids don't remove each other's strings; null
    ids are larger than any other. Cuts may fall inside a character, so what is left is given as bytes. Other columns are
    ignored; no rows give no rows.
    """
    import pyarrow as pa

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    edges = block_edges(rows, range_bytes)
    n = len(edges) + 1
    buckets = max(1, n * range_bytes // GROUP_BYTES)

    def deal(batches):
        import pyarrow.compute as pc

        for b in batches:
            ids = pc.fill_null(b.column(0), int(NO_ID)).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, ids, side="right"), pa.int32()), *b.columns], ["block", "doc_id", "text"])

    texts = rows.mapInArrow(deal, "block int, doc_id long, text string").repartition(n, "block")
    sent = texts.groupBy("block").applyInArrow(
        _segments_of_range(buckets), "bucket int, block int, keys binary, names binary, lefts binary, rights binary")
    settled = sent.groupBy("bucket").applyInArrow(_settle(scatter), "block int, keys binary, says binary")
    asked = texts.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(
        _open_segments(buckets), "bucket int, block int, names binary, groups binary, docs binary, sizes binary, data binary")
    owners = asked.groupBy("bucket").applyInArrow(_resolve, "block int, names binary, spans binary")
    none = F.lit(None).cast("binary")
    replies = settled.select("block", "keys", "says", none.alias("names"), none.alias("spans")).unionByName(
        owners.select("block", none.alias("keys"), none.alias("says"), "names", "spans"))
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _mark(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
