"""Near-duplicates by HyperMinHash: banded compressed registers, an estimate, then a check on the full sets.

A text's shingle set is hashed into 128 buckets. The register of a bucket holds the number of leading zeros of its smallest hash
and the ten bits after them. Texts that agree in a band of a few registers are candidates. Bands have four registers, or fewer if the
similarity asked for is low: a pair at the limit misses all bands with a probability below 1e-7 (5e-11 at 0.85, 5e-8 at 0.8).
Candidates whose estimated similarity, corrected for registers that agree by chance, is far below the limit are dropped (six
standard errors); the rest is decided on the full sets.

Equal sets are one node. In a round (or more), the nodes of every band bucket are compared with one of them, another one each
round and bucket, which joins nearly all that belong together at a cost in proportion to the buckets' members. What remains are
pairs of a bucket that lie in different components. These are compared inside the tasks, block by block, each in the first
bucket that the pair shares: by their registers first, then by the sets cut to a few bits a shingle, which can only overstate
what two sets have in common. The few pairs left leave the tasks and are decided on the full sets. Buckets with very many
members are split by a second band first, which a pair above the limit shares all but surely (2e-9 at 0.85, 1e-6 at 0.8).
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.links import components
from tarn.session import few_tasks, gathered, small_batches, store, temporary

from .common import ascii_lower, cache_of, keyed, one_of_each, positions, release
from .shingles import arrow_bytes, mix, shingle_sets

BUCKETS, MANTISSA = 128, 10
EMPTY = 0xFFFF
GROUPED, REMOVED = 0.85, 0.8  # similarities of near_groups and keep_one, unless told otherwise
MISSED = 1e-7  # probability that a pair at the limit shares no band, at most
ROUNDS = 1
BLOCK = 500_000  # shingles of the nodes that a task compares with each other or with another block
CROWDED = 5000  # members of a bucket beyond which a second band splits it
SIGMAS = 5
NARROW = 1024  # shingles up to which a cut set has 16 bits a shingle; larger ones have 32
BATCH = 1000  # rows that a Python task is given at once: each may hold two whole sets
NAMED = 500_000  # rows of (node, digest, id) that are broadcast; more are joined by shuffling


def registers(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """HyperMinHash registers of a sorted set."""
    out = np.full(buckets, EMPTY, dtype=np.uint16)
    bits = buckets.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    at, first = np.unique(bucket, return_index=True)
    rest = (hashes[first] << np.uint64(bits)) >> np.uint64(11)  # 53 bits: exact as doubles
    size = np.frexp(rest.astype(np.float64))[1]
    shift = size - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out[at] = ((53 - size).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarities from rows of registers of sets of n and m members, and the number of registers each rests on."""
    some = (a != EMPTY) | (b != EMPTY)
    used = some.sum(axis=1)
    same = ((a == b) & some).sum(axis=1)
    both = ((a != EMPTY) & (b != EMPTY)).sum(axis=1)
    # registers of different minima agree if both have the same zeros and mantissa: for sets of like size, about 2 in 3 * 2^MANTISSA
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = both / np.maximum(used, 1) * ratio * (2 / 3) / (1 << MANTISSA)
    found = same / np.maximum(used, 1)
    return np.clip((found - chance) / (1 - chance), 0, 1), used


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the set) and registers of every row."""
    import pyarrow as pa

    def work(batches):
        cache_of("near_dedup")
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sizes, ids, regs = [], [], []
                for s in shingle_sets(*arrow_bytes(ascii_lower(b.column(1)))):
                    sizes.append(len(s))
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                    regs.append(registers(s).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(ids), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "set_id", "regs"])
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_shingles long, set_id string, regs binary")


def band_rows(limit: Fraction) -> int:
    """Registers of a band: the most that let hardly any pair at the limit miss all bands."""
    for rows in (4, 2, 1):
        if (1 - float(limit) ** rows) ** (BUCKETS // rows) <= MISSED:
            return rows
    raise ValueError(f"{BUCKETS} registers can't find pairs of similarity {float(limit)}")


def _bands(nodes: DataFrame, width: int) -> DataFrame:
    """(key, band, node, n): a row for each band of a node that isn't all empty."""
    import pyarrow as pa

    def work(batches):
        cache_of("near_dedup")
        for b in batches:
            node, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            regs = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint16).reshape(len(node), -1, width)
            key = mix(np.broadcast_to(np.arange(regs.shape[1], dtype=np.uint64) + np.uint64(1), regs.shape[:2]).copy())
            for r in range(width):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r].astype(np.uint64))
            row, band = np.nonzero((regs != EMPTY).any(axis=2))
            yield pa.RecordBatch.from_arrays([pa.array(key[row, band].view(np.int64)), pa.array(band, pa.int32()), pa.array(node[row]), pa.array(n[row])], ["key", "band", "node", "n"])

    return nodes.select("node", "n", "regs").mapInArrow(work, "key long, band int, node long, n long")


def _close(near: np.ndarray, used: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether an estimate isn't far below the limit. Registers sample the union without replacement, so their errors are those of
    a binomial, less the share of the union that is sampled."""
    limit, used = float(similarity), np.maximum(used, 1)
    rest = np.clip(1 - used * (1 + limit) / np.maximum(n + m, 1), 0, 1)
    return near >= limit - SIGMAS * np.sqrt(limit * (1 - limit) / used * rest) - 1.5 / used


def _fits(n: str, m: str, limit: Fraction):
    """Sets of these sizes can be as similar as asked."""
    return F.least(n, m) * limit.denominator >= F.greatest(n, m) * limit.numerator


def _likely(pairs: DataFrame, nodes: DataFrame, limit: Fraction) -> DataFrame:
    """The pairs (a, b) whose estimated similarity isn't far below the limit."""
    import pyarrow as pa

    def work(batches):
        cache_of("near_dedup")
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) for c in ("ra", "rb"))
            sizes = b.column("na").to_numpy(), b.column("nb").to_numpy()
            keep = _close(*estimate(x, y, *sizes), *sizes, limit)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    return gathered(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ra", "rb")).mapInArrow(work, "a long, b long")


def _across(members: DataFrame, nodes: DataFrame, sets: DataFrame, block: int, limit: Fraction) -> DataFrame:
    """Pairs (a, b) of a bucket's members (key, band, node, label, shingles) that have different labels and may be linked.

    All links are among them, and hardly anything else. ``shingles``: of all members together. ``band`` is null in buckets
    made by two bands. ``sets``: (node, members) with cut sets.
    """
    import pyarrow as pa

    width = band_rows(limit)

    def compare(table):
        node, n, label, part = (table[c].to_numpy() for c in ("node", "n", "label", "part"))
        band = table["band"][0].as_py()
        cross = table["low"][0].as_py() != table["high"][0].as_py()
        order = np.argsort(n, kind="stable")
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), dtype=np.uint16).reshape(len(node), -1)[order]
        cut = [np.frombuffer(v.as_buffer(), dtype=_width(s)) for v, s in zip(table["members"], n.tolist(), strict=True)]
        node, n, label, part = node[order], n[order], label[order], part[order]
        stop = np.searchsorted(n * limit.numerator, n * limit.denominator, side="right")
        found = []
        for i in range(len(node)):
            j = np.arange(i + 1, stop[i])
            j = j[(label[j] != label[i]) & (node[j] != node[i]) & ((part[j] != part[i]) | (not cross))]
            if j.size:
                j = j[_close(*estimate(regs[i][None, :], regs[j], n[i], n[j]), n[i], n[j], limit)]
            if j.size and band is not None:  # a pair belongs to the first bucket that it shares
                same = regs[i].reshape(1, -1, width) == regs[j].reshape(len(j), -1, width)
                shared = same.all(axis=2) & (regs[i].reshape(1, -1, width) != EMPTY).any(axis=2)
                j = j[shared.argmax(axis=1) == band]
            found += [(min(node[i], node[k]), max(node[i], node[k])) for k in j.tolist() if _enough(_most_common(cut[order[i]], cut[order[k]], n[i], n[k]), n[i], n[k], limit)]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    blocks = F.ceil(F.col("shingles") / block).cast("int")
    dealt = members.withColumn("part", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", "band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "label")
    return (dealt.join(nodes.select("node", "n", "regs").join(sets, "node"), "node").groupBy("key", "low", "high")
            .applyInArrow(compare, "a long, b long").distinct())


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return len(x) + len(y) - len(np.unique(np.concatenate([x, y])))


def _enough(common: int, n: int, m: int, limit: Fraction) -> bool:
    return limit.denominator * common >= limit.numerator * (n + m - common)


def _alike(x: np.ndarray, y: np.ndarray, limit: Fraction) -> bool:
    return _enough(_common(x, y), len(x), len(y), limit)


def _width(n: int) -> type:
    return np.uint16 if n <= NARROW else np.uint32


def _cut(s: np.ndarray) -> np.ndarray:
    """A set with the low bits of its hashes only."""
    return np.unique(s.astype(_width(len(s))))


def _most_common(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """What sets of n and m members have in common at most, from their cut sets: members of both that fell together when cut
    did so in either set."""
    if x.dtype != y.dtype:
        x, y = (np.unique(z.astype(np.uint16)) for z in (x, y))
    return _common(x, y) + min(n - len(x), m - len(y))


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, form=lambda s: s) -> DataFrame:
    """(node, members) of the nodes asked for, worked out from the texts again; ``form`` makes the members of a full set."""
    import pyarrow as pa

    def members(batches):
        cache_of("near_dedup")
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                sets = list(shingle_sets(*arrow_bytes(ascii_lower(b.column("text")))))
                own = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() == i for s, i in zip(sets, b.column("set_id").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([form(s).tobytes() for s in sets], pa.binary())], ["node", "members"]).filter(pa.array(own, pa.bool_()))
        release()

    named = store(nodes.join(asked, "node").select("node", "set_id", F.col("first_id").alias("id_")))
    if named.count() <= NAMED:
        named = F.broadcast(named)
    # an id may name more than one text: the digest tells which row is meant
    texts = docs.join(named, F.col("doc_id").eqNullSafe(F.col("id_"))).select("node", "set_id", "text")
    return store(texts.mapInArrow(members, "node long, members binary").dropDuplicates(["node"]))


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, limit: Fraction) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""
    import pyarrow as pa

    def decide(batches):
        cache_of("near_dedup")
        for b in batches:
            keep = [_alike(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in xy), limit) for xy in zip(b.column("ma"), b.column("mb"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    sets = _sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), nodes, docs)
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b"))
    return gathered(both.select("a", "b", "ma", "mb")).mapInArrow(decide, "a long, b long")


def _to_pivots(labelled: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, limit: Fraction) -> DataFrame:
    """Links (a, b) between a bucket's members and the one of them that round ``k`` picks, where labels differ."""
    each = F.struct(F.xxhash64("node", "key", F.lit(k)), "node", "n", "label")
    pivots = labelled.groupBy("key").agg(F.min(each).alias("p"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    pivots = store(pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("m"), F.col("p.label").alias("other")))
    pairs = labelled.join(pivots, "key").filter((F.col("label") != F.col("other")) & _fits("n", "m", limit))
    pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    return _linked(store(_likely(pairs, nodes, limit)), nodes, docs, limit)


def _meeting(labelled: DataFrame, bucketed: DataFrame, crowded: int) -> DataFrame:
    """Members (key, band, node, label, shingles) of the buckets that still have different labels, stored."""
    apart = store(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key"))
    open_ = store(labelled.join(apart, "key").select("key", "band", "node", "n", "label", "members", "shingles"))
    # the members of a crowded bucket meet only where they share another bucket as well
    other = bucketed.select(F.col("key").alias("key2"), "node")
    split = open_.filter(F.col("members") > crowded).join(other, "node").filter("key <> key2").select(
        F.xxhash64(F.least("key", "key2"), F.greatest("key", "key2")).alias("key"), F.lit(None).cast("int").alias("band"), "node", "n", "label").distinct()
    counts = split.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).filter("members > 1").drop("members")
    return store(open_.filter(F.col("members") <= crowded).select("key", "band", "node", "label", "shingles").unionByName(
        split.join(counts, "key").select("key", "band", "node", "label", "shingles")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = GROUPED,
                rounds: int = ROUNDS, block: int = BLOCK, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a set has the different runs of five words, or
    all words as one if there are fewer. Two texts are linked if their sets' Jaccard similarity is at least ``similarity``. A text that is
    null or has no word has an empty set and is linked with nothing: it is its own component. A component's id is its
    smallest doc_id (an integer). Rows that repeat an id count each with their own text; null ids are larger than any other, and
    a component with null ids only has the id null and keeps all its rows. Other columns are ignored; no rows give no rows.
    """
    limit = Fraction(str(similarity))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with temporary(docs.sparkSession) as keep, small_batches(docs.sparkSession, BATCH):
        known = keep(sketch(rows))
        with few_tasks(docs.sparkSession, known.count()):
            classes = known.filter("n_shingles > 0").groupBy("set_id").agg(
                F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.max("regs").alias("regs"), F.count("*").alias("rows"))
            with temporary(docs.sparkSession) as hold:
                nodes = hold(positions(classes, F.col("first_id").asc_nulls_last(), F.col("set_id")).withColumnRenamed("at", "node"))
            with temporary(docs.sparkSession) as hold:
                bands = store(_bands(nodes, band_rows(limit)))
                shared = bands.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).filter("members > 1")
                # only buckets of two and more matter from here on
                bucketed = hold(bands.join(store(shared), "key"))

            links = labels = None
            labelled = bucketed.withColumn("label", F.col("node"))
            for k in range(rounds):
                with temporary(docs.sparkSession) as hold:
                    more = hold(_to_pivots(labelled, nodes, rows, k, limit))
                if more.isEmpty():
                    break
                links = more if links is None else links.unionByName(more)
                labels = components(links)
                labelled = store(bucketed.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
            with temporary(docs.sparkSession) as hold:
                meeting = _meeting(labelled, bucketed, crowded)
                pairs = store(_across(meeting, nodes, _sets(meeting.select("node").distinct(), nodes, rows, _cut), block, limit))
                more = hold(_linked(pairs, nodes, rows, limit))
            if labels is None or not more.isEmpty():
                labels = components(more if links is None else links.unionByName(more))

            smallest = nodes.select(F.col("node").alias("label"), F.col("first_id").alias("component_id"))
            grouped = keep(nodes.join(labels, "node", "left").filter("label IS NOT NULL OR rows > 1")
                           .select("set_id", F.coalesce("label", "node").alias("label")).join(smallest, "label").select("set_id", "component_id", F.lit(True).alias("in_group")))
    found = known.select("doc_id", "n_shingles", "set_id").join(grouped, "set_id", "left")
    own = F.when(F.col("in_group"), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = REMOVED) -> DataFrame:
    """One row of each component, with all its columns.

    It is the row with the smallest id, null being larger than any other; of rows with equal ids, any. Rows are told apart by
    themselves, not by their ids: of a repeated id's rows with different texts, each belongs to its own component.
    """
    rows, key = keyed(docs)
    groups = near_groups(rows, key, text_col, similarity).select(F.col("doc_id").alias(key), F.col("component_id").alias("group"))
    return one_of_each(rows, key, id_col, groups, largest=False)
