"""How many near partners every item has and which class it belongs to, without a row for any pair; and the near pairs themselves.

Items are packed into blocks of bounded size, one row each. Every two blocks meet in a task, which reads both of them: their
overlaps are a matrix there, and only the items' numbers of links leave the task, with as many links between classes of the two
blocks as connect what they connect. Overlaps take time for every pair of blocks, but no pair of items is ever written. Where the pairs
are asked for, the near ones leave the task as they are found, a strip of the matrix at a time: none is shuffled or stored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import on_demand, store, temporary

ITEMS = 4096  # items of a block, at most
CELLS = 1_000_000  # cells of a block, unless a single item has more
BITS = 20  # of an item's number within its block
DENSE = 0.25  # a key shared by more than this part of two blocks' pairs is taken as a column of all items
OUTER = 1000  # pairs at a key from which it is worth a step of its own
STRIP = 128  # items of one block that meet the dense columns at once
EVEN = 1e-9  # a distance this far above the limit is at it: sums are added in any order
MET = 2_000_000  # pairs at keys that are listed at once
CUTS = (0.5,)  # where the values at dense columns are parted for a bound of their overlaps
FEW = 0.1  # part of a strip's pairs up to which those that the bound leaves are worked out one by one


class _Block(NamedTuple):
    """Items by their sums, and their cells by key."""

    total: np.ndarray
    key: np.ndarray
    who: np.ndarray
    value: np.ndarray


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin, and their lengths."""
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return at, np.diff(at, append=len(keys))


def _overlaps(x: _Block, y: _Block, share: float) -> Iterator[tuple]:
    """``(rows, columns, s)``: overlaps of items of ``x`` (rows) and ``y``, one by one (arrays of equal lengths) or as a matrix (slices).

    Left out are pairs that share nothing, and such as can't have an overlap of ``share`` of both sums: those whose sums differ too much, and
    mostly those whose bound by dense columns (a matrix product) is too small.
    """
    size = len(x.total), len(y.total)
    (ax, nx), (ay, ny) = _runs(x.key), _runs(y.key)
    _, i, j = np.intersect1d(x.key[ax], y.key[ay], assume_unique=True, return_indices=True)
    ax, nx, ay, ny = ax[i], nx[i], ay[j], ny[j]
    work = nx * ny
    dense, light = work > DENSE * size[0] * size[1], work <= OUTER

    def listed():
        at = np.flatnonzero(light & ~dense)
        upto = np.cumsum(work[at])
        for part in np.split(at, np.searchsorted(upto, np.arange(MET, upto[-1] if len(at) else 0, MET))):
            of = np.repeat(part, work[part])
            row, column = np.divmod(np.arange(len(of)) - np.repeat(np.cumsum(work[part]) - work[part], work[part]), ny[of])
            row, column = row + ax[of], column + ay[of]
            yield x.who[row].astype(np.int64) * size[1] + y.who[column], np.minimum(x.value[row], y.value[column])

    if light.all() and not dense.any() and work.sum() <= min(MET, size[0] * size[1] // 16):  # few pairs share anything
        for code, least in listed():
            code, at = np.unique(code, return_inverse=True)
            yield *np.divmod(code, size[1]), np.bincount(at, least, len(code))
        return

    sums = np.zeros(size if not dense.all() else (0, 0))
    for code, least in listed():
        np.add.at(sums.reshape(-1), code, least)
    for k in np.flatnonzero(~light & ~dense):
        own, other = slice(ax[k], ax[k] + nx[k]), slice(ay[k], ay[k] + ny[k])
        sums[np.ix_(x.who[own], y.who[other])] += np.minimum.outer(x.value[own], y.value[other])
    columns = [np.zeros((int(dense.sum()), len(b.total))) for b in (x, y)]
    for b, into, at, n in zip((x, y), columns, (ax[dense], ay[dense]), (nx[dense], ny[dense])):
        for k in range(len(at)):
            into[k, b.who[at[k]:at[k] + n[k]]] = b.value[at[k]:at[k] + n[k]]
    roots = [_roots(c, levels).astype(np.float32) for levels in [np.quantile(columns[0][columns[0] > 0], CUTS)] for c in columns] if dense.any() else columns
    enough = share * (1 - 1e-4 - 2e-7 * len(roots[0]))  # single precision: bounds are a little too small
    ratio = share / (1 - share) * (1 - 1e-6)  # sums that differ by more can't overlap enough
    for top in range(0, size[0], STRIP):
        rows = slice(top, min(top + STRIP, size[0]))
        met = slice(np.searchsorted(y.total, x.total[rows.start] * ratio), np.searchsorted(y.total, x.total[rows.stop - 1] / ratio, "right"))
        s = sums[rows, met] if len(sums) else np.zeros((rows.stop - rows.start, met.stop - met.start))
        if dense.any():
            most = roots[0][:, rows].T @ roots[1][:, met]
            if len(sums):
                most += s
            row, column = np.nonzero(most >= enough * (x.total[rows, None] + y.total[met]).astype(np.float32))
            if len(row) <= s.size * FEW:
                s, row, column = s[row, column], row + rows.start, column + met.start
                for own, other in zip(*columns):
                    s += np.minimum(own[row], other[column])
                yield row, column, s
                continue
        least = np.empty(s.shape)
        for own, other in zip(*columns):
            s += np.minimum(own[rows, None], other[met], out=least)
        yield rows, met, s


def _roots(columns: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Vectors whose products are at least the sums of the smaller values: roots of the values' parts between the levels, as
    ``min(u, v) <= sqrt(u * v)``."""
    ends = np.append(levels, np.inf)
    return np.concatenate([np.sqrt(np.clip(columns, low, high) - low) for low, high in zip(np.insert(levels, 0, 0.0), ends)])


def _distances(x: _Block, y: _Block, distance: Callable, share: float) -> Iterator[tuple]:
    """``(rows, columns, d)`` as of ``_overlaps``."""
    for rows, columns, s in _overlaps(x, y, share):
        total = x.total[rows, None] if isinstance(rows, slice) else x.total[rows]
        yield rows, columns, distance(s, total + y.total[columns])


def _near(x: _Block, y: _Block, distance: Callable, within: float, share: float) -> np.ndarray:
    """Which items of ``x`` (rows) and ``y`` are at most ``within`` apart."""
    near = np.zeros((len(x.total), len(y.total)), dtype=bool)
    for rows, columns, d in _distances(x, y, distance, share):
        near[rows, columns] = d <= within + EVEN
    return near


def _labels(near: np.ndarray) -> np.ndarray:
    """The smallest item that each one is connected with, from a symmetric matrix."""
    label, open_ = np.arange(len(near)), np.ones(len(near), dtype=bool)
    for start in range(len(near)):
        if not open_[start]:
            continue
        open_[start], todo = False, [start]
        while todo:
            more = np.flatnonzero(near[todo.pop()] & open_)
            open_[more], label[more] = False, start
            todo += more.tolist()
    return label


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of as many links as connect what a matrix between two sides connects."""
    if np.count_nonzero(near) < sum(near.shape):
        return np.nonzero(near)
    sides, rows, columns = (near, np.ascontiguousarray(near.T)), [], []
    open_ = [np.ones(n, dtype=bool) for n in near.shape]
    for start in range(len(near)):
        todo = [(0, start)] if open_[0][start] else []
        open_[0][start] = False
        while todo:
            side, at = todo.pop()
            more = np.flatnonzero(sides[side][at] & open_[1 - side])
            open_[1 - side][more] = False
            rows.append(more if side else np.full(len(more), at))
            columns.append(np.full(len(more), at) if side else more)
            todo += [(1 - side, k) for k in more.tolist()]
    return np.concatenate(rows), np.concatenate(columns)


def _contracted(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows and columns that are linked, as few pairs as connect the same."""
    if np.count_nonzero(near) < sum(near.shape):
        rows, columns = np.nonzero(near)
        pairs = np.unique(np.stack([left[rows], right[columns]]), axis=1)
        return pairs[0], pairs[1]
    for axis, label in enumerate((left, right)):
        order = np.argsort(label, kind="stable")
        near = np.logical_or.reduceat(near.take(order, axis), _runs(label[order])[0], axis=axis)
    rows, columns = _forest(near)
    return np.unique(left)[rows], np.unique(right)[columns]


def _packer(near_of: Callable[[_Block], np.ndarray] | None, items: int, cells: int):
    """Packs a partition's rows (item, key, value), which lie together by item, into blocks, with the links inside them by ``near_of``."""
    import pyarrow as pa
    from pyspark import TaskContext

    def block(number: int, rows: pa.Table):
        names = rows.column("item").combine_chunks().dictionary_encode()
        who, n = names.indices.to_numpy(zero_copy_only=False), len(names.dictionary)
        held = rows.column("key").is_valid().to_numpy()
        key, value = (rows.column(c).filter(pa.array(held)).to_numpy() for c in ("key", "value"))
        who = who[held].astype(np.int64)
        total = np.bincount(who, value, n)
        order = np.argsort(total, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        by_key = np.lexsort((place[who], key))
        made = _Block(total[order], key[by_key], place[who][by_key].astype(np.int32), value[by_key])
        one = lambda a, kind: pa.array([a.tolist() if isinstance(a, pa.Array) else a], pa.list_(kind))
        inside = {}
        if near_of:
            near = near_of(made)
            np.fill_diagonal(near, False)
            inside = {"label": one(_labels(near).astype(np.int32), pa.int32()), "links": one(near.sum(axis=1), pa.int64())}
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([number], pa.int64()), "item": one(names.dictionary.take(pa.array(order)), names.dictionary.type), **inside}
            | {f: one(a, k) for f, a, k in zip(_Block._fields, made, (pa.float64(), pa.int64(), pa.int32(), pa.float64()))})

    def pack(batches):
        number, waiting = TaskContext.get().partitionId() << BITS, []

        def full(last: bool):
            nonlocal number, waiting
            rows = pa.Table.from_batches(waiting)
            starts = np.flatnonzero(np.diff(rows.column("item").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), prepend=-1))
            ends, begun, done = np.append(starts[1:], len(rows)), 0, 0
            complete = len(starts) - (not last)  # more of the last item may follow
            while begun < complete:
                until = min(begun + items, complete, max(int(np.searchsorted(ends, done + cells, "right")), begun + 1))
                if until == complete and not last and until - begun < items and ends[until - 1] - done < cells:
                    break
                yield block(number, rows.slice(done, ends[until - 1] - done))
                number, begun, done = number + 1, until, int(ends[until - 1])
            waiting = rows.slice(done).to_batches()

        names = rows = 0
        for b in batches:
            waiting.append(b)
            names, rows = names + len(b.column(0).unique()), rows + len(b)
            if names > items or rows > cells:
                yield from full(False)
                names, rows = sum(len(w.column(0).unique()) for w in waiting), sum(map(len, waiting))
        if waiting:
            yield from full(True)

    return pack


def _read(batch, k: int, side: str) -> _Block:
    return _Block(*[batch.column(f"{side}_{f}")[k].values.to_numpy() for f in _Block._fields])


def _pairer(distance: Callable, within: float, share: float):
    """For rows of two blocks, or of one twice: the near pairs of their items."""
    import pyarrow as pa

    def pair(batches):
        for b in batches:
            for k in range(len(b)):
                x, y = _read(b, k, "x"), _read(b, k, "y")
                names = [b.column(f"{side}_item")[k].values for side in "xy"]
                same = b.column("x_block")[k].as_py() == b.column("y_block")[k].as_py()
                for rows, columns, d in _distances(x, y, distance, share):
                    near = d <= within + EVEN
                    if isinstance(rows, slice):
                        some, d = np.nonzero(near), d[near]
                        rows, columns = some[0] + rows.start, some[1] + columns.start
                    else:
                        rows, columns, d = rows[near], columns[near], d[near]
                    if same:
                        once = rows < columns
                        rows, columns, d = rows[once], columns[once], d[once]
                    if len(d):
                        yield pa.RecordBatch.from_arrays([names[0].take(pa.array(rows)), names[1].take(pa.array(columns)), pa.array(np.maximum(d, 0.0))], ["i", "j", "d"])

    return pair


def _meeter(distance: Callable, within: float, share: float):
    """For rows of two blocks: items' numbers (code) with links, and links (code, other) between classes of the two."""
    import pyarrow as pa

    def meet(batches):
        for b in batches:
            for k in range(len(b)):
                labels = [b.column(f"{side}_label")[k].values.to_numpy().astype(np.int64) for side in "xy"]
                base = [b.column(f"{side}_block")[k].as_py() << BITS for side in "xy"]
                near = _near(_read(b, k, "x"), _read(b, k, "y"), distance, within, share)
                code, other, links = [], [], []
                for axis in (0, 1):
                    n = near.sum(axis=1 - axis)
                    some = np.flatnonzero(n)
                    code.append(base[axis] + some)
                    links.append(n[some])
                counted = sum(map(len, code))
                rows, columns = _contracted(near, *labels)
                code, links = np.concatenate([*code, base[0] + rows]), np.concatenate([*links, np.zeros(len(rows), np.int64)])
                other = np.concatenate([np.zeros(counted, np.int64), base[1] + columns])
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(other.astype(np.int64), mask=np.arange(len(other)) < counted), pa.array(links.astype(np.int64))],
                                                 ["code", "other", "links"])

    return meet


def components(links: DataFrame) -> DataFrame:
    """(node, label), stored: the smallest node reachable, for every node that has a link (a, b), by alternating stars."""
    with temporary(links.sparkSession) as keep:
        edges = store(links.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = store(both.filter("v > u").join(least, "u").select(F.col("v"), F.col("m")).filter("v <> m").distinct())
            down = large.select(F.col("v").alias("u"), F.col("m").alias("v"))  # v < u
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            edges = store(down.join(least, "u").select(F.col("v"), F.col("m")).filter("v <> m").unionByName(least.select(F.col("u").alias("v"), "m"))
                          .select(F.col("m").alias("u"), "v").distinct())
            # done when every node is either the centre of a star or has one edge, to a centre
            places = edges.select(F.col("u").alias("node"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("node"), F.lit(1).alias("above")))
            if places.groupBy("node").agg(F.sum("above").alias("above"), F.count("*").alias("n")).filter("above > 0 AND n > 1").isEmpty():
                break
        stars = edges.select(F.col("v").alias("node"), F.col("u").alias("label"))
        return keep(stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct()))


def _numbered(src: DataFrame) -> DataFrame:
    """``src`` with a long in place of every key: its hash, with the first seed under which no two keys share one."""
    keys, seed = src.filter("key IS NOT NULL").select("key").distinct(), 0
    while True:
        code = F.xxhash64("key", F.lit(seed))
        if keys.groupBy(code.alias("code")).count().filter("count > 1").isEmpty():
            return src.withColumn("key", F.when(F.col("key").isNotNull(), code))
        seed += 1


def _blocks(cells: DataFrame, item: str, key: str, value: str, near_of: Callable[[_Block], np.ndarray] | None) -> DataFrame:
    """The items in blocks, a row each; to be stored."""
    held = F.col(f"`{key}`").isNotNull() & (F.col(f"`{value}`") > 0) & (F.col(f"`{value}`") < float("inf"))
    src = store(cells.select(F.col(f"`{item}`").alias("item"), F.when(held, F.col(f"`{key}`")).alias("key"), F.when(held, F.col(f"`{value}`").cast("double")).alias("value"))
                .filter("item IS NOT NULL"))
    n_cells, n_items = src.agg(F.count("*"), F.approx_count_distinct("item", 0.02)).first()
    parts = max(1, math.ceil(n_items / (0.9 * ITEMS)), math.ceil(n_cells / (0.9 * CELLS)))
    longs, doubles, ints = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
    fields = {"block": T.LongType(), "item": T.ArrayType(cells.schema[item].dataType), **({"label": ints, "links": longs} if near_of else {}),
              "total": doubles, "key": longs, "who": ints, "value": doubles}
    return _numbered(src).repartition(parts, "item").sortWithinPartitions("item").mapInArrow(
        _packer(near_of, ITEMS, CELLS), T.StructType([T.StructField(*f) for f in fields.items()]))


def _met(blocks: DataFrame, fields: tuple[str, ...], condition: str) -> DataFrame:
    """Two blocks a row, by their ``x_`` and ``y_`` columns. Every task reads two blocks from the same shuffle files: nothing is copied for their meeting."""
    dealt = blocks.select(*fields).repartitionByRange(max(1, blocks.count()), "block")
    x, y = (dealt.select(*[F.col(c).alias(f"{side}_{c}") for c in fields]) for side in "xy")
    return x.hint("shuffle_replicate_nl").join(y, F.expr(condition))


def overlap_near(cells: DataFrame, item: str, key: str, value: str, distance: Callable, within: float, share: float) -> DataFrame:
    """``(i, j, d)`` with i < j for the pairs of items at most ``within`` apart (or a billionth more); negative distances are 0.

    Arguments and absent cells as of ``overlap_links``. Right also where nearly all pairs share a key: no pair is shuffled or stored, they are
    worked out as the result's rows are asked for. Time grows with the square of the items, disk with the cells.
    """
    if not 0 < share <= 0.5:
        raise ValueError("share must be above 0 and at most 1/2")
    kind = cells.schema[item].dataType.simpleString()
    with temporary(cells.sparkSession) as keep:
        blocks = keep(_blocks(cells, item, key, value, None))
    pairs = _met(blocks, ("block", "item", *_Block._fields), "x_block <= y_block").mapInArrow(_pairer(distance, within, share), f"i {kind}, j {kind}, d double")
    return on_demand(pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d"))


def overlap_links(cells: DataFrame, item: str, key: str, value: str, distance: Callable, within: float, share: float) -> DataFrame:
    """``(item, class_id, links)``, a row for every item of ``cells``: how many others are at most ``within`` apart from it, and the
    smallest item that such links lead to, itself included.

    ``distance`` works out arrays of distances from overlaps (the sums over keys of the smaller value) and the two items' sums added
    up; it is at most ``within`` (or a billionth more, since sums are added in any order) only where the overlap is at least ``share`` (above 0) of these. Cells are unique per item and key. Those with a
    NULL key, or a value that is NULL, NaN, infinite or not above zero, count as absent; an item without others has no link. Rows without an item are left out.
    """
    if not 0 < share <= 0.5:
        raise ValueError("share must be above 0 and at most 1/2")
    spark = cells.sparkSession
    with temporary(spark) as keep:
        with temporary(spark) as hold:
            blocks = hold(_blocks(cells, item, key, value, lambda b: _near(b, b, distance, within, share)))
        pairs = _met(blocks, ("block", "label", *_Block._fields), "x_block < y_block")
        found = store(pairs.mapInArrow(_meeter(distance, within, share), "code long, other long, links long"))
        number = lambda c: F.shiftleft("block", BITS) + F.col(c)
        rows = blocks.select("block", F.posexplode(F.arrays_zip("item", "label", "links")).alias("at", "r")).select(
            "block", "at", "r.item", "r.label", "r.links").select("item", number("at").alias("code"), number("label").alias("top"), "links")
        classes = components(found.filter("other IS NOT NULL").select(F.col("code").alias("a"), F.col("other").alias("b")))
        tops = rows.groupBy("top").agg(F.min("item").alias("least")).join(classes.withColumnRenamed("node", "top"), "top", "left").withColumn("label", F.coalesce("label", "top"))
        tops = store(tops)
        named = tops.join(tops.groupBy("label").agg(F.min("least").alias("class_id")), "label").select("top", "class_id")
        more = found.filter("other IS NULL").groupBy("code").agg(F.sum("links").alias("more"))
        return keep(rows.join(named, "top").join(more, "code", "left").select(
            "item", "class_id", (F.col("links") + F.coalesce("more", F.lit(0).cast("long"))).alias("links")))
