"""Exact nearest rows: cheap bounds for all pairs, and distances for the few that these leave open.

A block of queries meets a block of items as one matrix product in single precision, with two more coordinates that hold the
greatest error the product can have.  Pairs that can be among the nearest so far are measured in double precision, in the same
task; a block passes on ``k`` rows per query.

Vectors with gaps are bounded by small signatures instead (a vector approximation file).  One aggregation over the items gives their
spread.  A signature is a vector, each coordinate cut to the few bits that its spread deserves, with the exact distance between the
vector and its cut form.  So the distance of a query to a signature bounds that to the vector from both sides.

Vectors of few coordinates lie in cells of space instead: a query meets only the cells whose box can hold one of its nearest, and
in a cell only such blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.session import cut_lineage

#: Bits per coordinate on average and at most; half the width of a grid in standard deviations.
BITS, MOST_BITS, WIDTH = 6, 8, 3.5
#: Rows of a block of queries and of items at most, coordinates of a block; bounds held at once in a task.
QUERY_BLOCK, ITEM_BLOCK, BLOCK_VALUES, BOUNDS = 25_000, 50_000, 3_200_000, 4_000_000
#: Blocks of queries that smaller tables are cut to, if each gets so many queries.
LEAST_BLOCKS, LEAST_QUERIES = 16, 2_000
#: Queries of one matrix product, items of the first and of the largest.
AT_ONCE, FIRST_ITEMS, MOST_ITEMS = 512, 256, 4_096

#: Vectors of at most so many coordinates are searched by cells; items of a cell, most cells, sampled items that place one.
LOW_DIMENSIONS, CELL_ITEMS, MOST_CELLS, CELL_SAMPLE = 4, 2_000, 2_048, 32
#: Queries of a cell, if it keeps as many items as a block; items of a block, a part of a cell with a box of its own.
CELL_QUERIES, BLOCK_ITEMS = 10_000, 64


def _matrix(series: pd.Series) -> np.ndarray:
    try:
        return np.stack(series.to_numpy()).astype("float64")  # arrays of one length without gaps
    except (TypeError, ValueError):
        return np.array([[np.nan if x is None else x for x in v] for v in series], dtype="float64")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def pair_distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of ``q`` to the same row of ``x``; infinite where they share no coordinate."""
    if metric == "cosine":
        return 1.0 - (_unit(q) * _unit(x)).sum(axis=1)
    gap = (q - x) ** 2
    if metric == "nan_euclidean":
        both = (~np.isnan(gap)).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(both > 0, np.sqrt(np.nansum(gap, axis=1) * q.shape[1] / both), np.inf)
    return np.sqrt(gap.sum(axis=1))


class Signatures:
    """Axes and grid of a table of vectors; cuts vectors to signatures and bounds distances to them."""

    def __init__(self, metric: str, mean: np.ndarray, axes: np.ndarray, spread: np.ndarray):
        """``axes``: columns of length one at right angles; ``spread``: standard deviation along each."""
        self.metric, self.mean, self.axes = metric, mean, axes
        bits = self._deserved_bits(spread)
        self.kept = np.flatnonzero(bits)
        self.levels = 2.0 ** bits[self.kept]
        self.low = -WIDTH * spread[self.kept]
        self.step = np.where(spread[self.kept] > 0, -2 * self.low / self.levels, 1.0)
        self.with_gaps = metric == "nan_euclidean"

    @staticmethod
    def _deserved_bits(spread: np.ndarray) -> np.ndarray:
        """Whole bits per axis, in proportion to the logarithm of its spread; ``BITS`` on average."""
        live = np.log2(np.maximum(spread, 1e-300))
        floor, top = live.min() - MOST_BITS - 1, live.max() + 1
        for _ in range(60):
            level = (floor + top) / 2
            bits = np.clip(np.round(live - level), 0, MOST_BITS)
            floor, top = (level, top) if bits.sum() > BITS * len(spread) else (floor, level)
        bits = np.clip(np.round(live - top), 0, MOST_BITS)
        return np.where(spread > 0, bits, 0)

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return _unit(x) if self.metric == "cosine" else x

    def cut(self, x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Signature of each vector, and how far the vector is from it."""
        x = self.prepared(x)
        known = ~np.isnan(x)
        y = (np.where(known, x, self.mean) - self.mean) @ self.axes
        code = np.clip(np.floor((y[:, self.kept] - self.low) / self.step), 0, self.levels - 1)
        y[:, self.kept] -= self.low + (code + 0.5) * self.step
        if self.with_gaps:
            y = np.where(known, y, 0.0)  # the axes are the coordinates themselves
        body = code.astype(np.uint8)
        if self.with_gaps:
            body = np.concatenate([body, np.packbits(known, axis=1)], axis=1)
        return [row.tobytes() for row in body], np.sqrt((y * y).sum(1))

    def restored(self, signatures: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray | None]:
        """Cut vectors in the axes, and which coordinates are known (with gaps only)."""
        body = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
        y = np.zeros((len(body), self.axes.shape[1]))
        y[:, self.kept] = self.low + (body[:, :len(self.kept)] + 0.5) * self.step
        known = None
        if self.with_gaps:
            known = np.unpackbits(body[:, len(self.kept):], axis=1)[:, :len(self.mean)].astype(bool)
        return y, known

    def bounds(self, q: np.ndarray, y: np.ndarray, known, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distance of each query to each cut vector."""
        if self.metric == "cosine":
            q = _unit(q)
            near = 1.0 - (q @ self.mean)[:, None] - (q @ self.axes) @ y.T
            error = error + 1e-12
            return near - error, near + error
        if self.with_gaps:
            mine = ~np.isnan(q)
            x = np.where(known, y @ self.axes.T + self.mean, 0.0)
            q0 = np.where(mine, q, 0.0)
            size = (q0**2) @ known.T.astype(float) + mine.astype(float) @ (x**2).T
            square = size - 2.0 * q0 @ x.T
            both = mine.astype(float) @ known.T.astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                scale = np.where(both > 0, np.sqrt(q.shape[1] / both), np.inf)
        else:
            z = (q - self.mean) @ self.axes
            size = (z * z).sum(1)[:, None] + (y * y).sum(1)
            square, scale = size - 2.0 * z @ y.T, 1.0
        slack = 1e-12 * size
        low = np.sqrt(np.maximum(square - slack, 0.0)) * (1 - 1e-12) - error * (1 + 1e-12)
        high = np.sqrt(np.maximum(square, 0.0) + slack) * (1 + 1e-12) + error * (1 + 1e-12)
        if self.with_gaps:
            apart = np.isinf(scale)
            return np.where(apart, np.inf, np.maximum(low, 0.0) * np.where(apart, 1.0, scale)), np.where(
                apart, np.inf, high * np.where(apart, 1.0, scale))
        return low, high


def signatures_of(items: DataFrame, vector: str, metric: str) -> tuple[Signatures | None, int]:
    """Axes and grid from one pass over ``items``, and their number; each task sends one matrix."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch[vector])
            x = _unit(x) if metric == "cosine" else x
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            part = [np.full(x.shape[1], len(x)), known.sum(0), x.sum(0), (x * x).sum(0), x.T @ x]
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            rows, known, s, ss, cross = total
            yield pd.DataFrame({"i": np.arange(len(s)), "rows": rows, "known": known, "s": s, "ss": ss, "cross": list(cross)})

    parts = items.select(vector).mapInPandas(sums, "i int, rows bigint, known bigint, s double, ss double, cross array<double>")
    cells = parts.select("*", F.posexplode("cross").alias("j", "v")).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("rows", "known", "s", "ss", "v")])
    found = cells.groupBy("i").agg(*[F.max(c).alias(c) for c in ("rows", "known", "s", "ss")], F.sort_array(
        F.collect_list(F.struct("j", "v"))).alias("cross")).orderBy("i").toPandas()
    if not len(found):
        return None, 0
    n, known = int(found["rows"].iloc[0]), np.maximum(found["known"].to_numpy(dtype=float), 1.0)
    mean = found["s"].to_numpy(dtype=float) / known
    if metric == "nan_euclidean":
        spread = np.sqrt(np.maximum(found["ss"].to_numpy(dtype=float) / known - mean**2, 0.0))
        return Signatures(metric, mean, np.eye(len(mean)), spread), n
    cross = np.array([[c["v"] for c in row] for row in found["cross"]]) / n - np.outer(mean, mean)
    spread, axes = np.linalg.eigh((cross + cross.T) / 2)
    return Signatures(metric, mean, axes, np.sqrt(np.maximum(spread, 0.0))), n


def _kept(queries: np.ndarray, items: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least distances of each query; of equal ones the first items."""
    order = np.lexsort((items, distance, queries))
    who = queries[order]
    return order[np.arange(len(who)) - np.searchsorted(who, who) < k]


class Scores:
    """Bounds in single precision on how near items are to queries: the greater the score, the nearer.

    Vectors are scaled by a power of two, if they are not of length one, and centred at ``m``.  The score of a pair is ``q x``
    and what the item adds on its own, ``- x x / 2`` or, for the cosine, ``m x``.  That is one coordinate more, and another holds the
    error of the product: rounding errors are within ``c`` times the sum of all its terms without their signs, which is at most
    ``|q| |x|`` and the item's own.  So no score lies above its product.
    """

    def __init__(self, q: np.ndarray, x: np.ndarray, metric: str):
        self.cosine, n = metric == "cosine", x.shape[1]
        if self.cosine:
            q, x = _unit(q), _unit(x)
        top = max(np.abs(q).max(initial=0.0), np.abs(x).max(initial=0.0))
        self.scale = 1.0 if self.cosine and top <= 1 else 2.0 ** -max(int(np.frexp(top)[1]), -1000)
        q, x = q * self.scale, x * self.scale
        centre = np.median(x, axis=0) if len(x) else np.zeros(n)
        q, x = q - centre, x - centre
        c = 1.1 * (n + 8) * 2.0 ** -24
        self.size, size = (q * q).sum(1), (x * x).sum(1)
        self.shift = q @ centre + centre @ centre
        self.loose = (2.0 ** -50 + self.scale * 2.0 ** -537) * math.sqrt(n)  # by centring, and by squares too small for a number
        up = lambda v: np.nextafter(v.astype("float32"), np.float32(np.inf))[:, None]
        own = x @ centre if self.cosine else -size / 2
        self.q = np.concatenate([q.astype("float32"), up(c * np.sqrt(self.size)), np.ones((len(q), 1), "float32")], axis=1)
        self.x = np.concatenate([x.astype("float32"), up(np.sqrt(size)), up(own + c * np.abs(own) + 1e-30)], axis=1)

    def least(self, rows, distance: np.ndarray) -> np.ndarray:
        """What the product of these queries reaches with every item that is not farther than ``distance``."""
        if self.cosine:
            score = (1.0 - distance) * self.scale**2
            score -= self.shift[rows] + 1e-12 * (1 + np.abs(score))
        else:
            reach = (distance * self.scale * (1 + 1e-9) + self.loose) ** 2
            score = (self.size[rows] - reach) / 2 - 1e-9 * (self.size[rows] + reach)
        return np.nextafter(score.astype("float32"), np.float32(-np.inf))


def _open(product: np.ndarray, least: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where ``product`` reaches the ``least`` of its row; ``flags``: room for words of 64 of them per row."""
    n, width = product.shape
    room = -(-width // 64) * 64
    hit = flags[:n * room].reshape(n, room)
    hit[:, width:] = False
    np.greater_equal(product, least[:, None], out=hit[:, :width])
    words = np.flatnonzero(np.packbits(hit).view(np.uint64))
    word, bit = np.nonzero(hit.reshape(-1, 64)[words])
    at = words[word] * 64 + bit
    return at // room, at % room


def nearest_places(q: np.ndarray, x: np.ndarray, k: int, metric: str, barred=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Queries, places and distances of the ``k`` nearest items of each query, of equal ones the first, and how many pairs were
    measured in double precision.

    ``barred`` tells of pairs (places of queries, of items) which must not be taken.
    """
    asks, has = (np.flatnonzero(np.isfinite(v).all(axis=1)) for v in (q, x))  # others have no finite distance
    scores, out, measured = Scores(q[asks], x[has], metric), [], 0
    product, flags = np.empty(AT_ONCE * MOST_ITEMS, "float32"), np.empty(AT_ONCE * (MOST_ITEMS + 64), bool)
    step = max(1, BOUNDS // q.shape[1])

    def distances(who, what):
        return np.concatenate([np.zeros(0), *[pair_distances(q[asks[who[at:at + step]]], x[has[what[at:at + step]]], metric)
                                              for at in range(0, len(who), step)]])

    for first in range(0, len(asks), AT_ONCE):
        mine = np.arange(first, min(first + AT_ONCE, len(asks)))
        n, at = len(mine), 0
        near, place, least = np.full((n, k), np.inf), np.full((n, k), -1), np.full(n, -np.inf, "float32")
        while at < len(has):
            end = min(len(has), at + min(MOST_ITEMS, max(FIRST_ITEMS, at)))
            width = end - at
            found = np.matmul(scores.q[mine], scores.x[at:end].T, out=product[:n * width].reshape(n, width))
            if not at and width >= k:  # the k that seem nearest tell how far the nearest are at most
                who, what = np.repeat(np.arange(n), width), np.tile(np.arange(width), n)
                free = np.where(barred(asks[mine[who]], has[what]).reshape(n, width), -np.inf, found) if barred else found
                what = np.argpartition(free, width - k, axis=1)[:, width - k:]
                who = np.repeat(np.arange(n), k)
                d = distances(mine[who], what.ravel()).reshape(n, k)
                d = np.where(np.isfinite(np.take_along_axis(free, what, 1)), d, np.inf).max(axis=1)
                sure = np.flatnonzero(np.isfinite(d))
                least[sure] = scores.least(mine[sure], d[sure])
            who, what = _open(found, least, flags)
            what += at
            at = end
            if barred:
                taken = ~barred(asks[mine[who]], has[what])
                who, what = who[taken], what[taken]
            measured += len(who)
            d = distances(mine[who], what)
            finite = np.isfinite(d)
            who, what, d = who[finite], what[finite], d[finite]
            if not len(who):
                continue
            hit = np.unique(who)
            old = np.repeat(hit, k), place[hit].ravel(), near[hit].ravel()
            real = old[1] >= 0
            who, what, d = (np.concatenate([a, b[real]]) for a, b in zip((who, what, d), old))
            best = _kept(who, what, d, k)
            who, what, d = who[best], what[best], d[best]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            near[who, rank], place[who, rank] = d, what
            full = hit[np.isfinite(near[hit, k - 1])]
            least[full] = np.maximum(least[full], scores.least(mine[full], near[full, k - 1]))
        who, rank = np.nonzero(place >= 0)
        out.append((asks[mine[who]], has[place[who, rank]], near[who, rank]))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return (*(np.concatenate(c) for c in zip(none, *out)), measured)


def _by_key(items: pd.DataFrame, item_key: str) -> pd.DataFrame:
    return items.iloc[np.argsort(pd.factorize(items[item_key], sort=True)[0], kind="stable")]


def candidates(q_side: DataFrame, i_side: DataFrame, vector: str, metric: str, differ_on: str | None, apart: tuple[str, str] | None,
             k: int, item_key: str | None) -> DataFrame | None:
    """Every block of queries with every block of items; null where there are no items.

    ``_q, _i, distance``: the ``k`` nearest items of each query in each block, measured where the bounds leave a pair open.
    Without an ``item_key`` one row ``refined`` per block: how many pairs were left open.
    """
    with_gaps = metric == "nan_euclidean"
    cut, n_items = signatures_of(i_side, vector, metric) if with_gaps else (None, i_side.count())
    if not n_items:
        return None
    extra = list(dict.fromkeys(([differ_on] if differ_on else []) + ([apart[0]] if apart else [])))
    q_extra = list(dict.fromkeys(extra + ([apart[1]] if apart else [])))
    n_queries, width = q_side.count(), i_side.agg(F.max(F.size(vector)).alias("n")).first()["n"]
    most = max(1, BLOCK_VALUES // max(1, width))
    i_blocks = -(-n_items // min(ITEM_BLOCK, most))
    q_blocks = max(1, -(-n_queries // min(QUERY_BLOCK, most)), min(LEAST_BLOCKS, n_queries // LEAST_QUERIES))
    i_cols = list(dict.fromkeys(["_i", *extra, *([item_key] if item_key else []), vector]))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            body, error = cut.cut(_matrix(batch[vector])) if len(batch) else ([], [])
            yield batch.assign(_body=np.array(body, dtype=object), _error=np.array(error, dtype="float64"))

    signed = i_side.select(*[F.col(c).alias(c) for c in i_cols])  # columns of its own, since both sides may come from one table
    if with_gaps:
        signed = signed.mapInPandas(sign, T.StructType([
            *signed.schema.fields, T.StructField("_body", T.BinaryType()), T.StructField("_error", T.DoubleType())]))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q_side.select("_q", *q_extra, vector).withColumn("_qb", F.pmod(F.xxhash64("_q"), F.lit(q_blocks)).cast("int")).withColumn(
        "_ib", each(i_blocks))
    right = signed.withColumn("_ib", F.pmod(F.xxhash64("_i"), F.lit(i_blocks)).cast("int")).withColumn("_qb", each(q_blocks))
    none = {"_q": np.zeros(0, np.int64), "_i": np.zeros(0, np.int64), "distance": np.zeros(0)} if item_key else {
        "refined": np.zeros(0, np.int64)}

    def scan(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(items):
            return pd.DataFrame(none)
        if item_key:
            items = _by_key(items, item_key)
        if with_gaps:
            return scan_signatures(queries, items)
        column = {c: (queries[c].to_numpy(), items[c].to_numpy()) for c in extra}
        margin = queries[apart[1]].to_numpy() if apart else None

        def barred(who: np.ndarray, what: np.ndarray) -> np.ndarray:
            out = np.zeros(len(who), bool)
            if differ_on:
                mine, other = column[differ_on]
                out |= mine[who] == other[what]
            if apart:
                mine, other = column[apart[0]]
                out |= np.abs(mine[who] - other[what]) <= margin[who]
            return out

        who, what, d, measured = nearest_places(_matrix(queries[vector]), _matrix(items[vector]), k, metric, barred if extra else None)
        return pd.DataFrame({"_q": queries["_q"].to_numpy()[who], "_i": items["_i"].to_numpy()[what], "distance": d}) if item_key else (
            pd.DataFrame({"refined": [measured]}))

    def scan_signatures(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        y, known = cut.restored(items["_body"].tolist())
        x, error, names, out, refined = _matrix(items[vector]), items["_error"].to_numpy(), items["_i"].to_numpy(), [], 0
        at_once = max(1, BOUNDS // len(items))
        for first in range(0, len(queries), at_once):
            some = queries.iloc[first:first + at_once]
            q = _matrix(some[vector])
            low, high = cut.bounds(q, y, known, error)
            if differ_on:
                same = some[differ_on].to_numpy()[:, None] == items[differ_on].to_numpy()[None, :]
                low, high = np.where(same, np.inf, low), np.where(same, np.inf, high)
            if apart:
                gap = np.abs(some[apart[0]].to_numpy()[:, None] - items[apart[0]].to_numpy()[None, :])
                near = gap <= some[apart[1]].to_numpy()[:, None]
                low, high = np.where(near, np.inf, low), np.where(near, np.inf, high)
            reach = np.partition(high, k - 1, axis=1)[:, k - 1] if len(items) >= k else np.full(len(some), np.inf)
            who, what = np.nonzero((low <= reach[:, None]) & np.isfinite(low))
            refined += len(who)
            if not item_key:
                continue
            step = max(1, BOUNDS // q.shape[1])
            d = np.concatenate([np.zeros(0), *[pair_distances(q[who[at:at + step]], x[what[at:at + step]], metric)
                                               for at in range(0, len(who), step)]])
            best = _kept(who, what, d, k)
            best = best[np.isfinite(d[best])]
            out.append(pd.DataFrame({"_q": some["_q"].to_numpy()[who[best]], "_i": names[what[best]], "distance": d[best]}))
        return pd.concat(out, ignore_index=True) if item_key else pd.DataFrame({"refined": [refined]})

    keys, parts = ["_qb", "_ib"], 2 * q_blocks * i_blocks  # few tasks get more than one pair of blocks
    left, right = (side.repartition(parts, *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        scan, "_q bigint, _i bigint, distance double" if item_key else "refined bigint")


class Cells:
    """Parts of space, from halving a sample of the items at the median of its widest coordinate.

    Items that lack different coordinates lie in different cells, so that a box bounds the distances to all its items.
    """

    def __init__(self, sample: np.ndarray, cells: int):
        known = ~np.isnan(sample)
        self.centre = np.array([np.median(c[m]) if m.any() else 0.0 for c, m in zip(sample.T, known.T)])
        self.axis, self.cut, todo = np.full(4 * cells, -1), np.zeros(4 * cells), [(0, self._filled(sample), cells)]
        while todo:
            node, x, n = todo.pop()
            if n < 2 or len(x) < 2:
                continue
            axis = int(np.argmax(x.max(0) - x.min(0)))
            c = x[:, axis]
            below = c[c < c.max()]
            if not len(below):
                continue
            self.axis[node], self.cut[node] = axis, min(np.median(c), below.max())
            left = c <= self.cut[node]
            todo += [(2 * node + 1, x[left], n // 2), (2 * node + 2, x[~left], n // 2)]

    def _filled(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), self.centre, x)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each item."""
        known, x, node = ~np.isnan(x), self._filled(x), np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                break
            at = node[inner]
            node[inner] = 2 * at + 2 - (x[inner, self.axis[at]] <= self.cut[at])
        return node * 2 ** known.shape[1] + known @ (1 << np.arange(known.shape[1]))


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of each query to the items in each box (NaN: no item has the coordinate)."""
    near, far, both = (np.zeros((len(q), len(low))) for _ in range(3))
    for i in range(q.shape[1]):
        under, over = low[:, i] - q[:, i, None], q[:, i, None] - high[:, i]
        shared = ~np.isnan(under)
        both += shared
        near += np.where(shared, np.maximum(np.maximum(under, over), 0.0) ** 2, 0.0)
        far += np.where(shared, np.maximum(np.abs(under), np.abs(over)) ** 2, 0.0)
    if metric == "nan_euclidean":
        with np.errstate(divide="ignore", invalid="ignore"):
            near, far = (np.where(both > 0, b * q.shape[1] / both, np.inf) for b in (near, far))
    return np.sqrt(near) * (1 - 1e-9), np.sqrt(far) * (1 + 1e-9)


def halves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The places of ``x`` in blocks of at most ``most``, from halving at the median of the widest coordinate."""
    x, todo, done = np.nan_to_num(x), [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            done.append(at)
            continue
        c = x[at]
        order = np.argpartition(c[:, np.argmax(c.max(0) - c.min(0))], len(at) // 2)
        todo += [at[order[:len(at) // 2]], at[order[len(at) // 2:]]]
    return done


class Boxes:
    """Sets of items: their boxes, and what tells how many of them a query may take.

    ``often``: the most frequent value to differ from, ``has`` it so many of ``n``; ``least`` and ``most``: the ``k``-th smallest and
    largest number to be apart from, ``lowest`` and ``highest`` the first and the last.
    """

    FACTS = "n bigint, has bigint, least double, most double, lowest double, highest double"

    def __init__(self, metric: str, k: int, differ_on: str | None, apart: tuple[str, str] | None, facts: pd.DataFrame):
        self.metric, self.k, self.differ_on, self.apart = metric, k, differ_on, apart
        self.low, self.high = _matrix(facts["low"]), _matrix(facts["high"])
        self.often = facts["often"].to_numpy() if differ_on else None
        self.n, self.has, self.least, self.most, self.lowest, self.highest = (
            facts[c].to_numpy(dtype=float) for c in ("n", "has", "least", "most", "lowest", "highest"))

    @staticmethod
    def facts(items: pd.DataFrame, x: np.ndarray, sets: list[np.ndarray], k: int, differ_on, apart) -> pd.DataFrame:
        """One row per set of places in ``items``, whose vectors are ``x``."""
        if differ_on:
            codes, values = pd.factorize(items[differ_on], use_na_sentinel=False)
        p = items[apart[0]].to_numpy(dtype=float) if apart else None
        rows = []
        for at in sets:
            often, has, least, most, lowest, highest = None, 0, np.nan, np.nan, np.nan, np.nan
            if differ_on:
                many = np.bincount(codes[at])
                often, has = values[many.argmax()], int(many.max())
            if apart:
                own = np.sort(p[at])  # missing ones, which are apart from all, come last
                real = own[:len(own) - np.isnan(own).sum()]
                least, most = (real[k - 1], real[-k]) if len(real) >= k else (np.nan, np.nan)
                lowest, highest = (own[0], own[-1]) if len(real) == len(own) else (-np.inf, np.inf)
            rows.append((x[at].min(0).tolist(), x[at].max(0).tolist(), often, len(at), has, least, most, lowest, highest))
        return pd.DataFrame(rows, columns=["low", "high", "often", "n", "has", "least", "most", "lowest", "highest"])

    def reach(self, q: np.ndarray, queries: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of each query to an item of each set that it may take, and one that its nearest are within."""
        near, far = box_bounds(q, self.low, self.high, self.metric)
        some, enough = np.ones(near.shape, bool), np.broadcast_to(self.n >= self.k, near.shape)
        if self.differ_on:
            same = queries[self.differ_on].to_numpy()[:, None] == self.often[None, :]
            others = self.n - self.has
            some, enough = ~same | (others > 0), np.where(same, others, np.maximum(others, self.has)) >= self.k
        if self.apart:
            p, margin = (queries[c].to_numpy(dtype=float)[:, None] for c in self.apart)
            slack, free = 1e-9 * (np.abs(p) + np.abs(margin) + 1), np.isnan(p + margin)
            some = some & (free | (self.lowest < p - margin + slack) | (self.highest > p + margin - slack))
            enough = enough & (free | (self.least < p - margin - slack) | (self.most > p + margin + slack))
        return np.where(some, near, np.inf), np.where(enough, far, np.inf).min(axis=1)


def _block_distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """As ``pair_distances``, of each query to each item."""
    total, both = np.zeros((len(q), len(x))), np.zeros((len(q), len(x)))
    for i in range(q.shape[1]):
        gap = (q[:, i, None] - x[:, i]) ** 2
        shared = ~np.isnan(gap)
        total += np.where(shared, gap, 0.0)
        both += shared
    if metric == "nan_euclidean":
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.where(both > 0, total * q.shape[1] / both, np.inf)
    return np.sqrt(total)


def _nearest_by_cells(q_side: DataFrame, i_side: DataFrame, item_key: str, vector: str, width: int, k: int, metric: str,
                      differ_on: str | None, apart: tuple[str, str] | None) -> DataFrame | None:
    """``_q, _i, distance``: the ``k`` nearest items of each query in each cell that can hold one of its nearest."""
    extra = list(dict.fromkeys(([differ_on] if differ_on else []) + ([apart[0]] if apart else [])))
    first = W.partitionBy(vector, *extra).orderBy(item_key)  # of equal items only the k smallest keys can be among the nearest
    items = cut_lineage(i_side.select("_i", item_key, vector, *extra).withColumn("_r", F.row_number().over(first)).where(
        F.col("_r") <= k).drop("_r"))
    n = items.count()
    if not n:
        return None
    wanted = max(1, min(MOST_CELLS, max(n // CELL_ITEMS, min(n // BLOCK_ITEMS, q_side.count() // CELL_QUERIES))))
    share = max(1, n // (wanted * CELL_SAMPLE))
    sample = items.where(F.pmod(F.xxhash64("_i"), F.lit(share)) == 0).select(vector).toPandas()[vector]
    cells = Cells(_matrix(sample) if len(sample) else np.zeros((0, width)), wanted)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(_cell=cells.of(_matrix(batch[vector])) if len(batch) else np.zeros(0, dtype=np.int64))

    placed = items.mapInPandas(place, T.StructType([*items.schema.fields, T.StructField("_cell", T.LongType())]))
    value = items.schema[differ_on].dataType if differ_on else T.LongType()

    def describe(rows: pd.DataFrame) -> pd.DataFrame:
        facts = Boxes.facts(rows, _matrix(rows[vector]), [np.arange(len(rows))], k, differ_on, apart)
        return facts.assign(_cell=rows["_cell"].iloc[0])

    known = placed.groupBy("_cell").applyInPandas(describe, T.StructType([
        T.StructField("_cell", T.LongType()), T.StructField("often", value),
        *T._parse_datatype_string(f"low array<double>, high array<double>, {Boxes.FACTS}").fields])).toPandas()
    boxes, names = Boxes(metric, k, differ_on, apart, known), known["_cell"].to_numpy()

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), max(1, BOUNDS // len(names))):
                some = batch.iloc[at:at + max(1, BOUNDS // len(names))]
                near, limit = boxes.reach(_matrix(some[vector]), some)
                meets = (near <= limit[:, None]) & np.isfinite(near)
                yield some.assign(_limit=limit, _cells=[names[m].tolist() for m in meets])

    asked = q_side.mapInPandas(reach, T.StructType([*q_side.schema.fields, T.StructField("_limit", T.DoubleType()),
                                                    T.StructField("_cells", T.ArrayType(T.LongType()))]))

    def measured(some: pd.DataFrame, q: np.ndarray, items: pd.DataFrame, x: np.ndarray, at: np.ndarray):
        """Queries, places and distances of the items at ``at`` that can be among the nearest of each query."""
        d, own = _block_distances(q, x[at], metric), items.iloc[at]
        if differ_on:
            d = np.where(some[differ_on].to_numpy()[:, None] == own[differ_on].to_numpy()[None, :], np.inf, d)
        if apart:
            gap = np.abs(some[apart[0]].to_numpy()[:, None] - own[apart[0]].to_numpy()[None, :])
            d = np.where(gap <= some[apart[1]].to_numpy()[:, None], np.inf, d)
        within = np.partition(d, k - 1, axis=1)[:, k - 1] if len(at) >= k else np.full(len(some), np.inf)
        who, what = np.nonzero((d <= within[:, None]) & np.isfinite(d))
        return who, at[what], d[who, what]

    def scan(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"_q": np.zeros(0, np.int64), "_i": np.zeros(0, np.int64), "distance": np.zeros(0)})]
        if not len(queries) or not len(items):
            return out[0]
        items = _by_key(items, item_key)
        x, ids = _matrix(items[vector]), items["_i"].to_numpy()
        blocks = halves(x, max(BLOCK_ITEMS, math.isqrt(len(x))))
        inside = Boxes(metric, k, differ_on, apart, Boxes.facts(items, x, blocks, k, differ_on, apart))
        at_once = max(1, BOUNDS // max(len(blocks), *map(len, blocks)))
        for first in range(0, len(queries), at_once):
            some = queries.iloc[first:first + at_once]
            q = _matrix(some[vector])
            near, limit = inside.reach(q, some)
            meets = (near <= np.minimum(limit, some["_limit"].to_numpy())[:, None]) & np.isfinite(near)
            found = []
            for block, at in enumerate(blocks):
                asks = np.flatnonzero(meets[:, block])
                if len(asks):
                    who, what, d = measured(some.iloc[asks], q[asks], items, x, at)
                    found.append((asks[who], what, d))
            if found:
                who, what, d = (np.concatenate(c) for c in zip(*found))
                best = _kept(who, what, d, k)
                out.append(pd.DataFrame({"_q": some["_q"].to_numpy()[who[best]], "_i": ids[what[best]], "distance": d[best]}))
        return pd.concat(out, ignore_index=True)

    left = asked.withColumn("_cell", F.explode("_cells")).drop("_cells")
    return left.groupBy("_cell").cogroup(placed.groupBy("_cell")).applyInPandas(scan, "_q bigint, _i bigint, distance double")


def _sides(queries: DataFrame, items: DataFrame, vector: str, q_cols: Sequence[str], i_cols: Sequence[str], metric: str):
    """Rows that can have a distance, each with a number of its own."""
    whole = F.lit(True) if metric == "nan_euclidean" else F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c))
    side = lambda df, cols, name: cut_lineage(df.select(*cols).where(F.col(vector).isNotNull() & whole).withColumn(
        name, F.monotonically_increasing_id()))
    return side(queries, q_cols, "_q"), side(items, i_cols, "_i")


def nearest(queries: DataFrame, items: DataFrame, *, query_key: str, item_key: str, vector: str,
            k: int, metric: str = "euclidean", payload: Sequence[str] = (),
            differ_on: str | None = None, apart: tuple[str, str] | None = None) -> DataFrame:
    """The ``k`` nearest ``items`` of every query row: ``(query_key, item_key, distance, rank)``.

    ``differ_on`` names a column present on both sides that must not be equal;
    ``apart`` = (column, margin) asks for a difference above the query row's margin.
    Vectors with gaps have a distance under ``nan_euclidean`` only.  Ties are broken by the item key.
    """
    payload = list(payload)
    extra = ([differ_on] if differ_on else []) + ([apart[0]] if apart else [])
    q_cols = list(dict.fromkeys([query_key, vector, *extra, *([apart[1]] if apart else [])]))
    i_cols = list(dict.fromkeys([item_key, vector, *extra, *payload]))
    q_side, i_side = _sides(queries, items, vector, q_cols, i_cols, metric)
    types = dict(items.dtypes)
    schema = ", ".join([
        f"{query_key} {dict(queries.dtypes)[query_key]}", f"{item_key} {types[item_key]}",
        *[f"{p} {types[p]}" for p in payload], "distance double"])
    none = _ranked(queries.sparkSession.createDataFrame([], schema), query_key, item_key, k)
    width = i_side.agg(F.max(F.size(vector)).alias("n")).first()["n"]
    if width is not None and 0 < width <= LOW_DIMENSIONS and metric != "cosine":
        met = _nearest_by_cells(q_side, i_side, item_key, vector, width, k, metric, differ_on, apart)
    else:
        met = candidates(q_side, i_side, vector, metric, differ_on, apart, k, item_key)
        if met is not None:  # of all blocks, before keys and payload are joined; equal distances are left for the key
            met = met.withColumn("_r", F.rank().over(W.partitionBy("_q").orderBy("distance"))).where(F.col("_r") <= k).drop("_r")
    return none if met is None else _ranked(met.join(q_side.select("_q", query_key), "_q").join(
        i_side.select("_i", item_key, *payload), "_i").select("_q", query_key, item_key, "distance", *payload),
        query_key, item_key, k).drop("_q")


def refined_share(queries: DataFrame, items: DataFrame, *, vector: str, k: int, metric: str = "euclidean") -> DataFrame:
    """One row ``pairs, refined, share``: how many of all pairs the bounds leave open, so that they are measured."""
    q_side, i_side = _sides(queries, items, vector, [vector], [vector], metric)
    open_ = candidates(q_side, i_side, vector, metric, None, None, k, None)
    pairs = q_side.agg(F.count(F.lit(1)).alias("q")).withColumn("i", i_side.agg(F.count(F.lit(1))).scalar())
    refined = F.lit(0).cast("bigint") if open_ is None else open_.agg(F.coalesce(F.sum("refined"), F.lit(0))).scalar()
    return pairs.select((F.col("q") * F.col("i")).alias("pairs"), refined.alias("refined")).withColumn(
        "share", F.col("refined") / F.nullif(F.col("pairs"), F.lit(0)))


def _ranked(found: DataFrame, query_key: str, item_key: str, k: int) -> DataFrame:
    w = W.partitionBy(query_key).orderBy("distance", item_key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_predict(train: DataFrame, queries: DataFrame, *, query_key: str, item_key: str,
                vector: str, label: str, k: int = 5, differ_on: str | None = None) -> DataFrame:
    """Majority label of the k nearest training rows (smallest label on ties).

    ``differ_on`` names a row id on both sides, for leave-one-out prediction.
    """
    found = nearest(queries, train, query_key=query_key, item_key=item_key, vector=vector, k=k,
                    payload=[label], differ_on=differ_on)
    votes = found.groupBy(query_key, label).agg(F.count(F.lit(1)).alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("k"), F.col(label).alias("label"))).alias("b")
    return votes.groupBy(query_key).agg(best).select(
        query_key, F.col("b.label").alias("prediction"), (-F.col("b.k")).alias("votes"))


def knn_regress(train: DataFrame, queries: DataFrame, *, query_key: str, item_key: str,
                vector: str, label: str, k: int = 5) -> DataFrame:
    """Mean target of the k nearest training rows."""
    found = nearest(queries, train, query_key=query_key, item_key=item_key, vector=vector, k=k,
                    payload=[label])
    return found.groupBy(query_key).agg(F.avg(label).alias("prediction"))


def vector_search(queries: DataFrame, items: DataFrame, *, query_key: str, item_key: str,
                  vector: str = "embedding", k: int = 5, metric: str = "cosine",
                  where: str | None = None) -> DataFrame:
    """Top-k stored vectors per query vector, with an optional filter on the stored rows."""
    pool = items.where(where) if where else items
    return nearest(queries, pool, query_key=query_key, item_key=item_key, vector=vector, k=k,
                   metric=metric)
