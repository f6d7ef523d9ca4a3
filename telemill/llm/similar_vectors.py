"""The k most similar vectors of every vector by shifted space-filling curves.

Unit vectors are projected by several random orthonormal bases to a few
dimensions, standardised, shifted at random and put in the order of a Hilbert
curve. Each ordering is range-partitioned by Spark; inside a partition the sorted
rows run through in blocks, every block is compared with itself and the `reach`
blocks before it (matrix products), and each vector keeps its best k. The ends of
neighbouring partitions of a curve meet in a second, small step, so a bound
between partitions hides no neighbour. The lists of all orderings merge into
the final k.

What travels with a key is the unit vector in 16-bit steps of its largest
component, half the size of the floats; a cosine of two such codes is within
code_error() of the exact one. `close_pairs` decides pairs that near to its limit by
the vectors themselves.

Cost is linear: curves x (2 reach + 1) x block comparisons a vector. Ties in a
curve key (copies) are split over partitions by id, so a group of copies that
holds a third of all rows is still many blocks. Only the moments of the
projections (curves x dims numbers) come to the driver.

Defined results: vectors that are null, of another length, not finite or all
zero take no part; neighbours of equal cosine are listed by id, and which of
them takes the last place is open; with fewer than k others a vector has fewer
neighbours; repeated ids are not neighbours of themselves; an empty input gives
an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 20240304
_LISTS = "id long, near array<struct<c:float,n:long>>"
_NEAR = pa.list_(pa.struct([("c", pa.float32()), ("n", pa.int64())]))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims) with bits per dimension; dims * bits <= 62."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, from the highest bit on
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _bases(dim: int, curves: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    bases = [np.linalg.qr(rng.normal(size=(dim, min(dims, dim))))[0] for _ in range(curves)]
    return np.concatenate(bases, axis=1), rng.uniform(0, 1, size=(curves, min(dims, dim)))


def _units(vectors: pa.ListArray, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codes(units: np.ndarray) -> np.ndarray:
    """Components in 16-bit steps of the largest one."""
    return np.rint(units * (32_767 / np.abs(units).max(axis=1, keepdims=True))).astype("<i2")


def _decoded(codes: np.ndarray) -> np.ndarray:
    """Unit vectors (float32) of codes."""
    x = codes.astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None].astype(np.float32)


def usable_vectors(rows: DataFrame, vec_id: str, vector: str, dim: int) -> DataFrame:
    """id, vector of the rows that take part."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) == dim)).where(good).select(F.col(vec_id).cast("long").alias("id"), v.alias("vector"))


def nearest(
    rows: DataFrame,
    vec_id: str,
    vector: str,
    dim: int = 128,
    k: int = 5,
    curves: int = 6,
    dims: int = 6,
    bits: int = 7,
    block: int = 512,
    reach: int = 8,
    rows_per_partition: int = 60_000,
) -> DataFrame:
    """id, rank (1..k), neighbour, cosine (within code_error) for every usable vector."""
    spark = rows.sparkSession
    usable = usable_vectors(rows, vec_id, vector, dim)
    basis, shift = _bases(dim, curves, dims)
    width = basis.shape[1] // curves

    def moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, s2 = 0, np.zeros(basis.shape[1]), np.zeros(basis.shape[1])
        for part in parts:
            if part.num_rows:
                y = _units(part.column(0), dim) @ basis
                n, s, s2 = n + len(y), s + y.sum(0), s2 + (y * y).sum(0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(s)), pa.int32()), "n": pa.array(np.full(len(s), n), pa.int64()), "s": s, "s2": s2})

    stats = usable.select("vector").mapInArrow(moments, "i int, n long, s double, s2 double").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")]).toPandas().sort_values("i")
    n = int(stats["n"].iloc[0]) if len(stats) else 0
    mean = stats["s"].to_numpy() / max(n, 1)
    sd = np.sqrt(np.maximum(stats["s2"].to_numpy() / max(n, 1) - mean**2, 1e-18)) if n else np.ones(basis.shape[1])

    def order(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            u = _units(part.column(1), dim)
            y = (u @ basis - mean) / sd
            size = dim * 2
            codes = pa.Array.from_buffers(pa.binary(size), len(u), [None, pa.py_buffer(_codes(u).tobytes())]).cast(pa.binary())
            for c in range(curves):
                z = (y[:, c * width : (c + 1) * width] + shift[c]) / 8.0 + 0.44
                cells = np.clip(z * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), c), pa.int32()), pa.array(hilbert_keys(cells, bits), pa.int64()), part.column(0), codes], names=["curve", "key", "id", "code"])

    def windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[_Block] = deque()  # the blocks before, of the same curve
        for new in _blocks(parts, block, dim, k):
            while held and held[0].curve != new.curve:
                yield held.popleft().lists()
            _compare(new, new, k)
            for old in held:
                _compare(new, old, k)
            held.append(new)
            if len(held) > reach:
                yield held.popleft().lists()
        for old in held:
            yield old.lists()

    def ends(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last blocks of a partition, under the number of the bound that they lie at."""
        at, first, last = TaskContext.get().partitionId(), [], deque(maxlen=reach)
        for x in _blocks(parts, block, dim, k):
            if not first or (len(first) < reach and first[0].curve == x.curve):
                first.append(x)
            if last and last[0].curve != x.curve:
                last.clear()
            last.append(x)
        for bound, side, blocks in ((at - 1, 1, first), (at, 0, list(last)[::-1])):
            for i, x in enumerate(blocks):
                yield x.rows(bound, side, i)

    def bridge(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks: dict[tuple[int, int], _Block] = {}
        for (side, i), part in pdf.groupby(["side", "distance"], sort=True):
            codes = np.frombuffer(b"".join(part["code"]), "<i2").reshape(-1, dim)
            blocks[side, i] = _Block(int(part["curve"].iloc[0]), part["id"].to_numpy(np.int64), codes, k)
        made = []
        for (s, i), x in blocks.items():
            for (t, j), y in blocks.items():
                if s == 0 and t == 1 and i + j < reach and x.curve == y.curve:
                    _compare(x, y, k)
        for x in blocks.values():
            made.append(x.lists().to_pandas())
        return pd.concat(made) if made else pd.DataFrame({"id": [], "near": []})

    # Small inputs are split too, but into parts of several windows.
    partitions = max(1, -(-n * curves // rows_per_partition), min(spark.sparkContext.defaultParallelism, n * curves // (2 * (reach + 1) * block)))
    ordered = usable.mapInArrow(order, "curve int, key long, id long, code binary").repartitionByRange(partitions, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    lists = ordered.mapInArrow(windows, _LISTS)
    if partitions > 1:  # both read the same shuffle
        edge = ordered.mapInArrow(ends, "bound int, side int, distance int, curve int, id long, code binary")
        lists = lists.unionAll(edge.groupBy("bound").applyInPandas(bridge, _LISTS))
    # Codes of the same pair have one cosine up to the last digits of its sum: of sorted candidates the first of each neighbour counts.
    merged = lists.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    none = F.slice("near", 1, 0)
    best = F.aggregate("near", none, lambda got, x: F.when((F.size(got) >= k) | F.exists(got, lambda y: y["n"] == x["n"]), got).otherwise(F.concat(got, F.array(x))))
    return merged.select("id", F.posexplode(best).alias("pos", "x")).select("id", (F.col("pos") + 1).alias("rank"), F.col("x.n").alias("neighbour"), (-F.col("x.c").cast("double")).alias("cosine"))


def code_error(dim: int) -> float:
    """Bound of the error of a cosine of two codes: every component is off by half a step of 1 / 32,767 at most."""
    return 2.1 * dim**0.5 / 65_534


class _Block:
    """Consecutive rows of one curve with the best k found for each so far."""

    def __init__(self, curve: int, ids: np.ndarray, codes: np.ndarray, k: int) -> None:
        self.curve, self.ids, self.codes, self.units = curve, ids, codes, _decoded(codes)
        self.cosine, self.near = np.full((len(ids), k), -2.0, np.float32), np.full((len(ids), k), -1, np.int64)

    def lists(self) -> pa.RecordBatch:
        """One list of (-cosine, neighbour) an id; sorting it gives the best first."""
        some = self.cosine > -1.5
        items = pa.StructArray.from_arrays([pa.array(-self.cosine[some]), pa.array(self.near[some])], fields=list(_NEAR.value_type))
        offsets = np.r_[0, np.cumsum(some.sum(1))].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.ListArray.from_arrays(pa.array(offsets), items, type=_NEAR)], names=["id", "near"])

    def rows(self, bound: int, side: int, distance: int) -> pa.RecordBatch:
        n = len(self.ids)
        cells = [pa.array(np.full(n, x), pa.int32()) for x in (bound, side, distance, self.curve)]
        return pa.RecordBatch.from_arrays([*cells, pa.array(self.ids), pa.array([c.tobytes() for c in self.codes], pa.binary())], names=["bound", "side", "distance", "curve", "id", "code"])


def _blocks(parts: Iterator[pa.RecordBatch], block: int, dim: int, k: int) -> Iterator[_Block]:
    """Blocks of consecutive rows of one curve, across the Arrow batches of a partition."""
    curve, ids, codes, size = -1, [], [], 0

    def cut() -> Iterator[_Block]:
        i, c = np.concatenate(ids), np.concatenate(codes)
        pieces = max(1, round(len(i) / block))
        for a, b in zip(np.array_split(i, pieces), np.array_split(c, pieces)):
            yield _Block(curve, a, b, k)

    for part in parts:
        curves = part.column(0).to_numpy()
        bounds = np.r_[0, np.flatnonzero(np.diff(curves)) + 1, len(curves)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            if size and (curves[a] != curve or size >= 8 * block):
                yield from cut()
                ids, codes, size = [], [], 0
            curve = int(curves[a])
            ids.append(part.column(2).slice(a, b - a).to_numpy())
            codes.append(np.frombuffer(b"".join(part.column(3).slice(a, b - a).to_pylist()), "<i2").reshape(-1, dim))
            size += b - a
    if size:
        yield from cut()


def _compare(a: _Block, b: _Block, k: int) -> None:
    """Both blocks learn of each other's vectors."""
    s = a.units @ b.units.T
    if a is b:
        s[a.ids[:, None] == a.ids[None, :]] = -2.0
    elif len(np.intersect1d(a.ids, b.ids, assume_unique=False)):
        s[a.ids[:, None] == b.ids[None, :]] = -2.0
    _learn(a, s, b.ids, k)
    if a is not b:
        _learn(b, np.ascontiguousarray(s.T), a.ids, k)


def _learn(x: _Block, s: np.ndarray, ids: np.ndarray, k: int) -> None:
    """The best k of what x has and of the cosines s to ids."""
    better = s > x.cosine[:, -1:]
    row, col = np.divmod(np.flatnonzero(better), s.shape[1])
    if not len(row):
        return
    if len(row) > 4 * k * len(s):  # many at once, as for copies: the best k of each row first
        at = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
        keep = np.take_along_axis(better, at, 1)
        row, col = np.nonzero(keep)[0], at[keep]
    rows = np.unique(row)
    c = np.concatenate([x.cosine[rows].ravel(), s[row, col]])
    i = np.concatenate([x.near[rows].ravel(), ids[col]])
    r = np.concatenate([np.repeat(rows, k), row])
    order = np.lexsort((i, -c, r))
    r, c, i = r[order], c[order], i[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    first = place < k
    x.cosine[r[first], place[first]], x.near[r[first], place[first]] = c[first], i[first]


def close_pairs(neighbours: DataFrame, least: float, rows: DataFrame, vec_id: str, vector: str, dim: int = 128) -> DataFrame:
    """vec_id_a < vec_id_b of which one is among the other's neighbours with at least that cosine.

    Pairs within code_error of the limit, which are few, are decided by their vectors in rows.
    """
    pair = neighbours.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b"), "cosine").groupBy("vec_id_a", "vec_id_b").agg(F.max("cosine").alias("c"))
    pair = pair.where(F.col("c") >= least - code_error(dim))
    names = ["vec_id_a", "vec_id_b"]
    doubt = pair.where(F.col("c") < least + code_error(dim)).select(*names)
    given = usable_vectors(rows, vec_id, vector, dim).dropDuplicates(["id"])
    both = doubt.join(given.withColumnsRenamed({"id": "vec_id_a", "vector": "va"}), "vec_id_a").join(given.withColumnsRenamed({"id": "vec_id_b", "vector": "vb"}), "vec_id_b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    exact = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    return pair.where(F.col("c") >= least + code_error(dim)).select(*names).unionAll(both.where(exact >= least).select(*names))
