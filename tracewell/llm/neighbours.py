"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected at random to a few dimensions, several times, each time with another shift of the grid, and put in
Hilbert order. Spark range-partitions (curve, key); ranks follow from the partitions' sizes, and blocks of so many ranks
are the units of the search: a query meets the rows within `window` ranks on every curve, in its own block and the next
ones. The window is the one that finds the wanted share of the true neighbours of a bounded sample of queries, so it
follows the table's size and structure; where it spans the table, the search is exact. One-byte codes with a bound of
their error screen what a window holds, and what may be among the nearest is reranked by exact distance.

Equal vectors are one point with its smallest ids, so ties are exact however often a vector repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.common import bounds, stored, whole_groups

SALTS = 16
#: Queries whose true neighbours set the window, and the least window.
SAMPLE, LEAST = 64, 64
#: Distances that are screened at once.
SCREEN = 1 << 22


def hilbert(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place on the Hilbert curve of each row of cells (n x d, below 2 ** bits), as bytes in its order; Skilling's transform."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    for k in range(bits - 1, 0, -1):
        q, p = 1 << k, (1 << k) - 1
        for i in range(d):
            inverted = (x[i] & q) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(inverted, p, swapped)
            x[i] ^= swapped
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for k in range(bits - 1, 0, -1):
        t ^= np.where((x[-1] >> k) & 1, (1 << k) - 1, 0)
    x ^= t
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1  # bits x d x n, the highest bits first
    return [r.tobytes() for r in np.packbits(planes.reshape(bits * d, -1).T.astype(np.uint8), axis=1)]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)


def points(vectors: DataFrame, id_col: str, vector_col: str, n_ids: int) -> tuple[DataFrame, int]:
    """Stored distinct vectors (point, a, b: their hashes, vector, ids: the n_ids smallest) and their dimension, the most common one.

    Vectors are equal if two 64-bit hashes of them are. Only hashes and ids are sorted: copies of a row are dropped first,
    then a vector's ids are cut down in two steps, by a salt of the id first, so that no task sees all copies.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))
    sizes = v.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    v = hashed(v.filter(F.size("vector") == dim))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))
    ids = v.select("a", "b", "vec_id").distinct().withColumn("salt", salt)
    for by in (("a", "b", "salt"), ("a", "b")):
        ids = ids.withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("vec_id"))).filter(F.col("k") <= n_ids).drop("k")
    ids = ids.groupBy("a", "b").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    rows = v.groupBy("a", "b").agg(F.first("vector").alias("vector")).join(ids, ["a", "b"])
    return stored(rows.select(F.monotonically_increasing_id().alias("point"), "a", "b", "vector", "ids"), "points"), dim


def hashed(v: DataFrame) -> DataFrame:
    return v.withColumns({"a": F.xxhash64("vector"), "b": F.xxhash64(F.lit(1), "vector")})


class Frame:
    """Projections, grids and codes, from the mean and spread of all vectors."""

    def __init__(self, pts: DataFrame, dim: int, curves: int, dims: int, bits: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.dim, self.curves, self.dims, self.bits = dim, curves, min(dims, dim), bits
        self.project = project = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : self.dims] for _ in range(curves)], axis=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s, ss = 0, np.zeros(dim + project.shape[1]), np.zeros(dim + project.shape[1])
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    x = matrix(batch.column(0).slice(lo, 2048), dim)
                    y = np.concatenate([x, x @ project], axis=1)
                    n, s, ss = n + len(y), s + y.sum(0), ss + (y * y).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array([float(n)] * len(s)), pa.array(s), pa.array(ss)], names=["k", "n", "s", "ss"])

        got = sorted(pts.select("vector").mapInArrow(run, "k int, n double, s double, ss double").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).collect())
        self.n = int(got[0]["n"]) if got else 0
        mean = np.array([r["s"] for r in got] or np.zeros(dim + project.shape[1])) / max(1, self.n)
        spread = np.sqrt(np.maximum(np.array([r["ss"] for r in got] or np.ones(dim + project.shape[1])) / max(1, self.n) - mean**2, 1e-300))
        self.centre, self.step = mean[:dim], max(1e-150, 4.0 * float(spread[:dim].max())) / 127
        self.corner = mean[dim:] - 2.5 * spread[dim:] - rng.uniform(0, 1.5, size=len(mean) - dim) * spread[dim:]
        self.width = 6.5 * spread[dim:]

    def keys(self, x: np.ndarray) -> Iterator[list[bytes]]:
        """Of each curve, the rows' places on it."""
        top = (1 << self.bits) - 1
        cells = np.clip((x @ self.project - self.corner) / self.width * (top + 1), 0, top).astype(np.int64)
        for c in range(self.curves):
            yield hilbert(cells[:, c * self.dims : (c + 1) * self.dims], self.bits)

    def codes(self, x: np.ndarray) -> list[bytes]:
        """One byte a component, then how far the code may be from the vector (a float, rounded up), in steps."""
        y = (x - self.centre) / self.step
        code = np.clip(np.rint(y), -127, 127).astype(np.int8)
        off = np.nextafter((np.sqrt(((y - code) ** 2).sum(1)) * 1.0001 + 1e-3).astype(np.float32), np.float32(np.inf))
        return [a.tobytes() + b.tobytes() for a, b in zip(code, off)]

    def decoded(self, codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(codes), np.int8).reshape(-1, self.dim + 4)
        return raw[:, : self.dim].astype(np.float32), np.ascontiguousarray(raw[:, self.dim :]).view(np.float32)[:, 0]


def true_neighbours(pts: DataFrame, dim: int, sample: DataFrame, n: int) -> list[tuple[int, int]]:
    """(point, near point): the n nearest other points of the sampled points, by a scan of all; sample has SAMPLE rows at most."""
    asked = sample.collect()
    if not asked:
        return []
    own, x = np.array([r["point"] for r in asked]), np.array([r["vector"] for r in asked], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                p, y = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
                d = (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None]
                d[own[:, None] == p[None]] = np.inf
                best = np.argpartition(d, n - 1, axis=1)[:, :n] if len(p) > n else np.tile(np.arange(len(p)), (len(x), 1))
                got = np.take_along_axis(d, best, 1)
                ok = np.isfinite(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, ok.sum(1))), pa.array(p[best[ok]]), pa.array(got[ok])], names=["q", "c", "d"])

    near = pts.select("point", "vector").mapInArrow(run, "q long, c long, d double")
    near = near.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("d", "c"))).filter(F.col("k") <= n)
    return [(r["q"], r["c"]) for r in near.select("q", "c").collect()]


def nearest(vectors: DataFrame, n: int = 10, every: int = 100, curves: int = 16, dims: int = 8, bits: int = 16, recall: float = 0.96, window: int | None = None, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its n nearest found rows.

    score is the Euclidean distance in double precision; ties go to smaller ids. Vectors null, zero, holding null or
    non-finite components, without an id, or of another than the most common dimension take no part. Rows alike in id and
    vector count once, and rows with the query's id are its own. With fewer candidates than n, all found are returned;
    an empty table gives an empty result; other columns are not read. Every row is on every curve. `window` bounds the
    work of a query on a curve; by default it is the least with which `recall` of the true neighbours of SAMPLE sampled
    queries (the documented bound, answered by a scan) are met. Vectors without structure need windows in proportion to
    the table (see README).
    """
    pts, dim = points(vectors, id_col, vector_col, n + 1)
    ids = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector")).filter(F.col("query_id") % every == 0)
    ids = hashed(ids).select("query_id", "a", "b").distinct()
    queries = stored(ids.join(pts.select("point", "a", "b"), ["a", "b"]).select("query_id", "point"), "queries")
    frame = Frame(pts, dim, curves, dims, bits, seed)

    def on_curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                for c, key in enumerate(frame.keys(matrix(batch.column(1), dim))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c, np.int32)), pa.array(key, pa.binary()), batch.column(0)], names=["curve", "key", "point"])

    keyed = stored(pts.select("point", "vector").mapInArrow(on_curves, "curve int, key binary, point long"), "curve-keys")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(k, k + b.num_rows)), b.column("curve"), b.column("point")], names=["part", "k", "curve", "point"])
            k += b.num_rows

    ordered = keyed.repartitionByRange(parts, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    ordered = stored(ordered.mapInArrow(numbered, "part int, k long, curve int, point long"), "curve-order")
    # One count a partition and curve: places in the whole order, then in the curve, follow from them.
    counts = sorted((r["curve"], r["part"], r["n"], r["lo"]) for r in ordered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("k").alias("lo")).collect())
    base, before = {}, {}
    for c, part, rows, lo in counts:
        base[c, part] = before.get(c, 0) - lo
        before[c] = before.get(c, 0) + rows
    spark = ordered.sparkSession
    offsets = spark.createDataFrame([(c, p, o) for (c, p), o in base.items()], "curve int, part int, base long")
    ranked = ordered.join(F.broadcast(offsets), ["curve", "part"]).select("curve", (F.col("k") + F.col("base")).alias("place"), "point")
    if window is None:
        drawn = queries.select("point").distinct().orderBy(F.xxhash64("point"), "point").limit(SAMPLE)
        true = true_neighbours(pts, dim, pts.join(drawn, "point").select("point", "vector"), n)
        window = _window(spark, ranked, true, recall)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frame.codes(matrix(batch.column(1), dim)), pa.binary())], names=["point", "code"])

    codes = pts.select("point", "vector").mapInArrow(coded, "point long, code binary")
    ranked = ranked.join(codes, "point")
    data = ranked.withColumns({"block": F.floor(F.col("place") / window), "kind": F.lit(0)})
    asked = ranked.join(queries.select("point").distinct(), "point")
    asked = asked.withColumns({"block": F.explode(F.sequence(F.floor(F.greatest(F.col("place") - window, F.lit(0)) / window), F.floor((F.col("place") + window) / window))), "kind": F.lit(1)})
    both = data.unionByName(asked).select("curve", F.col("block").cast("long").alias("block"), "kind", "place", "point", "code")
    n_all = n + 1  # the query's own point is among them

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["curve", "block"], 5_000):
            cut = bounds(rows, ["curve", "block"])
            kind, place, point = (rows.column(c).to_numpy() for c in ("kind", "place", "point"))
            code, off = frame.decoded(rows.column("code").to_pylist())
            for a, b in zip(cut, cut[1:]):
                m = a + int((kind[a:b] == 0).sum())
                if m == b or m == a:
                    continue
                x, norm, step = code[a:m], (code[a:m] * code[a:m]).sum(1)[None], max(1, SCREEN // (m - a))
                for lo in range(m, b, step):
                    hi = min(b, lo + step)
                    q = code[lo:hi]
                    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + norm, 0))
                    slack = off[lo:hi][:, None] + off[a:m][None]
                    far = np.abs(place[lo:hi][:, None] - place[a:m][None]) > window
                    high = np.where(far, np.inf, d + slack)
                    most = np.partition(high, n_all - 1, axis=1)[:, n_all - 1] if m - a >= n_all else np.full(hi - lo, np.inf)
                    r, c = np.nonzero(~far & (d - slack <= most[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(point[lo:hi][r]), pa.array(point[a:m][c]), *(pa.array(v[r, c].astype(float)) for v in (d - slack, high))], names=["q", "c", "low", "high"])

    near = both.repartition("curve", "block").sortWithinPartitions("curve", "block", "kind").mapInArrow(screen, "q long, c long, low double, high double")
    # Merge the curves: each point once, and of a query's points those that may still be among the nearest.
    near = near.groupBy("q", "c").agg(F.min("low").alias("low"), F.min("high").alias("high"))
    near = near.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("high", "c")))
    near = near.withColumn("most", F.max(F.when(F.col("k") <= n_all, F.col("high"))).over(W.partitionBy("q"))).filter(F.col("low") <= F.col("most")).select("q", "c")
    exact = lambda name, **more: pts.select(F.col("point").alias(name), F.col("vector").cast("array<double>").alias(more["vector"]), *more["also"])
    pair = near.join(exact("q", vector="x", also=[]), "q").join(exact("c", vector="y", also=["ids"]), "c")
    square = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)
    scored = pair.select("q", F.sqrt(square).alias("score"), F.explode("ids").alias("vec_id"))
    best = scored.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("k") <= n_all)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    answered = queries.join(lists, queries["point"] == lists["q"])
    own = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, n)
    out = answered.select("query_id", F.posexplode(own).alias("k", "f"))
    return out.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def _window(spark, ranked: DataFrame, true: list[tuple[int, int]], recall: float) -> int:
    """The least window that meets a share of `recall` of the pairs (point, near point) on some curve."""
    if not true:
        return LEAST
    pairs = spark.createDataFrame([(k, x) for k, p in enumerate(true) for x in p], "pair int, point long")
    ends = ranked.join(F.broadcast(pairs), "point")  # two rows for each of SAMPLE queries and its n neighbours
    apart = ends.groupBy("pair", "curve").agg((F.max("place") - F.min("place")).alias("d")).groupBy("pair").agg(F.min("d").alias("d"))
    gaps = sorted(r["d"] for r in apart.collect())
    return max(LEAST, int(gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))))]))
