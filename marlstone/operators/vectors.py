"""Vectors: blocked top-k search, threshold joins, means, k-means.

Products are numpy in Arrow batches. What is sent to the executors is a set of
pivots or the centroids, both of a size that a parameter sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import bounded, written

#: Bytes of vectors that a task holds of each side, and of the centroids that every task holds.
BLOCK_BYTES, CENTROID_BYTES = 16 << 20, 256 << 20
#: Passes that draw candidates for the first centroids, and how many times k each draws.
DRAWS, OVERSAMPLED = 3, 2
#: Decimal places to which a cosine is rounded before it is held against a threshold.
PLACES = 9
#: Rows of a block of ``matches``, and of two blocks those whose pairs stand in one batch at once.
MATCH_ROWS, STEP = 4096, (128, 4096)
#: Of ``matches``: vectors of a partition, and partitions (of blocks; their squares are tasks).
PART_ROWS, MOST_PARTS = 10_000, 32


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def checked(rows: DataFrame, dim: int) -> DataFrame:
    """rows whose embeddings have ``dim`` elements; another length is an error when it is met, a null stays."""
    right = F.col("embedding").isNull() | (F.size("embedding") == dim)
    return rows.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"an embedding of another length than {dim}: "), F.size("embedding").cast("string"))).cast(rows.schema["embedding"].dataType)))


def _block_rows(rows: DataFrame) -> int:
    first = rows.select(F.size("embedding").alias("n")).first()
    return max(1, BLOCK_BYTES // (8 * max(1, first.n))) if first else 1


def _blocks(rows: DataFrame, n: Column) -> Column:
    return F.pmod(F.xxhash64("vec_id"), n).cast("int")


def top_k(queries: DataFrame, rows: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """query_id, vec_id, score and place: the ``k`` rows of greatest cosine to each query, itself left out.

    Exact: every row meets every query. Queries and rows are dealt into blocks of about ``block_rows`` by a hash; each
    pair of blocks is a group of its own, whose task multiplies the two and keeps ``k`` a query, and a window takes the
    best of those. Nothing passes through the driver. Ties go to the smaller vec_id.
    """
    queries, rows = (df.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")) for df in (queries, rows))
    size = block_rows or _block_rows(rows)
    n_q, n_r = (max(1, -(-df.count() // size)) for df in (queries, rows))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = queries.select("*", _blocks(queries, F.lit(n_q)).alias("q")).select("*", every(n_r, "r"))
    right = rows.select("*", _blocks(rows, F.lit(n_r)).alias("r")).select("*", every(n_q, "q"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            ids, vec = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
            dim = len(a.column("embedding")[0])
            q, m = (_unit(_matrix(t.column("embedding").combine_chunks(), dim)) for t in (a, b))
            by_id = np.argsort(vec, kind="stable")
            vec, m = vec[by_id], m[by_id]
            step = max(1, BLOCK_BYTES // (8 * len(vec)))
            for at in range(0, len(ids), step):
                own = ids[at : at + step]
                score = np.round(q[at : at + step] @ m.T, 6) + 0.0
                score[own[:, None] == vec[None]] = -np.inf
                place = np.argsort(-score, axis=1, kind="stable")[:, :k]  # rows come by vec_id, so ties do too
                best = np.take_along_axis(score, place, axis=1)
                keep = best > -np.inf
                out.append((np.repeat(own, keep.sum(axis=1)), vec[place][keep], best[keep]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    left = left.toDF(*left.columns)  # columns of its own, as both sides may come from one table
    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = F.col("embedding").cast("array<double>")
    some = rows.where("embedding IS NOT NULL").select("vec_id", e.alias("embedding")).where(F.exists("embedding", lambda x: x != 0))
    least = some.groupBy("embedding").agg(F.min("vec_id").alias("class"))
    return some, least, some.join(least, "embedding").select("class", "vec_id")


def equal_classes(rows: DataFrame) -> DataFrame:
    """class and vec_id of every vector that is not null and not of zeros: equal vectors are one class, named by its least vec_id; nothing is compared."""
    return _classes(rows)[2]


def _distances(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of vectors of length 1."""
    return np.sqrt(np.maximum(2 - 2 * m @ p.T, 0))


def matches(rows: DataFrame, least: float = 0.92, pivots: int = 64, block_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, members, work): all pairs a < b of different vectors with a cosine of ``least`` or more, and its score.

    Equal vectors are one class from the start, named by its least vec_id: members has class and vec_id, pairs are
    between classes. On the unit sphere a cosine of ``least`` is a distance r. Each vector lives in the cell of its
    nearest of some pivots (the first by a hash; at most ``pivots`` travel), and a cell is cut into blocks by a hash.
    Two blocks meet unless the distances of their vectors to some pivot lie more than r apart. Of two that meet, a
    vector counts only if the half-space between the two cells' pivots and the other block's distances to them allow
    it, and two are compared only if their distances to the first block's pivot differ by about r at most. All these
    bounds hold in any space of distances, so no pair is lost. Cosines are rounded to ``PLACES`` before they meet
    ``least``, as one that is ``least`` exactly may come out a bit less. work has, for each pair of blocks, how many
    pairs were compared; it compares again.

    Only the blocks are written, a row each. They meet in a product of partitions without a shuffle, and pairs leave a
    task as they are found: the disk grows with the vectors, not with the pairs.

    A null vector, or one of zeros, matches nothing.
    """
    spark = rows.sparkSession
    _, members, member = _classes(rows)
    classes = written(members.select(F.col("class").alias("vec_id"), "embedding"), "classes")
    picked = classes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not picked:
        return classes.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), F.lit(0.0).alias("score")).limit(0), member, classes.select(F.lit(0).cast("long").alias("compared")).limit(0)
    p = _unit(np.array([r.embedding for r in picked], dtype=np.float64))
    dim = p.shape[1]
    r = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6  # room for rounding: a bound may only keep too much
    sent = spark.sparkContext.broadcast(p)  # ``pivots`` vectors
    bounded(spark)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _unit(_matrix(batch.column(1), dim))
            home = _distances(m, sent.value).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(m), pa.list_(pa.float64())), pa.array(home, pa.int32())], names=["vec_id", "embedding", "cell"])

    def packed(block: pa.Table) -> pa.Table:
        m = _matrix(block.column("embedding").combine_chunks(), dim)
        d = _distances(m, sent.value)
        cell = block.column("cell")[0].as_py()
        ids = block.column("vec_id").to_numpy()
        one = [cell, (cell << 32) + block.column("block")[0].as_py(), ids.tobytes(), m.tobytes(), d.min(axis=0), d.max(axis=0)]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(one, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=["cell", "number", "ids", "m", "low", "high"])

    celled = classes.select("vec_id", "embedding").mapInArrow(put, "vec_id long, embedding array<double>, cell int")
    size = block_rows or min(_block_rows(classes), MATCH_ROWS)
    n = celled.groupBy("cell").count()
    met = celled.join(F.broadcast(n), "cell").select("cell", "vec_id", "embedding", _blocks(celled, F.ceil(F.col("count") / size)).alias("block"))  # n has a row a pivot
    parts = min(classes.count() // PART_ROWS, MOST_PARTS) + 1
    blocks = written(met.repartition(parts, "cell", "block").groupBy("cell", "block").applyInArrow(packed, "cell int, number long, ids binary, m binary, low array<double>, high array<double>"), "blocks")
    left, right = (blocks.toDF(*[f"{side}_{c}" for c in blocks.columns]) for side in "ab")
    apart = F.exists(F.zip_with("a_low", "b_high", lambda x, y: x - y), lambda g: g > r) | F.exists(F.zip_with("b_low", "a_high", lambda x, y: x - y), lambda g: g > r)
    pair = left.hint("shuffle_replicate_nl").join(right, (F.col("a_number") <= F.col("b_number")) & ~apart).select("a_cell", "b_cell", "a_ids", "b_ids", "a_m", "b_m")

    def compared(i: int, j: int, ix: np.ndarray, iy: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple]:
        """Parts of two blocks, of cells i and j, that may match: ids, vectors and which pairs count (None: all)."""
        p = sent.value[[i, j]]
        dx, dy = _distances(x, p), _distances(y, p)
        fits = (dx[:, 1] >= dy[:, 1].min() - r) & (dx[:, 1] <= dy[:, 1].max() + r) & (dx[:, 0] >= dy[:, 0].min() - r) & (dx[:, 0] <= dy[:, 0].max() + r)
        fits_y = (dy[:, 0] >= dx[:, 0].min() - r) & (dy[:, 0] <= dx[:, 0].max() + r) & (dy[:, 1] >= dx[:, 1].min() - r) & (dy[:, 1] <= dx[:, 1].max() + r)
        if (gap := float(_distances(p[:1], p[1:])[0, 0])) > 0:  # the plane half way between the two pivots
            fits &= (dx[:, 1] ** 2 - dx[:, 0] ** 2) / (2 * gap) <= r
            fits_y &= (dy[:, 0] ** 2 - dy[:, 1] ** 2) / (2 * gap) <= r
        at, to = np.flatnonzero(fits), np.flatnonzero(fits_y)
        at, to = at[np.argsort(dx[at, 0])], to[np.argsort(dy[to, 0])]
        fx, fy, ix, iy, x, y = dx[at, 0], dy[to, 0], ix[at], iy[to], x[at], y[to]
        for a in range(0, len(at), STEP[0]):
            own = slice(a, a + STEP[0])
            lo, hi = np.searchsorted(fy, fx[own][0] - r), np.searchsorted(fy, fx[own][-1] + r, side="right")
            for b in range(lo, hi, STEP[1]):
                other = slice(b, min(hi, b + STEP[1]))
                yield ix[own], iy[other], x[own], y[other], ix[own][:, None] < iy[other][None] if same else None

    def run(batches: Iterator[pa.RecordBatch], counts: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *bytes_ in zip(*(batch.column(c).to_pylist() for c in ("a_cell", "b_cell", "a_ids", "b_ids", "a_m", "b_m")), strict=True):
                same = bytes_[0] == bytes_[1]
                ix, iy, x, y = *(np.frombuffer(v, np.int64) for v in bytes_[:2]), *(np.frombuffer(v, np.float64).reshape(-1, dim) for v in bytes_[2:])
                n = 0
                for a, b, u, v, own in compared(i, j, ix, iy, x, y, same):
                    if counts:
                        n += len(a) * len(b) if own is None else int(own.sum())
                        continue
                    score = u @ v.T
                    near = score >= least - 10.0**-PLACES
                    if own is not None:
                        near &= own
                    hits = np.count_nonzero(near, axis=1)
                    at = np.flatnonzero(near)
                    s = score.ravel()[at]
                    a, b = np.repeat(a, hits), b[at - np.repeat(np.arange(len(a)) * len(b), hits)]
                    if len(s) and s.min() < least + 10.0**-PLACES:
                        keep = np.round(s, PLACES) >= least
                        a, b, s = a[keep], b[keep], s[keep]
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s)], names=["a", "b", "score"])
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["compared"])

    return pair.mapInArrow(run, "a long, b long, score double"), member, pair.mapInArrow(lambda b: run(b, True), "compared long")


def means(rows: DataFrame, keys: list[str], most: int = 4096) -> DataFrame:
    """The keys and centroid: the mean of the embeddings of each key; rows without one are left out.

    Tasks send sums and counts of the keys that they meet, ``most`` at a time. Vectors of different lengths under one key are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}

        def told() -> Iterator[pa.RecordBatch]:
            if sums:
                cols = [pa.array([k[i] for k in sums], kinds[i]) for i in range(len(keys))]
                n = pa.array([v[1] for v in sums.values()], pa.int64())
                total = pa.array([v[0] for v in sums.values()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*cols, n, total], names=[*keys, "n", "total"])
                sums.clear()

        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(keys))]
            owners = zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)
            vec = batch.column(len(keys))
            values, at = np.asarray(vec.flatten(), dtype=np.float64), np.concatenate(([0], np.cumsum(pc.list_value_length(vec).to_numpy())))
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(owners):
                places.setdefault(key, []).append(i)
            for key, own in places.items():
                total = sum((values[at[i] : at[i + 1]] for i in own), np.float64(0))
                have = sums.get(key)
                sums[key] = [have[0] + total, have[1] + len(own)] if have else [total, len(own)]
            if len(sums) > most:
                yield from told()
        yield from told()

    some = rows.where("embedding IS NOT NULL").select(*keys, F.col("embedding").cast("array<double>").alias("embedding"))
    kinds_ = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.select(*keys).schema)
    parts = some.mapInArrow(run, f"{kinds_}, n long, total array<double>").select(*keys, "n", F.posexplode("total").alias("i", "x"))
    each = parts.groupBy(*keys, "i").agg((F.sum("x") / F.sum("n")).alias("m"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def pick_k(n: int, wanted: int | None = None) -> int:
    """Number of clusters for ``n`` rows: the wanted one, or the root of half the rows, two at least."""
    if n <= 1:
        return n
    return min(n, wanted if wanted else max(2, int(math.sqrt(n / 2))))


def _steps(batch: pa.RecordBatch, centroids: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose distances to all centroids take ``BLOCK_BYTES`` at most, whatever their number."""
    n = max(1, BLOCK_BYTES // (8 * max(1, centroids)))
    yield from (batch.slice(at, n) for at in range(0, batch.num_rows, n))


def nearest(rows: DataFrame, centroids: np.ndarray, keep: bool = False) -> DataFrame:
    """vec_id, cluster and distance (squared euclidean) to the nearest centroid, ties to the lowest; with ``keep`` the embedding too."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for whole in batches:
            for batch in _steps(whole, len(c)):
                m = _matrix(batch.column(1), c.shape[1])
                d = np.maximum((m**2).sum(1)[:, None] - 2 * m @ c.T + (c**2).sum(1)[None], 0.0)
                cols = {"vec_id": batch.column(0), "cluster": pa.array(d.argmin(1), pa.int32()), "distance": pa.array(d.min(1))} | ({"embedding": batch.column(1)} if keep else {})
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    vector = f", embedding {rows.schema['embedding'].dataType.simpleString()}" if keep else ""
    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cluster int, distance double" + vector)


def _weighted_seeds(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the points, each drawn in proportion to its weight and squared distance to those before; the first point first."""
    r = np.random.default_rng(seed)
    chosen = [0]
    d = ((points - points[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        w = weights * d
        total = w.sum()
        nxt = int(np.searchsorted(np.cumsum(w), r.random() * total, side="right")) if total > 0 else int(d.argmax())
        chosen.append(min(nxt, len(points) - 1))
        d = np.minimum(d, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def seeds(rows: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    """``k`` first centroids in ``DRAWS`` + 2 passes, whatever k.

    The row of least vec_id is the first candidate. Each of ``DRAWS`` passes adds ``OVERSAMPLED`` times k rows, drawn
    without replacement in proportion to their squared distance to the candidates: a race, in which the least
    ``-ln(u) / distance`` win, with u from a hash of vec_id, pass and seed. One more pass counts the rows nearest to
    each candidate, and from the candidates with these weights k are drawn on the driver, which holds
    1 + DRAWS * OVERSAMPLED * k vectors and never more than ``CENTROID_BYTES`` of them.
    """
    first = rows.orderBy("vec_id").select("embedding").first()
    found = np.array([first.embedding], dtype=np.float64)
    if (1 + DRAWS * OVERSAMPLED * k) * found.shape[1] * 8 > CENTROID_BYTES:
        raise ValueError(f"{k} clusters of {found.shape[1]} dimensions need more than {CENTROID_BYTES} bytes; name a smaller number")
    for step in range(DRAWS):
        u = (F.pmod(F.xxhash64("vec_id", F.lit(step), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        far = nearest(rows, found, keep=True).where("distance > 0")
        won = far.select("vec_id", "embedding", (-F.log(u) / F.col("distance")).alias("race")).orderBy("race", "vec_id").limit(OVERSAMPLED * k)
        more = [r.embedding for r in sorted(won.collect(), key=lambda r: (r.race, r.vec_id))]
        if more:
            found = np.vstack((found, np.array(more, dtype=np.float64)))
    n = dict(nearest(rows, found).groupBy("cluster").count().collect())
    return _weighted_seeds(found, np.array([n.get(i, 0) for i in range(len(found))], dtype=np.float64), k, seed)


def kmeans(rows: DataFrame, k: int | None = None, most_rounds: int = 50, tolerance: float = 1e-4, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(assignments, centroids): Lloyd's iterations until the centroids move less than ``tolerance``.

    A round is one pass: tasks add up the vectors of each cluster, the sums are added on the executors, and the driver
    gets a row a cluster. An empty cluster keeps its centroid. The assignments are those that made the last move. With
    k or fewer rows each is a cluster of its own, in order of vec_id. The driver and each task hold the centroids.
    """
    rows = rows.where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    k = pick_k(n, k)
    if not k:
        return nearest(rows, np.zeros((1, 1))), np.zeros((0, 0))
    if k >= n:
        own = rows.orderBy("vec_id").collect()  # k rows at most
        place = F.row_number().over(Window.orderBy("vec_id")) - 1
        return rows.select("vec_id", place.cast("int").alias("cluster"), F.lit(0.0).alias("distance")), np.array([r.embedding for r in own], dtype=np.float64)
    centroids = seeds(rows, k, seed)
    for _ in range(most_rounds):
        sent = rows.sparkSession.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            c = sent.value
            total = np.zeros((len(c), c.shape[1] + 1))  # the last element counts
            half = (c**2).sum(1)[None]
            for whole in batches:
                for batch in _steps(whole, len(c)):
                    m = _matrix(batch.column(1), c.shape[1])
                    own = (half - 2 * m @ c.T).argmin(1)
                    np.add.at(total, own, np.hstack((m, np.ones((len(m), 1)))))
            some = np.flatnonzero(total[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["cluster", "total"])

        parts = rows.mapInArrow(run, "cluster long, total array<double>").select("cluster", F.posexplode("total").alias("i", "x"))
        sums = parts.groupBy("cluster", "i").agg(F.sum("x").alias("x")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("t"))
        moved = centroids.copy()
        for r in sums.collect():
            t = np.array([x.x for x in r.t])
            moved[r.cluster] = t[:-1] / t[-1]
        shift = float(np.linalg.norm(moved - centroids))
        before, centroids = centroids, moved
        if shift < tolerance:
            break
    return nearest(rows, before), centroids
