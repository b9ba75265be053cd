"""Exact top-k inner products by a Voronoi join.

Vectors are quantised to integers. Pivots cut the space into cells; each cell's number of
vectors and radius bound the score of a query with any of its vectors. From those summaries
every query gets a score that k vectors are sure to reach, and a cell is sent to a group of
queries only if it can hold something better for one of them. Groups and cells travel in
blocks of bounded size and are solved with matrix products; the best k of each block are
merged. Nothing is approximate.

Vectors of several lengths have cells of their own, as only the common components count: a
shorter vector acts like one that goes on with zeros.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskmart.llm.storing import extended, kept, partitions

SCALE = 64
PIVOTS = 32                 # at least
MOST_PIVOTS = 1024
BLOCK_ROWS = 4096           # data vectors in a block; also the vectors a pivot stands for, about
GROUP_ROWS = 2048           # queries in a group, at most
TASK_BLOCKS = 16            # blocks that one task holds against a group
EVERY = 20
LONGEST = 2**63 - 1         # scores beyond are listed as this


def quantised(vectors: DataFrame, id_col, vector_col) -> DataFrame:
    """(id, v): floor(SCALE * component) of the vectors that take part; beyond 64 bits the nearest such number."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(
        F.col("x"), lambda c: c.isNull() | F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf")))
    )
    rows = vectors.withColumn("x", x).where(good & (F.size("x") > 0))
    return rows.select(
        F.col(id_col).cast("long").alias("id"), F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v")
    )


def matrix(column):
    """A list column as a float matrix, shorter rows filled with zeros, and the rows' lengths."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=1))
    if len(sizes) and sizes.min() == width:
        return flat.reshape(len(sizes), width), sizes
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def fitted(pivots, width):
    """The pivots with as many components."""
    out = np.zeros((len(pivots), width))
    out[:, : pivots.shape[1]] = pivots[:, :width]
    return out


def nearest(x, pivots):
    """(cell, distance) of the closest pivot of each row."""
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1), 0)
    cell = d.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _placed(vectors, pivots, n_cells):
    """The rows of (id, v, ...) with their length n, and cell and distance among the first n_cells pivots."""

    def place(batches):
        for batch in batches:
            x, sizes = matrix(batch.column(1))
            cell, distance = np.zeros(len(x), np.int32), np.zeros(len(x))
            for n in np.unique(sizes):
                use = sizes == n
                cell[use], distance[use] = nearest(x[use, :n], fitted(pivots.value[:n_cells], n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(cell), pa.array(distance)],
                names=[*batch.schema.names, "n", "cell", "distance"],
            )

    return vectors.mapInArrow(place, extended(vectors, vectors.columns, "n int, cell int, distance double"))


def _packed(rows, keys, more=()):
    """Rows of equal keys as one row, ordered by id: ids, vectors (as `wide` where 32 bits do not do) and more columns."""
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "v", *more))).alias("r"))
    got = got.select(*keys, F.col("r.id").alias("ids"), F.flatten("r.v").alias("w"), *[F.col(f"r.{c}").alias(c) for c in more])
    narrow = ~F.exists("w", lambda c: (c > 2**31 - 1) | (c < -(2**31)))
    return got.withColumns({
        "values": F.when(narrow, F.col("w").cast("array<int>")), "wide": F.when(~narrow, F.col("w"))
    }).drop("w")


def needed_cells(x, pivots, counts, radii, k, own):
    """Which cells each query has to see, from the cells' sizes and radii.

    `own` are the numbers of rows with the queries' ids, which they do not meet. The slack is
    far above what rounding can do to a bound.
    """
    if not len(x):
        return np.zeros((0, len(counts)), bool)
    size = np.sqrt((x**2).sum(1))[:, None]
    middle, reach = x @ pivots.T, size * radii
    slack = 1e-9 * (1 + size * (np.sqrt((pivots**2).sum(1)) + radii))
    low, high = middle - reach - slack, middle + reach + slack
    low[:, counts == 0] = -np.inf
    order = np.argsort(-low, 1)
    seen = np.cumsum(counts[order], 1)
    enough = k + np.asarray(own)      # more, for the query's own rows
    at = np.minimum((seen < enough[:, None]).sum(1), len(counts) - 1)
    sure = low[np.arange(len(x)), order[np.arange(len(x)), at]]
    sure[seen[:, -1] < enough] = -np.inf
    return (high >= sure[:, None]) & (counts > 0)


def top_inner_products(vectors: DataFrame, k=20, id_col="vec_id", vector_col="embedding", every=EVERY) -> DataFrame:
    """For each query (id divisible by `every`) its k best other vectors: query_id, rank, id, score.

    Ties go to the smaller id. Vectors that are null or empty or hold a null or non-finite
    component take no part. Vectors of different lengths meet in their common components.
    Products are whole numbers of any size; a score beyond 64 bits is ranked and listed as the nearest
    64-bit number. Rows of one id never meet each other; a repeated id counts as several
    vectors, and as one query, that of its smallest vector. An empty table gives no rows. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = kept(quantised(vectors, id_col, vector_col))
    wanted = min(MOST_PIVOTS, max(PIVOTS, rows.count() // BLOCK_ROWS))
    seeds = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").distinct().collect()]
    pivots = np.zeros((max(len(seeds), 1), max(map(len, seeds), default=1)))
    for row, seed in zip(pivots, seeds):
        row[: len(seed)] = seed
    shared = spark.sparkContext.broadcast(pivots)
    placed = kept(_placed(rows, shared, len(pivots)))
    # a row per cell of each length
    summary = placed.groupBy("n", "cell").agg(F.count("*").alias("rows"), F.max("distance").alias("r")).orderBy("n", "cell").collect()
    lengths, cells = np.array([s["n"] for s in summary], np.int64), np.array([s["cell"] for s in summary], np.int64)
    counts, radii = np.array([s["rows"] for s in summary], np.int64), np.array([s["r"] for s in summary], np.float64)
    blocks_of = np.maximum(1, -(-counts // BLOCK_ROWS))

    # equal vectors and ids are spread over a cell's blocks by their place in the stored table
    sizes = spark.createDataFrame(
        [(s["n"], s["cell"], int(b)) for s, b in zip(summary, blocks_of)], "n int, cell int, blocks int"
    )
    salted = placed.join(F.broadcast(sizes), ["n", "cell"]).withColumn(
        "block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("blocks")).cast("int")
    )
    data = kept(_packed(salted, ["n", "cell", "block"]))

    asked = kept(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("own")))
    n_asked = asked.count()
    groups = int(min(len(pivots), max(1, -(-n_asked // GROUP_ROWS))))
    near = _placed(asked, shared, groups)
    parts = max(1, -(-n_asked // (groups * GROUP_ROWS)))
    near = near.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumnsRenamed({"cell": "group", "n": "size"})
    queries = kept(_packed(near, ["size", "group", "part"], ["own"]))
    slices = max(1, -(-int(blocks_of.sum()) // TASK_BLOCKS))

    def route(batches):
        for batch in batches:
            out = {c: [] for c in ("size", "group", "part", "n", "cell", "block")}
            for size, group, part, ids, own, values, wide in zip(*(batch.column(i) for i in range(7))):
                x = _values(values, wide).astype(np.float64).reshape(len(ids), -1)
                own = np.array(own.as_py())
                # against the cells of every length, in the components they share
                need = np.zeros(len(counts), bool)
                at = fitted(shared.value, max(size.as_py(), int(lengths.max())))[cells]
                at[np.arange(at.shape[1])[None, :] >= lengths[:, None]] = 0
                x = np.hstack([x, np.zeros((len(x), at.shape[1] - x.shape[1]))])
                for first in range(0, len(x), 256):
                    part_x, part_own = x[first:first + 256], own[first:first + 256]
                    need |= needed_cells(part_x, at, counts, radii, k, part_own).any(0)
                for cell in np.flatnonzero(need):
                    for block in range(blocks_of[cell]):
                        row = size.as_py(), group.as_py(), part.as_py(), int(lengths[cell]), int(cells[cell]), block
                        for c, v in zip(out, row):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int32()) for c in out]))

    tasks = queries.mapInArrow(route, "size int, group int, part int, n int, cell int, block int")
    tasks = kept(tasks.withColumn("slice", F.pmod(F.xxhash64("n", "cell", "block"), F.lit(slices)).cast("int")))
    place = ["size", "group", "part", "slice"]
    columns = [*place, "is_data", "n", "ids", "values", "wide"]
    # a slice of blocks gets its queries once, before the blocks
    heads = tasks.select(*place).distinct().join(queries, ["size", "group", "part"]).select(
        *place, F.lit(False).alias("is_data"), F.col("size").alias("n"), "ids", "values", "wide"
    )
    blocks = tasks.join(data, ["n", "cell", "block"]).withColumn("is_data", F.lit(True)).select(*columns)
    met = heads.unionByName(blocks).repartition(partitions(vectors), *place).sortWithinPartitions(*place, "is_data")

    def solve(batches):
        best = None
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(6)[i].values.to_numpy(zero_copy_only=False)
                values = _values(batch.column(7)[i], batch.column(8)[i]).reshape(len(ids), -1)
                if not batch.column(4)[i].as_py():
                    if best is not None:
                        yield _ranked(*best)
                    x, best = values, (ids, None, None)
                else:
                    best = _merged(best, _products(x, values), ids, k)
        if best is not None:
            yield _ranked(*best)

    partial = met.mapInArrow(solve, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _values(values, wide):
    """The numbers of a packed cell as 64-bit integers."""
    return (values if values.is_valid else wide).values.to_numpy(zero_copy_only=False).astype(np.int64)


def _products(x, y):
    """Inner products over the common components as whole numbers, exact whatever their size."""
    d = min(x.shape[1], y.shape[1])
    x, y = x[:, :d], y[:, :d]
    bound = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) * d
    if bound < 2**53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return x @ y.T
    exact = x.astype(object) @ y.T.astype(object)
    return np.clip(exact, -LONGEST - 1, LONGEST).astype(np.int64)


def _merged(best, scores, ids, k):
    """The k best per query of what was best and new scores; ties to the smaller id.

    Ranks sort by the complement of a score, which reverses the order without leaving 64 bits.
    """
    query_ids, top, top_ids = best
    names = np.broadcast_to(ids, scores.shape)
    hidden = ids[None, :] == query_ids[:, None]
    if top is not None:
        scores, names = np.hstack([top, scores]), np.hstack([top_ids, names])
        hidden = np.hstack([top_ids == query_ids[:, None], hidden])
    if scores.shape[1] > 4 * k and not hidden.any():
        # everything tied with the k-th stays until the ids decide
        cut = np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k]
        columns = np.flatnonzero((scores >= cut[:, None]).any(0))
        scores, names, hidden = scores[:, columns], names[:, columns], hidden[:, columns]
    order = np.lexsort((names, ~scores, hidden), axis=1)[:, :k]
    return query_ids, np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)


def _ranked(query_ids, scores, ids):
    if scores is None:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["query_id", "id", "score"])
    keep = ids != query_ids[:, None]      # hidden rows come last, and only where there are too few others
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(query_ids, keep.sum(1)).astype(np.int64)), pa.array(ids[keep]), pa.array(scores[keep].astype(np.int64))],
        names=["query_id", "id", "score"],
    )
