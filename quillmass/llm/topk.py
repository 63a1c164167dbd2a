"""Exact top-k inner products (operator 3): norm-sorted scan with SVD-rotated partial sums.

Vectors are integers, floor(scale * x). The longest vectors (a bounded head, broadcast) give every query a first
threshold, the k-th score that they reach. A candidate shorter than threshold / |query| cannot be among a query's
best, so queries are sorted by that length into blocks, candidates into bands by length, and only (block, shard)
cells that can reach a threshold are shuffled at all. The bands of the longest candidates run first; what they
find raises the thresholds for the rest.

A cell is one task's work, of bounded size. It walks its candidates by descending length. Both sides are rotated
onto the principal directions of all vectors, so the first coordinates carry most of the product: their partial
sum plus the product of the residual lengths (Cauchy-Schwarz) bounds the score, and only pairs whose bound
reaches the query's threshold are computed, in exact integers. A query whose length times the next candidate's
length stays under its threshold is done. Bounds are doubles with a slack for their rounding; scores never are:
products that could leave 53 bits are taken in 64-bit integers. A component or a score that does not fit in a long
is an error ("out of the range of long"), not a wrong row.

Rows whose id is null, or whose vector is null, empty or holds null or non-finite components, take no part.
Vectors meet only vectors of their own dimension. A query's own id is never its candidate; rows that repeat both
id and vector count once as queries, and each as a candidate. Fewer than k candidates: all are returned. Ties go
to the smaller id. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

FOUND = "query_id long, query_key long, vec_id long, score long"
LEAST = np.iinfo(np.int64).min
#: Directions are found within groups of so many coordinates, for so many of the most frequent dimensions.
GROUP, MOST_DIMS = 256, 16
#: Relative rounding of the bounds, against the product of the lengths.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of long), dim, norm of the rows that take part."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(e.cast("double")))
    large = F.raise_error(F.lit(f"{vector_col}: a component is out of the range of long")).cast("long")
    v = F.transform(x, lambda e: F.when(F.abs(e.cast("double") * scale) < float(1 << 63), F.floor(e.cast("double") * scale).cast("long")).otherwise(large))
    kept = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    out = kept.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return out.withColumn("dim", F.size("v")).withColumn("norm", norm)


def _matrix(column, dim: int) -> np.ndarray:
    values = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _most(m: np.ndarray) -> int:
    return max(-int(m.min()), int(m.max())) if m.size else 0


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of long, exactly; an error if one does not fit in a long."""
    most = _most(q) * _most(c) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        a, b = q.astype(np.float64), c.astype(np.float64)
        rounding = 1e-12 * np.outer(np.sqrt((a**2).sum(axis=1)), np.sqrt((b**2).sum(axis=1)))
        if (np.abs(a @ b.T) + rounding >= float(1 << 63)).any():
            exact = q.astype(object) @ c.T.astype(object)
            if max(abs(int(x)) for x in exact.ravel()) >= 1 << 63:
                raise OverflowError("an inner product is out of the range of long")
    return q @ c.T  # modulo 2^64, and the result fits


def rotations(vectors: DataFrame) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Principal directions of all vectors: for each dimension, groups of coordinates (their start) and directions.

    From second moments summed over all rows. Dimensions beyond the MOST_DIMS most frequent have none; their
    bounds use the coordinates as they are.
    """
    dims = [r.dim for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_DIMS).collect()]

    def moments(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            held = batch.column(1).to_numpy()
            for dim in np.unique(held):
                rows = _matrix(batch.column(0).filter(pa.array(held == dim)), int(dim)).astype(np.float64)
                for at in range(0, int(dim), GROUP):
                    part = rows[:, at : at + GROUP]
                    sums[int(dim), at] = sums.get((int(dim), at), 0) + part.T @ part
        for (dim, at), m in sums.items():
            for i, row in enumerate(m):
                n = len(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x), pa.int32()) for x in (dim, at, i)] + [pa.array(np.arange(n), pa.int32()), pa.array(row)], names=["dim", "at", "i", "j", "m"])

    summed = vectors.filter(F.col("dim").isin(dims)).select("v", "dim").mapInArrow(moments, "dim int, at int, i int, j int, m double").groupBy("dim", "at", "i", "j").agg(F.sum("m").alias("m"))
    rows = summed.groupBy("dim", "at", "i").agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("row")).collect()  # at most GROUP numbers each
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for dim, at in sorted({(r.dim, r.at) for r in rows}):
        m = np.array([[c.m for c in r.row] for r in sorted((r for r in rows if (r.dim, r.at) == (dim, at)), key=lambda r: r.i)])
        values, directions = np.linalg.eigh(m)
        out.setdefault(dim, []).append((at, directions[:, np.argsort(-values)]))
    return out


class Scan:
    """The walk of one block of queries over candidates sorted by descending length."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: list[tuple[int, np.ndarray]] | None, k: int, floor: np.ndarray | None = None, block: int = 256):
        self.ids, self.queries, self.k, self.block = ids, queries, k, block
        self.dim = queries.shape[1]
        self.rotation = rotation or []
        self.lead, self.residual, self.length = self.turned(queries.astype(np.float64))
        self.floor = np.full(len(ids), LEAST) if floor is None else floor.copy()  # no score under it can be among the k best
        self.scores = np.full((len(ids), k), LEAST)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.pairs_computed = 0

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first quarter of the rotated coordinates, the length of the rest, and the whole length."""
        turned = [x[:, at : at + len(d)] @ d for at, d in self.rotation] or [x]
        firsts = [max(1, t.shape[1] // 4) for t in turned]
        lead = np.concatenate([t[:, :n] for t, n in zip(turned, firsts, strict=True)], axis=1)
        rest = sum((t[:, n:] ** 2).sum(axis=1) for t, n in zip(turned, firsts, strict=True))
        return lead, np.sqrt(rest), np.sqrt((x**2).sum(axis=1))

    def walk(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        lead, residual, length = self.turned(vectors.astype(np.float64))
        order = np.argsort(-length, kind="stable")
        ids, vectors, lead, residual, length = ids[order], vectors[order], lead[order], residual[order], length[order]
        for at in range(0, len(ids), self.block):
            part = slice(at, at + self.block)
            reach = self.length * length[at] * (1 + SLACK) + 1e-6
            active = np.flatnonzero(reach >= self.floor.astype(np.float64))
            if not len(active):
                break  # the rest is shorter still
            slack = SLACK * self.length[active] * length[at] + 1e-6
            bound = self.lead[active] @ lead[part].T + np.outer(self.residual[active], residual[part]) + slack[:, None]
            reaches = (bound >= self.floor[active, None].astype(np.float64)) & (self.ids[active, None] != ids[None, part])
            rows, columns = np.flatnonzero(reaches.any(axis=1)), np.flatnonzero(reaches.any(axis=0))
            if not len(rows):
                continue
            self.pairs_computed += int(reaches.sum())
            q = active[rows]
            here = reaches[np.ix_(rows, columns)]
            exact = products(self.queries[q], vectors[part][columns])
            scores = np.concatenate([self.scores[q], np.where(here, exact, LEAST)], axis=1)
            beside = np.where(here, ids[part][columns][None, :], np.iinfo(np.int64).max)
            found = np.concatenate([self.found[q], beside], axis=1)
            best = np.lexsort((found, -1 - scores), axis=1)[:, : self.k]  # -1 - s falls as s grows and cannot overflow
            self.scores[q] = np.take_along_axis(scores, best, axis=1)
            self.found[q] = np.take_along_axis(found, best, axis=1)
            self.floor[q] = np.maximum(self.floor[q], self.scores[q, -1])

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Query and place of what was found at or above the thresholds."""
        return np.nonzero((self.found < np.iinfo(np.int64).max) & (self.scores >= self.floor[:, None]))


def _first_floors(queries: DataFrame, head, k: int) -> DataFrame:
    """Adds floor: the k-th score that the head's vectors reach, null if it has fewer."""

    def run(batches):
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            floors = np.full(len(ids), LEAST)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                head_ids, vectors = head.value.get(int(dim), ((), ()))
                if len(head_ids) < k:
                    continue
                asked = _matrix(batch.column(2).filter(pa.array(dims == dim)), int(dim))
                for part in range(0, len(at), 1024):
                    some = slice(part, part + 1024)
                    scores = np.where(ids[at[some], None] == head_ids[None, :], LEAST, products(asked[some], vectors))
                    floors[at[some]] = np.partition(scores, len(head_ids) - k, axis=1)[:, len(head_ids) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, mask=floors == LEAST)], names=[*batch.schema.names, "floor"])

    return queries.select("vec_id", "query_key", "v", "dim", "norm").mapInArrow(run, "vec_id long, query_key long, v array<long>, dim int, norm double, floor long")


@dataclass(frozen=True)
class Band:
    """Rows between two values, and the cells (first to last) that a hash deals them to."""

    number: int
    low: float
    high: float
    first: int
    last: int


def _dealt(rows: DataFrame, value: str, count: int, size: int, *key: str) -> tuple[DataFrame, list[Band]]:
    """Rows with ``band`` (of ``value``, by quantiles) and ``cell`` (of about ``size`` rows), and the bands, ascending.

    Equal values share a band, whose rows the hash of ``key`` spreads over its cells.
    """
    bands = max(1, min(64, -(-count // size)))
    cuts = sorted({float(x) for x in rows.agg(F.percentile_approx(value, [i / bands for i in range(1, bands)], 1000).alias("q")).first().q}) if bands > 1 else []
    band = F.lit(0)
    for c in cuts:
        band = band + F.when(F.col(value) >= c, 1).otherwise(0)
    rows = rows.withColumn("band", band)
    out: list[Band] = []
    for r in sorted(rows.groupBy("band").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect(), key=lambda r: r.band):
        first = out[-1].last + 1 if out else 0
        out.append(Band(r.band, r.low, r.high, first, first + max(1, -(-r.n // size)) - 1))
    ways = _by_band(out, lambda b: F.lit(b.last - b.first + 1))
    return rows.withColumn("cell", (_by_band(out, lambda b: F.lit(b.first)) + F.pmod(F.xxhash64(*key), ways)).cast("int")), out


def _by_band(bands: list[Band], of) -> Column:
    """A value for each band (of at most 64)."""
    found = F.when(F.lit(False), of(bands[0]))
    for b in bands:
        found = found.when(F.col("band") == b.number, of(b))
    return found


def _run_cells(queries: DataFrame, blocks: list[Band], candidates: DataFrame, shards: list[Band], turn, k: int) -> DataFrame:
    """The best pairs of every (block, shard) that can reach a threshold; no other is shuffled.

    Blocks ascend by the length that they need, shards by the length that they have: a block goes to the shards
    from some place on, a shard to the blocks up to some place.
    """
    none = F.array().cast("array<int>")

    def shards_of(block: Band) -> Column:
        reached = [s for s in shards if s.high >= block.low]
        return F.sequence(F.lit(reached[0].first), F.lit(reached[-1].last)) if reached else none

    def blocks_of(shard: Band) -> Column:
        reached = [b for b in blocks if b.low <= shard.high]
        return F.sequence(F.lit(0), F.lit(reached[-1].last)) if reached else none

    left = queries.withColumn("shard", F.explode(_by_band(blocks, shards_of))).withColumnRenamed("cell", "block").select("dim", "block", "shard", "vec_id", "query_key", "v", "floor")
    right = candidates.withColumn("block", F.explode(_by_band(shards, blocks_of)))
    # a candidate goes only to blocks whose least length it has
    needed = F.lit(0.0)
    for b in blocks:
        needed = F.when(F.col("block") >= b.first, F.lit(b.low)).otherwise(needed)
    right = right.filter(F.col("norm") >= needed).withColumnRenamed("cell", "shard").select("dim", "block", "shard", "vec_id", "v")

    def run(key, asked: pa.Table, given: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        empty = pa.array([], pa.int64())
        if not asked.num_rows or not given.num_rows:
            return pa.table({"query_id": empty, "query_key": empty, "vec_id": empty, "score": empty})
        floor = asked["floor"].fill_null(int(LEAST)).to_numpy()
        scan = Scan(asked["vec_id"].to_numpy(), _matrix(asked["v"], dim), turn.value.get(dim), k, floor)
        scan.walk(given["vec_id"].to_numpy(), _matrix(given["v"], dim))
        q, c = scan.kept()
        return pa.table({"query_id": scan.ids[q], "query_key": asked["query_key"].to_numpy()[q], "vec_id": scan.found[q, c], "score": scan.scores[q, c]})

    return left.groupBy("dim", "block", "shard").cogroup(right.groupBy("dim", "block", "shard")).applyInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, query_block: int = 4096, shard_rows: int = 16_384, head_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query; ties to the smaller id.

    ``is_query`` is a condition on vec_id. A task holds about ``query_block`` queries and ``shard_rows``
    candidates, whatever the size of the table.
    """
    ready = cut(integer_vectors(vectors, scale))
    asked = ready.filter(is_query).withColumn("query_key", F.xxhash64("v")).dropDuplicates(["vec_id", "query_key"])
    n = ready.count()
    spark = ready.sparkSession
    heads: dict[int, list] = {}
    for row in ready.orderBy(F.desc("norm"), "vec_id").limit(head_rows).collect():
        heads.setdefault(row.dim, []).append((row.vec_id, row.v))
    head = spark.sparkContext.broadcast({dim: (np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.int64)) for dim, rows in heads.items()})
    need = F.when(F.col("floor") > 0, F.col("floor") / F.col("norm") * (1 - 2 * SLACK)).otherwise(0.0)
    queries = cut(_first_floors(asked, head, k).withColumn("need", need))
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = spark.sparkContext.broadcast(rotations(ready))
    given, shards = _dealt(ready.withColumn("row", F.monotonically_increasing_id()), "norm", n, shard_rows, "row")
    longest = shards[-max(1, len(shards) // 4) :]  # the bands of the longest quarter
    found = None
    for part in (longest, shards[: -len(longest)]):
        if not part:
            continue
        if found is not None:  # what the longest gave raises the thresholds
            best = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
            reached = found.withColumn("r", best).filter(F.col("r") == k).select(F.col("query_id").alias("vec_id"), "query_key", F.col("score").alias("reached"))
            raised = queries.join(reached, ["vec_id", "query_key"], "left").withColumn("floor", F.greatest("floor", "reached")).drop("reached")
            queries = cut(raised.withColumn("need", need))
        dealt, blocks = _dealt(queries, "need", n_queries, query_block, "vec_id", "query_key")
        candidates = given.filter(F.col("band").isin([b.number for b in part]))
        more = cut(_run_cells(dealt, blocks, candidates, part, turn, k))
        found = more if found is None else found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
