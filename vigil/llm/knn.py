"""Exact top-k search by inner product as a Voronoi kNN join.

Components x become floor(SCALE * x); rows whose vector is null or holds a null or a non-finite
component take no part, nor do null ids. All finite numbers take part, doubles of any size too. Scores
are exact whole numbers of any size and ranked as such; one that a long cannot hold is returned as null.
Shorter vectors count as followed by zeros. A query's own row is no candidate; other rows with its
id are. Ties go to the smaller id. Queries are rows whose id is divisible by `every`. Columns but id and
vector don't matter, whatever their names; an empty table gives no rows.

Inner products become distances by one coordinate more: with M the greatest norm, x gets
sqrt(M^2 - |x|^2) and q gets 0, so that |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and the best scores are the nearest points.

Data and queries are dealt to the Voronoi cells of the same pivots (data rows chosen by hash). Of each data cell a
summary is kept: its rows, the greatest distance from its pivot and the k + 1 least ones; of each
query cell the greatest distance. For queries of cell i, U_i + |p_i p_j| + d is not below the distance of any of
them to the row at distance d in cell j, so the (k + 1)-th least of these over all summaries bounds what any query
of the cell still needs: T_i. A data row can be wanted only if it lies within U_i + T_i of p_i. Cells whose summary
rules that out are left out whole, rows of others by their own distance; the rest are sent to the cell's
group (neighbouring query cells make one group, large groups are split), in blocks, and each
block is searched exactly where its group is. Blocks' best are merged.

Of equal vectors only the k + 1 smallest ids can be among any k best, so the others are left out
first (before the shuffle in each task, so a vector that fills the table stays small). Vectors with a component over
HUGE, whose squares floats don't hold, lie in no cell: as data they go to all groups, as queries they make a group
that gets all, and they are scored in whole numbers only.

For vectors spread evenly in many dimensions these bounds exclude little and the join becomes the
stated query set against all rows, in blocks; for clustered ones each row goes to few groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import written

SCALE = 256
HUGE = 2.0**490
#: Queries that a group holds, and rows that a block holds, at most; groups made at least.
GROUP, BLOCK, GROUPS = 2048, 8192, 4
#: Pivots at most, rows measured at a time.
PIVOTS, ROWS = 1024, 2048
#: Floats are whole up to this; bytes of a score that a long cannot hold.
EXACT, WIDE = float(1 << 53), 272


def taking_part(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors as doubles, rows that take part only."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    known = rows.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & finite)
    return known.select("vec_id", F.transform(vector, lambda e: e.cast("double")).alias("v"))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole components; and which rows are huge, for which they are zeros."""
    with np.errstate(over="ignore"):
        out = np.floor(x * SCALE)
    huge = np.abs(out).max(axis=1, initial=0) > HUGE
    out[huge] = 0
    return out, huge


def digits(v: list[float]) -> list[int]:
    """Whole components as Python has them, of any size."""
    return [floor(a * SCALE) if abs(a) < EXACT else int(a) * SCALE for a in v]


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows of floats, zeros behind the shorter ones."""
    sizes = np.asarray(column.combine_chunks().value_lengths() if isinstance(column, pa.ChunkedArray) else column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).astype(np.float64)
    out = np.zeros((len(sizes), dim))
    if len(flat) == len(sizes) * dim:
        return flat.reshape(len(sizes), dim)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scores(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Inner products as floats, and how far each may be off; None if they are exact."""
    score = q @ x.T
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < EXACT:
        return score, None
    return score, np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)) * (max(1, q.shape[1]) * 2.0**-50)


def least(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """For each q a number that its k-th best score is not below."""
    score, off = scores(q, x)
    return np.partition(score if off is None else score - off, len(x) - k, axis=1)[:, len(x) - k]


def top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(row, column, score) of the k highest of each q, ties to smaller ids. q, x: vectors as given.

    Where floats are too short, those that may be among them are computed again as whole numbers.
    """
    (wide_q, huge_q), (wide_x, huge_x) = scaled(q), scaled(x)
    score, off = scores(wide_q, wide_x)
    if off is None and not huge_q.any() and not huge_x.any():
        row, column = best(score.astype(np.int64), ids, k)
        return row, column, score[row, column].astype(np.int64).tolist()
    off = np.zeros(score.shape) if off is None else off
    may = np.ones(score.shape, bool)
    if (~huge_x).sum() > k:
        low = least(wide_q, wide_x[~huge_x], k)
        may = (score + off >= low[:, None]) | huge_q[:, None] | huge_x[None, :]
    found = []
    whole_x = {n: digits(x[n].tolist()) for n in np.flatnonzero(may.any(axis=0)).tolist()}
    for n, v in enumerate(q.tolist()):
        own = digits(v)
        exact = sorted((-sum(a * b for a, b in zip(own, whole_x[m])), int(ids[m]), m) for m in np.flatnonzero(may[n]).tolist())
        found += [(n, m, -s) for s, _, m in exact[:k]]
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64), [f[2] for f in found]


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row, ties to smaller ids."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        row, column = np.nonzero(score >= least[:, None])
    else:
        row, column = np.nonzero(np.ones(score.shape, bool))
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def distances(x: np.ndarray, sizes: np.ndarray, p: np.ndarray, p_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of rows to pivots from below and above; sizes: squared norms."""
    size = sizes[:, None] + p_sizes[None, :]
    square, off = size - 2 * (x @ p.T), size * (x.shape[1] * 2.0**-48)
    return np.sqrt(np.maximum(square - off, 0)), np.sqrt(np.maximum(square, 0) + off)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Data rows with the coordinate that makes their norm the greatest one."""
    return np.column_stack((x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))))


def flat(q: np.ndarray) -> np.ndarray:
    """Queries with a zero in its place."""
    return np.column_stack((q, np.zeros(len(q))))


def squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


def reaches(apart: np.ndarray, asked: dict[int, float], near: dict[int, list[float]], k: int) -> dict[int, float]:
    """For each query cell how far from its pivot a wanted row can lie. apart: pivots' distances; asked: a cell's greatest distance; near: the least k of a data cell."""
    cell = np.array([j for j, ds in near.items() for _ in ds], np.int64)
    dist = np.array([d for ds in near.values() for d in ds])
    out = {}
    for i, far in asked.items():
        bounds = far + apart[i, cell] + dist
        out[i] = far + np.partition(bounds, k - 1)[k - 1] if len(bounds) >= k else np.inf
    return out


def search(rows: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best, fewer if there are fewer."""
    spark = rows.sparkSession
    valid = taking_part(rows, vector)
    same = Window.partitionBy("v").orderBy("vec_id")
    data = valid.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "v", F.xxhash64("v").alias("h"))
    asked = valid.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    whole = lambda e: F.floor(F.when(F.abs(e) < EXACT, e * SCALE)).cast("double")
    small = F.forall("v", lambda e: F.abs(e) * SCALE <= HUGE)
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + F.pow(F.coalesce(whole(e), e * SCALE), 2))
    n, dim, most = valid.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.max(F.when(small, norm))).first()
    n_asked, most = asked.count(), (most or 0.0) * (1 + 1e-9)
    of = int(np.clip(np.ceil(np.sqrt(n)), 1, PIVOTS))
    chosen = data.where(small).orderBy(F.xxhash64(F.lit("pivot"), "v"), "vec_id").limit(of).select("v").collect()
    pivot = np.zeros((len(chosen), dim))
    for m, r in enumerate(chosen):
        pivot[m, : len(r["v"])] = r["v"]
    pivot = lifted(scaled(pivot)[0], most)
    shared = spark.sparkContext.broadcast(pivot)

    def measured(column: pa.Array, put: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, cell, distances from below and above, huge) of some rows at a time."""
        p = shared.value
        p_sizes = squares(p)
        for a in range(0, len(column), ROWS):
            x, huge = scaled(matrix(column.slice(a, ROWS), dim))
            x = put(x)
            low, high = distances(x, squares(x), p, p_sizes)
            yield slice(a, a + len(x)), high.argmin(axis=1) if len(p) else np.zeros(len(x), np.int64), low, high, huge

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's part of the summaries: of each cell its rows, greatest distance and k + 1 least ones."""
        count, far = np.zeros(len(shared.value), np.int64), np.zeros(len(shared.value))
        near = np.full((len(shared.value), k + 1), np.inf)
        for batch in batches:
            for _, cell, _, high, huge in measured(batch.column("v"), lambda x: lifted(x, most)):
                own = high[np.arange(len(cell)), cell][~huge] if len(shared.value) else np.zeros(0)
                cell = cell[~huge] if len(own) else np.zeros(0, np.int64)
                np.add.at(count, cell, 1)
                np.maximum.at(far, cell, own)
                for j in np.unique(cell):
                    near[j] = np.sort(np.concatenate((near[j], own[cell == j])))[: k + 1]
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(count[full]), pa.array(far[full]), pa.array([[d for d in near[j].tolist() if d < np.inf] for j in full], pa.list_(pa.float64()))], names=["cell", "n", "far", "near"])

    parts = written(data.select("v").mapInArrow(summed, "cell int, n long, far double, near array<double>"))
    cells = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()  # a row a pivot
    by_cell = Window.partitionBy("cell").orderBy("d")
    least_of = parts.select("cell", F.explode("near").alias("d")).withColumn("at", F.row_number().over(by_cell)).where(F.col("at") <= k + 1)
    near: dict[int, list[float]] = {}
    for r in least_of.collect():  # k + 1 rows a pivot
        near.setdefault(r["cell"], []).append(r["d"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for at, own, _, high, huge in measured(batch.column("v"), flat):
                if len(shared.value):
                    cell[at], away[at] = np.where(huge, -1, own), high[np.arange(len(own)), own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    placed = asked.mapInArrow(place, "vec_id bigint, v array<double>, times bigint, cell int, away double")
    of_cell = placed.groupBy("cell").agg(F.max("away").alias("far"), F.count("*").alias("n")).collect()  # a row a pivot
    low, high = distances(pivot, squares(pivot), pivot, squares(pivot))
    usual = {r["cell"]: r["far"] for r in of_cell if r["cell"] >= 0}
    reach = reaches(high, usual, near, k + 1)
    # Neighbouring query cells make a group, by the nearest of the first pivots; a group more takes huge queries.
    heads = max(1, min(len(pivot), int(np.clip(-(-n_asked // (GROUP // 2)), GROUPS, PIVOTS))))
    group = {i: int(low[i, :heads].argmin()) for i in usual} | {-1: -1}
    held: dict[int, int] = {}
    for r in of_cell:
        held[group[r["cell"]]] = held.get(group[r["cell"]], 0) + r["n"]
    splits = {g: -(-m // GROUP) for g, m in held.items()}
    far = np.full(len(pivot), -np.inf)
    for r in cells:
        far[r["cell"]] = r["far"]
    order = sorted(usual, key=lambda i: group[i])
    wanted = np.array([reach[i] for i in order])
    meets = low[order] - far[None, :] <= wanted[:, None] if order else np.zeros((0, len(pivot)), bool)
    blocks = max(1, -(-n // BLOCK))
    known = spark.sparkContext.broadcast((order, [group[i] for i in order], wanted, meets, splits))
    pair = lambda d: F.create_map(*(F.lit(x) for kv in (d or {-1: 1}).items() for x in kv))
    g = pair(group)[F.col("cell")]
    split = F.pmod(F.xxhash64("vec_id", "v"), pair(splits)[F.col("g")].cast("bigint")).cast("int")
    queries = placed.withColumn("g", g).select("vec_id", "v", F.xxhash64("v").alias("h"), "g", split.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, group, wanted, meets, splits = known.value
        for batch in batches:
            block = np.asarray(batch.column("h")).view(np.uint64) ^ np.asarray(batch.column("vec_id")).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            block = ((block >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
            to: dict[int, list[np.ndarray]] = {}
            for at, cell, low, _, huge in measured(batch.column("v"), lambda x: lifted(x, most)) if order else ():
                need = (meets[:, cell].T & (low[:, order] <= wanted[None, :])) | huge[:, None]
                for g in set(group):
                    own = need[:, [n for n, x in enumerate(group) if x == g]].any(axis=1)
                    to.setdefault(g, []).append(at.start + np.flatnonzero(own))
            if -1 in splits:
                to[-1] = [np.arange(batch.num_rows)]
            for g, found in to.items():
                found = np.concatenate(found)
                if len(found):
                    own = batch.take(pa.array(found))
                    for part in range(splits[g]):
                        same = [pa.array(np.full(len(found), y, np.int32)) for y in (g, part)]
                        yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("v"), own.column("h"), *same, pa.array(block[found], pa.int32())], names=["vec_id", "v", "h", "g", "part", "block"])

    dealt = data.mapInArrow(deal, "vec_id bigint, v array<double>, h bigint, g int, part int, block int")

    def solve(asked: pa.Table, given: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 4]
        score: list[int] = []
        if asked.num_rows and given.num_rows:
            x, q = matrix(given.column("v"), dim), matrix(asked.column("v"), dim)
            ids, h = np.asarray(given.column("vec_id")), np.asarray(given.column("h"))
            own, own_h = np.asarray(asked.column("vec_id")), np.asarray(asked.column("h"))
            for a in range(0, len(q), 256):
                row, column, some = top(q[a : a + 256], x, ids, k + 1)
                found.append((own[a + row], own_h[a + row], ids[column], h[column]))
                score += some
        side = [0 if -(1 << 63) <= s < 1 << 63 else 1 if s > 0 else -1 for s in score]
        wide = [(s + (1 << 8 * WIDE - 1)).to_bytes(WIDE) if y else None for s, y in zip(score, side)]  # sorts as the numbers do
        kept = [None if y else s for s, y in zip(score, side)]
        columns = [*(pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)), pa.array(side, pa.int32()), pa.array(wide, pa.binary()), pa.array(kept, pa.int64())]
        return pa.table(columns, names=["query_id", "qh", "vec_id", "h", "side", "wide", "score"])

    keys = ["g", "part", "block"]
    some = queries.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(solve, "query_id long, qh long, vec_id long, h long, side int, wide binary, score long")
    order = [F.col("side").desc(), F.col("wide").desc(), F.col("score").desc(), "vec_id"]
    of_query = Window.partitionBy("query_id", "qh")
    some = some.withColumn("n", F.row_number().over(of_query.orderBy(*order))).where(F.col("n") <= k + 1)
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("h") == F.col("qh"))
    some = some.withColumn("own", F.when(mine, F.row_number().over(Window.partitionBy("query_id", "qh", mine).orderBy("n"))))
    ranked = some.where("own IS NULL OR own > 1").withColumn("rank", F.row_number().over(of_query.orderBy(*order))).where(F.col("rank") <= k)
    times = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("qh"), "times")
    out = ranked.join(times, ["query_id", "qh"]).withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return out.select("query_id", "rank", "vec_id", "score")
