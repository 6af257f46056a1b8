"""Nearest vectors by an inverted-file index: cells around centroids, all rows assigned, exact scores inside cells.

*Fit*: centroids of unit vectors by k-means over a sample: at most SAMPLE different vectors, those with the smallest
hashes of their ids. Cells grow with the root of the number of vectors, up to MAX_CELLS and MAX_BYTES of centroids, which are
what is broadcast. *Build*: equal vectors are one entry; every entry goes to its nearest centroid's cell, in a table saved
in the shared folder. *Search*: a query visits its `probes` nearest cells (unless given: as many as hold TARGET of the nearest
neighbours inside the sample; in more rows neighbours are nearer) and is scored there exactly, in parts
of a cell of bounded size, so a cell with very many entries is no task's alone; a part is copied once for each BLOCK queries of its cell.
With exact=True a second visit goes to every other cell whose bound (the angle to its centroid less its radius) allows a
result, which makes the search equal to one over all pairs.

Defined cases: null vectors, vectors without length and such with a value that is not finite have no cosine and are left out; vectors of
another width than the sample's have a cell for their width, visited by queries of that width; of equal
scores (to 9 digits) the smaller id is nearer; a query is not its own neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pyspark.sql.pandas.types import to_arrow_schema

from ..session import saved

#: Vectors that centroids are fitted to, cells, bytes of centroids, and rounds of k-means.
SAMPLE, MAX_CELLS, MAX_BYTES, ROUNDS = 65_536, 16_384, 64 << 20, 8
#: The recall that the number of visited cells is chosen for.
TARGET = 0.95
#: Entries of a cell that one task scores, and queries that meet them at a time.
PART, BLOCK = 16_384, 16_384
_TIE = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit vectors by k-means, beginning with evenly spread rows of the sample."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = nearest_cells(sample, c, 1)[0][:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        full = np.linalg.norm(sums, axis=1) > 0
        c = np.where(full[:, None], _unit(sums), c)
    return c


def nearest_cells(x: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest centroids of each row, and their cosines, a few rows at a time."""
    n = min(n, len(c))
    at, cos = np.empty((len(x), n), np.int64), np.empty((len(x), n))
    step = max(1, (1 << 22) // len(c))
    for i in range(0, len(x), step):
        s = x[i : i + step] @ c.T
        a = s.argmax(1)[:, None] if n == 1 else np.argpartition(-s, n - 1, axis=1)[:, :n]
        at[i : i + step], cos[i : i + step] = a, np.take_along_axis(s, a, 1)
    return at, cos


def enough_probes(sample: np.ndarray, c: np.ndarray, target: float, k: int = 10, queries: int = 256) -> int:
    """How many nearest cells hold the share `target` of the k nearest rows of the sample, for some of its rows."""
    some = sample[np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)]
    own = nearest_cells(sample, c, 1)[0][:, 0]
    places = []
    for q in some:
        cos = sample @ q
        near = np.argpartition(-cos, min(k, len(cos) - 1))[: k + 1]  # itself among them
        place = np.empty(len(c), int)
        place[np.argsort(-(c @ q))] = np.arange(len(c))
        places.append(place[own[near]])
    return int(np.quantile(np.concatenate(places), target, method="higher")) + 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _entries(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h1, h2): usable vectors, and 128 bits that name equal ones."""
    v = F.col(vector_col)
    if df.schema[vector_col].dataType != T.ArrayType(T.FloatType()):
        v = v.cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    return rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))


@dataclass
class VectorIndex:
    """entries (cell, h1, h2, first_id, v), members (h1, h2, id) and cells (cell, n), saved; centroids with the least cosine of their entries."""

    entries: DataFrame
    members: DataFrame
    cells: DataFrame
    centers: np.ndarray
    reach: np.ndarray
    probes: int

    @classmethod
    def build(cls, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE, target: float = TARGET) -> VectorIndex:
        members = saved(_entries(vectors, id_col, vector_col), "vector-members")
        one = saved(members.groupBy("h1", "h2").agg(F.any_value("v").alias("v"), F.min("id").alias("first_id")), "vector-entries")
        drawn = one.select(F.size("v").alias("width"), "v").orderBy(F.xxhash64("first_id"), "first_id").limit(sample).toArrow()  # at most `sample` rows
        widths = drawn.column(0).to_numpy()
        width = int(np.bincount(widths).argmax()) if len(widths) else 1
        x = _unit(_matrix(drawn.filter(pa.compute.equal(drawn.column(0), width)).column(1).combine_chunks(), width)) if len(widths) else np.zeros((0, 1))
        n = one.count()
        most = max(1, min(MAX_CELLS, MAX_BYTES // (8 * width), len(x) // 4, len(x)))
        c = centroids(x, min(most, cells or max(1, round(2 * n**0.5)))) if len(x) else np.eye(1)
        shared = vectors.sparkSession.sparkContext.broadcast(c)  # at most MAX_BYTES

        def assign(batches):
            for b in batches:
                cell, cos = np.empty(b.num_rows, np.int64), np.ones(b.num_rows)
                lengths = np.array([len(v) for v in b.column(2)], int)
                cell[:] = -1 - lengths
                rows = np.flatnonzero(lengths == shared.value.shape[1])
                if len(rows):
                    at, near = nearest_cells(_unit(_matrix(b.column(2).take(pa.array(rows)), shared.value.shape[1])), shared.value, 1)
                    cell[rows], cos[rows] = at[:, 0], near[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns, pa.array(cos)], names=["cell", "h1", "h2", "v", "first_id", "cos"])

        kind = vectors.schema[id_col].dataType.simpleString()
        v = members.schema["v"].dataType.simpleString()
        placed = one.mapInArrow(assign, f"cell long, h1 long, h2 long, v {v}, first_id {kind}, cos double")
        entries = saved(placed.repartition("cell"), "vector-cells")
        sizes = saved(entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least")), "vector-sizes")
        reach = np.ones(len(c))
        for r in sizes.filter("cell >= 0").select("cell", "least").collect():  # at most MAX_CELLS rows
            reach[r.cell] = r.least
        return cls(entries.drop("cos"), members.select("h1", "h2", "id"), sizes.select("cell", "n"), c, reach, enough_probes(x, c, target) if len(x) else 1)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query, id, score, rank): the k nearest ids of each query by cosine over 0."""
        probes = probes or self.probes
        asked = saved(_entries(queries, id_col, vector_col), "vector-queries")
        one = asked.groupBy("h1", "h2").agg(F.any_value("v").alias("v"), F.lit(None).cast("double").alias("least"))
        found = saved(self._scored(self._visits(one, probes, False), k + 1), "vector-found")
        best = _best(found, k + 1)
        if exact:
            # the (k + 1)-th best score so far: no cell whose bound is below can better it
            least = best.filter(F.col("_n") == k + 1).select("h1", "h2", F.col("score").alias("least"))
            again = saved(one.drop("least").join(least, ["h1", "h2"], "left"), "vector-again")
            more = self._scored(self._visits(again, probes, True), k + 1)
            best = _best(saved(found.unionByName(more), "vector-found"), k + 1)
        hits = best.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("e1").alias("h1"), F.col("e2").alias("h2"), "score")
        near = W.partitionBy("h1", "h2").orderBy("id")
        few = saved(self.members.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k + 1).drop("_n"), "vector-few")  # of equal vectors the first are enough
        rows = hits.join(few, ["h1", "h2"]).select("q1", "q2", "id", "score")
        order = W.partitionBy("q1", "q2").orderBy(F.round("score", 9).desc(), "id")
        rows = saved(rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n"), "vector-rows")
        own = asked.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("id").alias("query"))
        out = own.join(rows, ["q1", "q2"]).filter(F.col("query") != F.col("id"))
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.round("score", 9).desc(), "id"))
        return out.select("query", "id", "score", rank.alias("rank")).filter(F.col("rank") <= k)

    def _visits(self, asked: DataFrame, probes: int, rest: bool) -> DataFrame:
        """(cell, h1, h2, v): the cells that each different query visits; rest: all but the nearest that can hold something better than least."""
        shared = asked.sparkSession.sparkContext.broadcast((self.centers, np.arccos(np.clip(self.reach, -1, 1))))

        def run(batches):
            c, radius = shared.value
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    lengths = np.array([len(v) for v in part.column(2)], int)
                    rows = np.flatnonzero(lengths == c.shape[1])
                    others = np.flatnonzero(lengths != c.shape[1])
                    who, cells = [np.empty(0, np.int64)] * 2 if rest else [others, -1 - lengths[others]]
                    if len(rows):
                        x = _unit(_matrix(part.column(2).take(pa.array(rows)), c.shape[1]))
                        near, _ = nearest_cells(x, c, probes)
                        if rest:
                            least = np.nan_to_num(part.column(3).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(float), nan=0.0)
                            bound = np.cos(np.maximum(0, np.arccos(np.clip(x @ c.T, -1, 1)) - radius))
                            open_ = bound >= least[:, None] - 1e-6
                            np.put_along_axis(open_, near, False, 1)
                            i, cell = np.nonzero(open_)
                        else:
                            i, cell = np.repeat(np.arange(len(rows)), near.shape[1]), near.ravel()
                        who, cells = np.concatenate([who, rows[i]]), np.concatenate([cells, cell])
                    for j in range(0, len(who), 4096):
                        take = pa.array(who[j : j + 4096], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(cells[j : j + 4096], pa.int64()), *(part.column(m).take(take) for m in range(3))], names=["cell", "h1", "h2", "v"])

        return asked.select("h1", "h2", "v", "least").mapInArrow(run, f"cell long, h1 long, h2 long, v {asked.schema['v'].dataType.simpleString()}")

    def _scored(self, visits: DataFrame, k: int) -> DataFrame:
        """(h1, h2, e1, e2, first_id, score): the k best entries of each query in each part of a cell that it visits, and ties."""
        visits = saved(visits, "vector-visits")
        crowd = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
        plan = self.cells.join(crowd, "cell").select("cell", F.ceil(F.col("n") / PART).alias("parts"), F.ceil(F.col("q") / BLOCK).alias("blocks"))
        plan = F.broadcast(saved(plan, "vector-plan"))  # a row for each cell
        dealt = lambda n: F.pmod(F.col("h1"), F.col(n))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        e = self.entries.join(plan, "cell").select("cell", dealt("parts").alias("part"), upto("blocks").alias("block"), "h1", "h2", "v", "first_id")
        q = visits.join(plan, "cell").select("cell", upto("parts").alias("part"), dealt("blocks").alias("block"), "h1", "h2", "v")

        width = lambda t: len(t.column("v")[0])  # noqa: E731  all vectors of a cell have one width
        units = lambda t: _unit(_matrix(t.column("v").combine_chunks(), width(t)))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            out = []
            if a.num_rows and b.num_rows:
                x, y = units(a), units(b)
                step = max(1, (1 << 22) // len(x))
                for i in range(0, len(y), step):
                    cos = y[i : i + step] @ x.T
                    low = np.partition(cos, -k, axis=1)[:, -k] - _TIE if len(x) > k else np.full(len(cos), -1.0)
                    r, c = np.nonzero((cos > 0) & (cos >= low[:, None]))
                    own, met = b.select(["h1", "h2"]).take(pa.array(i + r)), a.select(["h1", "h2", "first_id"]).take(pa.array(c))
                    out.append(pa.Table.from_arrays([*own.columns, *met.columns, pa.array(cos[r, c])], names=schema.names))
            return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], x) for x in kinds], names=schema.names)

        schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("h1", "h2", "e1", "e2")), T.StructField("first_id", self.entries.schema["first_id"].dataType), T.StructField("score", T.DoubleType())])
        kinds = [f.type for f in to_arrow_schema(schema)]
        keys = ("cell", "part", "block")
        return e.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order: list[Column] = [F.round("score", 9).desc(), F.col("first_id")]
    return found.withColumn("_n", F.row_number().over(W.partitionBy("h1", "h2").orderBy(*order))).filter(F.col("_n") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact (query, id) that found has too."""
    both = exact.select("query", "id").join(found.select("query", "id").withColumn("_hit", F.lit(1)), ["query", "id"], "left")
    return both.agg(F.avg(F.when(F.col("_hit").isNotNull(), 1.0).otherwise(0.0))).first()[0] or 0.0
