"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order of nearness and posted in the inverted
files of those pivots together with the place it gives them. A query adds up, over the postings of
its own nearest pivots, how far the places differ (Spearman's footrule), reranks the vectors with
the smallest distance by exact cosine and keeps the nearest.

There are two tables of pivots, and what either finds is reranked. Pivots drawn evenly tell vectors
of a crowded place apart, but there most of them are nearly the same vector to any other query;
pivots that are spread out (farthest first) serve those.

The index is written once, in shards of bounded size, and the queries in blocks of bounded size. A
task takes a block of queries over a run of shards, which it reads one after another from the shared
folder, and keeps the nearest of each query as it goes: neither vectors nor queries are copied
by a shuffle, and what is shuffled in the end is a few rows per query and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as arrow_fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lateweave.llm.common import materialize
from lateweave.session import scratch_path
from lateweave.sources import paths

SAMPLE = 4_096      # distinct vectors from which pivots are chosen
PIVOTS = 256        # in each of the two tables
SAME = 0.99999      # a pivot of this cosine to a chosen one adds nothing
NEAREST = 64        # pivots that represent a vector
SHARE = 0.08        # share of a shard that each table has reranked for a query
LEAST = 400         # and at least so many
SHARD_ROWS = 16_384
BLOCK_ROWS = 16_384
RUN_SHARDS = 64     # at most in one run
MOST_TASKS = 100_000    # beyond that a task does several runs


def unit_rows(vectors: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Valid vectors as unit rows in double precision, and which of the given ones are valid."""
    ok = np.zeros(len(vectors), dtype=bool)
    rows = []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or (dim is not None and len(v) != dim):
            continue
        x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) if any(
            c is None for c in v) else np.asarray(v, dtype=np.float64)
        if np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            ok[i] = True
            rows.append(x / np.linalg.norm(x))
    return (np.stack(rows) if rows else np.zeros((0, dim or 0))), ok


def distinct_vectors(rows: DataFrame, keep: int, dim: int) -> DataFrame:
    """One row per distinct vector: its bytes, unit vector and ``keep`` smallest ids.

    Copies are cut to ``keep`` ids inside each batch before the shuffle, so a vector that makes up
    a third of the table is no large group. More copies than ``keep`` can't be among the nearest.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, ok = unit_rows(batch.column("embedding").to_pylist(), dim)
            raw = [units[i].tobytes() for i in range(len(units))]
            df = pd.DataFrame({"vec_id": batch.column("vec_id").to_pandas()[ok].to_numpy(), "unit": raw})
            df = df.dropna().sort_values("vec_id", kind="stable")
            df = df[df.groupby("unit").cumcount() < keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(df["vec_id"].astype("int64")), pa.array(df["unit"], pa.binary())],
                names=["vec_id", "unit"])

    slim = rows.select("vec_id", "embedding").mapInArrow(local, "vec_id bigint, unit binary")
    place = Window.partitionBy("unit").orderBy("vec_id")
    return (slim.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= keep)
            .groupBy("unit").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))


def _permutations(units: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Per row its nearest pivots, nearest first; ties by pivot number."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :nearest]


def spread_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest first: each next pivot is the vector least alike to all chosen ones."""
    # No matrix product here: threaded linear algebra can block on a driver that runs Spark.
    chosen, near = [0], np.einsum("ij,j->i", sample, sample[0])
    while len(chosen) < most:
        i = int(near.argmin())
        if near[i] >= SAME:
            break
        chosen.append(i)
        near = np.maximum(near, np.einsum("ij,j->i", sample, sample[i]))
    return sample[chosen]


class Postings:
    """Inverted files of one shard: for each pivot the rows that have it, and at which place."""

    def __init__(self, units: np.ndarray, pivots: np.ndarray, nearest: int):
        self.pivots = pivots
        order = _permutations(units, pivots, nearest)
        self.size, self.nearest = order.shape
        row = np.repeat(np.arange(len(units)), self.nearest)
        pivot, place = order.ravel(), np.tile(np.arange(self.nearest), len(units))
        by = np.argsort(pivot, kind="stable")
        self.rows, self.places = row[by], place[by].astype(np.int32)
        self.edges = np.searchsorted(pivot[by], np.arange(len(pivots) + 1))
        # A pivot that is missing on one side counts as standing at the place after the last one.
        self.absent = int((self.nearest - np.arange(self.nearest)).sum())

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every row to one query's pivots, from the query's postings alone."""
        total = np.full(self.size, 2 * self.absent, dtype=np.int32)
        last = self.nearest
        for mine, pivot in enumerate(order.tolist()):
            a, b = self.edges[pivot], self.edges[pivot + 1]
            theirs = self.places[a:b]
            total[self.rows[a:b]] += np.abs(theirs - mine) - (last - theirs) - (last - mine)
        return total


class Shard:
    """The vectors of one shard, their ids, and their postings by each table of pivots."""

    def __init__(self, units: np.ndarray, ids: list, tables: list[np.ndarray], nearest: int):
        self.units, self.ids = units, ids
        self.postings = [Postings(units, pivots, nearest) for pivots in tables]

    def orders(self, units: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Per query its nearest pivots of each table."""
        return zip(*(_permutations(units, p.pivots, p.nearest) for p in self.postings))

    def search(self, unit: np.ndarray, orders: tuple[np.ndarray, ...], most: int,
               k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` rows of largest cosine among the ``most`` of smallest footrule distance by each table."""
        near = np.arange(len(self.units))
        if most < len(near):
            keep = np.zeros(len(near), dtype=bool)
            for postings, order in zip(self.postings, orders):
                distance = postings.footrule(order)
                keep |= distance <= np.partition(distance, most - 1)[most - 1]
            near = np.flatnonzero(keep)
        score = self.units[near] @ unit
        if k < len(near):
            edge = np.partition(-score, k - 1)[k - 1]
            tied = -score <= edge + 1e-12
            near, score = near[tied], score[tied]
        return near, score


def _hash_parts(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def write_parts(table: DataFrame, part: str, n: int, name: str) -> str:
    """Write the rows in ``n`` folders by the hash of ``unit``; the path of the table."""
    path = scratch_path(table.sparkSession, name)
    (table.withColumn(part, _hash_parts("unit", n)).repartition(n, part)
     .write.partitionBy(part).parquet(path))
    paths.arrow_location(path)      # raises here, not in a task, where Arrow can't open the store
    return path


def read_part(path: str, part: str, i: int) -> pa.Table:
    """The rows of folder ``i``, inside a task; a folder that is not there raises."""
    store, folder = paths.arrow_location(f"{path}/{part}={i}")
    files = sorted(f.path for f in store.get_file_info(arrow_fs.FileSelector(folder)) if f.path.endswith(".parquet"))
    tables = []
    for file in files:
        with store.open_input_file(file) as source:
            tables.append(pq.read_table(source))
    return pa.concat_tables(tables)


class Nearest:
    """The nearest candidates of one query so far: larger score first, then the smaller id."""

    def __init__(self, keep: int):
        self.keep, self.scores, self.ids = keep, np.zeros(0), np.zeros(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[:self.keep]
        self.scores, self.ids = scores[first], ids[first]


def search_runs(index: str, asked: str, tables: list[np.ndarray], nearest: int, share: float, least: int, k: int):
    """For rows (block, first, last): the ``k`` + 1 nearest of each query of the block in those shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                raw = read_part(asked, "block", task["block"]).column("unit").to_pylist()
                queries = np.stack([np.frombuffer(u) for u in raw])
                held = [Nearest(k + 1) for _ in raw]
                for i in range(task["first"], task["last"]):
                    have = read_part(index, "shard", i)
                    ids = have.column("ids").to_pylist()
                    units = np.stack([np.frombuffer(u) for u in have.column("unit").to_pylist()])
                    shard, most = Shard(units, ids, tables, nearest), max(least, int(np.ceil(share * len(ids))))
                    for best, unit, orders in zip(held, queries, shard.orders(queries)):
                        near, score = shard.search(unit, orders, most, k + 1)
                        of_each = [ids[j] for j in near]
                        best.add(np.repeat(score.round(14), [len(x) for x in of_each]),
                                 np.array([x for some in of_each for x in some], dtype=np.int64))
                counts = [len(best.ids) for best in held]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(len(raw)), counts))),
                     pa.array(np.concatenate([best.ids for best in held])),
                     pa.array(np.concatenate([best.scores for best in held]))], names=["unit", "vec_id", "score"])
    return run


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, nearest: int = NEAREST,
                       share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every row where ``is_query`` holds.

    Score is the cosine of the original vectors in double precision; ties (and equal vectors) go to
    the smaller id; a query is not its own neighbour. NULL ids, and vectors that are NULL, zero,
    of another length than most or hold NULL or non-finite components take no part. With no more
    than ``k`` other vectors all are returned. An empty table gives no rows; extra columns are
    ignored. A row repeated with the same id and vector is one candidate.
    """
    spark = vectors.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding",
                          is_query.alias("asks")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL").distinct()
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.filter("d > 0").orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], out)
    dim = common["d"]
    index = materialize(distinct_vectors(rows, k + 1, dim), "ann-index")
    n = index.count()
    if not n:
        return spark.createDataFrame([], out)
    sample = index.orderBy(F.xxhash64("unit"), "unit").limit(max(SAMPLE, pivots)).select("unit").collect()
    drawn = np.stack([np.frombuffer(r["unit"]) for r in sample])
    tables = [drawn[:pivots], spread_pivots(drawn, pivots)]
    shards = max(1, -(-n // SHARD_ROWS))

    def units_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, ok = unit_rows(batch.column("embedding").to_pylist(), dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(ok)),
                 pa.array([u.tobytes() for u in units], pa.binary())], names=["query_id", "unit"])

    asking = materialize(rows.filter("asks").select("vec_id", "embedding")
                         .mapInArrow(units_only, "query_id bigint, unit binary"), "ann-queries")
    asked = materialize(asking.select("unit").distinct(), "ann-asked")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], out)
    blocks = -(-n_asked // BLOCK_ROWS)
    # Long runs return fewer rows; short ones give every core a task.
    length = max(1, min(RUN_SHARDS, shards * blocks // (2 * spark.sparkContext.defaultParallelism)))
    runs = -(-shards // length)
    row = F.col("id") % runs * length
    todo = spark.range(0, blocks * runs, 1, min(blocks * runs, MOST_TASKS)).select(
        F.floor(F.col("id") / runs).alias("block"), row.alias("first"),
        F.least(row + length, F.lit(shards)).alias("last"))
    stored = write_parts(index, "shard", shards, "ann-shards"), write_parts(asked, "block", blocks, "ann-blocks")
    found = todo.mapInArrow(search_runs(*stored, tables, nearest, share, least, k),
                            "unit binary, vec_id bigint, score double")
    best = Window.partitionBy("unit").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    # A query that is among its own nearest drops out; the others move up.
    joined = asking.distinct().join(top, "unit").filter("vec_id != query_id")
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (joined.withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
