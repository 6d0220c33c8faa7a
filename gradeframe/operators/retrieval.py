"""Vector retrieval: exact top-k by inner product, and answers over retrieved contexts."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.constants import RETRIEVED_CONTEXTS
from gradeframe.functions.labels import letter_at
from gradeframe.functions.options import argmax_index
from gradeframe.session import materialise, work_dir
from gradeframe.sources.blobs import read_blob, write_blob

SCORE_PLACES = 6
PIVOTS = 64  # vectors that the others are dealt around
BLOCK_ROWS = 4096  # vectors per block: 4096 x 1024 doubles are 32 MB
QUERY_ROWS = 8192  # queries that a task compares with the blocks
QUERY_CELLS = 1 << 20  # numbers of the queries that are looked at together: 8 MB
SCORE_CELLS = 1 << 19  # scores that are held at once: 4 MB
BOUND_ROWS = 256  # blocks whose bounds are held at once
TASKS_PER_CORE = 2  # at least, if there are enough queries

RESULT = "query_id bigint, vec_id bigint, score double"


@dataclass(frozen=True)
class VectorIndex:
    """Blocks of neighbouring vectors as files, and what bounds the scores of each block.

    ``blocks`` has one row per block: uri, number of vectors, centre, radius (the largest distance of
    a vector from the centre). It is written in files whose addresses are ``listed``.
    """

    blocks: DataFrame
    listed: tuple[str, ...]


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _numbers(vectors: DataFrame) -> str:
    """Type of the numbers of an embedding: floats stay floats, which doubles hold exactly."""
    return "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"


def _pack(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    head = np.array([*matrix.shape, matrix.dtype.itemsize], np.int64)
    return head.tobytes() + ids.astype(np.int64).tobytes() + matrix.tobytes()


def _unpack(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, the vectors as doubles."""
    data = read_blob(uri)
    n, dims, size = np.frombuffer(data, np.int64, 3)
    matrix = np.frombuffer(data, f"f{size}", n * dims, offset=24 + 8 * n)
    return np.frombuffer(data, np.int64, n, offset=24), matrix.reshape(n, dims).astype(np.float64, copy=False)


def build_index(vectors: DataFrame, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> VectorIndex:
    """Deal vectors (vec_id, embedding) to blocks around pivots; the only time that vectors are shuffled.

    Pivots are the vectors whose ids have the smallest hashes. A pivot near which very many vectors
    lie, copies of one among them, has as many blocks as their number asks for.
    """
    spark = vectors.sparkSession
    kind = _numbers(vectors)
    vectors = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast(f"array<{kind}>")).where("embedding IS NOT NULL")
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("embedding").toPandas()
    centres = _stacked(chosen["embedding"]) if len(chosen) else np.zeros((1, 1))
    folder = work_dir(spark, "vector-blocks")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = (centres**2).sum(axis=1)
        for batch in batches:
            if len(batch):
                yield batch.assign(pivot=(lengths - 2 * _stacked(batch["embedding"]) @ centres.T).argmin(axis=1))

    # dealt twice, for the sizes and for the blocks, and not kept: that is cheaper than a copy on disk
    dealt = vectors.mapInPandas(near, f"vec_id bigint, embedding array<{kind}>, pivot int")
    sizes = {r.pivot: r["count"] for r in dealt.groupBy("pivot").count().collect()}
    parts = F.create_map(*[F.lit(x) for p, n in sizes.items() for x in (p, math.ceil(n / block_rows))]) if sizes else F.lit(None)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts[F.col("pivot")] if sizes else F.lit(1)))

    def write(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id", kind="stable")
        matrix = _stacked(block["embedding"])
        centre = matrix.mean(axis=0)
        radius = float(np.sqrt(((matrix - centre) ** 2).sum(axis=1).max()))
        data = _pack(block["vec_id"].to_numpy(), matrix.astype(np.float32 if kind == "float" else np.float64))
        return pd.DataFrame({"uri": [write_blob(folder, data)], "n": [len(block)], "centre": [centre], "radius": [radius]})

    blocks = dealt.groupBy("pivot", "part").applyInPandas(write, "uri string, n bigint, centre array<double>, radius double")
    blocks = materialise(blocks, "vector-index")
    return VectorIndex(blocks, tuple(sorted(blocks.inputFiles())))


def _slack(bounds: np.ndarray, places: int) -> np.ndarray:
    """Bounds of rounded scores, beyond what the arithmetic can be off by."""
    return bounds + np.abs(bounds) * 1e-9 + 10.0**-places


def _bounds(listed: tuple[str, ...], queries: np.ndarray, places: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Address and number of vectors of some blocks with the most that each query can score in them.

    q.v = q.c + q.(v - c), and the last term is at most |q| times the radius. The list of blocks is
    read file by file, so it need not fit in memory.
    """
    length = np.sqrt((queries**2).sum(axis=1, keepdims=True))
    for uri in listed:
        for rows in pq.ParquetFile(io.BytesIO(read_blob(uri))).iter_batches(batch_size=BOUND_ROWS):
            if rows.num_rows:
                centres = np.asarray(rows.column("centre").flatten()).reshape(rows.num_rows, queries.shape[1])
                radius = np.asarray(rows.column("radius"))
                yield np.array(rows.column("uri").to_pylist(), object), np.asarray(rows.column("n")), _slack(queries @ centres.T + length * radius, places)


def _first_blocks(listed: tuple[str, ...], queries: np.ndarray, k: int, places: int) -> dict[str, np.ndarray]:
    """The blocks of the highest bounds that hold k vectors together for a query, with the rows of these queries."""
    names: list[str] = []
    held, which, size = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0), np.int64)
    for uris, n, bounds in _bounds(listed, queries, places):
        number = np.broadcast_to(len(names) + np.arange(len(uris)), bounds.shape)
        held, which, size = (np.hstack(x) for x in ((held, -bounds), (which, number), (size, np.broadcast_to(n, bounds.shape))))
        if held.shape[1] > k:  # a block holds one vector at least
            top = np.argpartition(held, k - 1, axis=1)[:, :k]
            held, which, size = (np.take_along_axis(x, top, axis=1) for x in (held, which, size))
        names += uris.tolist()
    order = np.argsort(held, axis=1, kind="stable")
    which, size = np.take_along_axis(which, order, axis=1), np.take_along_axis(size, order, axis=1)
    row, column = np.nonzero(np.cumsum(size, axis=1) - size < k)
    chosen = which[row, column]
    order = np.argsort(chosen, kind="stable")
    blocks, starts = np.unique(chosen[order], return_index=True)
    return {names[b]: rows for b, rows in zip(blocks, np.split(row[order], starts[1:]), strict=False)}


class _Nearest:
    """The best vectors that were found so far for some queries, and the score that a better one must reach."""

    def __init__(self, queries: np.ndarray, k: int, places: int):
        self.queries, self.k, self.places = queries, k, places
        self.floor = np.full(len(queries), -np.inf)
        self.row, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def look(self, uri: str, rows: np.ndarray) -> None:
        """Compare some queries, given by their ascending rows, with a block."""
        ids, matrix = _unpack(uri)
        step = max(1, SCORE_CELLS // len(ids))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            scores = self.queries[part] @ matrix.T
            if np.isneginf(self.floor[part]).any():
                row, column, found = _best(scores, self.k, self.places)
            else:
                # rounding moves a score by half a place at most
                row, column = np.divmod(np.flatnonzero(scores >= (self.floor[part] - 10.0**-self.places)[:, None]), len(ids))
                found = _rounded(scores[row, column], self.places)
            self._add(part[row], ids[column], found)

    def _add(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        kept = scores >= self.floor[row]
        self.more.append((row[kept], ids[kept], scores[kept]))
        self.waiting += int(kept.sum())
        if self.waiting > max(4 * self.k, len(self.queries) * self.k):
            self.settle()

    def settle(self) -> None:
        """Keep the k best of each query, equal scores by the smaller id, and raise the floors to the k-th."""
        row, ids, scores = (np.concatenate(x) for x in zip((self.row, self.ids, self.scores), *self.more, strict=True))
        order = np.lexsort((ids, -scores, row))
        row = row[order]
        first = np.searchsorted(row, np.arange(len(self.queries)))
        kept = np.arange(len(row)) - first[row] < self.k
        self.row, self.ids, self.scores = row[kept], ids[order][kept], scores[order][kept]
        ends = np.cumsum(np.bincount(self.row, minlength=len(self.queries)))
        full = np.diff(ends, prepend=0) == self.k
        self.floor[full] = self.scores[ends[full] - 1]
        self.more, self.waiting = [], 0


def _rounded(scores: np.ndarray, places: int) -> np.ndarray:
    return np.rint(scores * 10.0**places) / 10.0**places


def _best(scores: np.ndarray, k: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best vectors of a block for each query; ids ascend, so equal scores go to the smaller id."""
    scores = _rounded(scores, places)
    n = scores.shape[1]
    k = min(k, n)
    limit = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above, equal = scores > limit, scores == limit
    room = k - above.sum(axis=1, keepdims=True)
    row, column = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))
    return row, column, scores[row, column]


def _nearest(listed: tuple[str, ...], queries: np.ndarray, k: int, places: int) -> _Nearest:
    """The k best vectors of all blocks for each query.

    Each query first looks into the blocks of the highest bounds that hold k vectors; its k-th score there is
    the floor below which no other block is opened. Floors rise as better vectors are found.
    """
    found = _Nearest(queries, k, places)
    first = _first_blocks(listed, queries, k, places)
    for uri, rows in first.items():
        found.look(uri, rows)
    found.settle()
    for uris, _, bounds in _bounds(listed, queries, places):
        for column, uri in enumerate(uris):
            open_to = bounds[:, column] >= found.floor
            if uri in first:
                open_to[first[uri]] = False
            if open_to.any():
                found.look(uri, np.flatnonzero(open_to))
    found.settle()
    return found


def search(index: VectorIndex, queries: DataFrame, k: int = RETRIEVED_CONTEXTS, places: int = SCORE_PLACES) -> DataFrame:
    """The k vectors with the largest inner product for each query (query_id, embedding): query_id, vec_id, score, rank.

    Scores are rounded before ranking, ties go to the smaller id. The result is that of a comparison with
    all vectors. Queries are dealt once to tasks of bounded size; a task reads the blocks that any of its
    queries must look into one after the other, so neither pairs of queries and blocks nor vectors are
    shuffled, and what leaves it are k rows of each query.
    """
    listed = index.listed
    kind = _numbers(queries)
    queries = queries.select(F.col("query_id").cast("bigint"), F.col("embedding").cast(f"array<{kind}>")).where("embedding IS NOT NULL")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, QUERY_CELLS // max(1, len(batch["embedding"].iloc[0]))) if len(batch) else 1
            for start in range(0, len(batch), step):
                part = batch[start : start + step]
                found = _nearest(listed, _stacked(part["embedding"]), k, places)
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[found.row], "vec_id": found.ids, "score": found.scores})

    n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    waves = max(TASKS_PER_CORE, math.ceil(n / (QUERY_ROWS * cores)))
    tasks = max(1, min(waves * cores, math.ceil(n / 1024)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = queries.repartition(tasks).mapInPandas(compare, RESULT)
    # an id that several queries share has the best of all of them
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve_topk(
    queries: DataFrame, vectors: DataFrame, k: int = RETRIEVED_CONTEXTS, score_places: int = SCORE_PLACES,
    pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``search`` over an index made for this call; keep the index of ``build_index`` for many calls."""
    return search(build_index(vectors, pivots, block_rows), queries, k, score_places)


def question_contexts(questions: DataFrame, contexts: DataFrame, on: str = "query_id") -> DataFrame:
    """Each question with each of its own retrieved contexts."""
    return questions.join(contexts, on)


def joint_argmax(df: DataFrame, by: str = "query_id", position: str = "rank", scores: str = "scores") -> DataFrame:
    """The best (context, option) pair per question; the first in reading order wins a tie.

    Each row reduces its own options first, then one aggregate with map-side combination keeps
    the best row per question.
    """
    option = argmax_index(F.col(scores))
    rows = df.withColumn("__o", option).withColumn("__s", F.array_max(F.col(scores)))
    best = rows.groupBy(by).agg(
        F.max_by(
            F.struct(F.col(position).alias("context"), F.col("__o").alias("option"), F.col("__s").alias("score")),
            F.struct(F.col("__s"), -F.col(position)),
        ).alias("__b")
    )
    return best.select(
        by, F.col("__b.option").alias("choice"), letter_at(F.col("__b.option")).alias("letter"),
        F.col("__b.context").alias("context"), F.col("__b.score").alias("score"),
    )


def flat_argmax(scores, options: int = 4):
    """Choice and context index of the best entry of a flat context-major score array."""
    best = argmax_index(scores)
    return F.struct(
        F.pmod(best, F.lit(options)).alias("choice"), F.floor(best / F.lit(options)).cast("int").alias("context")
    )


def answer_with_contexts(questions: DataFrame, contexts: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """Retrieve, pair with the question, score every option, take the joint best.

    ``contexts`` is the output of ``retrieve_topk``; ``pair_scores`` has query_id, vec_id and an
    array of option scores from the reader model.
    """
    paired = question_contexts(questions, contexts).join(pair_scores, ["query_id", "vec_id"])
    return joint_argmax(paired.withColumn("rank", F.col("rank") - 1))


def predict_batches(df: DataFrame, fn, schema: T.StructType | str) -> DataFrame:
    """Hook for a user's scorer: a function from an Arrow batch (pandas) to a batch of results."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)
