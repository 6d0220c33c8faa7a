"""Quality of whole texts by Bradley-Terry ranking: scores learned from pairs, cut at a score quantile."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.shared import held_out, id_and_text, record_batch, text_slices, texts_of
from gradeframe.operators.quantiles import exact_quantiles
from gradeframe.session import materialise

GROUP_ROWS = 1024  # labelled rows that find their partners among each other
GROUP_PARTNERS = 64  # rows of the rarer label in a group, on average at least; they join several groups if they must
PAIRS_PER_ROW = 4
STEPS = 12  # of Newton, at most
SLICE = 2 << 20  # bytes of text looked at at once; each takes about 30 bytes of memory
RIDGE = 1e-3
GOOD = 0.7  # the score at the cut

# Kinds of bytes, in this order; all others are the last kind but two.
KINDS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?;:",
    b"\"'()", b"[]{}<>", b"|\\/", b"-_=+", b"#$%&*@^~`",
)
_N = 16
_KIND = np.full(256, _N - 3, np.uint8)
for _n, _kind in enumerate(KINDS):
    _KIND[list(_kind)] = _n
_KIND[0x80:0xC0], _KIND[0xC0:] = _N - 2, _N - 1


def features(texts: list[str]) -> np.ndarray:
    """What a text looks like, one row each: how often each kind of byte follows each other kind, how
    long texts, lines and words are, and how often words and lines repeat."""
    out = np.zeros((len(texts), _N * _N + 6), np.float32)
    data = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    if sizes.sum():
        kinds = _KIND[np.frombuffer(b"".join(data), np.uint8)].astype(np.int64)
        pair = np.repeat(np.arange(len(texts)) * _N, sizes)[1:]
        ends = np.cumsum(sizes)[:-1]
        inside = np.ones(len(kinds) - 1, bool)
        inside[ends[(ends > 0) & (ends < len(kinds))] - 1] = False
        pair = ((pair + kinds[:-1]) * _N + kinds[1:])[inside]
        counts = np.bincount(pair, minlength=len(texts) * _N * _N).reshape(len(texts), -1)
        out[:, : _N * _N] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    for n, text in enumerate(texts):
        words, lines = text.split(), text.split("\n")
        if words:
            distinct = len(set(words))
            out[n, _N * _N :] = (
                np.log1p(len(words)), np.log1p(len(text) / len(words)), np.log(distinct + 1) / np.log(len(words) + 1),
                np.log1p(len(words) / len(lines)), len(set(lines)) / len(lines), 1.0,
            )
    return out


@dataclass
class Ranking:
    """A text's score is the weighted sum of its standardised features, beyond a cut."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; ``GOOD`` at the cut."""
        beyond = (rows - self.middle) / self.scale @ self.weights - self.cut + np.log(GOOD / (1 - GOOD))
        return 1 / (1 + np.exp(-np.clip(beyond, -60, 60)))


def _partners(labels: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of label 1, row of label 0): each own row with ``PAIRS_PER_ROW`` random rows of the other label."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own_good, own_bad = good[own[good]], bad[own[bad]]
    first = np.concatenate([np.repeat(own_good, PAIRS_PER_ROW), rng.choice(good, len(own_bad) * PAIRS_PER_ROW)])
    second = np.concatenate([rng.choice(bad, len(own_good) * PAIRS_PER_ROW), np.repeat(own_bad, PAIRS_PER_ROW)])
    return first, second


def _slopes(difference: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What pairs add to the gradient and the hessian of the loss, and their number: a row each of the
    hessian, then the gradient, then the number."""
    p = 1 / (1 + np.exp(-np.clip(difference @ weights, -30, 30)))
    hessian = (difference * (p * (1 - p))[:, None]).T @ difference
    return np.vstack([hessian, difference.T @ (p - 1), np.full(len(weights), len(difference))])


def _newton(slopes: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Weights that minimise the mean loss of all pairs with a small ridge; zeros if there is no pair."""
    weights = np.zeros(size)
    for _ in range(STEPS):
        found = slopes(weights)
        n = found[-1, 0]
        if not n:
            break
        step = np.linalg.solve(found[:-2] / n + RIDGE * np.eye(size), found[-2] / n + RIDGE * weights)
        weights = weights - step
        if np.abs(step).max() < 1e-5:
            break
    return weights


def fit(rows: np.ndarray, labels: np.ndarray, share_of_zero: float, seed: int = 7) -> Ranking:
    """Bradley-Terry: P(a before b) is the logistic function of the difference of their scores.

    Each row is paired with ``PAIRS_PER_ROW`` random rows of the other label, and the row with label 1
    is preferred. Newton steps minimise the logistic loss on feature differences with a small ridge.
    The cut is the score quantile that leaves the share of label 0 below it.
    """
    middle = rows.mean(axis=0) if len(rows) else np.zeros(_N * _N + 6)
    scale = np.maximum(rows.std(axis=0), 1e-3) if len(rows) else np.ones(_N * _N + 6)
    x = ((rows - middle) / scale).astype(np.float64)
    first, second = _partners(labels, np.ones(len(labels), bool), np.random.default_rng(seed))
    difference = x[first] - x[second]
    weights = _newton(lambda w: _slopes(difference, w), x.shape[1])
    ranked = np.sort(x @ weights)
    below = round(share_of_zero * len(ranked))
    if not len(ranked):
        cut = np.log(GOOD / (1 - GOOD))  # nothing is known: all scores are one half
    elif 0 < below < len(ranked):
        cut = (ranked[below - 1] + ranked[below]) / 2
    else:
        cut = ranked[0] if not below else ranked[-1] + 60
    return Ranking(middle, scale, weights, float(cut))


def _blocks(features: DataFrame, known: DataFrame, n_rows: int, rare: int, n_rare: int) -> DataFrame:
    """(block, labels, own, features): all labelled rows, dealt at random to groups of about ``GROUP_ROWS``.

    Every row is an own row of one group. Rows of the rarer label also lend themselves to the groups
    after it, if there are too few of them to be in each.
    """
    n_groups = max(1, n_rows // GROUP_ROWS)
    copies = min(n_groups, max(1, math.ceil(GROUP_PARTNERS * n_groups / max(1, n_rare))))
    rows = features.join(known, "doc_id").withColumn("at", F.pmod(F.xxhash64("doc_id", "label", "features"), F.lit(n_groups)))
    last = F.when(F.col("label") == rare, F.lit(copies - 1)).otherwise(F.lit(0))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select(((F.col("at") + F.col("copy")) % n_groups).alias("block"), (F.col("copy") == 0).alias("own"), "doc_id", "label", "features")
    schema = pa.schema([("block", pa.int64()), ("labels", pa.binary()), ("own", pa.binary()), ("features", pa.binary())])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, labels, own, held = None, bytearray(), bytearray(), bytearray()

        def gathered() -> pa.RecordBatch:
            return record_batch(schema, block=[at], labels=[bytes(labels)], own=[bytes(own)], features=[bytes(held)])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("block", "label", "own", "features"))
            for block, label, is_own, row in zip(*columns, strict=True):
                if block != at:
                    if labels:
                        yield gathered()
                    at, labels, own, held = block, bytearray(), bytearray(), bytearray()
                labels.append(label)
                own.append(is_own)
                held += row
        if labels:
            yield gathered()

    dealt = rows.repartition("block").sortWithinPartitions("block", "doc_id", "label", "features", "own")
    return materialise(dealt.mapInArrow(gather, "block long, labels binary, own binary, features binary"), "labelled-blocks")


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, labels, own and features of each block."""
    for batch in batches:
        for block, labels, own, rows in zip(*(batch.column(c) for c in ("block", "labels", "own", "features")), strict=True):
            found = np.frombuffer(rows.as_buffer(), np.float32).reshape(-1, _N * _N + 6)
            yield block.as_py(), np.frombuffer(labels.as_buffer(), np.uint8), np.frombuffer(own.as_buffer(), bool), found


def _summed(blocks: DataFrame, of_block: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of an array of ``of_block``. Tasks add up theirs; Spark adds up the tasks', row by row of the array."""
    schema = pa.schema([("row", pa.int32()), ("task", pa.int32()), ("numbers", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _opened(batches):
            found = of_block(*block)
            total = found if total is None else total + found
        if total is not None:
            task = TaskContext.get().partitionId()
            yield record_batch(schema, row=range(len(total)), task=[task] * len(total), numbers=[r.astype("<f8").tobytes() for r in total])

    def add(part: pa.Table) -> pa.Table:
        part = part.sort_by("task")  # the same sum whatever arrives first
        total = sum(np.frombuffer(r, "<f8") for r in part["numbers"].to_pylist())
        return pa.Table.from_arrays([part["row"][:1], pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    types = "row int, task int, numbers binary"
    got = blocks.mapInArrow(run, types).groupBy("row").applyInArrow(add, types).toArrow().sort_by("row")
    return np.array([np.frombuffer(r, "<f8") for r in got["numbers"].to_pylist()])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 7) -> Ranking:
    """Learn the ranking from all labelled rows that are not held out, as ``fit`` does from rows in memory.

    Rows find their partners among those dealt to the same group. Every Newton step goes over all
    groups, and only its sums reach the driver; the cut is the exact quantile of all rows' scores. The
    share of label 0 is counted over all labels. Labels other than 0 and 1, null ids and labels
    without a text are left out.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = known.agg(F.avg((F.col("label") == 0).cast("double"))).first()[0] or 0.0
    texts = id_and_text(docs, id_col, text_col).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n_of = {r["label"]: r["count"] for r in texts.select("doc_id").join(known, "doc_id").groupBy("label").count().collect()}
    n_rows = sum(n_of.values())
    size = _N * _N + 6
    if not n_rows:
        return fit(np.zeros((0, size), np.float32), np.zeros(0, np.int32), share)
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.binary())])

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, SLICE):
            yield record_batch(schema, doc_id=rows.column("doc_id"), features=[r.tobytes() for r in features(texts_of(rows))])

    rare = min((0, 1), key=lambda label: n_of.get(label, 0))
    blocks = _blocks(texts.mapInArrow(look, "doc_id long, features binary"), known, n_rows, rare, n_of.get(rare, 0))

    def moments(block: int, labels: np.ndarray, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
        x = rows[own].astype(np.float64)
        return np.array([x.sum(axis=0), (x * x).sum(axis=0)])

    total, squares = _summed(blocks, moments) / n_rows
    ranking = Ranking(total, np.maximum(np.sqrt(np.maximum(squares - total * total, 0)), 1e-3), np.zeros(size), 0.0)

    def slopes(weights: np.ndarray) -> np.ndarray:
        def of_block(block: int, labels: np.ndarray, own: np.ndarray, rows: np.ndarray) -> np.ndarray:
            x = (rows - ranking.middle) / ranking.scale
            first, second = _partners(labels, own, np.random.default_rng([seed, block]))
            return _slopes(x[first] - x[second], weights)

        return _summed(blocks, of_block)

    ranking.weights = _newton(slopes, size)
    ranking.cut = _cut(blocks, ranking, share, n_rows)
    return ranking


def _cut(blocks: DataFrame, ranking: Ranking, share_of_zero: float, n_rows: int) -> float:
    """The middle between the two own rows' scores that the share of label 0 falls between."""
    schema = pa.schema([("ranked", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, own, rows in _opened(batches):
            yield record_batch(schema, ranked=(rows[own] - ranking.middle) / ranking.scale @ ranking.weights)

    ranked = materialise(blocks.mapInArrow(run, "ranked double"), "ranked")
    below = round(share_of_zero * n_rows)
    if 0 < below < n_rows:
        return exact_quantiles(ranked, [], {"cut": ("ranked", (below - 0.5) / (n_rows - 1))}).first()["cut"]
    least, most = ranked.agg(F.min("ranked"), F.max("ranked")).first()
    return most + 60 if below else least


def score(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 from ``GOOD`` on) of every whole text.

    A null text is an empty one; empty texts get a score too. Every row is scored for itself.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, SLICE):
            yield record_batch(schema, doc_id=rows.column("doc_id"), score=ranking.scores(features(texts_of(rows))))

    scored = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
