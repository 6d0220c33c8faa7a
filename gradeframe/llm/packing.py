"""Best-fit packing of token pieces into sequences by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.llm.bpe import byte_bpe
from gradeframe.llm.shared import id_and_text, lean, record_batch, text_slices, texts_of
from gradeframe.session import materialise

# Pieces that one task packs together; and how many such groups hand their loose ends to one group
# of the second pass.
GROUP_PIECES = 16384
LOOSE_GROUPS = 32

PIECES = "doc_id long, piece int, start long, length long, ids binary"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of at most ``capacity`` ids, one row each: doc_id, piece, start, length, ids.

    ``ids`` are little-endian uint32. A document's ids are those of its whole text and ``end_id``.
    Only documents longer than ``capacity`` are cut; their first piece takes what is left over.
    A null or empty text is the one id ``end_id``. Repeated rows and null ids are packed like others.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for rows in text_slices(batches):
            out: dict[str, list] = {f.name: [] for f in _PIECES}
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts_of(rows), strict=True):
                ids = bpe.encode(text) + end
                total = len(ids) // 4
                first = total % capacity or min(total, capacity)
                edges = [0, *range(first, total + 1, capacity)]
                for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for name, value in zip(out, (doc_id, n, a, b - a, ids[4 * a : 4 * b]), strict=True):
                        out[name].append(value)
            yield record_batch(_PIECES, **out)

    return id_and_text(docs, id_col, text_col).mapInArrow(lean(run, byte_bpe), PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin, and fill of each bin, placing the lengths in the order given.

    With N(g) open bins of residual gap g, each length goes where the sum of N(g)^2 over all gaps
    below the capacity becomes smallest: into a bin of some gap, or a new bin. Among equal sums the
    smallest gap wins, and among its bins the one that got there last.
    """
    # Indexed by fill level. Taking a bin from level l to l+s adds (1 - 2 N(l)) + (1 + 2 N(l+s)); a
    # full bin is no longer counted, and a new bin takes nothing away.
    never = 1 << 40
    leave = np.full(capacity + 1, never, np.int64)
    leave[0] = 0
    enter = np.ones(capacity + 1, np.int64)
    enter[capacity] = 0
    at_level: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, size in enumerate(lengths.tolist()):
        cost = leave[: capacity + 1 - size] + enter[size:]
        level = capacity - size - int(cost[::-1].argmin())
        if level:
            chosen = at_level[level].pop()
            left = len(at_level[level])
            leave[level] = 1 - 2 * left if left else never
            enter[level] = 1 + 2 * left
        else:
            chosen = len(fill)
            fill.append(0)
        bins[i], offsets[i] = chosen, level
        now = fill[chosen] = level + size
        if now < capacity:
            at_level[now].append(chosen)
            leave[now] = 1 - 2 * len(at_level[now])
            enter[now] = 1 + 2 * len(at_level[now])
    return bins, offsets, np.array(fill, np.int64)


def place(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset``; all columns of ``pieces`` stay.

    ``pieces`` needs ``length`` (1 to ``capacity``). Pieces that fill a sequence take one alone. The
    others are dealt evenly to groups of about ``group_pieces`` that tasks pack apart, whatever their
    keys are, so neither a hot key nor repeated rows make a large group. Each group then gives back
    the few sequences that stayed open with more than a 64th free, and groups ``LOOSE_GROUPS`` times
    as wide pack those pieces anew. Both passes take longer pieces first. Offsets in a sequence are gapless from 0.
    """
    pieces = materialise(pieces, "pieces")
    # The files are read alike each time, so the number of a row stays its own.
    rows = pieces.withColumn("__row", F.monotonically_increasing_id())
    full = rows.filter(F.col("length") == capacity).select(
        *pieces.columns, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = rows.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    placed = (
        T.StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long").add("__group", "long").add("__loose", "boolean")
    )

    def packer(first_id: int, keep_open: int):
        def pack(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["length", "__row"], ascending=[False, True])
            bins, offsets, fill = sum_of_squares(group["length"].to_numpy(), capacity)
            number = int(group["__group"].iloc[0])
            return group.drop(columns="__row").assign(
                sequence_id=first_id + (number << 24) + bins, offset=offsets, __loose=fill[bins] < keep_open
            )

        return pack

    dealt = short.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    first = materialise(dealt.groupBy("__group").applyInPandas(packer(0, capacity - capacity // 64), placed), "packed")
    again = (
        first.filter("__loose").drop("sequence_id", "offset", "__loose")
        .withColumn("__group", F.floor(F.col("__group") / LOOSE_GROUPS))
        .withColumn("__row", F.xxhash64(*pieces.columns))
    )
    second = again.groupBy("__group").applyInPandas(packer(1 << 62, 0), placed)
    done = [*pieces.columns, "sequence_id", "offset"]
    return full.unionByName(first.filter(~F.col("__loose")).select(done)).unionByName(second.select(done))
