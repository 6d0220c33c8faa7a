"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.fingerprints import mixed, shingles, word_hashes
from gradeframe.llm.shared import id_and_text, lean, numbered, record_batch, text_slices, texts_of
from gradeframe.session import materialise

SIMILARITY = 0.8
BANDS, ROWS = 13, 3  # a pair of similarity 0.8 shares a band with probability 0.9999
SAMPLES = BANDS * ROWS
LEAST_AGREEING = 21  # of the samples; a pair of similarity 0.8 has 31, and fewer than this with probability 0.00006
SLICE = 1 << 20  # bytes of text cut into shingles at once
BLOCK_TEXTS = 1024  # texts of a bucket that a task compares with as many others at once
DF_BITS = 18  # document frequencies are kept by this many bits of a shingle's hash
IDF_SHARE = 0.25  # how much more the rarest shingle weighs than one of all documents
DF_PART = 1 << 10  # buckets of document frequencies that are added up together
CHUNK_MEMBERS = 256  # documents that one task compares with the same partner in a row
KNOWN_SHINGLES = 1 << 21  # of the texts that a task of a block keeps for its next pairs
PAIRS_AT_ONCE = 1 << 14  # of a block, as Python numbers
_BLOCK = 1 << 16  # shingles sampled at once


# ---- weights -------------------------------------------------------------------------------------


@dataclass
class Weights:
    """(1 + ln tf) times a mild inverse document frequency."""

    idf: np.ndarray  # float32 by bucket

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        idf = self.idf[(hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)]
        return (1 + np.log(counts)).astype(np.float32) * idf


def _distinct(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingles of each text and their counts."""
    flat, sizes = shingles(texts)
    start = 0
    for size in sizes.tolist():
        yield np.unique(flat[start : start + size], return_counts=True)
        start += size


def learn_weights(docs: DataFrame) -> Weights:
    """Document frequencies over all documents, by hash bucket.

    Each task counts its documents; Spark adds the counts up. The table has the same size for any
    corpus. A bucket also counts other shingles that fall into it; the mean of all buckets is taken off
    for them, so that shingles of many documents stand out.
    """
    schema = pa.schema([("part", pa.int32()), ("numbers", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(1 << DF_BITS, np.int64), 0
        for rows in text_slices(batches, SLICE):
            found = [h for h, _ in _distinct(texts_of(rows))]
            n += len(found)
            buckets = (np.concatenate(found) >> np.uint64(64 - DF_BITS)).astype(np.int64)
            counts += np.bincount(buckets, minlength=1 << DF_BITS)
        if n:
            parts = [np.array([n], "<i8"), *counts.astype("<i8").reshape(-1, DF_PART)]
            yield record_batch(schema, part=range(-1, len(parts) - 1), numbers=[x.tobytes() for x in parts])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in part["numbers"].to_pylist())
        return pa.Table.from_arrays([part["part"][:1], pa.array([total.tobytes()], pa.binary())], schema=schema)

    types = "part int, numbers binary"
    got = docs.select("text").mapInArrow(lean(run, word_hashes), types).groupBy("part").applyInArrow(add, types).toArrow().sort_by("part")
    numbers = np.frombuffer(b"".join(got["numbers"].to_pylist()), "<i8")
    n_docs = max(2, int(numbers[:1].sum()))
    counts = numbers[1:].astype(np.float64) if len(numbers) else np.zeros(1 << DF_BITS)
    frequency = np.clip(counts - counts.mean(), 1, n_docs)
    return Weights((1 + IDF_SHARE * np.log(n_docs / frequency) / np.log(n_docs)).astype(np.float32))


# ---- samples -------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """65,536 quantiles of Gamma(2, 1), their inverses and their logarithms."""
    x = np.linspace(0, 40, 1 << 20)
    gamma = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - np.exp(-x) * (1 + x), x)
    return gamma.astype(np.float32), (1 / gamma).astype(np.float32), np.log(gamma).astype(np.float32)


def samples(hashes: np.ndarray, log_weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``SAMPLES`` consistent weighted samples of each document, one row each.

    By improved consistent weighted sampling, a shingle of weight w draws r and c from Gamma(2, 1) and
    b from [0, 1), all from hashes of the shingle; t = floor(ln w / r + b), and the shingle with the
    smallest ln c - r (t - b + 1) is the sample, together with its t. Two documents have the same
    sample with the probability of their weighted Jaccard similarity.
    """
    gamma, inverse, log_gamma = _variates()
    out = np.empty((SAMPLES, len(starts)), np.uint32)
    low = np.uint64(0xFFFF)
    for k in range(SAMPLES):
        h = mixed(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r_at = (h & low).astype(np.int64)
        b = ((h >> np.uint64(16)) & low).astype(np.float32) * np.float32(1 / (1 << 16))
        t = np.floor(log_weights * inverse.take(r_at) + b)
        cost = log_gamma.take(((h >> np.uint64(32)) & low).astype(np.int64)) - gamma.take(r_at) * (t - b + 1)
        # As integers in the same order, above the name of the sample.
        bits = cost.view(np.int32)
        ordered = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)
        name = (h >> np.uint64(32)).astype(np.uint32) ^ (t.astype(np.int32).view(np.uint32) * np.uint32(2654435761))
        out[k] = np.minimum.reduceat(ordered.view(np.uint64) << np.uint64(32) | name, starts).astype(np.uint32)
    return np.ascontiguousarray(out.T)


def signatures(texts: list[str], weights: Weights) -> list[bytes | None]:
    """Samples of each text as bytes; None for texts without words."""
    out: list[bytes | None] = [None] * len(texts)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        sizes = np.array([len(h) for _, h, _ in held])
        hashes, counts = (np.concatenate([x[n] for x in held]) for n in (1, 2))
        for (n, _, _), row in zip(held, samples(hashes, np.log(weights.of(hashes, counts)), np.cumsum(sizes) - sizes), strict=True):
            out[n] = row.astype("<u4").tobytes()
        held.clear()

    size = 0
    for n, (hashes, counts) in enumerate(_distinct(texts)):
        if len(hashes):
            held.append((n, hashes, counts))
            size += len(hashes)
        if size >= _BLOCK:
            flush()
            size = 0
    if held:
        flush()
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' sorted shingles and weights."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    common = np.minimum(a[1][at[both]], b[1][both]).sum(dtype=np.float64)
    union = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - common
    return float(common / union) if union else 1.0


def _packed(text: str) -> bytes:
    """A text compressed, after its number of bytes: texts move several times before they are compared."""
    data = text.encode()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> str:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True).decode()


# ---- links ---------------------------------------------------------------------------------------


def _agreeing(a: str, b: str) -> F.Column:
    """Number of equal samples of two signatures."""
    def part(column: str, n: int) -> F.Column:
        return F.substring(F.col(column), 4 * n + 1, 4)

    return sum(((part(a, n) == part(b, n)).cast("int") for n in range(SAMPLES)), F.lit(0))


def _bands(texts: DataFrame) -> DataFrame:
    """(bucket, band, v): a hash of each band's samples, of each text with words."""
    buckets = F.array(*[F.xxhash64(F.lit(n), F.substring("signature", 4 * ROWS * n + 1, 4 * ROWS)) for n in range(BANDS)])
    return texts.filter("signature IS NOT NULL").select("v", F.posexplode(buckets).alias("band", "bucket"))


def _shared(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, band, v, n) of the buckets that hold n texts, more than one; and first id and signature of those texts.

    Most buckets hold one text. They are counted by their hash alone, before anything wider moves.
    """
    counts = _bands(texts).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bands = materialise(_bands(texts).join(materialise(counts, "buckets"), "bucket"), "bands")
    return bands, materialise(texts.join(bands.select("v").distinct(), "v"), "needed")


def _with_agreement(pairs: DataFrame, needed: DataFrame) -> DataFrame:
    """(v, u, agreeing) of the pairs with enough equal samples."""
    pairs = pairs.join(needed.select("v", "signature"), "v").join(needed.select(F.col("v").alias("u"), F.col("signature").alias("u_signature")), "u")
    return pairs.select("v", "u", _agreeing("signature", "u_signature").alias("agreeing")).filter(F.col("agreeing") >= LEAST_AGREEING)


def _leader_pairs(bands: DataFrame, needed: DataFrame) -> DataFrame:
    """Each text with the leaders of its buckets: the text in the fullest buckets over all bands
    (of equals, the one with the most copies), and one by chance.

    The text that a group of copies was made from shares more buckets than the copies share among
    themselves, so it leads the group even if the copies differ too much from each other.
    """
    centre = bands.groupBy("v").agg(F.sum("n").alias("centre"))
    chance = F.xxhash64("v", "bucket")
    rows = bands.join(centre.join(needed.select("v", "copies"), "v"), "v").select(
        "bucket", F.struct(-F.col("centre"), -F.col("copies"), chance, "v").alias("a"), F.struct(chance, "v").alias("b")
    )
    chosen = rows.groupBy("bucket").agg(F.min("a")["v"].alias("a"), F.min("b")["v"].alias("b"))
    pairs = bands.join(chosen, "bucket").select("v", F.explode(F.array("a", "b")).alias("u")).filter("v != u").distinct()
    return _with_agreement(pairs, needed)


def _cross_blocks(bands: DataFrame, needed: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, band, v, label, i, j, side, signature) of the texts of each bucket that still holds several groups.

    The texts are dealt to blocks of about ``BLOCK_TEXTS``, and each block is compared with each other and
    with itself: the rows of equal (bucket, i, j) come one after the other, for one task to compare.
    """
    rows = bands.select("bucket", "band", "v").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    open_ = rows.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n")).filter("a != b")
    some = rows.join(open_.select("bucket", F.ceil(F.col("n") / BLOCK_TEXTS).alias("blocks")), "bucket").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
    some = some.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    some = some.select(
        "bucket", "band", "v", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    return _by_block(some.join(needed.select("v", "signature"), "v"))


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _compared(rows: pa.Table, least: int, below: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_agreeing_in`` of the rows of one block with another."""
    side = rows["side"].to_numpy()
    label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    sample = np.frombuffer(b"".join(rows["signature"].to_pylist()), "<u4").reshape(-1, SAMPLES)
    return _agreeing_in(sample, label, side, rows["band"][0].as_py(), least, below)


def _cross_pairs(bands: DataFrame, needed: DataFrame, labels: DataFrame, least: int, below: int) -> DataFrame:
    """(v, u, agreeing) of every pair that shares a bucket, is in different groups so far and agrees
    in ``least`` or more, but fewer than ``below`` samples; each pair once."""
    schema = pa.schema([("v", pa.binary()), ("u", pa.binary()), ("agreeing", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("bucket", "i", "j")):
            names = rows["v"].to_pylist()
            for x, y, agreeing in _compared(rows, least, below):
                first, second = [names[k] for k in x], [names[k] for k in y]
                yield record_batch(schema, v=list(map(min, first, second)), u=list(map(max, first, second)), agreeing=agreeing)

    return _cross_blocks(bands, needed, labels).mapInArrow(lean(run, word_hashes), "v binary, u binary, agreeing int")


def _cross_links(bands: DataFrame, needed: DataFrame, labels: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """(v, u, similarity) of links that join all texts joined by any link of ``_cross_pairs``.

    Pairs are never rows: they come into being and are verified in the task of their block, from the most
    agreeing down, and a pair that the block's links or the groups so far have joined needs no test. So a
    block gives fewer links than it has texts. First, by signatures alone, each block names the texts
    that are in any of its pairs; only these move, with their texts, to the second comparison.
    """
    found = pa.schema([("v", pa.binary()), ("u", pa.binary()), ("similarity", pa.float64())])
    blocks = _cross_blocks(bands, needed, labels)
    schema = pa.schema([
        ("bucket", pa.int64()), ("band", pa.int32()), ("v", pa.binary()), ("label", pa.binary()),
        ("i", pa.int64()), ("j", pa.int64()), ("side", pa.int32()), ("signature", pa.binary()),
    ])

    def involved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("bucket", "i", "j")):
            some = np.zeros(len(rows), bool)
            for x, y, _ in _compared(rows, LEAST_AGREEING, SAMPLES + 1):
                some[x] = some[y] = True
            if some.any():
                yield from rows.filter(pa.array(some)).select(schema.names).cast(schema).to_batches()

    types = "bucket long, band int, v binary, label binary, i long, j long, side int, signature binary"
    chosen = materialise(blocks.select(*schema.names).mapInArrow(lean(involved, word_hashes), types), "open-blocks")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("bucket", "i", "j")):
            # A block may have a million pairs, so their rows are short numbers.
            parts = [(x.astype(np.int32), y.astype(np.int32), n) for x, y, n in _compared(rows, LEAST_AGREEING, SAMPLES + 1)]
            if parts:
                x, y, agreeing = (np.concatenate(c) for c in zip(*parts))
                del parts
                order = np.lexsort((y, x, -agreeing.astype(np.int8)))
                yield _links_in(rows, x[order], y[order], weights, found)

    return _by_block(chosen.join(texts, "v")).mapInArrow(lean(verify, word_hashes), "v binary, u binary, similarity double")


def _links_in(rows: pa.Table, x: np.ndarray, y: np.ndarray, weights: Weights, schema: pa.Schema) -> pa.RecordBatch:
    """Links among these pairs of rows, tested in order, without those between rows that are joined by then."""
    names, packed = rows["v"].to_pylist(), rows["packed"]
    # A text may be on both sides under one label; labels are joined, rows are not.
    parent = {label: label for label in rows["label"].to_pylist()}
    label = rows["label"].to_pylist()
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held = 0

    def root(of: bytes) -> bytes:
        while parent[of] != of:
            parent[of] = of = parent[parent[of]]
        return of

    def vector(n: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal held
        if n not in known:
            if held > KNOWN_SHINGLES:
                known.clear()
                held = 0
            ((hashes, counts),) = _distinct([_unpacked(packed[n].as_py())])
            known[n] = hashes, weights.of(hashes, counts)
            held += len(hashes)
        return known[n]

    out: dict[str, list] = {"v": [], "u": [], "similarity": []}
    pairs = (pair for n in range(0, len(x), PAIRS_AT_ONCE) for pair in zip(x[n : n + PAIRS_AT_ONCE].tolist(), y[n : n + PAIRS_AT_ONCE].tolist(), strict=True))
    for a, b in pairs:
        one, other = root(label[a]), root(label[b])
        if one == other:
            continue
        alike = similarity(vector(a), vector(b))
        if alike >= SIMILARITY:
            parent[one] = other
            for name, value in zip(out, (min(names[a], names[b]), max(names[a], names[b]), alike), strict=True):
                out[name].append(value)
    return record_batch(schema, **out)


def _runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, one table for each run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for start, stop in zip(starts, starts[1:]):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _agreeing_in(
    sample: np.ndarray, label: np.ndarray, side: np.ndarray, band: int, least: int, below: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of two blocks (sides 1 and 2), or of one block (side 0), that agree, and in how many samples.

    A pair is found in the first band that it shares, so that other buckets do not give it again.
    """
    one = side[0] == 0
    a = np.flatnonzero(side != 2)
    b = a if one else np.flatnonzero(side == 2)
    if not len(a) or not len(b):
        return
    step = max(1, (1 << 16) // len(b))
    for start in range(0, len(a), step):
        x = a[start : start + step]
        wanted = label[x][:, None] != label[b][None, :]
        if one:
            wanted &= x[:, None] < b[None, :]
        if not wanted.any():
            continue
        equal = sample[x][:, None, :] == sample[b][None, :, :]
        agreeing = equal.sum(axis=2, dtype=np.uint8)
        at = np.nonzero(wanted & (agreeing >= least) & (agreeing < below))
        shared = equal[at].reshape(-1, BANDS, ROWS).all(axis=2)
        own = shared.argmax(axis=1) == band
        if own.any():
            yield x[at[0][own]], b[at[1][own]], agreeing[at][own]


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights) -> DataFrame:
    """(v, u, similarity) of every pair.

    A partner of many texts is compared by many tasks, each with at most about ``CHUNK_MEMBERS`` of
    them. A task reads its partners and their texts in sorted order and holds one partner at a time.
    """
    chunks = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / CHUNK_MEMBERS).alias("chunks"))
    members = pairs.join(chunks, "u").select("v", "u", F.pmod(F.xxhash64("v"), F.col("chunks")).alias("chunk"), F.lit(1).alias("place"))
    partners = chunks.select(F.col("u").alias("v"), "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("place"))
    schema = pa.schema([("v", pa.binary()), ("u", pa.binary()), ("similarity", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, partner = None, None
        for rows in _packed_slices(batches):
            found = ((h, weights.of(h, n)) for h, n in _distinct(list(map(_unpacked, rows.column("packed").to_pylist()))))
            out: dict[str, list] = {"v": [], "u": [], "similarity": []}
            keys = zip(*(rows.column(c).to_pylist() for c in ("v", "u", "chunk", "place")), strict=True)
            for (v, u, chunk, place), vector in zip(keys, found, strict=True):
                if place == 0:
                    at, partner = (u, chunk), vector
                elif at == (u, chunk):
                    for name, value in zip(out, (v, u, similarity(partner, vector)), strict=True):
                        out[name].append(value)
            yield record_batch(schema, **out)

    work = texts.join(members.unionByName(partners), "v").select("v", "u", "chunk", "place", "packed")
    return work.repartition("u", "chunk").sortWithinPartitions("u", "chunk", "place", "v").mapInArrow(lean(run, word_hashes), "v binary, u binary, similarity double")


def _packed_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each slice have at most ``SLICE`` bytes unpacked, or are one."""
    for batch in batches:
        sizes = [int.from_bytes(p.as_buffer()[:8].to_pybytes(), "little") for p in batch.column("packed")]
        start = held = 0
        for n, size in enumerate(sizes):
            if n > start and held + size > SLICE:
                yield batch.slice(start, n - start)
                start, held = n, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest name in the connected component of every end of an edge (v, u).

    Each round takes the smallest label around and then the label of the label; the tables of a round
    are written to the shared folder, and rounds go on until no label changes.
    """
    both = materialise(edges.select("v", "u").unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct(), "edges")
    labels = materialise(both.groupBy("v").agg(F.min("u").alias("label")).withColumn("label", F.least("v", "label")), "labels")
    while True:
        around = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("near")), "u").groupBy("v").agg(F.min("near").alias("near"))
        closer = labels.join(around, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of_label = closer.select(F.col("v").alias("label"), F.col("label").alias("next"))
        after = materialise(closer.join(of_label, "label").select("v", "old", F.col("next").alias("label")), "labels")
        labels = after.select("v", "label")
        if after.filter("label != old").isEmpty():
            return labels


def _link(candidates: DataFrame, texts: DataFrame, weights: Weights) -> tuple[DataFrame, DataFrame]:
    """Links among candidate pairs, and the groups that they join, which any other of these links would join too.

    At first each text is compared with the partner that it agrees with most; most of the other pairs
    then join texts of one group, and the rest is compared in a second round.
    """
    best = materialise(candidates.groupBy("v").agg(F.max(F.struct("agreeing", "u")).alias("best")).select("v", "best.u"), "pairs")
    tested = materialise(_verified(best, texts, weights), "verified")
    labels = components(tested.filter(F.col("similarity") >= SIMILARITY))
    left = candidates.join(labels, "v", "left").withColumn("a", F.coalesce("label", "v")).drop("label")
    left = left.join(labels.select(F.col("v").alias("u"), F.col("label").alias("b")), "u", "left").withColumn("b", F.coalesce("b", "u"))
    left = materialise(left.filter("a != b").join(tested.select("v", "u"), ["v", "u"], "left_anti").select("v", "u"), "pairs")
    if not left.isEmpty():
        tested = tested.unionByName(materialise(_verified(left, texts, weights), "verified"))
        labels = components(tested.filter(F.col("similarity") >= SIMILARITY))
    return tested.filter(F.col("similarity") >= SIMILARITY), labels


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, group_id and kept of every document.

    Documents are in one group if a chain of links joins them. A link is an equal text or a weighted
    Jaccard similarity of at least ``SIMILARITY``: five-word shingles weigh (1 + ln of their count)
    times a mild inverse document frequency over all documents. ``group_id`` is the smallest doc_id of
    the group, and ``kept`` marks one document of each group; rows that repeat both id and text are
    marked alike. Equal texts are one candidate, however many there are. A null text (digest null) is
    a group of its own and kept; empty texts are equal texts. A text of one to four words is one shingle.
    """
    rows = id_and_text(docs, id_col, text_col)
    weights = learn_weights(rows)
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary()), ("packed", pa.binary())])

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE):
            texts = part.column("text").to_pylist()
            digests = [None if t is None else hashlib.md5(t.encode()).digest() for t in texts]
            found = signatures([t or "" for t in texts], weights)
            # A text without words has no bucket, so nothing is compared with it.
            packed = [None if s is None else _packed(t) for t, s in zip(texts, found, strict=True)]
            yield record_batch(schema, doc_id=part.column("doc_id"), digest=digests, signature=found, packed=packed)

    signed = materialise(rows.mapInArrow(lean(sign, word_hashes), "doc_id long, digest binary, signature binary, packed binary"), "signatures")
    # Null ids come last, so that a text with any id is found by it again.
    distinct = materialise(
        signed.filter("digest IS NOT NULL").groupBy(F.col("digest").alias("v")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.max("signature").alias("signature")),
        "distinct-texts",
    )
    bands, needed = _shared(distinct)
    candidates = materialise(_leader_pairs(bands, needed), "candidates")
    labels = rows.sparkSession.createDataFrame([], "v binary, label binary")
    if not bands.isEmpty():
        texts = _texts_of_pairs(signed, needed)
        links, labels = _link(candidates, texts, weights)
        more = materialise(_cross_links(bands, needed, labels, texts, weights), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))
    named = distinct.select("v", "first").join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    first = named.groupBy("label").agg(F.min("first").alias("group_id"), F.min(F.struct(F.col("first").isNull().alias("none"), "first", "v")).alias("keep"))
    by_text = named.join(first, "label").select(F.col("v").alias("digest"), "group_id", (F.col("v") == F.col("keep.v")).alias("keeps"), F.col("first"))
    joined = signed.select("doc_id", "digest").join(by_text, "digest", "left")
    kept = F.col("digest").isNull() | (F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("first")))
    return joined.select("doc_id", "digest", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), kept.alias("kept"))


def _texts_of_pairs(signed: DataFrame, needed: DataFrame) -> DataFrame:
    """(v, packed) of every text that shares a bucket with another, once."""
    texts = signed.filter("packed IS NOT NULL").select("doc_id", F.col("digest").alias("v"), "packed").join(needed.select("v", "first"), "v")
    return materialise(texts.filter(F.col("doc_id").eqNullSafe(F.col("first"))).select("v", "packed").dropDuplicates(["v"]), "texts")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all columns under their names. A document with a null text stays."""
    found = groups(docs, id_col, text_col).filter("kept AND digest IS NOT NULL").select("doc_id", "digest").distinct()
    safe, (safe_id, safe_text) = numbered(docs, id_col, text_col)
    own = safe.withColumn("own_digest", F.unhex(F.md5(F.col(safe_text).cast("string"))))
    kept = own.join(found, (F.col("own_digest") == F.col("digest")) & F.col(safe_id).eqNullSafe(F.col("doc_id")), "left_semi")
    once = kept.dropDuplicates([safe_id, "own_digest"]).drop("own_digest")
    return once.unionByName(safe.filter(F.col(safe_text).isNull())).toDF(*docs.columns)
