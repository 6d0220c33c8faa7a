"""Language of whole texts by interpolated Kneser-Ney models of letters, one per language."""

from __future__ import annotations

import functools
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.fingerprints import mixed
from gradeframe.llm.shared import create_file, held_out, id_and_text, lean, open_file, record_batch, text_slices, texts_of, worker_table
from gradeframe.session import materialise, work_dir

ORDER = 4
MAX_CELLS = 16_000_000  # n-grams times languages of a model that a task holds at once; a larger one stays in files
SHARD_ENTRIES = 1 << 19  # of a file of such a model
SHARDS_HELD = 16  # files that a task keeps in memory
LEAST_ROWS = 5  # of a language, to say what is unusual in it; the rows of all languages speak for one of fewer
SHARPNESS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
REJECT_Z = 8.0
LEAST_SPREAD = 1.0  # nats by which the cost of a single symbol varies at least
UNDETERMINED = "und"
SLICE = 1 << 20  # bytes of text turned into n-grams at once; each takes about 60 bytes of memory
TASK_GRAMS = 1 << 20  # n-grams that a task counts before it hands its counts on
_16 = np.uint64(16)


@functools.lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """16-bit symbol of each code point: itself for letters, 0 for all else. Rare letters beyond 16 bits share some."""
    out = np.zeros(0x110000, np.uint16)
    for code in range(0x110000):
        if chr(code).isalpha():
            out[code] = code if code < 0x10000 else 0xE000 + code % 0x1900
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of the texts with the three before it, packed into 64 bits; and the number of its text.

    Texts are lower-cased; a run of other signs than letters is one symbol 0, and so is the end of a
    text. Before a text stand zeros. A text without letters gives nothing.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _symbols()[codes]
    kept = symbols != 0
    kept[1:] |= symbols[:-1] != 0
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in lowered])[kept]
    s = symbols[kept].astype(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(s) else np.zeros(0, np.int64)
    before = [np.concatenate([np.zeros(k, np.uint64), s[:-k]])[: len(s)] if len(s) else s for k in (1, 2, 3)]
    # The symbol before a text is the 0 that ends the last one; those before it belong to that text.
    before[1][starts] = 0
    before[2][starts] = 0
    before[2][np.minimum(starts + 1, max(len(s) - 1, 0))] = 0
    return ((before[2] << _16 | before[1]) << _16 | before[0]) << _16 | s, owner


class HashArray:
    """Sorted hashes of keys, and where each range of hashes begins."""

    def __init__(self, keys: np.ndarray):
        hashes = mixed(keys + np.uint64(1))
        self.order = np.argsort(hashes, kind="stable")
        bits = min(22, max(8, int(len(keys)).bit_length() + 2))
        self.shift = np.uint64(64 - bits)
        ordered = hashes[self.order]
        self.first = np.searchsorted(ordered, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.hashes = np.concatenate([ordered, [np.uint64(0xFFFFFFFFFFFFFFFF)]])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key among the sorted ones, and whether it is there."""
        wanted = mixed(keys + np.uint64(1))
        at = self.first.take((wanted >> self.shift).astype(np.int64))
        there = self.hashes.take(at)
        more = np.flatnonzero(there < wanted)
        while len(more):
            at[more] += 1
            there[more] = self.hashes.take(at[more])
            more = more[there[more] < wanted[more]]
        return np.minimum(at, len(self.hashes) - 2), there == wanted


@dataclass
class Model:
    """Log probabilities of n-grams of each order in every language, and weights for falling back to a shorter one."""

    languages: list[str]
    tables: list[tuple[HashArray, np.ndarray]]  # orders 1 to ORDER
    backoff: list[tuple[HashArray, np.ndarray]]  # contexts of orders 2 to ORDER
    unknown: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread_per_symbol: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sharpness: float = 1.0

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of each n-gram's last symbol after the others, one column per language."""
        out = np.empty((len(keys), len(self.languages)), np.float32)
        left, fallen = np.arange(len(keys)), np.zeros((len(keys), len(self.languages)), np.float32)
        for order in range(ORDER, 0, -1):
            keys = keys & np.uint64((1 << 16 * order) - 1) if order < 4 else keys
            table, values = self.tables[order - 1]
            at, found = table.find(keys)
            if order == ORDER:
                out = values.take(at, axis=0)
            else:
                out[left[found]] = values[at[found]] + fallen[found]
            left, keys, fallen = left[~found], keys[~found], fallen[~found]
            if not len(left):
                break
            if order > 1:
                contexts, weights = self.backoff[order - 2]
                at, found = contexts.find(keys >> _16)
                fallen += np.where(found[:, None], weights[at], np.float32(0))
        out[left] = self.unknown + fallen
        return out


@dataclass
class FileModel(Model):
    """A model of any number of n-grams, in files of the shared folder.

    ``files`` has the shards of six tables by name: ``("gram", n)`` holds what an n-gram's own count gives
    to its probability, ``("context", n)`` what the shorter n-gram counts after a context that was met.
    Only what a language has seen is stored. The probabilities of single symbols are held in memory.
    """

    files: dict[tuple[str, int], list[str]] = field(default_factory=dict)
    symbols: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    single: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(keys, return_inverse=True)
        last = distinct & np.uint64(0xFFFF)
        at = np.minimum(np.searchsorted(self.symbols, last), len(self.symbols) - 1)
        p = np.where((self.symbols[at] == last)[:, None], self.single[at], np.exp(self.unknown))
        for order in range(2, ORDER + 1):
            grams_ = distinct & np.uint64((1 << 16 * order) - 1)
            p = self._of(("gram", order), grams_, 0.0) + self._of(("context", order), grams_ >> _16, 1.0) * p
        return np.log(p).astype(np.float32)[where]

    def _of(self, table: tuple[str, int], wanted: np.ndarray, missing: float) -> np.ndarray:
        """Values of each key, one column per language; ``missing`` where a language has none."""
        keys, back = np.unique(wanted, return_inverse=True)
        out = np.full((len(keys), len(self.languages)), missing)
        files = self.files[table]
        shard = np.mod(keys.view(np.int64), len(files))
        for n in np.unique(shard).tolist():
            if files[n] is None:
                continue
            array, starts, languages, values = _load_shard(files[n])
            own = np.flatnonzero(shard == n)
            at, found = array.find(keys[own])
            own, at = own[found], at[found]
            sizes = starts[at + 1] - starts[at]
            entry = np.arange(sizes.sum()) + np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes)
            out[np.repeat(own, sizes), languages[entry]] = values[entry]
        return out[back]


@worker_table(maxsize=SHARDS_HELD)
def _load_shard(uri: str) -> tuple[HashArray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash array of a shard's keys, where the entries of each key begin, and languages and values of the entries."""
    with open_file(uri) as file:
        data = np.load(io.BytesIO(file.read()))
        keys, language, value = data["keys"], data["language"], data["value"]
    distinct, first, sizes = np.unique(keys, return_index=True, return_counts=True)
    array = HashArray(distinct)
    first, sizes = first[array.order], sizes[array.order]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    entry = np.arange(len(keys)) + np.repeat(first - starts[:-1], sizes)
    return array, starts, language[entry], value[entry]


def _groups(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their weights (or their number)."""
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(where, weights, len(distinct)) if len(keys) else np.zeros(0)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 where a key is missing."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def build(languages: list[str], language: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Model:
    """Interpolated Kneser-Ney estimates from the counts of the longest n-grams.

    Shorter n-grams count the different symbols met before them. Each order takes off one absolute
    discount and gives it to the next shorter order; the shortest shares with a uniform distribution.
    """
    masks = [np.uint64((1 << 16 * n) - 1) for n in range(1, ORDER)] + [np.uint64(0xFFFFFFFFFFFFFFFF)]
    union = [np.unique(keys & mask) for mask in masks]
    contexts = [np.unique(u >> _16) for u in union[1:]]
    logs = [np.zeros((len(u), len(languages)), np.float32) for u in union]
    weights = [np.zeros((len(c), len(languages)), np.float32) for c in contexts]
    unknown = np.zeros(len(languages), np.float32)
    size = len(union[0]) + 1
    for n in range(len(languages)):
        own = language == n
        seen = [(None, None)] * ORDER
        seen[ORDER - 1] = _groups(keys[own], counts[own])
        for order in range(ORDER - 1, 0, -1):
            seen[order - 1] = _groups(seen[order][0] & masks[order - 1])
        shorter = None
        for order, (grams_, count) in enumerate(seen):
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = float(np.clip(ones / (ones + 2 * twos) if ones + twos else 0.5, 0.1, 0.95))
            if order == 0:
                total = max(count.sum(), 1)
                rest = (discount * len(count) if len(count) else 1) / total / size
                probability = np.maximum(_at(grams_, count, union[0]) - discount, 0) / total + rest
                unknown[n] = np.log(rest)
            else:
                ctx, totals = _groups(grams_ >> _16, count)
                _, kinds = _groups(grams_ >> _16)
                weight = discount * kinds / np.maximum(totals, 1)
                own_total = _at(ctx, totals, union[order] >> _16)
                own_weight = np.where(own_total > 0, _at(ctx, weight, union[order] >> _16), 1.0)
                lower = shorter[np.searchsorted(union[order - 1], union[order] & masks[order - 1])]
                probability = np.maximum(_at(grams_, count, union[order]) - discount, 0) / np.maximum(own_total, 1) + own_weight * lower
                all_weights = _at(ctx, weight, contexts[order - 1])
                weights[order - 1][:, n] = np.log(np.where(all_weights > 0, all_weights, 1.0))
            logs[order][:, n] = np.log(probability)
            shorter = probability
    tables, backoff = ([], [])
    for out, all_keys, all_values in ((tables, union, logs), (backoff, contexts, weights)):
        for k, v in zip(all_keys, all_values, strict=True):
            array = HashArray(k)
            out.append((array, np.ascontiguousarray(v[array.order])))
    return Model(languages, tables, backoff, unknown)


def build_files(languages: list[str], counts: DataFrame) -> FileModel:
    """The estimates of ``build`` from (lang, gram, n), calculated in tasks and written to the shared folder.

    The driver sees counts per language and order, and those of single symbols, which the alphabet bounds.
    """
    spark = counts.sparkSession
    number = spark.createDataFrame(list(enumerate(languages)), "language int, lang string")
    level = materialise(counts.join(F.broadcast(number), "lang").select("language", "gram", "n"), "grams")
    entries = []
    for order in range(ORDER, 1, -1):
        discount = F.broadcast(spark.createDataFrame(_discounts(level), "language int, discount double"))
        seen = level.withColumn("context", F.shiftrightunsigned("gram", 16))
        context = seen.groupBy("language", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        context = materialise(context.join(discount, "language"), "contexts")
        own = seen.join(context, ["language", "context"]).select("language", F.col("gram").alias("key"), ((F.col("n") - F.col("discount")) / F.col("total")).alias("value"))
        weight = context.select("language", F.col("context").alias("key"), (F.col("discount") * F.col("kinds") / F.col("total")).alias("value"))
        entries += [(("gram", order), own), (("context", order), weight)]
        shorter = level.withColumn("gram", F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)))
        level = materialise(shorter.groupBy("language", "gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    files = {table: _write_shards(rows) for table, rows in entries}
    discounts, rows = dict(_discounts(level)), level.toArrow()
    language, gram, n = rows["language"].to_numpy(), rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(float)
    symbols = np.unique(gram)
    single, unknown = np.zeros((len(symbols), len(languages))), np.zeros(len(languages))
    for k in range(len(languages)):
        own, d = language == k, discounts.get(k, 0.5)
        total = max(n[own].sum(), 1)
        rest = (d * own.sum() if own.any() else 1) / total / (len(symbols) + 1)
        single[:, k] = rest
        single[np.searchsorted(symbols, gram[own]), k] += (n[own] - d) / total
        unknown[k] = np.log(rest)
    return FileModel(languages, [], [], unknown, files=files, symbols=symbols, single=single)


def _discounts(level: DataFrame) -> list[tuple[int, float]]:
    """The absolute discount of each language, from how many n-grams were counted once and twice."""
    ones, twos = (F.sum((F.col("n") == k).cast("long")) for k in (1, 2))
    rows = level.groupBy("language").agg(ones.alias("ones"), twos.alias("twos")).collect()
    return [(r.language, float(np.clip(r.ones / (r.ones + 2 * r.twos) if r.ones + r.twos else 0.5, 0.1, 0.95))) for r in rows]


def _write_shards(entries: DataFrame) -> list[str | None]:
    """Write (language, key, value) by ranges of the key's remainder; returns the file of each remainder.

    All entries of a key are in one file. The number of files grows with the entries.
    """
    entries = materialise(entries, "entries")
    shards = 2 * (entries.count() // SHARD_ENTRIES) + 1  # odd, so that every symbol of a key counts
    folder = work_dir(entries.sparkSession, "language-model")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def write() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            file, uri = create_file(folder, ".npz")
            with file:
                buffer = io.BytesIO()
                np.savez(buffer, keys=rows["key"].to_numpy().view(np.uint64), language=rows["language"].to_numpy(), value=rows["value"].to_numpy())
                file.write(buffer.getvalue())
            return pa.record_batch({"shard": [rows["shard"][0].as_py()], "uri": [uri]}, pa.schema([("shard", pa.int64()), ("uri", pa.string())]))

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            ends = [*(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), batch.num_rows]
            start = 0
            for end in ends if batch.num_rows else []:
                if held and held[0].column("shard")[0].as_py() != shard[start]:
                    yield write()
                    held = []
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield write()

    dealt = entries.withColumn("shard", F.pmod("key", F.lit(shards).cast("long"))).repartition("shard").sortWithinPartitions("shard", "key")
    found = {r.shard: r.uri for r in dealt.mapInArrow(run, "shard long, uri string").collect()}
    return [found.get(n) for n in range(shards)]


def _slice(model: Model | None) -> int:
    """Bytes of text scored at once: a table has a column per language, so fewer with many languages."""
    return SLICE * 4 // max(4, len(model.languages)) if model else SLICE


def entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol of each text in each language, and its number of symbols."""
    keys, owner = grams(texts)
    n = np.bincount(owner, minlength=len(texts))
    sums = np.zeros((len(texts), len(model.languages)))
    if len(keys):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sums[owner[starts]] = np.add.reduceat(model.log_probabilities(keys), starts, axis=0, dtype=np.float64)
    return -sums / np.maximum(n, 1)[:, None], n


def _gram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over all learning texts."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged() -> int:
            for lang, parts in held.items():
                distinct, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                held[lang] = [(distinct, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64))]
            return sum(len(k) for ((k, _),) in held.values())

        def listed() -> Iterator[pa.RecordBatch]:
            for lang, ((keys, n),) in held.items():
                yield record_batch(schema, lang=[lang] * len(keys), gram=keys.view(np.int64), n=n)
            held.clear()

        for rows in text_slices(batches, SLICE):
            names = rows.column("lang").to_pylist()
            langs = {lang: n for n, lang in enumerate(dict.fromkeys(names))}
            keys, owner = grams(texts_of(rows))
            of_key = np.array([langs[x] for x in names], np.int16)[owner]
            for lang, n in langs.items():
                held.setdefault(lang, []).append(np.unique(keys[of_key == n], return_counts=True))
                size += len(held[lang][-1][0])
            if size > 2 * TASK_GRAMS and (size := merged()) > TASK_GRAMS:
                yield from listed()
                size = 0
        merged()
        yield from listed()

    return train.select("lang", "text").mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Models of all languages among the rows that are not held out; None if there is no such row.

    N-grams are counted over all of these rows and all are kept: in memory up to ``MAX_CELLS``, in files
    of the shared folder beyond, with the same probabilities. Rejection and score are calibrated on
    all of these rows.
    """
    train = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    )
    counts = materialise(_gram_counts(train), "gram-counts")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    if counts.count() * len(languages) <= MAX_CELLS:
        kept = counts.toArrow()
        language = np.searchsorted(np.array(languages), np.array(kept["lang"].to_pylist()))
        model = build(languages, language, kept["gram"].to_numpy().view(np.uint64), kept["n"].to_numpy().astype(np.float64))
    else:
        model = build_files(languages, counts)

    calibrate(model, train)
    return model


def calibrate(model: Model, train: DataFrame) -> None:
    """Set what a usual text of each language costs, and how sharply costs tell languages apart.

    Both come from all rows (lang, text); tasks add them up, and a few numbers per language reach the driver.
    """
    sums = ["rows", "cost", "square", "symbols", "symbols_cost", "symbols_square", *(f"fit{n}" for n in range(len(SHARPNESS)))]
    schema = pa.schema([("lang", pa.string()), *((name, pa.float64()) for name in sums)])
    languages = np.array(model.languages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), len(sums)))
        for rows in text_slices(batches, _slice(model)):
            h, n = entropies(model, texts_of(rows))
            some = n > 0
            h, n = h[some], n[some].astype(float)
            truth = np.searchsorted(languages, np.array(rows.column("lang").to_pylist(), str)[some])
            at = np.arange(len(h))
            cost = h[at, truth]
            # Costs above the best, so that no exponential overflows.
            beyond = h - h.min(axis=1, keepdims=True)
            fits = [np.log(np.exp(-x * beyond[at, truth]) / np.exp(-x * beyond).sum(axis=1) + 1e-12) for x in SHARPNESS]
            np.add.at(totals, truth, np.stack([np.ones(len(h)), cost, cost**2, n, n * cost, n * cost**2, *fits], axis=1))
        yield record_batch(schema, lang=model.languages, **dict(zip(sums, totals.T, strict=True)))

    counted = train.select("lang", "text").mapInArrow(lean(run, _load_shard), ", ".join(["lang string", *(f"{name} double" for name in sums)]))
    got = {r.lang: list(r)[1:] for r in counted.groupBy("lang").agg(*[F.sum(name) for name in sums]).collect()}
    totals = np.array([got.get(lang, [0.0] * len(sums)) for lang in model.languages])
    pooled = totals.sum(axis=0)
    model.mean, model.spread, model.spread_per_symbol = (np.zeros(len(languages)) for _ in range(3))
    for k, own in enumerate(totals):
        rows, cost, square, symbols, symbols_cost, symbols_square = (own if own[0] >= LEAST_ROWS else pooled)[:6]
        if not rows:
            # No text has a letter: nothing is rejected for its cost.
            model.mean[k] = np.inf
            continue
        mean = model.mean[k] = symbols_cost / symbols
        model.spread[k] = np.sqrt(max(square / rows - (cost / rows) ** 2, 0.0))
        model.spread_per_symbol[k] = max(LEAST_SPREAD, np.sqrt(max((symbols_square - 2 * mean * symbols_cost + mean**2 * symbols) / rows, 0.0)))
    if pooled[0]:
        fits = dict(zip(SHARPNESS, pooled[6:] / pooled[0], strict=True))
        model.sharpness = max(fits, key=lambda s: (round(fits[s], 6), -s))


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])


def _decide(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cost and rejection of each text."""
    if model is None:
        nothing = np.zeros(len(texts))
        return [UNDETERMINED] * len(texts), nothing, nothing, np.ones(len(texts), bool)
    h, n = entropies(model, texts)
    best = h.argmin(axis=1)
    cost = h[np.arange(len(texts)), best]
    likelihood = np.exp(-model.sharpness * (h - cost[:, None]))
    limit = model.mean + REJECT_Z * np.hypot(model.spread, model.spread_per_symbol / np.sqrt(np.maximum(n, 1))[:, None])
    rejected = (n == 0) | (cost > limit[np.arange(len(texts)), best])
    names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)]
    return names, np.where(n > 0, 1 / likelihood.sum(axis=1), 0.0), np.where(n > 0, cost, 0.0), rejected


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected of every whole text.

    The language of the lowest cross-entropy per symbol wins; equal costs go to the first name. A
    null text or one without letters is "und" and rejected. Others are rejected if they cost far more
    than the learning texts of that language do, for their length. ``score`` is the calibrated
    probability of the language. Without any language to learn from, all is "und".
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, _slice(model)):
            lang, score, cost, rejected = _decide(model, texts_of(rows))
            yield record_batch(_PREDICTED, doc_id=rows.column("doc_id"), lang_pred=lang, score=score, cross_entropy=cost, rejected=rejected)

    return id_and_text(docs, id_col, text_col).mapInArrow(lean(run, _load_shard), "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in text_slices(batches, _slice(model), text_col):
            yield rows.filter(pa.array(~_decide(model, texts_of(rows, text_col))[3]))

    return docs.mapInArrow(lean(run, _load_shard), docs.schema)
