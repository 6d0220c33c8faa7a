"""What a Python worker keeps from one operator's tasks to the next one's, and what a shard holds."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from gradeframe.llm import decontaminate
from gradeframe.llm.bpe import byte_bpe
from gradeframe.llm.fingerprints import word_hashes
from gradeframe.llm.shared import lean


def test_a_task_drops_tables_of_other_operators():
    byte_bpe(public_tokenizers.path("byte_bpe_50k.json")).encode("some words")
    own = word_hashes()
    own["word"]
    batch = pa.record_batch({"text": ["a"]})
    assert list(lean(lambda batches: batches, word_hashes)([batch])) == [batch]
    assert byte_bpe.cache_info().currsize == 0
    assert word_hashes() is own and "word" in own
    list(lean(lambda batches: batches)([batch]))
    assert word_hashes() is not own


def test_pipeline_tasks_keep_their_own_tables(spark):
    def held(batches):
        for batch in batches:
            word_hashes()
            yield pa.record_batch({"n": pa.array([byte_bpe.cache_info().currsize, word_hashes.cache_info().currsize], pa.int64())})

    def encoding(batches):
        bpe = byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))
        for batch in batches:
            yield pa.record_batch({"n": pa.array([len(bpe.encode("some words"))], pa.int64())})

    one = spark.range(1).repartition(1)
    assert one.mapInArrow(lean(encoding, byte_bpe), "n long").first().n > 0
    assert [r.n for r in one.mapInArrow(lean(held, word_hashes), "n long").collect()] == [0, 1]


def test_a_shard_holds_numbers_instead_of_words():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 500, 1000)) for _ in range(200)]
    size = sum(map(len, texts))
    tracemalloc.start()
    found = decontaminate.search(texts, [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.n_words == [1000] * 200 and found.spans == [[]] * 200 and found.items == [[]] * 200
    assert peak < 5 * size
