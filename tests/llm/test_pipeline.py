"""Every stage against a plain check of its own input and output."""

import public_tokenizers
from test_decontaminate import plain as plain_contamination
from test_near_dedup import brute_groups
from test_packing import check as check_packing
from test_secret_scan import plain as plain_secrets
from tokenizers import Tokenizer

import corpus_pipeline
from gradeframe.llm import langid, near_dedup


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages(spark, sf, tmp_path):
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(900_001, None, "en", "s", 0), (900_002, "", None, None, None), (900_003, "12 34 ?!", "en", "s", 3), (900_004, "The " + 'token = "abcdef0123456789abcdef0123"', "en", "s", 40)]
    docs, before = raw.unionByName(spark.createDataFrame(extra, raw.schema)), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        before = rows(docs)
        if name != "packing":
            assert after.columns == docs.columns
            got = rows(after)
            assert len(got) == after.count()
        if name == "language":
            judged = rows(langid.predict(docs, langid.learn(docs)))
            assert set(got) == {k for k, r in judged.items() if not r.rejected} and not {900_001, 900_002, 900_003} & set(got)
            assert 900_004 in got and len(got) >= 0.99 * raw.count()
        elif name == "near_copies":
            groups = brute_groups([(k, r.text) for k, r in before.items()], near_dedup.learn_weights(docs))
            assert set(got) == set(groups.values()) and all(got[k] == before[k] for k in got)
        elif name == "benchmark":
            hit = plain_contamination([(k, r.text) for k, r in before.items()], benchmark)
            assert set(got) == set(before) and any(x[4] for x in hit.values())
            assert all((got[k] == before[k]) != hit[k][4] for k in got)
            assert not any(x[4] for x in plain_contamination([(k, r.text) for k, r in got.items()], benchmark).values())
        elif name == "secrets":
            assert set(got) == set(before)
            assert all((got[k] == before[k]) == (plain_secrets(r.text)[4] == "") for k, r in before.items())
            assert all(plain_secrets(r.text)[4] == "" and r.n_chars == len(r.text) for r in got.values())
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
            check_packing(after.collect(), [(k, r.text) for k, r in before.items()], tokenizer, 2048)
        docs = after


def test_run_on_nothing(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
