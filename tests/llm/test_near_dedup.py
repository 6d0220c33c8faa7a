"""Groups against a comparison of all pairs, and the estimates of the samples."""

import hashlib
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from gradeframe.llm import near_dedup as nd
from gradeframe.llm.queries import op6_near_dedup


def brute_groups(docs, weights, floor=nd.SIMILARITY):
    """Groups of ids by all pairs of distinct texts, through a table of shared shingles."""
    by_text = defaultdict(list)
    for doc_id, text in docs:
        if text is not None:
            by_text[text].append(doc_id)
    texts = list(by_text)
    vectors = [(h, weights.of(h, n)) for h, n in nd._distinct(texts)]
    postings = defaultdict(list)
    for n, (hashes, _) in enumerate(vectors):
        for h in hashes.tolist():
            postings[h].append(n)
    shared = Counter(p for where in postings.values() for p in itertools.combinations(where, 2))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n >= 0.5 * min(len(vectors[a][0]), len(vectors[b][0])) and nd.similarity(vectors[a], vectors[b]) >= floor:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for n, text in enumerate(texts):
        groups[root(n)] += by_text[text]
    return {d: min(g) for g in groups.values() for d in g}


def test_op6_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert nd.groups(table.limit(0)).collect() == []
    docs = [(r.doc_id, r.text) for r in table.collect()]
    rows = op6_near_dedup(spark, sf).collect()
    expected = brute_groups(docs, nd.learn_weights(table))
    assert {r.doc_id: r.group_id for r in rows} == expected
    assert {r.doc_id for r in rows if r.kept} == set(expected.values())
    assert len(set(expected.values())) < len(docs)


def changed(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_hot_group_and_edges(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(vocabulary, 300))
    passage = " ".join(rng.choice(vocabulary, 60))
    rows = [(i, changed(rng, base, 5), "x", 1) for i in range(120)]  # copies like the base, and each other about 0.8
    rows += [(200 + i, " ".join(base), "x", 1) for i in range(30)]
    rows += [(300 + i, passage + " " + " ".join(rng.choice(vocabulary, 90)), "x", 1) for i in range(60)]
    rows += [(400, None, "x", 1), (401, None, "x", 1), (402, "", "x", 1), (403, "", "x", 1), (404, "two words", "x", 1), (405, "Two  words", "x", 1)]
    rows += [(406, "long " * 30_000, "x", 1), (200, " ".join(base), "x", 1), (300, "another text with the id of another one", "x", 1), (None, "no id at all in here", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v string, label int")
    found = nd.groups(docs).collect()
    assert len(found) == len(rows)
    group = {(r.doc_id, r.digest and bytes(r.digest)): r.group_id for r in found}
    by_id = defaultdict(set)
    for (doc_id, _), g in group.items():
        by_id[doc_id].add(g)
    weights = nd.learn_weights(docs)
    expected = brute_groups([r[:2] for r in rows if r[0] not in (None, 300)], weights)
    assert all(by_id[i] == {expected[i]} for i in by_id if i in expected)
    assert all(by_id[i] == {0} for i in list(range(120)) + list(range(200, 230)))
    assert by_id[400] == {400} and by_id[401] == {401} and by_id[403] == {402} and by_id[405] == {404}
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == sorted([*{g for k, g in group.items() if k[0] not in (None, 300)}, 300, 300, None], key=lambda x: (x is None, x))
    assert nd.deduplicated(docs.limit(0)).collect() == []


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        words = list(rng.choice([f"w{i}" for i in range(5000)], 400))
        a, b = " ".join(words), changed(rng, words, int(rng.integers(1, 30)))
        idf = nd.Weights(rng.uniform(1, 2, 1 << nd.DF_BITS).astype(np.float32))
        x, y = (np.frombuffer(s, "<u4") for s in nd.signatures([a, b], idf))
        (ha, na), (hb, nb) = nd._distinct([a, b])
        errors.append((x == y).mean() - nd.similarity((ha, idf.of(ha, na)), (hb, idf.of(hb, nb))))
    assert abs(np.mean(errors)) < 0.03


def test_filter_loses_under_one_link_in_ten_thousand():
    lost = sum(math.comb(nd.SAMPLES, n) * nd.SIMILARITY**n * (1 - nd.SIMILARITY) ** (nd.SAMPLES - n) for n in range(nd.LEAST_AGREEING))
    assert lost < 1e-4


def test_components_of_chains(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("900", "901"), ("902", "901"), ("a", "b")]
    labels = {r.v: r.label for r in nd.components(spark.createDataFrame(edges, "v string, u string")).collect()}
    assert all(labels[f"{i:03d}"] == "000" for i in range(41))
    assert labels["902"] == "900" and labels["b"] == "a"


def test_family_without_its_base(spark):
    # Copies of an absent text, most pairs of them below 0.8; half of them have one partner of 0.8 or more.
    rng = np.random.default_rng(3)
    base = list(rng.choice([f"w{i}" for i in range(5000)], 300))
    texts = [changed(rng, base, 5) for _ in range(240)]
    texts += [changed(rng, text.split(), 5) for text in texts[:120]]
    docs = list(enumerate(texts))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    weights = nd.learn_weights(table)
    vectors = [(h, weights.of(h, n)) for h, n in nd._distinct(texts)]
    assert 0.6 < np.median([nd.similarity(a, b) for a, b in itertools.combinations(vectors, 2)]) < nd.SIMILARITY
    expected = brute_groups(docs, weights)
    assert 120 < len(set(expected.values())) < 300
    found = {r.doc_id: r.group_id for r in nd.groups(table).collect()}
    assert {i: (found[i], expected[i]) for i in found if found[i] != expected[i]} == {}


def test_cross_pairs_are_all_pairs_of_open_buckets(spark, monkeypatch):
    # Blocks of 16 texts: each pair comes out once, however its texts are dealt.
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 16)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, nd.SAMPLES, dtype=np.uint32)
    drawn = np.where(rng.random((120, nd.SAMPLES)) < 0.8, base, rng.integers(0, 1 << 32, (120, nd.SAMPLES), dtype=np.uint32)).astype("<u4")
    names = [bytes([n]) * 16 for n in range(120)]
    rows = [(v, n, 1, bytearray(s.tobytes())) for n, (v, s) in enumerate(zip(names, drawn, strict=True))]
    texts = spark.createDataFrame(rows, "v binary, first long, copies long, signature binary")
    labels = spark.createDataFrame([(v, names[0]) for v in names[:20]], "v binary, label binary")
    bands, needed = nd._shared(texts)
    found = [(bytes(r.v), bytes(r.u), r.agreeing) for r in nd._cross_pairs(bands, needed, labels, 21, 32).collect()]
    expected = set()
    for a, b in itertools.combinations(range(120), 2):
        same = drawn[a] == drawn[b]
        if b >= 20 and 21 <= same.sum() < 32 and same.reshape(nd.BANDS, nd.ROWS).all(axis=1).any():
            expected.add((names[a], names[b], int(same.sum())))
    assert len(found) == len(set(found)) and set(found) == expected and expected


def test_cross_links_stay_few_and_join_what_all_pairs_join(spark, monkeypatch):
    # A family whose pairs are around 0.8: thousands of pairs agree, and no pair but a link leaves its task.
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 32)
    monkeypatch.setattr(nd, "KNOWN_SHINGLES", 3000)
    rng = np.random.default_rng(8)
    base = list(rng.choice([f"w{i}" for i in range(5000)], 300))
    docs = list(enumerate(changed(rng, base, 4) for _ in range(150)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    weights = nd.learn_weights(table)
    by_name = {hashlib.md5(t.encode()).digest(): t for _, t in docs}
    rows = [(v, n, 1, s, nd._packed(t)) for n, ((v, t), s) in enumerate(zip(by_name.items(), nd.signatures(list(by_name.values()), weights), strict=True))]
    texts = spark.createDataFrame(rows, "v binary, first long, copies long, signature binary, packed binary")
    labels = spark.createDataFrame([], "v binary, label binary")
    bands, needed = nd._shared(texts.drop("packed"))
    found = [(bytes(r.v), bytes(r.u)) for r in nd._cross_links(bands, needed, labels, texts.select("v", "packed"), weights).collect()]
    pairs = [(bytes(r.v), bytes(r.u)) for r in nd._cross_pairs(bands, needed, labels, nd.LEAST_AGREEING, nd.SAMPLES + 1).collect()]
    vectors = {v: (h, weights.of(h, n)) for v, (h, n) in zip(by_name, nd._distinct(list(by_name.values())), strict=True)}
    linked = [(v, u) for v, u in pairs if nd.similarity(vectors[v], vectors[u]) >= nd.SIMILARITY]

    def joined(edges):
        of = {v: v for v in by_name}
        for v, u in edges:
            a, b = of[v], of[u]
            of = {k: min(a, b) if x in (a, b) else x for k, x in of.items()}
        return of

    assert joined(found) == joined(linked) and set(found) <= set(linked)
    assert len(pairs) > 4000 and len(found) < len(pairs) / 3


def test_packed_texts_come_back():
    texts = ["", "a", "ünïcode \U0001f600 " * 1000, "x" * 3_000_000, "b"]
    assert [nd._unpacked(nd._packed(t)) for t in texts] == texts
    batch = pa.RecordBatch.from_pydict({"packed": [nd._packed(t) for t in texts]})
    slices = [s.num_rows for s in nd._packed_slices([batch, batch.slice(0, 0)])]
    assert slices == [3, 1, 1]
