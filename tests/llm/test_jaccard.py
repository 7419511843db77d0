"""The near-duplicate stage against brute force at a Jaccard similarity of 0.8."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from siltwork.llm import jaccard, rows, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    size = min(5, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()


def kept_by_brute_force(rows):
    sets, top = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return sorted({min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) for i in range(len(rows))})


def near_copies():
    """Texts of 200 words with up to five edited places: similarities from 0.78 to 0.95; one group chains 40 of them."""
    R = random.Random(3)
    word = lambda: f"w{R.randrange(30000)}"
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  TWO"), (5, "one three")]
    for n in range(60):
        base = [word() for _ in range(200)]
        rows.append((100 + 2 * n, " ".join(base)))
        copy = list(base)
        for k in range(1 + n % 5):
            copy[10 + 37 * k] = word()
        rows.append((101 + 2 * n, " ".join(copy)))
    base = [word() for _ in range(200)]
    for n in range(40):
        base[R.randrange(200)] = word()
        rows.append((1000 + n, " ".join(base)))
    return rows


def test_stage_equals_brute_force(spark):
    data = near_copies()
    pairs = [(shingles(a), shingles(b)) for (_, a), (_, b) in zip(data[5:125:2], data[6:125:2])]
    likeness = [len(a & b) / len(a | b) for a, b in pairs]
    assert sum(0.8 <= j < 0.85 for j in likeness) >= 10 and sum(j < 0.8 for j in likeness) >= 10
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force(data)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_documents_equal_brute_force(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    data = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(r.doc_id for r in jaccard.keep_first(docs).collect()) == kept_by_brute_force(data)


def test_linked_sets_equal_brute_force():
    R = random.Random(5)
    sets, roots = [np.zeros(0, np.int64)] * 2, [0, 1]
    for g in range(6):
        base = R.sample(range(10**6), 60)
        for _ in range(15):
            sets.append(np.array(sorted({x if R.random() < 0.9 else R.randrange(10**6) for x in base}), np.int64))
            roots.append(len(roots))
    roots[5] = roots[3]
    entries = list(range(len(sets)))
    shards = [jaccard.Shard(*(x[part] for x in (entries, roots, sets))) for part in (slice(0, 40), slice(40, None))]
    found, top = [x for k in entries for shard in shards for x in shard.links(k, roots[k], sets[k])], {r: r for r in roots}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    same = lambda a, b: 9 * len(set(a.tolist()) & set(b.tolist())) >= 4 * (len(a) + len(b))
    assert all(same(sets[a], sets[b]) for a, b in found)
    for a, b in found:
        top[max(root(roots[a]), root(roots[b]))] = min(root(roots[a]), root(roots[b]))
    for a in range(len(sets)):
        for b in range(a):
            assert not same(sets[a], sets[b]) or root(roots[a]) == root(roots[b])


def test_small_shards_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUDGET", 700)
    test_stage_equals_brute_force(spark)


def test_one_id_with_several_texts(spark):
    """Ids repeat: decisions are by group and text, not by id."""
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    data = [(3, a, 1), (5, a.upper(), 2), (5, b, 3), (None, "other text here", 4), (7, b, 5), (7, b, 5), (None, "another", 6), (5, "third of five", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n long")
    for keep in (jaccard.keep_first, simhash.keep_first):
        assert sorted(r.n for r in keep(docs).collect()) == [1, 3, 4, 6, 7]


def test_a_hot_repeated_row(spark):
    hot = spark.range(30_000).selectExpr("7L AS doc_id", "'the same words in every row here' AS text", "id AS extra")
    rest = spark.range(50).selectExpr("id + 100 AS doc_id", "repeat(concat('w', id, ' x', id * 3, ' '), 9) AS text", "id AS extra")
    kept = jaccard.keep_first(hot.unionByName(rest)).collect()
    assert len(kept) == 51 and sum(r.doc_id == 7 for r in kept) == 1


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    """Past its bound the bitmap holds rows that no key has; the exact join decides."""
    monkeypatch.setattr(rows.Sieve.__init__, "__defaults__", (6,))
    docs = spark.createDataFrame([(k % 150, f"text {k}") for k in range(300)], "doc_id long, text string")
    found = docs.selectExpr("doc_id AS id", "xxhash64(text) AS salt", "doc_id % 60 AS root")
    kept = rows.keep_firsts(docs, found).collect()
    assert sorted(r.doc_id for r in kept) == list(range(60))
    chosen = docs.where("doc_id < 20").selectExpr("doc_id AS id", "xxhash64(text) AS salt", "text AS own")
    got = rows.rows_of(docs, chosen, also=("own",)).collect()
    assert len(got) == 40 and all(r.text == r.own for r in got)
