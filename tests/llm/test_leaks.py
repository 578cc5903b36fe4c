"""Paraphrased benchmark items, and the latent space against a whole decomposition."""

from __future__ import annotations

import random

import numpy as np

from cairnfield.llm import common, decontaminate
from tests.conftest import SF_SMALL


def replaced(words: list[bytes], share: float, rng: random.Random, others: list[bytes]) -> list[bytes]:
    places = set(rng.sample(range(len(words)), round(share * len(words))))
    return [rng.choice(others) if k in places else w for k, w in enumerate(words)]


def test_three_words_in_ten_replaced(spark):
    rng = random.Random(11)
    bodies = [decontaminate.words_of((r.text or "").encode()) for r in common.table(spark, SF_SMALL, "documents").collect()]
    bodies = [b[:1500] for b in bodies if len(b) > 20]
    others = [w for b in bodies for w in b]
    benchmark = common.table(spark, SF_SMALL, "benchmark")
    items = {r.item_id: decontaminate.words_of(r.text.encode()) for r in benchmark.collect()}
    rows, truth = [], {}
    for n, (k, words) in enumerate(sorted(items.items())):
        body = rng.choice(bodies)
        at = rng.randrange(len(body) + 1)
        rows.append((n, b" ".join(body[:at] + replaced(words, 0.3, rng, others) + body[at:]).decode()))
        truth[n] = k
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    assert sum((n, k) in got for n, k in truth.items()) >= 0.95 * len(truth)
    clean = [(n, " ".join(rng.choices([w.decode() for w in others], k=400))) for n in range(200)]
    assert decontaminate.find_leaks(spark.createDataFrame(clean, "doc_id long, text string"), benchmark).count() == 0


def test_latent_space_is_that_of_a_whole_decomposition(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "RANK", 6)
    rng = random.Random(2)
    topics = [[f"t{t}w{k}" for k in range(30)] for t in range(6)]
    texts = [" ".join(rng.choices(topics[k % 6], k=128 * rng.randint(1, 3))) for k in range(120)]
    items = [decontaminate.Item(t, [w.encode() for w in rng.sample(topics[t], 20)], []) for t in range(6)]
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "body binary")
    index = decontaminate.build_index(docs, items, decontaminate.Settings(max_share=1.0))
    vocabulary, rows = index.vocabulary, []
    for text in texts:
        words = decontaminate.words_of(text.encode())
        for at in range(0, len(words), 128):
            row = np.zeros(len(vocabulary))
            for w in words[at : at + 128]:
                if w in vocabulary:
                    row[vocabulary[w]] += 1
            rows.append(row)
    held = np.array(rows)
    tf = np.zeros((6, len(vocabulary)))
    for k, item in enumerate(items):
        for w in item.words:
            tf[k, vocabulary[w]] += 1
    idf = np.maximum(np.log((1 + len(held) + 6) / (1 + (held > 0).sum(0) + (tf > 0).sum(0))), 1e-3)
    a, b = held * idf, tf * idf
    whole = a.T @ a / (a**2).sum() + b.T @ b / (b**2).sum()
    best = np.linalg.eigh(whole)[1][:, ::-1][:, :6]
    got = index.projection / np.where(idf > 0, idf, 1)[:, None]
    assert got.shape[1] == 6
    assert np.linalg.norm(got @ got.T @ best - best) < 0.05 * np.linalg.norm(best)


def test_common_subsequence_of_few_words_is_passed_over():
    item, text = [b"a", b"b", b"c", b"d"], [b"x", b"a", b"y", b"c"]
    assert decontaminate.lcs_length(item, text) == 2 and decontaminate.lcs_length(item, text, least=3) == 0
