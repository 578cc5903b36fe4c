"""The classifiers' predictions against plain loops."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import numpy as np
import pytest

from cairnfield.llm import langid, toxicity
from tests.llm import fixtures


def brute_vector(text: str, idf: np.ndarray) -> dict[int, float]:
    """TF-IDF of a text, a byte at a time."""
    raw = text.encode().translate(langid._FOLD)
    folded = [0x20 + 1, *(b + 1 for b in b" ".join((b" " + raw + b" ").split())), 0x20 + 1]
    odd, mask, counts = [int(x) for x in langid._ODD], (1 << 32) - 1, Counter()
    for k in range(len(folded)):
        grams = [folded[k] * odd[0]]
        if k + 1 < len(folded):
            grams.append(folded[k] * odd[1] & mask ^ folded[k + 1] * odd[0] & mask)
        if k + 2 < len(folded):
            grams.append((folded[k] * odd[2] & mask ^ folded[k + 1] * odd[1] & mask) + folded[k + 2] * odd[0])
        for gram in grams:
            counts[(gram & mask) * 2246822507 % (1 << 32) >> 32 - langid.BITS] += 1
    out = {k: math.log1p(n) * float(idf[k]) for k, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in out.values())) or 1
    return {k: v / norm for k, v in out.items()}


def test_nearest_centroid_by_plain_loops(spark):
    docs = fixtures.awkward(spark)
    model = langid.fit(docs, clusters=3)
    assert set(model.languages) == {"en", "de"} and sorted(model.owner.tolist()) == model.owner.tolist()
    texts = {r.text for r in docs.select("text").collect() if r.text and len(r.text) < 5000}
    for text in texts:
        (lang,), (score,), (cosine,), (_,) = model.predict([text.encode()])
        if not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        v = brute_vector(text, model.idf)
        cosines = [sum(float(c[k]) * x for k, x in v.items()) for c in model.centroids]
        best = [max(c for c, o in zip(cosines, model.owner, strict=True) if o == k) for k in range(2)]
        assert cosine == pytest.approx(max(best), abs=1e-4)
        assert lang == model.languages[int(np.argmax(best))] or abs(best[0] - best[1]) < 1e-4


@pytest.mark.parametrize(("text", "letter"), [("½ ² Ⅷ", False), ("①②", False), ("12 _ .", False), ("", False), ("½ a", True), ("成", True), ("ª", True)])
def test_letters(text, letter):
    assert langid.has_letter(text) is letter is any(c.isalpha() for c in text)


def test_all_languages_are_learned(spark):
    rows = [(300 * k + j, f"lang{k:03d} " + " ".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=30)) * 3, f"l{k:03d}") for k in range(230) for j in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), clusters=1)
    assert len(model.languages) == 230


def brute_hits(folded: str, model: toxicity.ToxicityModel) -> set[tuple[int, int, float]]:
    excepted = [(i, i + len(p) + 2) for p in model.exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
    best: dict[int, tuple[float, int, int]] = {}
    for i in range(len(folded)):
        for entry, weight in model.weights.items():
            if folded.startswith(f" {entry}", i) and not any(b <= i and i + len(entry) + 1 <= e for b, e in excepted):
                best[i] = max(best.get(i, (0.0, 0, 0)), (weight, -len(entry), i + len(entry) + 1))
    return {(i, end, weight) for i, (weight, _, end) in best.items()}


def test_hits_by_plain_search():
    rng = random.Random(3)
    model = toxicity.ToxicityModel({"bad": 2.0, "badge": 1.0, "worse": 1.5, "wor": 1.5}, ("not bad", "bad luck", "worse for wear"), ())
    automaton = model.automaton()
    for _ in range(300):
        text = " ".join(rng.choices(["bad", "badge", "b4d", "ВАD", "not", "luck", "worse", "for", "wear", "fine", "worst", "abad", "no-bad"], k=rng.randint(0, 15)))
        folded = toxicity.fold(text)
        assert {(b, e, w) for b, e, w, _ in toxicity.hits(folded, automaton)} == brute_hits(folded, model)


def test_exceptions_take_linear_time():
    model = toxicity.ToxicityModel({"bad": 2.0}, ("not bad",), ())
    automaton = model.automaton()

    def took(n: int) -> float:
        began = time.perf_counter()
        assert len(toxicity.hits(" not bad bad" * n + " ", automaton)) == n
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 60 * max(took(4000), 0.005)


def test_every_telling_word_is_an_entry(spark):
    rows, labels = [], []
    for k in range(240):
        toxic = k % 2
        words = [f"nasty{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(k // 2 % 12 * 20, k // 2 % 12 * 20 + 20)] if toxic else ["plain", "words"]
        rows.append((k, " ".join(["some", "text", *words])))
        labels.append((k, toxic))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), min_docs=5)
    automaton = model.automaton()
    assert all(toxicity.features(text, automaton)[2] == bool(k % 2) for k, text in rows)


def test_one_id_with_most_rows(spark, tmp_path):
    from cairnfield.llm import sharding

    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id", "if(id % 2 = 0, 'same', concat('t', id)) as text")
    path = str(tmp_path / "map")
    got = sharding.shard_documents(df, map_path=path).collect()
    by_shard: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        by_shard.setdefault(r.shard, []).append(r)
    for rows in by_shard.values():
        assert [r.slot for r in rows] == list(range(len(rows)))
        keys = [(r.virtual_slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r["size"]) for r in rows]
        assert keys == sorted(keys)
    first, grown = sharding.SlotMap.load(spark, path, 1), sharding.SlotMap.load(spark, path)
    assert (first.version, grown.version, grown.owners) == (1, 2, first.grown().owners)
    edited = sharding.rebalance(spark, path, sharding.sized(df))
    assert edited.version == 3 and sharding.SlotMap.load(spark, path).owners == edited.owners
    with pytest.raises(Exception, match="already exists"):
        first.save(spark, path)
