"""The near-duplicate stage against all pairs, and its blocks of masks."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest

from cairnfield.llm import common, simhash
from tests.llm import fixtures


def clusters(seed: int, groups: int, copies: int, edits: int) -> list[str]:
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        words = [f"g{g}w{rng.randint(0, 60)}" for _ in range(120)]
        for _ in range(copies):
            own = list(words)
            for at in rng.sample(range(120), rng.randint(0, edits)):
                own[at] = f"new{rng.randint(0, 10**6)}"
            out.append(" ".join(own))
    return out + [fixtures.prose(1000 + k, 40 + k) for k in range(60)]


def brute_roots(texts: list[str]) -> list[int]:
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if (sets[i] or sets[j]) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("nearest", [1, 3])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, nearest):
    monkeypatch.setattr(simhash, "NEAREST", nearest)
    texts = clusters(1, 5, 50, 7)
    roots = brute_roots(texts)
    kept = {r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wanted = {k for k, r in enumerate(roots) if k == r}
    assert wanted <= kept  # no link that is none
    assert len(kept - wanted) <= 0.02 * len(texts), sorted(kept - wanted)


def test_recall_at_the_threshold(spark):
    rng = random.Random(3)
    texts, pairs = [], 0
    for g in range(400):
        words = [f"g{g}w{k}" for k in range(200)]
        other = list(words)
        for at in rng.sample(range(5, 195, 6), 4):  # 20 of 196 shingles differ: 176 of 216 in common
            other[at] = "new"
        texts += [" ".join(words), " ".join(other)]
        pairs += 1
    kept = simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    assert len(texts) - kept >= 0.9 * pairs


def test_unique_text_under_a_repeated_id_stays(spark):
    a, b = fixtures.prose(1, 80), fixtures.prose(2, 80)
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (None, a), (None, a), (7, None), (8, ""), (9, " \n")], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([(3, a), (5, b), (None, a), (None, a), (7, None)], key=str)


def test_empty_table(spark):
    none = fixtures.empty(spark)
    assert simhash.keep_one_of_each(none).count() == 0 and simhash.keep_one_of_each(none).columns == none.columns


@pytest.mark.parametrize("n", [10, 50_000, 300_000, 10**8])
def test_blocks_meet_what_they_guarantee(n):
    plan = simhash.block_plan(n)
    tables = plan.masks()
    assert max(lane for lane, _ in tables) < plan.lanes
    each, rng = 64 // plan.size, np.random.default_rng(n % 1000)
    places = [(k // each, k % each * plan.size + b) for k in range(plan.blocks) for b in range(plan.size)]
    for _ in range(300):
        differ = np.zeros(plan.lanes, np.uint64)
        for at in rng.choice(len(places), min(plan.guaranteed, len(places)), replace=False):
            differ[places[at][0]] |= np.uint64(1 << places[at][1])
        assert any(not int(differ[lane] & mask) for lane, mask in tables)
    share = simhash.differing_share(0.8)
    assert (1 - simhash._within(plan.size, plan.radius, share)) ** plan.blocks <= 0.1


def test_nearest_pairs_end_with_all():
    rng = np.random.default_rng(5)
    s0, s1 = rng.integers(0, 4, 40, np.uint64), rng.integers(0, 4, 40, np.uint64)
    roots, marks, met, nearest = np.arange(40), np.full(40, -1), set(), 1
    while True:
        pairs, marks, more, _ = simhash.nearest_pairs(np.stack([s0, s1]), roots, marks, 3, nearest)
        met.update((min(p[:2]), max(p[:2])) for p in pairs)
        nearest *= 4
        if not more:
            break
    near = {(i, j) for i, j in itertools.combinations(range(40), 2) if int(s0[i] ^ s0[j]).bit_count() + int(s1[i] ^ s1[j]).bit_count() <= 3}
    assert met == near


def test_a_pair_is_given_in_one_table(spark):
    rng = np.random.default_rng(8)
    plan = simhash.block_plan(50_000)
    base = rng.integers(0, 1 << 63, simhash.LONG_LANES, np.uint64)
    words = []
    for _ in range(60):  # some bits of 1024 differ, so two are near, but meet in some tables only
        own = base.copy()
        for at in rng.choice(64 * simhash.LONG_LANES, 40, replace=False):
            own[at // 64] ^= np.uint64(1 << int(at % 64))
        words.append(own)
    rows, met = [], set()
    for number, (lane, mask) in enumerate(plan.masks()):
        rows += [(number, int((w[lane] & mask).view(np.int64)), k, int(w[0].view(np.int64)), int(w[1].view(np.int64)), -1, 0, k, w.tobytes()) for k, w in enumerate(words)]
        met |= {(a, b) for a, b in itertools.combinations(range(60), 2) if not int((words[a][lane] ^ words[b][lane]) & mask)}
    df = spark.createDataFrame(rows, "tab long, masked long, fp long, s0 long, s1 long, mark long, mark_fp long, root long, long binary")
    found = [(r.fp, r.other) for r in simhash._met(df, plan, 1000).where("kind = 0").collect()]
    assert sorted(found) == sorted(met)


@pytest.mark.parametrize("nearest", [1, 2])
def test_marks_hold_when_members_go(nearest):
    """Rounds as the stage runs them: only members that are involved go on, and a pair of an earlier table is left to it."""
    rng = np.random.default_rng(6)
    words, earlier = rng.integers(0, 4, (2, 40), np.uint64), [(0, np.uint64(1))]
    fps, marks, met = np.arange(40), np.full(40, -1), set()
    for _ in range(100):
        n = len(fps)
        pairs, new, more, involved = simhash.nearest_pairs(words[:, fps], fps, marks, 3, nearest, earlier)
        met.update((min(fps[a], fps[b]), max(fps[a], fps[b])) for a, b, _ in pairs)
        if not more:
            break
        far, mark_fp = np.where(new < 1 << 62, new // n, 1 << 20)[involved], fps[np.where(new < 1 << 62, new % n, 0)][involved]
        fps = fps[involved]
        marks = far * len(fps) + np.searchsorted(fps, mark_fp, "right") - 1
    assert not more
    far = lambda i, j: sum(int(w[i] ^ w[j]).bit_count() for w in words)
    assert met == {(i, j) for i, j in itertools.combinations(range(40), 2) if far(i, j) <= 3 and int(words[0][i] ^ words[0][j]) & 1}


def test_rows_by_bits(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 40000, (1 << 33) - 1, 1 << 33, (1 << 33) + 32768, 5 << 33]
    rows = spark.createDataFrame([(i, "x" if k % 3 else None) for k, i in enumerate(ids)], "row_id long, t string")
    chosen = spark.createDataFrame([(i,) for i in [*ids[::2], 99, 3 << 33]], "row_id long")
    assert sorted(r.row_id for r in common.rows_with_bits(rows, chosen, "row_id").collect()) == sorted(ids[::2])
    assert sorted(r.row_id for r in common.rows_with_bits(rows, chosen, "row_id", rows.t.isNull()).collect()) == sorted({*ids[::2], *ids[::3]})
    assert common.rows_with_bits(rows, chosen.limit(0), "row_id").count() == 0


def test_files_of_rounds_are_removed_and_the_setting_stays(spark):
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    texts = clusters(2, 2, 10, 5)
    kept = simhash.keep_one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "shingles" in left and not left & {"nodes", "met", "bodies", "open"}
    assert spark.conf.get(common._REMOVE_SHUFFLES, "false") == "false"
    assert 0 < kept.count() < len(texts)
