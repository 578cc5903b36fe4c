"""Each operator against a brute-force version, exact round trips or held-out accuracy, and on awkward tables."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cairnfield.llm import common, components, decontaminate, html, langid, lines, mixing, ppm, queries, sharding, simhash, tokens, toxicity
from tests.conftest import SF_SMALL
from tests.llm import fixtures


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.awkward(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "source").collect()


def held(k, mod, rest):
    return zlib.crc32(b"" if k is None else str(k).encode()) % mod == rest


# --- 1 --------------------------------------------------------------------------------------------


def test_lines_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    cursor = con.execute(lines.LINE_QUALITY_SQL)
    names = [d[0] for d in cursor.description]
    got = queries.op1_line_quality(spark, SF_SMALL).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_lines_of_awkward_documents(docs, rows):
    got = lines.line_quality(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert (by[40].n_words, by[40].base_failed, by[40].kept) == (0, True, False)
    assert by[43].n_symbols == 0 and by[48].n_symbols == 5 and by[48].word_chars == len("naïvecafé\U0001f600成都<|endoftext|>it's#1")
    assert by[47].n_words == 1 and by[47].word_chars == 160_000


def test_frequent_lines_are_removed(spark):
    banner = "Accept all cookies now " * 12
    rows = [(k, f"{banner}\n{fixtures.prose(k, 200 if k % 2 else 10)}", "h" if k < 40 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {r.doc_id: r for r in lines.line_quality(df, max_docs=30).collect()}
    assert by[1].kept and by[1].n_removed_lines == 1 and not by[2].kept and by[41].n_removed_lines == 0
    cleaned = {r.doc_id: r.text for r in lines.remove_frequent_lines(df, max_docs=30).collect()}
    assert banner not in cleaned[1] and cleaned[1] == rows[1][1].split("\n", 1)[1] and 2 not in cleaned and cleaned[41] == rows[41][1]


def test_repeated_words():
    words = b"a b c x a b c d a b c".split()
    assert lines.repeated_words(words) == 9
    assert lines.repeated_words(b"a a a a".split()) == 4 and lines.repeated_words(b"a b".split()) == 0


# --- 2 --------------------------------------------------------------------------------------------


def test_languages(docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == ("en" if k % 2 else "de") for k in range(40))
    assert by[40].lang_pred == by[41].lang_pred == by[43].lang_pred == "und" and by[43].score == 0 and by[43].rejected
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in got)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_languages_on_held_out_documents(spark):
    got = queries.op2_language_id(spark, SF_SMALL).join(common.table(spark, SF_SMALL, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


def test_prediction_does_not_see_labels(docs):
    model = langid.fit(docs)
    plain = langid.predict(docs.select("doc_id", "text"), model).collect()
    shuffled = langid.predict(docs.withColumn("lang", F.lit("xx")), model).collect()
    assert plain == shuffled


# --- 3 --------------------------------------------------------------------------------------------

TOKENIZER = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tokenizer_path():
    return str(pytest.importorskip("public_tokenizers").path(TOKENIZER))


def test_token_files_round_trip(spark, docs, rows, tokenizer_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    files = tokens.write_tokens(docs, tokenizer_path, frame_bytes=4096)
    got = files.documents(spark).orderBy("start").collect()
    start = 0
    want = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    for r, w in zip(got, want, strict=True):
        ids = np.array([*tokenizer.encode(w.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (w.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    picked = files.fetch([5, 44])
    assert picked[44] == [*tokenizer.encode("one", add_special_tokens=False).ids, 2] and set(picked) == {5, 44}


def test_words_alone_give_the_texts_ids(tokenizer_path):
    from tokenizers import Tokenizer

    tokenizer, known = Tokenizer.from_file(tokenizer_path), tokens.WordIds(tokenizer_path)
    rng = random.Random(3)
    pieces = ["the", "THE", "don't", "x's", "y.", "(z)", "é", "É", "ß", "İ", "é", "ñ!", "12", "a1b", "<|endoftext|>", "x<|endoftext|>!", "成都", " ", "\x1c", "ﬁ", "Σας", "½", "a--b", "''", "'s", "word,word", "…", "\U0001f600?"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "\n", "\t"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(known.of(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_frames_are_independent_and_checked(tmp_path):
    path = tmp_path / "f"
    with open(path, "wb") as out:
        writer = tokens.FrameWriter(out, frame_bytes=64)
        for k in range(50):
            writer.add(k if k != 7 else None, np.arange(k, dtype="<u4").tobytes())
        assert writer.finish() == 50
    import pyarrow.fs as pafs
    import zstandard

    with pafs.LocalFileSystem().open_input_file(str(path)) as source:
        reader = tokens.FrameReader(source)
        assert [len(ids) // 4 for _, ids in reader.documents()] == list(range(50))
        fresh = tokens.FrameReader(source)
        assert [ids for _, ids in fresh.documents(fresh.rows_of([30]))] == [np.arange(30, dtype="<u4").tobytes()] and fresh.frames_read == 1
        assert fresh.rows_of([0]) == [0]  # the null id is not taken for 0
    # any zstandard reader can read the whole file, the skippable frames passed over
    whole = zstandard.ZstdDecompressor().stream_reader(path.read_bytes(), read_across_frames=True).read()
    assert len(whole) == 4 * sum(range(50))
    data = bytearray(path.read_bytes())
    data[30] ^= 1
    path.write_bytes(data)
    with pafs.LocalFileSystem().open_input_file(str(path)) as source, pytest.raises((ValueError, zstandard.ZstdError)):
        list(tokens.FrameReader(source).documents())


# --- 4 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["You IDIOT", "you 1d10t!", "you іdіоt", "you ｉｄｉｏｔ", "you id​iot", "idiots"])
def test_disguises_are_folded(text):
    model = toxicity.ToxicityModel({"idiot": 5.0}, ("idiot proof",), ())
    assert toxicity.features(text, model.automaton())[2] == 1.0


def test_exceptions_and_plain_texts():
    automaton = toxicity.ToxicityModel({"idiot": 5.0}, ("idiot proof",), ()).automaton()
    assert toxicity.features("an idiot proof lock", automaton) == (0.0, 0.0, 0.0)
    assert toxicity.features("an idiot, proof an idiot", automaton)[2] == 1.0
    assert toxicity.features("fidiot videotape", automaton)[2] == 0.0
    long, short = toxicity.features("idiot " + "word " * 400, automaton), toxicity.features("idiot word", automaton)
    assert long[0] == short[0] and long[1] < short[1]


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(600):
        toxic = k % 5 == 0
        words = fixtures.prose(k, 80).split()
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "wretch", "v1lla1n", "lout"]))
        rows.append((k, " ".join(words)))
        marks.append((k, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, lab).collect()}
    assert all(r.held_out == held(k, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in got.items())
    out = [k for k, r in got.items() if r.held_out]
    assert sum(got[k].predicted == marks[k][1] for k in out) / len(out) > 0.98


def test_toxicity_of_awkward_tables(spark, docs, rows):
    assert toxicity.score_toxicity(docs, fixtures.labels(spark)).count() == len(rows)
    none = toxicity.score_toxicity(docs, fixtures.labels(spark).limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}


# --- 5 --------------------------------------------------------------------------------------------


def brute_rates(a, targets, start, steps=60_000):
    """Projected gradient of plain numpy, many small steps; rates have no upper bound."""
    r = np.full(a.shape[1], float(start))
    weight = np.maximum(a.sum(0), 1e-9)
    scaled = a / weight
    largest = np.linalg.eigvalsh(scaled @ a.T).max()
    for _ in range(steps):
        r = np.maximum(0, r - scaled.T @ (a @ r - targets) / largest)
    return r


def fitted(spark, p, n, targets, start):
    names = ", ".join(f"p{k} double" for k in range(p.shape[1]))
    members = common.cut(spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(len(n))], f"row_id int, n_tokens long, {names}"), "members")
    return np.array([r.rate for r in mixing.fit_rates(members, list(map(float, targets)), start).orderBy("row_id").collect()])


@pytest.mark.parametrize("share", [[0.6, 0.5, 0.2], [0.1, 0.1, 0.9], [3.0, 0.01, 0.5]])
def test_rates_come_as_near_as_least_squares(spark, share):
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet([0.4, 0.4, 0.4], 200), rng.integers(1, 400, 200)
    a = (p * n[:, None]).T
    targets = a.sum(1) * share
    got = fitted(spark, p, n, targets, 0.5)
    assert (got >= 0).all()
    assert np.abs(a @ got - targets).max() < 1e-3 * targets.max() or np.linalg.norm(a @ got - targets) <= 1.03 * np.linalg.norm(a @ brute_rates(a, targets, 0.5) - targets)


def test_weak_directions_are_steered_too(spark):
    """Posteriors that differ by one part in a hundred: targets that a bound on rates or a cut of directions would miss."""
    rng = np.random.default_rng(4)
    second = 0.02 + 0.01 * rng.random(300)
    p, n = np.stack([1 - second, second], 1), rng.integers(50, 200, 300)
    a = (p * n[:, None]).T
    reachable = a @ np.where(second > 0.025, 1.9, 0.1)
    got = fitted(spark, p, n, reachable, 1.0)
    assert np.abs(a @ got - reachable).max() <= 2e-4 * reachable.max()
    beyond = np.array([a.sum() * 0.5, a.sum() * 0.5])
    got, plain = fitted(spark, p, n, beyond, 1.0), brute_rates(a, beyond, 1.0)
    assert np.linalg.norm(a @ got - beyond) <= 1.02 * np.linalg.norm(a @ plain - beyond)


def test_softmax_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x, y = np.hstack([rng.normal(size=(300, 6)), np.ones((300, 1))]), rng.integers(0, 4, 300)
    x[:, 0] += y
    w = mixing._softmax(x, y, 4)

    def loss(w):
        z = x @ w.T
        return (np.log(np.exp(z).sum(1)) - z[np.arange(300), y]).sum() + 0.5 * (np.append(np.ones(6), 1e-3) * (w - w.mean(0)) ** 2).sum()

    assert all(loss(w) <= loss(w + 0.02 * rng.normal(size=w.shape)) for _ in range(50))


def test_a_domain_that_hardly_occurs_does_not_take_the_mix(spark):
    docs = spark.createDataFrame([(k, ("alpha beta gamma " if k % 2 else "delta epsilon zeta ") * 20 + f"word{k}") for k in range(300)] + [(300, "omega psi chi " * 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, "a" if k % 2 else "b") for k in range(300)] + [(300, "c")], "doc_id long, domain string")
    rated, model = mixing.mix(docs, labels, {"a": 0.6, "b": 0.3, "c": 0.1})
    whole = rated.selectExpr("sum(n_tokens) as n", "sum(n_tokens * rate) as m").first()
    assert model.domains == ("a", "b", "c") and whole.m > 0.3 * whole.n


def test_rates_steer_a_domain_of_one_per_cent(spark):
    rows = [(i, 100, 0.0, 1.0) if i % 100 == 0 else (i, 100, 1.0, 0.0) for i in range(2000)]
    members = spark.createDataFrame(rows, "row_id long, n_tokens long, p0 double, p1 double")
    rates = {r.p1: r.rate for r in mixing.fit_rates(members, [18_000.0, 2_000.0], 0.1).collect()}
    assert math.isclose(rates[1.0], 1.0, rel_tol=1e-3) and math.isclose(rates[0.0], 18_000 / 198_000, rel_tol=1e-3)


def test_mixing_awkward_tables(spark, docs, rows):
    got = mixing.document_rates(docs, fixtures.labels(spark)).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and r.copies >= 0 for r in got)
    n = {r.doc_id: r.n_tokens for r in got}
    assert (n[40], n[41], n[42], n[45]) == (0, 0, 0, 2)
    kept = mixing.mixed_documents(docs, fixtures.labels(spark))
    assert kept.columns == docs.columns
    assert mixing.document_rates(docs, fixtures.labels(spark).limit(0)).count() == len(rows)


def test_mixing_is_native(spark, docs):
    plan = mixing.document_rates(docs, fixtures.labels(spark))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


# --- 6 --------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    low = (text or "").encode().translate(common.ASCII_LOWER).split()
    if not low:
        return 0
    grams = [b" ".join(low[k : k + 3]) for k in range(len(low) - 2)] or [b" ".join(low)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def test_masks_cover_every_radius():
    masks = simhash.covering_masks(list(range(64)))
    assert all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in itertools.combinations(range(64), 3))
    for path in ((0,), (3, 7), (14, 2, 9)):
        assert simhash.table_mask(path).bit_count() > simhash.table_mask(path[:-1]).bit_count()


def test_simhash_components(docs, rows):
    got = simhash.fingerprint_components(docs).collect()
    want = Counter((r.doc_id, f"{brute_fingerprint(r.text):016x}") for r in rows if len(r.text or "") < 50_000)
    assert want == Counter((r.doc_id, r.fingerprint) for r in got if r.doc_id not in (46, 47))
    of = brute_components({int(r.fingerprint, 16) for r in got})
    least = {}
    for r in got:
        if r.doc_id is not None:
            k = of[int(r.fingerprint, 16)]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(of[int(r.fingerprint, 16)]) for r in got)


@pytest.mark.parametrize("radius", [1, 2, 4, 6])
def test_masks_always_grow(radius):
    for n in range(radius + 1, 20):
        assert all(simhash.covering_masks(list(range(n)), radius))
    masks = simhash.covering_masks(list(range(64)), radius)
    rng = random.Random(radius)
    for _ in range(2000):
        differ = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & differ for m in masks)


@pytest.mark.parametrize("bucket", [8, 512])
def test_dense_clusters_lose_no_link(spark, bucket):
    rng = random.Random(6)
    values = set()
    for centre in (rng.getrandbits(64) for _ in range(4)):
        for _ in range(60):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                v ^= 1 << b
            values.add(v)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), bucket=bucket)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    of = brute_components(values)
    for a, b in itertools.combinations(values, 2):
        assert (of[a] == of[b]) == (got.get(signed[a], signed[a]) == got.get(signed[b], signed[b]))


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).selectExpr("(id * 37) % 199 as a", "((id + 1) * 37) % 199 as b")
    got = components.connected_components(chain).collect()
    assert len(got) == 199 and {r.root for r in got} == {0}
    assert components.connected_components(chain.limit(0)).count() == 0


def test_one_of_each_stays(spark, docs):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(3) == 1 and 5 in ids and 50 not in ids and 51 not in ids and None in ids


def test_stage_links_by_similarity_of_five_word_sets(spark):
    rows = []
    for k in range(20):
        words = [f"w{k}x{i}" for i in range(100)]
        rows.append((3 * k, " ".join(words)))
        for copy, places in ((1, (30, 70)), (2, (20, 50, 80))):  # 86 of 106 shingles in common, and 81 of 111
            rows.append((3 * k + copy, " ".join("new" if i in places else w for i, w in enumerate(words))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a, b, c = (set(np.unique(simhash.shingle_hashes(t.encode(), 5)).tolist()) for _, t in rows[:3])
    assert len(a & b) / len(a | b) >= 0.8 > max(len(a & c) / len(a | c), len(b & c) / len(b | c))
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(df).collect()) == [k for k in range(60) if k % 3 != 1]


# --- 7 --------------------------------------------------------------------------------------------


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([bytes([rng.randrange(4)]) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs_length(a, b) == table[-1][-1]


def test_leaks_are_found(spark, docs):
    item = fixtures.benchmark(spark).first().text
    rng = random.Random(9)
    planted = []
    for k in range(60):
        words = item.split()
        if k % 3 == 1:
            words = [w for i, w in enumerate(words) if i not in (3, 9)]
        if k % 3 == 2:
            words = [w.upper() for w in words]
        body = fixtures.prose(500 + k, rng.choice([0, 20, 300, 3000])).split()
        at = rng.randrange(len(body) + 1)
        planted.append((1000 + k, " ".join(body[:at] + words + body[at:])))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = decontaminate.find_leaks(both, fixtures.benchmark(spark)).collect()
    assert {r.doc_id for r in got if r.item_id == 0} == {k for k, _ in planted}
    assert 46 in {r.doc_id for r in got if r.item_id == 3}  # the long text holds it by its seed
    left = decontaminate.without_leaks(both, fixtures.benchmark(spark))
    assert left.columns == both.columns and left.count() == both.count() - len(planted) - len({r.doc_id for r in got if r.item_id == 3})
    assert decontaminate.find_leaks(docs, fixtures.benchmark(spark), items_per_block=1).count() == sum(r.item_id == 3 for r in got)


def test_leaks_of_the_sample_match_plain_search(spark):
    got = {(r.doc_id, r.item_id) for r in queries.op7_benchmark_leaks(spark, SF_SMALL).collect()}
    items = [(r.item_id, b" ".join(decontaminate.words_of(r.text.encode()))) for r in common.table(spark, SF_SMALL, "benchmark").collect()]
    want = set()
    for r in common.table(spark, SF_SMALL, "documents").collect():
        body = b" " + b" ".join(decontaminate.words_of((r.text or "").encode())) + b" "
        want |= {(r.doc_id, k) for k, t in items if b" " + t + b" " in body}
    assert want and want <= got and len(got - want) <= 2


def test_verbatim_items_pass_without_the_cosine(spark):
    never = decontaminate.Settings(cosine=2.0)  # as where the latent space does not show a copy
    items = [(k, fixtures.prose(900 + k, 20 + k)) for k in range(6)] + [(6, "zq zw")]
    docs = [(k, f"{fixtures.prose(k, 37)} {items[k][1]} {fixtures.prose(k + 50, 16)}") for k in range(7)]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), never).collect()
    assert {(k, k) for k in range(7)} <= {(r.doc_id, r.item_id) for r in got if r.covered == 1.0}


# --- 8 --------------------------------------------------------------------------------------------


def test_shards(docs, rows):
    got = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(0 <= r.shard < 24 and r.law == "key" and r.grown_shard in (r.shard, 24) for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


def test_slot_maps(spark, tmp_path):
    even = sharding.SlotMap.even(24)
    grown = even.grown()
    counts = Counter(grown.owners)
    assert max(counts.values()) - min(counts.values()) <= 1 and counts[24] == sharding.VIRTUAL_SLOTS // 25
    assert all(a == b or b == 24 for a, b in zip(even.owners, grown.owners, strict=True)) and grown.version == 2
    rng = random.Random(1)
    sizes = {s: rng.randint(0, 1000) for s in range(sharding.VIRTUAL_SLOTS)}
    load = lambda m: Counter({o: 0 for o in range(24)}) + Counter({o: sum(sizes[s] for s, x in enumerate(m.owners) if x == o) for o in range(24)})
    better = even.rebalanced(sizes, 0.001)
    assert max(load(better).values()) - min(load(better).values()) < max(load(even).values()) - min(load(even).values())
    assert len(better.edits) < sharding.VIRTUAL_SLOTS // 20
    for m in (even, grown):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 2).owners == grown.owners


# --- 9 --------------------------------------------------------------------------------------------


def test_unigram_scores(docs, rows):
    got = ppm.score_held_out(docs).collect()
    assert len(got) == len(rows)
    words = [(r.doc_id, (r.text or "").encode().translate(common.ASCII_LOWER).split()) for r in rows]
    counts, ended = Counter(), 0
    for k, w in words:
        if not held(k, 10, 0):
            counts.update(w)
            ended += 1
    total, distinct = sum(counts.values()) + ended, len(counts) + 1
    want = []
    for k, w in words:
        score = sum(math.log10(counts[x] + 0.1) for x in w) + math.log10(ended + 0.1) - (len(w) + 1) * math.log10(total + 0.1 * (distinct + 1))
        want.append((k, held(k, 10, 0), len(w) + 1, sum(x in counts for x in w) + 1, total, score))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and a[6] <= 0


def test_shuffled_words_score_the_same(spark, docs):
    for heavy in (3, 500_000):  # nearly all words through the shuffle, or none
        scores = sorted((r.base_score, r.n_known) for r in ppm.score_documents(docs, F.lit(True), heavy=heavy).collect())
        if heavy == 3:
            first = scores
    assert all(math.isclose(a[0], b[0], rel_tol=1e-9) and a[1] == b[1] for a, b in zip(first, scores, strict=True))


class PlainPpm:
    """The same method with dictionaries, one byte at a time."""

    def __init__(self, streams, keep=None):
        self.counts = {}
        for s in streams:
            padded = bytes([ppm.END]) * ppm.ORDER + s
            for i in range(ppm.ORDER, len(padded)):
                for d in range(ppm.ORDER + 1):
                    self.counts.setdefault(padded[i - d : i], Counter())[padded[i]] += 1

    def log10(self, stream):
        padded, total = bytes([ppm.END]) * ppm.ORDER + stream, 0.0
        for i in range(ppm.ORDER, len(padded)):
            gone, p, symbol = set(), 1.0, padded[i]
            for d in range(ppm.ORDER, -1, -1):
                seen = self.counts.get(padded[i - d : i])
                if seen is None:
                    continue
                whole = max(sum(seen.values()), self.counts.get(padded[i - d : i - 1], Counter())[padded[i - 1]] if d else 0)
                missing = whole - sum(seen.values())
                free = {s: c for s, c in seen.items() if s not in gone}
                t = sum(free.values()) + missing
                if symbol in free:
                    p *= (free[symbol] - 0.5) / t
                    break
                p *= (missing + len(free) / 2) / t if t else 1.0
                gone |= set(free)
            else:
                p /= 256 - len(gone)
            total += math.log10(p)
        return total


def test_model_against_a_plain_one(spark):
    texts = [fixtures.prose(k, 30) for k in range(12)]
    df = spark.createDataFrame([(t,) for t in texts], "body string").select(common.as_bytes(F.col("body")).alias("body"))
    model = ppm.fit(ppm.count_corpus(df))
    streams = [b" ".join(ppm._tokens(t.encode())) + b"\n" for t in [*texts[:3], fixtures.prose(77, 20), "", "Zebra 123 é"]]
    plain = PlainPpm([b" ".join(ppm._tokens(t.encode())) + b"\n" for t in texts])
    assert np.allclose(model.score(streams), [plain.log10(s) for s in streams], rtol=1e-4)


@pytest.mark.parametrize("kept", [50, 600_000])
def test_scores_use_every_counted_gram(spark, monkeypatch, kept):
    monkeypatch.setattr(ppm, "RANGE_ROWS", 40, raising=False)
    texts = [fixtures.prose(k, 30) for k in range(12)] + [fixtures.prose(77, 20), "", "Zebra 123 é", fixtures.prose(3, 30) + " Zq"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in ppm.score_documents(df, F.col("doc_id") < 12, kept).collect()}
    streams = [b" ".join(ppm._tokens(t.encode())) + b"\n" for t in texts]
    plain = PlainPpm(streams[:12])
    assert np.allclose([got[k] for k in range(len(texts))], [plain.log10(s) for s in streams], rtol=1e-9)


@pytest.mark.parametrize("grams", [30, 300, 600_000])
def test_model_is_a_distribution(spark, grams):
    df = spark.createDataFrame([(fixtures.prose(k, 200),) for k in range(5)], "body string").select(common.as_bytes(F.col("body")).alias("body"))
    _, base, _, _, logs = ppm.fit(ppm.count_corpus(df), grams).tables
    p = 10.0 ** logs.reshape(-1, base).astype(float)
    assert np.allclose(p[:, :-1].sum(1) + p[:, -1] * (256 - (base - 1)), 1, atol=1e-4)


# --- 10 -------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div id="cookie-notice">We use cookies.</div>
<div class="sidebar"><a href="/x">Related link one</a></div><article class="post"><header><h1>The   title &amp; more</h1><span>by A. Writer</span></header>
<p><b>First paragraph of the article, long enough to matter to anyone who reads.<br><p>Second one with a <a href="/c">link</a> inside and
a line break &copy; &#233;.</p><p>Yes.</p><div class="ad-slot">Buy now!</div><form><label>Mail</label><input name=q><button>Send</button></form>
<ul><li>item one of the list, which belongs here</li><li>item two</li></ul><div class="comments"><p>Reader comment that is rather long and looks like an article text.</p></div></article>
<footer>&copy; site &middot; terms</footer></body></html>"""


def test_article_is_extracted():
    assert html.main_text(PAGE).split("\n") == [
        "The title & more",
        "First paragraph of the article, long enough to matter to anyone who reads.",
        "Second one with a link inside and a line break © é.",
        "Yes.",
        "item one of the list, which belongs here",
        "item two",
    ]


def test_page_without_an_article():
    page = "<body><div class=menu><a href=1>One</a><a href=2>Two</a></div><div><div><p>" + "Words of the main text go on and on. " * 8 + "</p><p>Short.</p></div></div><div class=footer>Imprint</div></body>"
    assert html.main_text(page).endswith("\nShort.") and "Imprint" not in html.main_text(page) and "One" not in html.main_text(page)


@pytest.mark.parametrize("page", ["", "plain words", "<", "<p", "</p></div>", "<p>a<b>c", "&amp", "<article></article>", "<!-- x", "<nav>only a menu</nav>", "<div>" * 3000 + "deep" + "</div>" * 10])
def test_broken_pages_do_not_raise(page):
    assert isinstance(html.main_text(page), str)


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (3, "v", "", "t")], "page_id long, url string, html string, text string")
    got = html.extract_main_text(df).orderBy("page_id").collect()
    assert got[0] == got[1] and got[0].n_chars == len(got[0].text) and (got[2].text, got[2].n_chars) == ("", 0) and got[3].text == ""


def test_smoothing_and_clusters():
    assert html.smoothed([1.0, 1.0, 1.0], 1.0) == pytest.approx([1, 1, 1])
    assert 1.5 < html.two_means([1.0, 1.2, 8.0, 9.0]) < 8 and html.two_means([2.0, 2.0]) == 2.0


# --- all ------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = fixtures.empty(spark)
    lab = fixtures.labels(spark)
    for df in (
        lines.line_quality(none),
        lines.remove_frequent_lines(none),
        langid.identify(none),
        toxicity.score_toxicity(none, lab),
        mixing.document_rates(none, lab),
        simhash.fingerprint_components(none),
        decontaminate.find_leaks(none, fixtures.benchmark(spark)),
        decontaminate.find_leaks(fixtures.awkward(spark), fixtures.benchmark(spark).limit(0)),
        sharding.shard_documents(none),
        ppm.score_held_out(none),
        html.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0
    path = pytest.importorskip("public_tokenizers").path(TOKENIZER)
    assert tokens.write_tokens(none, str(path)).documents(spark).count() == 0


def test_registered_queries():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert pa.__version__
