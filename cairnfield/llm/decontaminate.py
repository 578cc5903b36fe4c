"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into blocks of 16 words; passages are runs of blocks. Passages and benchmark items are
TF-IDF vectors over the words of the items; words in more than `max_share` of all passages weigh nothing. A randomised singular value decomposition gives the latent
space of RANK directions: passages are written once as terms and frequencies, and each of POWER distributed passes over them
multiplies a sketch by the moments of the matrix. The rows of both kinds weigh the same in all, so that
neither the corpus' common words nor the items alone decide it. In that space every passage of every
text is compared with every item: an item of n words with passages of 2n to 4n words that overlap by
half, so one of them holds any copy whole. Pairs above a low cosine are candidates, and so is every stretch
that has RUN words in a row of an item, so a verbatim copy is always one; a candidate counts
if the longest common subsequence of words covers enough of the item (65 words in 100), or somewhat less of it together
with its answer (the `answer` column, else the item's last words).

Items are searched in blocks of `items_per_block`, each block against all texts; vocabulary, latent
space and item vectors are bounded by a block.

Defined results: null texts have no words and no hits; null and empty items are left out; items of
fewer than `min_words` words are matched whole only; repeated rows are each reported; an empty table
of either kind gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cairnfield.llm.common import as_bytes, cut

BLOCK = 16
#: Blocks of a passage of the decomposition.
PASSAGE = 8
#: Directions of the latent space; those of the sketch that are mixtures of items, and those of noise; passes over the passages.
RANK, STRUCTURED, NOISE, POWER = 128, 144, 16, 2
#: Words in a row that make a stretch of text a candidate by themselves; of shorter items all words.
RUN = 6
#: Items searched for in one pass over the texts.
ITEMS_PER_BLOCK = 256
#: Words handled at once.
CHUNK_WORDS = 1 << 17
TERMS_PER_ROW = 64
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_FOLD).split()


def _places(words: list[bytes]) -> dict[bytes, int]:
    """A bit for each place of each word."""
    out: dict[bytes, int] = {}
    for i, word in enumerate(words):
        out[word] = out.get(word, 0) | 1 << i
    return out


def lcs_length(item: list[bytes], text: list[bytes], places: dict[bytes, int] | None = None, least: int = 0) -> int:
    """Length of the longest common subsequence, a machine integer of one bit an item word (Hyyrö's recurrence); 0 if fewer than `least` words of text are the item's."""
    met = [hit for hit in map((_places(item) if places is None else places).get, text) if hit]
    if len(met) < least:
        return 0
    every = state = (1 << len(item)) - 1
    for place in met:
        if hit := state & place:
            state = (state + hit | state - hit) & every
    return len(item) - state.bit_count()


@dataclass(frozen=True)
class Item:
    item_id: object
    words: list[bytes]
    answer: list[bytes]


@dataclass(frozen=True)
class Settings:
    """cosine: least of a candidate. covered: least share of the item in common; covered_with_answer: the same where answered of the answer is found too."""

    cosine: float = 0.45
    covered: float = 0.65
    covered_with_answer: float = 0.55
    answered: float = 0.8
    min_words: int = 8
    max_share: float = 0.1


def _laid_out(texts: list[list[bytes]], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term of each word, -1 for none, each text from a new block on; and the first block of each text."""
    parts, starts, at = [], [], 0
    for words in texts:
        starts.append(at)
        blocks = -(-len(words) // BLOCK)
        part = np.full(blocks * BLOCK, -1, np.int32)
        part[: len(words)] = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))
        parts.append(part)
        at += blocks
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array([*starts, at], np.int64)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words) of runs of texts of about CHUNK_WORDS words."""
    begin, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(words_of(text))
        size += len(held[-1])
        if size >= CHUNK_WORDS:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def _run_hashes(terms: np.ndarray, codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of so many terms; codes: a random number a term, the last one for -1."""
    n = max(0, len(terms) - length + 1)
    each, out = codes[terms], np.zeros(n, np.uint64)
    for k in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    return out


def _run_sums(group: np.ndarray, table: np.ndarray, place: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    """Sums of table[place] * weight by group (ascending), n groups in all: first members first, so that every step adds to distinct rows."""
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(group):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        order = np.argsort(rank, kind="stable")
        at = 0
        for size in np.bincount(rank).tolist():
            part = order[at : at + size]
            rows = table[place[part]]
            out[group[part]] += rows if weight is None else rows * weight[part, None]
            at += size
    return out


def _encoded(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """All passages as terms and frequencies, written out: a row is a run of passages with the terms of each, ascending, and how many terms each has."""
    shared, n = texts.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk in _chunks(batch.column(0).to_pylist()):
                terms, starts = _laid_out(chunk, shared.value)
                passages = -(-int(starts[-1]) // PASSAGE)
                at = np.flatnonzero(terms >= 0)
                pairs = np.sort(at // (BLOCK * PASSAGE) * n + terms[at])
                first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
                passage, term = np.divmod(pairs[first], n)
                tf = np.diff(np.append(first, len(pairs))).astype(np.uint8)  # a passage has 128 words
                held = np.bincount(passage, minlength=passages).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (term.astype(np.int32), tf, held)], names=["terms", "tf", "held"])

    return cut(texts.mapInArrow(run, "terms binary, tf binary, held binary"), "passages")


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, frequencies, terms of each passage) of every row."""
    for terms, tf, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield np.frombuffer(terms, np.int32), np.frombuffer(tf, np.uint8), np.frombuffer(held, np.int32)


def _document_counts(passages: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Passages that hold each of n terms, and passages in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n + 1, np.int64)
        for batch in batches:
            for terms, _, held in _decoded(batch):
                counts[:n] += np.bincount(terms, minlength=n)
                counts[n] += len(held)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["term", "n"])

    counts = np.zeros(n + 1, np.int64)
    for r in passages.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term
        counts[r["term"]] = r["n"]
    return counts[:n], int(counts[n])


def _sketch(passages: DataFrame, scaled: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """A^T A S over all passages (rows of A), for scaled = diag(idf) S, and the squared norm of A; sums of tasks meet by rows of terms."""
    shared = passages.sparkSession.sparkContext.broadcast((scaled.astype(np.float32), idf))
    n, width = scaled.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, idf = shared.value
        y, energy = np.zeros((n, width), np.float32), 0.0
        for batch in batches:
            for term, tf, held in _decoded(batch):
                passage = np.repeat(np.arange(len(held)), held)
                weighed = np.flatnonzero(idf[term] > 0)
                term, tf, passage = term[weighed], tf[weighed].astype(np.float32), passage[weighed]
                if not len(term):
                    continue
                weight = tf * idf[term]
                energy += float((weight.astype(np.float64) ** 2).sum())
                z = _run_sums(passage, scaled, term, tf, len(held))
                order = np.argsort(term, kind="stable")
                met, group = np.unique(term[order], return_inverse=True)
                y[met] += _run_sums(group, z, passage[order], weight[order], len(met))
        rows = [(k, y[k * TERMS_PER_ROW : (k + 1) * TERMS_PER_ROW].tobytes()) for k in range(-(-n // TERMS_PER_ROW)) if y[k * TERMS_PER_ROW : (k + 1) * TERMS_PER_ROW].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows] + [-1], pa.int64()), pa.array([v for _, v in rows] + [np.float64(energy).tobytes()], pa.binary())], names=["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(sums, np.float64 if part < 0 else np.float32).astype(np.float64)
                held[part] = held[part] + values if part in held else values
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["part", "sums"])

    schema = "part long, sums binary"
    y, energy = np.zeros((n, width)), 0.0
    for r in passages.mapInArrow(run, schema).repartition("part").mapInArrow(add, schema).collect():  # terms x width numbers in all
        values = np.frombuffer(r["sums"], np.float64)
        if r["part"] < 0:
            energy += float(values[0])
        else:
            y[r["part"] * TERMS_PER_ROW : (r["part"] + 1) * TERMS_PER_ROW] += values.reshape(-1, width)
    return y, energy


@dataclass(frozen=True)
class LatentIndex:
    """projection: each term's weighted place in the latent space; items by the blocks of their passages."""

    vocabulary: dict[bytes, int]
    projection: np.ndarray
    items: tuple[Item, ...]
    by_span: dict[int, tuple[np.ndarray, np.ndarray]]
    settings: Settings
    #: false for terms that weigh nothing
    weighed: np.ndarray
    #: a random number a term, and one for words outside the vocabulary
    codes: np.ndarray
    #: by length of the run: ascending hashes, and the item and its word of each
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    latent: np.ndarray
    #: items x terms, and a last column for words outside the vocabulary: whether the item has the word
    member: np.ndarray

    def exact_candidates(self, chunk: list[list[bytes]], terms: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """As candidates: the stretches around runs of words that an item has too."""
        places: set[tuple[int, int, int]] = set()
        for length, (keys, items, offsets) in self.runs.items():
            hashes = _run_hashes(terms, self.codes, length)
            bits = np.uint64(44)
            known = np.zeros(1 << 20, bool)
            known[keys >> bits] = True
            at = np.flatnonzero(known[hashes >> bits])
            low, high = np.searchsorted(keys, hashes[at], "left"), np.searchsorted(keys, hashes[at], "right")
            for p, lo, hi in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                row = int(np.searchsorted(starts, p // BLOCK, "right")) - 1
                word = p - int(starts[row]) * BLOCK
                if word + length <= len(chunk[row]):
                    places.update((row, int(items[k]), word - int(offsets[k])) for k in range(lo, hi))
        for row, k, begin in sorted(places):
            n = len(self.items[k].words)
            lo, hi = max(0, begin - n // 2), min(len(chunk[row]), begin + n + n // 2)
            first = int(starts[row]) * BLOCK
            own = terms[first + lo : first + hi]
            place = self.projection[own[own >= 0]].sum(0)
            yield row, k, lo, hi, float(place @ self.latent[k] / max(float(np.linalg.norm(place)), 1e-9))

    def _enough_words(self, terms: np.ndarray, first: np.ndarray, span: int, items: np.ndarray) -> np.ndarray:
        """Whether a passage (its first block, span blocks long) has as many words of the item as a hit needs."""
        least = np.array([math.ceil(len(i.words) * (self.settings.covered_with_answer if len(i.words) >= self.settings.min_words else 1.0)) for i in self.items])
        out = np.zeros(len(first), bool)
        padded = np.append(terms, np.full(span * BLOCK, -1, terms.dtype))
        for at in range(0, len(first), 1 << 12):
            part = slice(at, at + (1 << 12))
            words = padded[first[part, None] * BLOCK + np.arange(span * BLOCK)]
            out[part] = self.member[items[part, None], words].sum(1) >= least[items[part]]
        return out

    def candidates(self, chunk: list[list[bytes]]) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item, first word, last word, cosine): the passages near an item, neighbours joined."""
        terms, starts = _laid_out(chunk, self.vocabulary)
        blocks = int(starts[-1])
        at = np.flatnonzero(terms >= 0)
        at = at[self.weighed[terms[at]]]
        sums = _run_sums(at // BLOCK, self.projection, terms[at], None, blocks + 1)  # one empty block ends the last run
        span, half = 1, sums
        for wanted in sorted(self.by_span):
            while span < wanted // 2:
                half = half if len(half) % 2 == 0 else np.vstack([half, np.zeros((1, half.shape[1]), np.float32)])
                half, span = half[0::2] + half[1::2], span * 2
            passages = half[:-1] + half[1:] if len(half) > 1 else half
            norms = np.linalg.norm(passages, axis=1)
            own, vectors = self.by_span[wanted]
            live = np.flatnonzero(norms > 1e-9)
            near = (passages[live] / norms[live, None]) @ vectors.T
            place, column = np.nonzero(near >= self.settings.cosine)
            first, item = live[place] * span, own[column]
            enough = self._enough_words(terms, first, 2 * span, item)
            first, item, cosine = first[enough], item[enough], near[place[enough], column[enough]]
            low, high = np.searchsorted(starts, first, "right") - 1, np.searchsorted(starts, np.minimum(first + 2 * span, blocks), "left")
            best: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
            for at, k, value, begin, end in zip(first.tolist(), item.tolist(), cosine.tolist(), low.tolist(), high.tolist(), strict=True):
                for row in range(begin, min(end, len(chunk))):
                    lo, hi = (at - int(starts[row])) * BLOCK, (at + 2 * span - int(starts[row])) * BLOCK
                    runs = best.setdefault((row, k), [])
                    if runs and lo <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], hi, max(runs[-1][2], value))
                    else:
                        runs.append((lo, hi, value))
            for (row, k), runs in best.items():
                for lo, hi, value in runs:
                    if lo < len(chunk[row]):
                        yield row, k, max(0, lo), min(len(chunk[row]), hi), value
        yield from self.exact_candidates(chunk, terms, starts)

    def hits(self, texts: list[bytes]) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, cosine, covered, answered) of the candidates that count, the best of each row and item."""
        s = self.settings
        places = [_places(item.words) for item in self.items]
        for begin, chunk in _chunks(texts):
            found: dict[tuple[int, int], tuple[float, float, float]] = {}
            for row, k, lo, hi, cosine in self.candidates(chunk):
                item = self.items[k]
                n = len(item.words)
                share = s.covered_with_answer if n >= s.min_words else 1.0
                for at in range(lo, hi, 2 * n):  # runs of joined passages, a stretch of 4n words at a time
                    part = chunk[row][at : min(hi, at + 4 * n)]
                    covered = lcs_length(item.words, part, places[k], math.ceil(share * n)) / n
                    if covered < share:
                        continue
                    answered = lcs_length(item.answer, part) / len(item.answer)
                    if (covered >= max(share, s.covered) or answered >= s.answered) and found.get((row, k), (0.0,) * 3)[1] < covered:
                        found[row, k] = (cosine, covered, answered)
            for (row, k), values in found.items():
                yield begin + row, k, *values


def build_index(texts: DataFrame, items: list[Item], settings: Settings, seed: int = 7) -> LatentIndex:
    """Latent space of the items and of all of texts (a column of bytes)."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for item in items for w in item.words}))}
    n = len(vocabulary)
    encoded = _encoded(texts, vocabulary)
    counts, passages = _document_counts(encoded, n)
    tf = np.zeros((len(items), n), np.float32)
    for row, item in zip(tf, items, strict=True):
        np.add.at(row, [vocabulary[w] for w in item.words], 1)
    idf = np.log((1 + passages + len(items)) / (1 + counts + (tf > 0).sum(0))).astype(np.float32)
    common = counts > settings.max_share * max(passages, 1)
    # an item of common words alone keeps its words
    needed = (tf[((tf > 0) & ~common).sum(1) < 3] > 0).any(0)
    idf = np.where(common & ~needed, 0, np.maximum(idf, 1e-3)).astype(np.float32)
    a = tf * idf
    rng = np.random.default_rng(seed)
    width = min(n, STRUCTURED + NOISE)
    mixtures = a.T @ rng.standard_normal((len(items), min(STRUCTURED, len(items))), np.float32) if len(items) > STRUCTURED else a.T
    sketch = np.hstack([mixtures / np.maximum(np.linalg.norm(mixtures, axis=0), 1e-9), rng.standard_normal((n, max(1, width - mixtures.shape[1])), np.float32)])
    exact = a.astype(np.float64)
    test = y = np.linalg.qr(sketch)[0]
    for _ in range(POWER):
        test = np.linalg.qr(y)[0]
        y, energy = _sketch(encoded, idf[:, None] * test, idf)
        y = exact.T @ (exact @ test) / max(float((exact**2).sum()), 1e-12) + (y / energy if energy else 0)
    # eigenvectors of A^T A from its sketch y = A^T A test: the Nyström form y (test^T y)^-1 y^T
    values, vectors = np.linalg.eigh((test.T @ y + y.T @ test) / 2)
    good = values > 1e-10 * max(values.max(), 1e-300)
    left, sigma, _ = np.linalg.svd(y @ vectors[:, good] / np.sqrt(values[good]), full_matrices=False)
    basis = left[:, :RANK][:, sigma[:RANK] > 1e-6 * sigma.max()].astype(np.float32)
    latent = a @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    spans: dict[int, list[int]] = {}
    for i, item in enumerate(items):
        span = 2
        while span // 2 * BLOCK < len(item.words):
            span *= 2
        spans.setdefault(span, []).append(i)
    codes = rng.integers(0, 1 << 63, n + 1, np.uint64) * np.uint64(2) + np.uint64(1)
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i, item in enumerate(items):
        length = min(RUN, len(item.words))
        hashes = _run_hashes(np.array([vocabulary[w] for w in item.words]), codes, length)
        found.setdefault(length, []).append((hashes, np.full(len(hashes), i), np.arange(len(hashes))))
    runs = {}
    for length, parts in found.items():
        hashes, own, offsets = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        runs[length] = hashes[order], own[order], offsets[order]
    by_span = {s: (np.array(k), latent[k]) for s, k in spans.items()}
    return LatentIndex(vocabulary, idf[:, None] * basis, tuple(items), by_span, settings, idf > 0, codes, runs, latent, np.hstack([tf > 0, np.zeros((len(items), 1), bool)]))


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, per_block: int) -> Iterator[list[Item]]:
    """The items, per_block at a time; the driver holds one block."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    held: list[Item] = []
    for row in benchmark.select(F.col(id_col), as_bytes(F.col(text_col)), as_bytes(answer)).orderBy(id_col).toLocalIterator():
        words = words_of(bytes(row[1]))
        if words:
            held.append(Item(row[0], words, words_of(bytes(row[2])) or words[-max(1, len(words) // 4) :]))
        if len(held) == per_block:
            yield held
            held = []
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, items_per_block: int = ITEMS_PER_BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, covered, answered): every benchmark item found in a document."""
    spark = docs.sparkSession
    settings = settings or Settings()
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType)] + [T.StructField(n, T.DoubleType()) for n in ("cosine", "covered", "answered")]
    )
    item_type = to_arrow_type(schema["item_id"].dataType)
    texts = docs.select(as_bytes(F.col(text_col)).alias("body"))
    out = None
    for items in _item_blocks(benchmark, item_col, item_text_col, items_per_block):
        shared = spark.sparkContext.broadcast(build_index(texts, items, settings))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = list(index.hits(batch.column(1).to_pylist()))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.items[r[1]].item_id for r in rows], item_type), *(pa.array([r[i] for r in rows], pa.float64()) for i in (2, 3, 4))], names=schema.names)

        part = docs.select(F.col(id_col).alias("doc_id"), as_bytes(F.col(text_col)).alias("body")).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None, items_per_block: int = ITEMS_PER_BLOCK, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    settings = settings or Settings()
    texts = docs.select(as_bytes(F.col(text_col)).alias("body"))
    left, columns, schema = docs, docs.columns, docs.schema
    for items in _item_blocks(benchmark, item_col, item_text_col, items_per_block):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(texts, items, settings))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in shared.value.hits(batch.column(len(columns)).to_pylist())]] = False
                kept = batch.filter(pa.array(clean))
                yield pa.RecordBatch.from_arrays(kept.columns[: len(columns)], names=columns)

        left = left.select(*columns, as_bytes(F.col(text_col)).alias("__cf_body")).mapInArrow(run, schema)
    return left


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(docs, benchmark)
