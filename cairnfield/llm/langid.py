"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte n-grams (1 to 3 bytes of letters and single spaces), scaled
to length one. Each language has several centroids, found by spherical k-means; a text takes the
language of the centroid with the largest cosine, and is rejected where even that cosine is far under
what training texts of its length reach.

Training rows: at most about `per_language` of each language, chosen by a hash of the id, of all languages
there are; each language's centroids are found by a task of its own. Prediction reads every whole text.

Defined results: a null text, or one without a letter (digits of any script are none), is `und` with score 0 and rejected; without any
training row every text is `und`; of languages at equal cosines the first by name counts; texts of any length are
read whole; repeated rows are all predicted; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.common import as_bytes, crc_mod, cut

BITS = 13
#: What may be a letter; numerals such as fractions are among them.
_WORDLIKE = re.compile(r"[^\W\d_]")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Odd multipliers of the three n-gram hashes.
_ODD = np.array([2654435761, 2246822519, 3266489917], np.uint32)
#: How far the score goes from even to sure with a cosine's lead.
_SHARPNESS = 25.0


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, 2**BITS long."""
    folded = b" ".join((b" " + text.translate(_FOLD) + b" ").split())
    a = np.frombuffer(b" " + folded + b" ", np.uint8).astype(np.uint32) + np.uint32(1)
    one = a * _ODD[0]
    two = (a[:-1] * _ODD[1]) ^ (a[1:] * _ODD[0])
    three = ((a[:-2] * _ODD[2]) ^ (a[1:-1] * _ODD[1])) + a[2:] * _ODD[0]
    shift = np.uint32(32 - BITS)
    return np.bincount(np.concatenate([((g * np.uint32(2246822507)) >> shift) for g in (one, two, three)]), minlength=1 << BITS)


@dataclass(frozen=True)
class CentroidModel:
    """languages[k] owns the rows of centroids where owner == k (ascending); floors: lowest accepted cosine by log2 of the length."""

    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def vector(self, text: bytes) -> np.ndarray:
        v = np.log1p(ngram_counts(text)).astype(np.float32) * self.idf
        return v / (np.linalg.norm(v) or 1)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Language, score, cosine and rejection of each text."""
        out: tuple[list[str], list[float], list[float], list[bool]] = ([], [], [], [])
        starts = np.searchsorted(self.owner, np.arange(len(self.languages)))
        for text in texts:
            if not self.languages or not has_letter(text.decode("utf-8", "replace")):
                row = ("und", 0.0, 0.0, True)
            else:
                cosines = self.centroids @ self.vector(text)
                best = np.maximum.reduceat(cosines, starts)
                k = int(best.argmax())
                top = float(best[k])
                row = (self.languages[k], float(1 / np.exp(_SHARPNESS * (best - top)).sum()), top, top < self.floors[len(text).bit_length()])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return out


def _clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts are spread by taking the vector least like those taken."""
    centers = [vectors.mean(0)]
    near = np.full(len(vectors), np.inf)
    for _ in range(min(k, len(vectors))):
        near = np.minimum(near, 1 - vectors @ (centers[-1] / (np.linalg.norm(centers[-1]) or 1)))
        centers.append(vectors[int(near.argmax())])
    c = np.stack(centers[1:])
    for _ in range(rounds):
        member = (vectors @ c.T).argmax(1)
        c = np.stack([vectors[member == j].sum(0) if (member == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _floors(lengths: np.ndarray, cosines: np.ndarray, slack: float) -> np.ndarray:
    """For each bit length of a text, slack times the first percentile of training texts as long; where few are, that of the nearest length, shorter texts scaled down with the root of the length."""
    bits = np.array([int(n).bit_length() for n in lengths])
    known = {b: slack * float(np.percentile(cosines[bits == b], 1)) for b in np.unique(bits) if (bits == b).sum() >= 20}
    if not known:
        return np.zeros(64)
    low, high = min(known), max(known)
    floors = np.zeros(64)
    for b in range(64):
        floors[b] = known[low] * 2 ** (-0.5 * (low - b)) if b < low else known[high] if b > high else known.get(b, floors[b - 1])
    return floors


def _unpacked(at: list[bytes], n: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Unit vectors of texts whose counts are given as places and numbers."""
    rows = np.zeros((len(at), len(idf)), np.float32)
    for row, places, counts in zip(rows, at, n, strict=True):
        row[np.frombuffer(places, np.uint16)] = np.log1p(np.frombuffer(counts, np.uint32))
    rows *= idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 4, per_language: int = 500, slack: float = 0.5) -> CentroidModel:
    """Learns from the rows of docs whose language is not null; the caller leaves out what must not be seen."""
    spark, size = docs.sparkSession, 1 << BITS
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), as_bytes(F.col(text_col)).alias("body"))
    rates = known.groupBy("lang").agg((F.lit(float(1 << 30)) * F.least(F.lit(1.0), per_language / F.count(F.lit(1)))).alias("most"))
    chosen = known.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("most"))  # a row a language

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for text in batch.column(1):
                n = ngram_counts(text.as_py())
                at = np.flatnonzero(n)
                for column, value in zip(rows, (len(text.as_py()), at.astype(np.uint16).tobytes(), n[at].astype(np.uint32).tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["lang", "length", "at", "n"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, counts = 0, np.zeros(size, np.int64)
        for batch in batches:
            texts += batch.num_rows
            for places in batch.column(0).to_pylist():
                counts[np.frombuffer(places, np.uint16)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.append(texts, counts))], names=["gram", "n"])

    sample = cut(chosen.select("lang", "body").mapInArrow(vectors, "lang string, length long, at binary, n binary"), "language-sample")
    found = dict(sample.select("at").mapInArrow(held, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect())  # a row an n-gram
    if not found.get(-1):
        return CentroidModel((), np.zeros(size, np.float32), np.zeros((0, size), np.float32), np.zeros(0, np.int64), np.zeros(64))
    idf = (np.log((1 + found[-1]) / (1 + np.array([found[k] for k in range(size)]))) + 0.1).astype(np.float32)

    def centers(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "n"])  # whatever order they came in
        c = _clusters(_unpacked(rows["at"].tolist(), rows["n"].tolist(), idf), clusters)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "number": range(len(c)), "center": [v.astype(np.float32).tobytes() for v in c]})

    got = sorted(sample.groupBy("lang").applyInPandas(centers, "lang string, number int, center binary").collect(), key=lambda r: (r["lang"], r["number"]))  # a few rows a language
    languages = sorted({r["lang"] for r in got})
    owner = np.searchsorted(languages, [r["lang"] for r in got])
    centroids = np.stack([np.frombuffer(r["center"], np.float32) for r in got])
    shared = spark.sparkContext.broadcast((idf, centroids))  # languages x clusters x 2**BITS floats, whatever the data

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cosines = (_unpacked(part.column(1).to_pylist(), part.column(2).to_pylist(), idf) @ centroids.T).max(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cosines.astype(np.float64))], names=["length", "cosine"])

    reached = sample.select("length", "at", "n").mapInArrow(nearest, "length long, cosine double").toArrow()  # two numbers a training row
    return CentroidModel(tuple(languages), idf, centroids, owner, _floors(reached["length"].to_numpy(), reached["cosine"].to_numpy(), slack))


def predict(docs: DataFrame, model: CentroidModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", prefix: str = "") -> DataFrame:
    """The columns of keep, then lang_pred, score, cosine and rejected (their names after prefix), for every row."""
    kinds = {"lang_pred": T.StringType(), "score": T.DoubleType(), "cosine": T.DoubleType(), "rejected": T.BooleanType()}
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(prefix + n, kind) for n, kind in kinds.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x clusters x 2**BITS floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, cosines, rejected = shared.value.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(cosines, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    return docs.select(*keep, as_bytes(F.col(text_col)).alias("__cf_body")).mapInArrow(run, schema)


def held_out(docs: DataFrame, id_col: str = "doc_id"):
    return crc_mod(F.col(id_col), 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out, and predicts all."""
    model = fit(docs.where(~held_out(docs)))
    return predict(docs.select("doc_id", "text"), model).withColumn("held_out", held_out(docs)).select("doc_id", "held_out", "lang_pred", "score", "cosine", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose language is recognised."""
    model = fit(docs.where(~held_out(docs)))
    columns = tuple(docs.columns)
    return predict(docs, model, columns, prefix="__cf_").where("not __cf_rejected").select(*columns)
