"""Toxicity by a weighted lexicon.

Texts are folded (case, width, look-alike letters of other scripts, digits and signs that stand for
letters; accents stay, as they part words in many languages), and an Aho-Corasick automaton finds the lexicon's entries where words begin. Hits inside
exception phrases do not count. The score is a logistic function of the summed weights and of their
share of the text's words.

The lexicon, its weights, the exceptions and the function are learned from labelled rows: at most
about `per_label` of each label, chosen by a hash of the id. Every entry and every exception that these
rows show is used. Every whole text is scored.

Defined results: null and empty texts have no hits and get the score of such texts; texts of any length are
scored whole, in time that grows with the length alone; of hits that begin at one place the heaviest counts, at equal
weights the first to end; null labels are left out; without both labels among the training rows every score is 0; repeated rows are all scored;
an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.common import crc_mod, cut

# Signs and letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "a": "4@аαɑ", "b": "8вЬβ", "c": "сϲ¢", "d": "ԁɗ", "e": "3еєε€", "g": "9ɡ", "h": "һн", "i": "1!іιıї¡", "j": "јϳ", "k": "кκ", "l": "ӏⅼ|", "m": "мⅿ", "n": "ոηп", "o": "0оοσө",
    "p": "рρ", "q": "ԛ", "r": "гѓ", "s": "5$ѕ", "t": "7тτ+", "u": "υս", "v": "ѵν", "w": "ѡԝω", "x": "хχ×", "y": "уүγ", "z": "2ᴢ",
}
_MAP = {ord(sign): letter for letter, signs in LOOKALIKES.items() for sign in signs}
_ASCII = bytes(_MAP[b].encode()[0] if b in _MAP else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(128)) + bytes(range(128, 256))
_PREFIXES = range(3, 10)
#: Beginnings under this length have to be as telling as the words they begin.
SHORT = 5


class _Folded(dict):
    """Code point to its folded text, worked out when first met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if code in _MAP:
            out = _MAP[code]
        else:
            plain = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", char).casefold())
            hidden = unicodedata.category(char) in ("Cf", "Mn")  # joiners, marks
            out = "" if hidden else "".join(_MAP.get(ord(c), c if c.isalpha() else " ") for c in plain)
        self[code] = out
        return out


_FOLDED = _Folded()


def fold(text: str) -> str:
    """The text's words, folded, each with a space before it and one at the end."""
    if text.isascii():
        folded = text.encode().translate(_ASCII).decode()
    else:
        folded = text.translate(_FOLDED)
    return f" {' '.join(folded.split())} "


@dataclass(frozen=True)
class ToxicityModel:
    """weights: entry (found where a word begins) to weight; exceptions: phrases whose hits do not count; logistic: bias and factors."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    logistic: tuple[float, ...]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(f" {entry}", (len(entry) + 1, weight, entry))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, ""))
        found.make_automaton()
        return found


def hits(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float, str]]:
    """(begin, end, weight, entry) of every hit outside exceptions; where hits overlap, the heaviest."""
    if not len(automaton):
        return []
    spans, excepted = [], []
    for last, (length, weight, entry) in automaton.iter(folded):
        (spans if entry else excepted).append((last + 1 - length, last + 1, weight, entry))
    if excepted:
        begins, reach, farthest = [], [], 0
        for b, e, _, _ in sorted(excepted):
            farthest = max(farthest, e)
            begins.append(b)
            reach.append(farthest)  # of the exceptions that begin here or before, the last end
        spans = [s for s in spans if not (k := bisect.bisect_right(begins, s[0])) or reach[k - 1] < s[1]]
    best: dict[int, tuple[int, int, float, str]] = {}
    for span in spans:
        if span[0] not in best or span[2] > best[span[0]][2]:
            best[span[0]] = span
    return list(best.values())


def features(text: str, automaton: ahocorasick.Automaton) -> tuple[float, float, float]:
    """Summed weights, their share of the words, and whether there is any hit; the first two by logarithm."""
    folded = fold(text)
    found = hits(folded, automaton)
    if not found:
        return 0.0, 0.0, 0.0
    total = sum(h[2] for h in found)
    return math.log1p(total), math.log1p(100 * total / (folded.count(" ") - 1)), 1.0


def _terms(text: str) -> set[str]:
    """Folded words and the beginnings of longer ones."""
    words = {w for w in fold(text).split() if len(w) >= 3}
    return words | {w[:n] for w in words for n in _PREFIXES if len(w) > n}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method with a ridge on the factors."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, pull = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    pull[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (y - p) - pull @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _select(rows: list, toxic: int, clean: int, min_docs: int, min_weight: float) -> dict[str, float]:
    """Entries with weights: a beginning stands for its words unless one of them makes up nearly all of it."""
    scored = {}
    for r in rows:
        weight = math.log((r["t"] + 0.5) / (toxic + 1)) - math.log((r["n"] - r["t"] + 1.5) / (clean + 3))
        if r["t"] >= min_docs and weight >= min_weight:
            scored[r["term"]] = (weight, r["t"])
    out: dict[str, float] = {}
    for term in sorted(scored, key=lambda w: (len(w), w)):
        above = [term[:n] for n in _PREFIXES if n < len(term) and term[:n] in out]
        if any(scored[a][1] >= 1.1 * scored[term][1] and out[a] >= scored[term][0] - 1 for a in above):
            continue
        for a in above:
            if scored[a][1] < 1.1 * scored[term][1]:
                out.pop(a)
        out[term] = scored[term][0]
    # a short beginning that is much weaker than a word it begins only stands in for that word
    best: dict[str, float] = {}
    for term, (weight, _) in scored.items():
        for n in _PREFIXES:
            if n < len(term):
                best[term[:n]] = max(best.get(term[:n], 0.0), weight)
    out = {t: w for t, w in out.items() if len(t) >= SHORT or best.get(t, 0.0) <= w + 1}
    return dict(sorted(out.items(), key=lambda kv: (-kv[1], kv[0])))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 4000, min_docs: int = 8, min_weight: float = 1.2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns from docs joined with the rows of labels; the caller leaves out labels that must not be seen."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel({}, (), ())
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    part = F.when(F.col("label") == 1, int((1 << 30) * min(1.0, per_label / sizes[1]))).otherwise(int((1 << 30) * min(1.0, per_label / sizes[0])))
    chosen = known.where(draw < part).limit(4 * per_label)  # about 2 * per_label rows, so small enough to broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).join(F.broadcast(chosen), "id").select("label", "body")

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        every: Counter[str] = Counter()
        docs_of: Counter[int] = Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = _terms(text)
                docs_of[label] += 1
                every.update(terms)
                if label:
                    toxic.update(terms)
        every[""], toxic[""] = docs_of[0] + docs_of[1], docs_of[1]
        names = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[w] for w in names], pa.int64()), pa.array([every[w] for w in names], pa.int64())], names=["term", "t", "n"])

    counts = cut(sample.mapInArrow(count_terms, "term string, t long, n long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n")), "terms")
    whole = counts.where("term = ''").first()
    if whole is None or not 0 < whole["t"] < whole["n"]:
        return ToxicityModel({}, (), ())
    toxic, clean = whole["t"], whole["n"] - whole["t"]
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 1.5) / (clean + 3))
    telling = counts.where((F.col("term") != "") & (F.col("t") >= min_docs) & (weight >= min_weight - 1e-6))
    weights = _select(telling.collect(), toxic, clean, min_docs, min_weight)  # terms of the bounded sample that tell
    plain = ToxicityModel(weights, (), ())

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = plain.automaton()
        found: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text)
                for begin, end, _, _ in hits(folded, automaton):
                    stop = folded.index(" ", end - 1) if folded[end - 1] != " " else end - 1
                    before = folded.rfind(" ", 0, begin) if begin else -1
                    after = folded.find(" ", stop + 1)
                    if before >= 0:
                        found[folded[before + 1 : stop], label] += 1
                    if after >= 0:
                        found[folded[begin + 1 : after], label] += 1
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64()), pa.array(list(found.values()), pa.int64())], names=["phrase", "label", "n"])

    said = sample.mapInArrow(phrases, "phrase string, label long, n long").groupBy("phrase").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"))
    exceptions = tuple(r["phrase"] for r in said.where((F.col("c") >= min_docs) & (F.col("t") * 10 <= F.col("c"))).orderBy(F.desc("c"), "phrase").collect())  # of the sample
    model = ToxicityModel(weights, exceptions, ())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = [features(text, automaton) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([v[i] for v in x], pa.float64()) for i in range(3))], names=["label", "a", "b", "c"])

    # equal rows are counted together, those of the texts without a hit above all
    seen = sample.mapInArrow(measure, "label int, a double, b double, c double").groupBy("label", "a", "b", "c").count().collect()
    share = {k: sizes[k] / max(1, sum(r["count"] for r in seen if r["label"] == k)) for k in (0, 1)}
    x = np.repeat(np.array([[r["a"], r["b"], r["c"]] for r in seen]), [r["count"] for r in seen], axis=0)
    y = np.repeat(np.array([float(r["label"]) for r in seen]), [r["count"] for r in seen])
    fitted = list(_logistic(x, y))
    fitted[0] += math.log(share[1] / share[0])  # labels were drawn at different rates
    return ToxicityModel(weights, exceptions, tuple(fitted))


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The columns of keep, then score, predicted and n_hits, for every row."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("lexicon_weight", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # what the bounded sample of labelled rows showed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        automaton = model.automaton()
        for batch in batches:
            x = np.array([features(text, automaton) for text in batch.column(len(keep)).to_pylist()]).reshape(-1, 3)
            if model.logistic:
                p = 1 / (1 + np.exp(-np.clip(model.logistic[0] + x @ np.array(model.logistic[1:]), -30, 30)))
            else:
                p = np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32)), pa.array(np.expm1(x[:, 0]), pa.float64())], names=schema.names)

    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_body")).mapInArrow(run, schema)


def held_out(frame: DataFrame, id_col: str = "doc_id"):
    return crc_mod(F.col(id_col), 4) == 2


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels that are not held out, and scores every document."""
    model = fit(docs, labels.where(~held_out(labels)))
    return score(docs.select("doc_id", "text"), model).withColumn("held_out", held_out(docs)).select("doc_id", "held_out", "score", "predicted", "lexicon_weight")
