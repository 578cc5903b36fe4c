"""Language-model scores by prediction by partial matching.

A byte-context trie of order 5 is learned from the training texts. A byte's probability comes from the
longest context in the trie that was seen; unseen bytes escape to the next shorter context (escape
estimation of method D: d distinct successors of t occurrences give d / 2t), and symbols of the
longer context are excluded there. The document's code length is the sum over its bytes.

A text is modelled as its words, A-Z lower-cased, joined by one space and ended by a line feed, so its
probability is that of its tokens. Beside it stands a smoothed unigram score of the same tokens.

All training texts are counted, and every counted n-gram is used: the trie is a table of (ORDER + 1)-grams,
however many there are. A byte's probability depends on the gram that it ends alone, so a text's score is a
sum over its grams. The `cached` most frequent grams are sent to every worker with their probabilities; the
others meet theirs, worked out from the whole table by ranges of contexts, in a shuffle. Word counts are kept
whole in the same way: words that make up at least a `1 / heavy` part of all tokens, at most `heavy` of them by
that definition, are sent to every worker; the other words meet their counts in a shuffle.

Defined results: a null text is empty and has the end token alone; without training texts all counts
are 0 and every byte is equally likely; repeated rows are all scored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.common import ASCII_LOWER, as_bytes, crc_mod, cut

ORDER = 5
#: Stands for the bytes before a text; it ends every text, so no word holds it.
END = 10
#: Distinct keys that a counting task holds before it hands them on.
HELD_KEYS = 1_500_000
#: Bytes scored at once.
CHUNK = 1 << 20
#: Grams whose contexts are worked out at once.
RANGE_ROWS = 400_000
_WORDS, _GRAMS, _DOCS = 0, 1, 2


def _tokens(text: bytes) -> list[bytes]:
    return text.translate(ASCII_LOWER).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _padded(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with the start context before each, and the places of the bytes that are to be predicted."""
    pad = bytes([END]) * ORDER
    whole = np.frombuffer(b"".join(pad + s for s in streams), np.uint8)
    lengths = np.fromiter(map(len, streams), np.int64, len(streams))
    begins = np.cumsum(lengths + ORDER) - lengths
    real = np.ones(len(whole), bool)
    for k in range(ORDER):
        real[begins - 1 - k] = False
    return whole, np.flatnonzero(real)


def _codes(streams: list[bytes]) -> np.ndarray:
    """The (ORDER + 1)-gram that each byte of the streams ends, the byte itself lowest."""
    whole, at = _padded(streams)
    wide = whole.astype(np.uint64)
    codes = np.zeros(len(at), np.uint64)
    for back in range(ORDER, -1, -1):
        codes = (codes << np.uint64(8)) | wide[at - back]
    return codes


class _Tally:
    """Counts of 64-bit keys, by sorting."""

    def __init__(self) -> None:
        self._keys: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self._held = 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            found, counts = np.unique(keys, return_counts=True)
            self._keys.append(found)
            self._counts.append(counts)
            self._held += len(found)

    def merged(self) -> int:
        if len(self._keys) > 1:
            keys, counts = np.concatenate(self._keys), np.concatenate(self._counts)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self._keys, self._counts = [keys[first]], [np.add.reduceat(counts, first)]
        self._held = sum(map(len, self._keys))
        return self._held

    def full(self) -> bool:
        return self._held > HELD_KEYS and self.merged() > HELD_KEYS // 2

    def take(self, kind: int) -> pa.RecordBatch | None:
        if not self.merged():
            return None
        keys, counts = self._keys[0], self._counts[0]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])


def count_corpus(texts: DataFrame) -> DataFrame:
    """(kind, key, n): counts of word hashes, of byte (ORDER + 1)-grams and of documents over all of texts (a column of bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {_WORDS: _Tally(), _GRAMS: _Tally()}
        docs = 0
        for batch in batches:
            docs += batch.num_rows
            streams, words, size = [], [], 0
            for text in [*batch.column(0), None]:
                if text is not None:
                    found = _tokens(text.as_py())
                    words += found
                    streams.append(b" ".join(found) + bytes([END]))
                    size += len(streams[-1])
                if streams and (text is None or size > CHUNK):
                    tallies[_WORDS].add(_hashes(words))
                    tallies[_GRAMS].add(_codes(streams))
                    streams, words, size = [], [], 0
                    for kind, tally in tallies.items():
                        if tally.full() and (out := tally.take(kind)):
                            yield out
        for kind, tally in tallies.items():
            if out := tally.take(kind):
                yield out
        yield pa.RecordBatch.from_arrays([pa.array([_DOCS]), pa.array([0]), pa.array([docs])], names=["kind", "key", "n"])

    return cut(texts.mapInArrow(run, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")


@dataclass(frozen=True)
class PpmModel:
    """A trie held in memory, for small corpora. Byte n-grams, the last byte being the one predicted, with the depth of their contexts and their counts; the trie is worked out where it is used."""

    depths: np.ndarray
    grams: np.ndarray
    counts: np.ndarray

    @cached_property
    def tables(self) -> tuple[np.ndarray, int, np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
        """(class of each byte, number of classes, node of the last 3 bytes, nodes one byte deeper for each further depth, log10 of node and next class).

        Nodes are numbered by depth. A byte that training never predicts has the last class.
        """
        seen = np.unique(self.grams[self.depths == 0].astype(np.int64))
        size = len(seen)
        base = size + 1
        to_class = np.full(256, size, np.int64)
        to_class[seen] = np.arange(size)
        keys: list[np.ndarray] = []
        logs, offsets = [], [0]
        below = whole_below = prob_below = escape_below = None
        for depth in range(ORDER + 1):
            own = self.depths == depth
            grams, code = self.grams[own], np.zeros(int(own.sum()), np.int64)
            for back in range(depth, 0, -1):
                code = code * base + to_class[(grams >> np.uint64(8 * back)) & np.uint64(255)]
            nodes, node = np.unique(code, return_inverse=True)
            if not len(nodes) and not depth:
                nodes = np.zeros(1, np.int64)
            table = np.bincount(node * base + to_class[grams & np.uint64(255)], self.counts[own], len(nodes) * base).astype(np.float32).reshape(-1, base)
            prob = np.empty_like(table)
            escape = np.empty((len(nodes), 1), np.float32)
            parent = np.searchsorted(keys[depth - 1], nodes % base ** (depth - 1)) if depth else None
            # what follows a context in all: its own count as a gram, the successors left out included
            whole = table.sum(1, keepdims=True)
            if depth:
                before = np.flatnonzero(self.depths == depth - 1)
                before = before[np.argsort(self.grams[before])]
                context = np.unique(grams >> np.uint64(8))
                place = np.minimum(np.searchsorted(self.grams[before], context), len(before) - 1)
                whole[:, 0] = np.maximum(whole[:, 0], np.where(self.grams[before][place] == context, self.counts[before][place], 0))
            for at in range(0, len(nodes), 8192):
                part = slice(at, at + 8192)
                c = table[part]
                hit = c > 0
                total, distinct = whole[part], hit.sum(1, keepdims=True)
                # method D: half a count of each successor goes to the escape, and all of those left out
                out = np.divide(total - c.sum(1, keepdims=True) + distinct / 2, total, out=np.ones_like(total), where=total > 0)
                if not depth:
                    left = 256 - distinct
                    lower = np.full_like(c, 1.0)
                    lower[:, size] = 1 / np.maximum(left[:, 0], 1)
                else:
                    up = parent[part]
                    free = np.where(hit, 0, below[up])
                    d = (free > 0).sum(1, keepdims=True)
                    rest = whole_below[up] - below[up].sum(1, keepdims=True)
                    t = free.sum(1, keepdims=True) + rest
                    tail = np.divide(rest + d / 2, t, out=np.ones_like(t), where=t > 0)
                    lower = np.where(free > 0, (free - 0.5) / np.maximum(t, 0.5), tail * prob_below[up] / escape_below[up])
                prob[part] = np.where(hit, (c - 0.5) / np.maximum(total, 0.5), out * lower)
                escape[part] = out
            keys.append(nodes)
            offsets.append(offsets[-1] + len(nodes))
            logs.append(np.log10(np.maximum(prob, 1e-30)))
            below, whole_below, prob_below, escape_below = table, whole, prob, escape
        deepest = np.zeros(1, np.int32)
        for depth in range(1, 4):
            deepest = np.tile(deepest, base)
            deepest[keys[depth]] = offsets[depth] + np.arange(len(keys[depth]), dtype=np.int32)
        deeper = []
        for depth in range(4, ORDER + 1):
            oldest, rest = np.divmod(keys[depth], base ** (depth - 1))
            step = np.full((len(keys[depth - 1]) + 1, base), -1, np.int32)  # row 0: for nodes less deep
            step[np.searchsorted(keys[depth - 1], rest) + 1, oldest] = offsets[depth] + np.arange(len(keys[depth]), dtype=np.int32)
            deeper.append((offsets[depth - 1], step.reshape(-1)))
        return to_class, base, deepest, deeper, np.concatenate(logs).reshape(-1)

    def score(self, streams: list[bytes]) -> np.ndarray:
        """log10 of the probability of each stream (words joined by spaces, END at the end)."""
        to_class, base, deepest, deeper, logs = self.tables
        whole, at = _padded(streams)
        x = to_class[whole]
        node = deepest[(x[at - 3] * base + x[at - 2]) * base + x[at - 1]].astype(np.int64)
        for depth, (first, step) in enumerate(deeper, 4):
            child = step[np.maximum(node - first + 1, 0) * base + x[at - depth]]
            node = np.where(child >= 0, child, node)
        each = logs[node * base + x[at]].astype(np.float64)
        ends = np.cumsum(np.fromiter(map(len, streams), np.int64, len(streams)))
        return np.add.reduceat(each, np.append(0, ends[:-1]))


def _least_step(stepped: DataFrame, most: int) -> int:
    """The lowest step from which on there are at most `most` rows."""
    left, least = most, 1 << 30
    for r in sorted(stepped.groupBy("step").count().collect(), reverse=True):  # a few thousand steps at most
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    return least


def fit(counts: DataFrame, max_grams: int | None = None) -> PpmModel:
    """The byte n-grams of all lengths in memory, the most frequent max_grams at most if that is given; `score_documents` needs no such model.

    A histogram of the counts, by steps of their logarithm, gives the count from which n-grams are taken; no task
    sorts them. An n-gram is at least as frequent as those that it begins or ends, so contexts of contexts are there.
    """
    part = F.array(*(F.struct(F.lit(d).alias("depth"), F.col("key").bitwiseAND((1 << (8 * (d + 1))) - 1).alias("gram")) for d in range(ORDER + 1)))
    each = counts.where(F.col("kind") == _GRAMS).select("n", F.explode(part).alias("g")).groupBy("g.depth", "g.gram").agg(F.sum("n").alias("n"))
    stepped = cut(each.withColumn("step", F.floor(F.log2("n") * 64).cast("int")), "grams")
    least = 0 if max_grams is None else _least_step(stepped, max_grams)
    got = stepped.where(F.col("step") >= least).select("depth", "gram", "n").toArrow()
    order = np.lexsort((got["gram"].to_numpy(), got["depth"].to_numpy()))
    return PpmModel(got["depth"].to_numpy()[order].astype(np.int64), got["gram"].to_numpy()[order].astype(np.uint64), got["n"].to_numpy()[order])


class GramCache:
    """Values of the most frequent grams, in two tables by different hashes; a gram that finds both its places taken is left out."""

    FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, grams: np.ndarray, values: np.ndarray) -> None:
        """grams: the most frequent first."""
        bits = max(4, int(len(grams) * 1.5).bit_length())
        self.shift = np.uint64(64 - bits)
        self.tables = []
        for factor in self.FACTORS:
            keys, held = np.full(1 << bits, -1, np.int64).view(np.uint64), np.zeros(1 << bits)  # no gram has 64 bits
            slots, first = np.unique((grams * factor) >> self.shift, return_index=True)
            keys[slots], held[slots] = grams[first], values[first]
            self.tables.append((keys, held))
            left = np.ones(len(grams), bool)
            left[first] = False
            grams, values = grams[left], values[left]

    def get(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, or 0 where there is none; which have one)."""
        out, known = np.zeros(len(grams)), np.zeros(len(grams), bool)
        todo = np.arange(len(grams))
        for factor, (keys, held) in zip(self.FACTORS, self.tables, strict=True):
            own = grams[todo]
            slots = (own * factor) >> self.shift
            hit = keys[slots] == own
            out[todo[hit]], known[todo[hit]] = held[slots[hit]], True
            todo = todo[~hit]
        return out, known


def _within(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted value in the ascending keys; whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def gram_logs(grams: np.ndarray, counts: np.ndarray, asked: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of the last byte of each asked gram.

    grams, counts: all that training has of the contexts whose last two bytes are those of the asked ones; pairs: how
    often byte y follows byte x in all of training, 256 x 256.
    """
    levels = []  # by depth: grams, counts, contexts, their totals, successors, and both of the parent without those
    for depth in range(ORDER + 1):
        if depth < 2:
            flat = pairs.reshape(-1) if depth else pairs.sum(0)
            own = np.flatnonzero(flat).astype(np.uint64)
            n = flat[own.astype(np.int64)]
        else:
            own, at = np.unique(grams & np.uint64((1 << (8 * (depth + 1))) - 1), return_inverse=True)
            n = np.bincount(at, counts, len(own))
        contexts, of = np.unique(own >> np.uint64(8), return_inverse=True)
        total, distinct = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
        rest = fewer = None
        if depth and len(own):
            below = levels[-1]
            lower = below[1][np.searchsorted(below[0], own & np.uint64((1 << (8 * depth)) - 1))]
            parent = np.searchsorted(below[2], contexts & np.uint64((1 << (8 * (depth - 1))) - 1))
            rest = below[3][parent] - np.bincount(of, lower, len(contexts))
            fewer = below[4][parent] - distinct
        levels.append((own, n, contexts, total, distinct, rest, fewer))
    out = np.zeros(len(asked))
    todo = np.arange(len(asked))
    rest, fewer = np.full(len(asked), -1.0), np.zeros(len(asked))  # rest < 0: no longer context was seen
    for depth in range(ORDER, -1, -1):
        own, n, contexts, total, distinct, next_rest, next_fewer = levels[depth]
        code = asked[todo] & np.uint64((1 << (8 * (depth + 1))) - 1)
        node, seen = _within(contexts, code >> np.uint64(8))
        if not seen.any():
            continue
        place, hit = _within(own, code)
        first = rest[todo] < 0
        t = np.where(first, total[node], rest[todo])
        d = np.where(first, distinct[node], fewer[todo])
        done, on = todo[hit], seen & ~hit
        out[done] += np.log10((n[place[hit]] - 0.5) / t[hit])
        away = on & (t > 0)
        out[todo[away]] += np.log10(d[away] / 2 / t[away])
        if depth:
            rest[todo[on]], fewer[todo[on]] = next_rest[node[on]], next_fewer[node[on]]
        todo = todo[~hit]
    out[todo] -= math.log10(max(1, 256 - len(levels[0][0])))
    return out


def exact_logs(trained: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, log): log10 of the probability of every distinct gram of asked; trained: (key, n), all grams of training; both by ranges of contexts."""
    pairs = np.zeros(1 << 16)
    for r in trained.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        pairs[r["pair"]] = r["n"]
    shared = trained.sparkSession.sparkContext.broadcast(pairs.reshape(256, 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def worked(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            keys, asked = keys.view(np.uint64), n == 0
            logs = gram_logs(keys[~asked], n[~asked], keys[asked], shared.value)
            return pa.RecordBatch.from_arrays([pa.array(keys[asked].view(np.int64)), pa.array(logs)], names=["key", "log"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(i).to_numpy() for i in range(3)))
            size += batch.num_rows
            if size > RANGE_ROWS and held[0][0][0] != held[-1][0][-1]:
                ranges, keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
                end = int(np.searchsorted(ranges, ranges[-1]))  # the last range may go on
                yield worked(keys[:end], n[:end])
                held, size = [(ranges[end:], keys[end:], n[end:])], len(keys) - end
        if held:
            _, keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            yield worked(keys, n)

    both = trained.select("key", "n").unionByName(asked.select("key").distinct().withColumn("n", F.lit(0).cast("long")))
    ranged = both.select(F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("range"), "key", "n")
    return ranged.repartition("range").sortWithinPartitions("range").mapInArrow(run, "key long, log double")


def frequent_grams(trained: DataFrame, cached: int) -> GramCache:
    """The most frequent grams, `cached` at most, and the logarithms of their probabilities; a histogram of the counts says from where on."""
    stepped = trained.withColumn("step", F.floor(F.log2("n") * 64).cast("int"))
    least = _least_step(stepped, cached)
    context = F.shiftright("key", 8)
    totals = trained.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
    got = stepped.where(F.col("step") >= least).withColumn("context", context).join(totals, "context").select("key", "n", F.log10((F.col("n") - 0.5) / F.col("total")).alias("log")).toArrow()
    order = np.argsort(-got["n"].to_numpy(), kind="stable")
    return GramCache(got["key"].to_numpy().view(np.uint64)[order], got["log"].to_numpy()[order])


def score_documents(docs: DataFrame, training, cached: int = 600_000, heavy: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and scores of every document; training: a column that is true where a document is learned from.

    cached: grams that are sent to every worker; it changes no score.
    """
    spark = docs.sparkSession
    counts = count_corpus(docs.where(training).select(as_bytes(F.col(text_col)).alias("body")))
    words = counts.where(F.col("kind") == _WORDS)
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ended = counts.where(F.col("kind") == _DOCS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    total, distinct = whole["n"] + ended, whole["v"] + (ended > 0)
    norm = math.log10(total + 0.1 * (distinct + 1))
    common = words.where(F.col("n") * heavy >= total).select("key", "n").toArrow()
    keys = common["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    trained = counts.where(F.col("kind") == _GRAMS).select("key", "n")
    shared = spark.sparkContext.broadcast((frequent_grams(trained, cached), keys[order], np.log10(common["n"].to_numpy()[order] + 0.1)))
    end_score = math.log10(ended + 0.1)
    schema = T.StructType(
        [T.StructField("row_id", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_common")]
        + [T.StructField("common_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("rare_grams", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, keys, values = shared.value
        number = TaskContext.get().partitionId() << 40

        def close(rows: list[pa.Scalar], streams: list[bytes], found: list[list[bytes]]) -> list[pa.Array]:
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            hashes = _hashes([w for words in found for w in words])
            owner = np.repeat(np.arange(len(found)), lengths)
            place = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            known = keys[place] == hashes if len(keys) else np.zeros(len(hashes), bool)
            base = np.bincount(owner[known], values[place[known]], len(found)) if len(keys) else np.zeros(len(found))
            rare = np.bincount(owner[~known], minlength=len(found))
            codes = _codes(streams)
            logs, cached_here = cache.get(codes)
            text_of = np.repeat(np.arange(len(streams)), np.fromiter(map(len, streams), np.int64, len(streams)))
            other = np.bincount(text_of[~cached_here], minlength=len(streams))
            return [
                pa.array(lengths + 1),
                pa.array(np.bincount(owner[known], minlength=len(found)) + int(ended > 0)),
                pa.array(base + end_score),
                pa.array(np.bincount(text_of, logs, len(streams))),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rare)).astype(np.int32)), pa.array(hashes[~known].view(np.int64))),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(other)).astype(np.int32)), pa.array(codes[~cached_here].view(np.int64))),
            ]

        for batch in batches:
            begin = 0
            streams: list[bytes] = []
            found: list[list[bytes]] = []
            size = 0
            for i, text in enumerate(batch.column(2)):
                found.append(_tokens(text.as_py()))
                streams.append(b" ".join(found[-1]) + bytes([END]))
                size += len(streams[-1])
                if size > CHUNK or i + 1 == batch.num_rows:
                    n = i + 1 - begin
                    yield pa.RecordBatch.from_arrays([pa.array(range(number, number + n), pa.int64()), batch.column(0).slice(begin, n), batch.column(1).slice(begin, n), *close([], streams, found)], names=schema.names)
                    number, begin, streams, found, size = number + n, i + 1, [], [], 0

    scored = cut(docs.select(F.col(id_col).alias("doc_id"), (~training).alias("held_out"), as_bytes(F.col(text_col)).alias("body")).mapInArrow(run, schema), "scored")
    uncommon = words.where(F.col("n") * heavy < total).select("key", "n")
    met = scored.select("row_id", F.explode("rare").alias("key")).join(uncommon, "key", "left")
    rest = met.groupBy("row_id").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_score"), F.count("n").alias("n_rare"))
    grams = scored.select("row_id", F.explode("rare_grams").alias("key"))
    exact = exact_logs(trained, grams)
    others = grams.join(exact, "key").groupBy("row_id").agg(F.sum("log").alias("gram_score"))
    return scored.drop("rare", "rare_grams").join(rest, "row_id", "left").join(others, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("common_score") + F.coalesce("rare_score", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("score") + F.coalesce("gram_score", F.lit(0.0))).alias("score"),
    )


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out, and scores all."""
    return score_documents(docs, crc_mod(F.col("doc_id"), 10) != 0)
