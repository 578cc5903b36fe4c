"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Fingerprints of 64 bits come from the hashes of a text's word shingles. Two fingerprints are linked at
`radius` or fewer differing bits. To find all links, each bit position gets a nonzero vector of
radius + 1 bits, and each nonzero vector v gives a table whose mask keeps the positions whose vector
has an odd product with v. The positions in which a linked pair differs span at most radius
dimensions, so some v has an even product with all of them: that table's masked values are equal.
No link can be missed.

Only distinct fingerprints enter the tables. A bucket with more members than `bucket` is not searched
but dealt out again by the same construction over the positions its mask leaves out; the masks grow
until the bits left over allow no more distinct fingerprints than a bucket may have (2**radius at least). A bucket gives a
spanning set of its links, never all pairs.

The pipeline's stage (`keep_one_of_each`) links texts whose sets of five-word shingles have a Jaccard similarity
of 0.8 or more. Such fingerprints differ in about 15 bits of 100, so longer ones, of several words of 64
bits, are cut into blocks: of b blocks, some block of a pair within b (radius + 1) - 1 bits has radius or fewer, and the tables of
that block make the two meet. The number of blocks follows from the recall that is asked for. Whatever meets
and lies near enough by the whole fingerprint is a candidate, and the sets of every candidate are compared.
Candidates between texts that are already connected are not compared: each text is first compared with its nearest, then, where that left groups
apart, with further ones, until none is left, so a large group does not give all its pairs.

Defined results: a null text has no words and the fingerprint zero, linked like any other; component
ids are the smallest id that can be reached, null ids counting for nothing; repeated rows are each
returned; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.common import ASCII_LOWER, as_bytes, cut, discard, rows_with_bits
from cairnfield.llm.components import connected_components, extended_components

BITS = 64
RADIUS = 3
#: Distinct fingerprints that are compared with one another in one bucket.
BUCKET = 512
SEED = 42
#: The pipeline's stage: words of a shingle, least similarity of a link, share of the pairs at that similarity that meet in a table.
WORDS, SIMILAR, RECALL = 5, 0.8, 0.9
#: Fingerprints that are expected in a bucket of the stage, by a power of two; how many of the nearest a text meets in a bucket in the first
#: round, and by what factor that grows.
BUCKET_POWER, NEAREST, GROWTH = 7, 1, 16
#: Parts into which a text's candidates are dealt, the nearest of each part being compared; then all that are left are.
PARTS = (1, 4)
#: Words of a fingerprint by which candidates are told from texts that only share a bucket, in the first round and in later ones.
FILTER_LANES, LONG_LANES = 2, 16


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of the text's shingles, repeats included; a text of few words is one shingle."""
    parts = text.translate(ASCII_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = len(parts) - words + 1
    shingles = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[words - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def fingerprint(text: bytes, words: int = 3) -> int:
    """A bit is 1 if set in over half the hashes of the text's shingles, repeats included."""
    hashes = shingle_hashes(text, words)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint, as a signed long, of every whole text."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(text.as_py(), words) for text in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), as_bytes(F.col(text_col)).alias("body")).mapInArrow(run, schema)


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """For every set of radius positions or fewer, some mask keeps none of them.

    The unit vectors come first: with more than radius positions every mask then keeps one at least.
    """
    units = [1 << k for k in range(radius + 1)]
    others = sorted((v for v in range(1, 1 << (radius + 1)) if v not in units), key=lambda v: v * 2654435761 % (1 << 32))
    vectors = [*units, *others]
    of = {p: vectors[i % len(vectors)] for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (of[p] & v).bit_count() % 2) for v in vectors]


def table_mask(path: tuple[int, ...], radius: int = RADIUS) -> int:
    """The positions that the tables chosen at each level keep together."""
    mask = 0
    for choice in path:
        mask |= covering_masks([p for p in range(BITS) if not mask >> p & 1], radius)[choice]
    return mask


def _next_tables(table: int, level: int, radius: int) -> list[tuple[int, np.uint64]]:
    """(number, mask) of the tables below a table; the top is table 0 at level 0."""
    n = (1 << (radius + 1)) - 1
    path = []
    for _ in range(level):
        path.append(table % n)
        table //= n
    path = tuple(reversed(path))
    number = 0
    for choice in path:
        number = number * n + choice
    return [(number * n + k, np.uint64(table_mask((*path, k), radius))) for k in range(n)]


def bucket_links(members: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """(smallest, member) of the members of each group that links hold together."""
    if len(members) == 2:
        if int(members[0] ^ members[1]).bit_count() <= radius:
            yield int(min(members)), int(max(members))
        return
    members = np.sort(members)
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= radius
    left = np.ones(len(members), bool)
    for first in range(len(members)):
        if left[first]:
            reached = edge = near[first] & left
            while edge.any():
                grown = near[edge].any(0) & left
                edge, reached = grown & ~reached, reached | grown
            left &= ~reached
            left[first] = False
            for other in np.flatnonzero(reached):
                if other != first:
                    yield int(members[first]), int(members[other])


def _search_level(fps: DataFrame, level: int, radius: int, bucket: int) -> DataFrame:
    """kind 0: a link (x, y); kind 1: fingerprint y of a bucket, of table x, that is too large."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[int, list[tuple[int, np.uint64]]] = {}
        for batch in batches:
            tables, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for table in np.unique(tables).tolist():
                held = values[tables == table]
                for number, mask in below.setdefault(table, _next_tables(table, level, radius)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), number)), pa.array((held & mask).view(np.int64)), pa.array(held.view(np.int64))], names=["tab", "masked", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, over = None, np.zeros(0, np.uint64), False
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            nonlocal held, over
            if not over and len(held) > 1:
                out.extend((0, a, b) for a, b in bucket_links(held, radius))
            held, over = np.zeros(0, np.uint64), False

        def flush() -> pa.RecordBatch:
            columns = [pa.array(np.fromiter((row[i] for row in out), np.uint64, len(out)).view(np.int64)) for i in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["kind", "x", "y"])

        for batch in batches:
            tables, keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            if not len(values):
                continue
            ends = np.append(np.flatnonzero((tables[1:] != tables[:-1]) | (keys[1:] != keys[:-1])) + 1, len(values))
            begins = np.append(0, ends[:-1])
            # runs of one row that cannot go on in a neighbouring batch have no partner
            worth = (ends - begins > 1) | (begins == 0) | (ends == len(values))
            for begin, end in zip(begins[worth].tolist(), ends[worth].tolist(), strict=True):
                key = (int(tables[begin]), int(keys[begin]))
                if key != open_key:
                    close()
                    open_key = key
                part = values[begin:end]
                if not over and len(held) + len(part) > bucket:
                    out.extend((1, key[0], int(v)) for v in held)
                    held, over = np.zeros(0, np.uint64), True
                if over:
                    out.extend((1, key[0], int(v)) for v in part)
                else:
                    held = np.concatenate([held, part])
            if len(out) > 50_000:
                yield flush()
        close()
        yield flush()

    dealt = fps.mapInArrow(deal, "tab long, masked long, fp long")
    return cut(dealt.repartition("tab", "masked").sortWithinPartitions("tab", "masked").mapInArrow(search, "kind long, x long, y long"), "buckets")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that hold the same groups together as all pairs of fps within radius; fps: distinct values of fp."""
    level, found, bucket = 0, None, max(bucket, 1 << radius)
    todo = fps.select(F.lit(0).cast("long").alias("tab"), "fp")
    while True:
        result = _search_level(todo, level, radius, bucket)
        part = result.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))
        found = part if found is None else found.union(part)
        todo = result.where("kind = 1").select(F.col("x").alias("tab"), F.col("y").alias("fp"))
        level += 1
        if todo.isEmpty():
            return found


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every document."""
    marked = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    return _with_components(marked, links(marked.select("fp").distinct(), radius, bucket))


def _with_components(marked: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of marked (doc_id, fp); found: links (a, b) between values of fp."""
    firsts = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(found)
    of = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = cut(of.join(smallest, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def fingerprint_components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def differing_share(similar: float) -> float:
    """Expected share of differing bits of two fingerprints whose sets, of one size, have that Jaccard similarity."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def _within(bits: int, radius: int, share: float) -> float:
    """Probability that at most radius of so many bits differ."""
    return sum(math.comb(bits, k) * share**k * (1 - share) ** (bits - k) for k in range(radius + 1))


@dataclass(frozen=True)
class BlockPlan:
    """Blocks of `size` bits, as many to a word of 64 bits as fit; all tables of all blocks together."""

    size: int
    blocks: int
    lanes: int
    #: share of the pairs at the least similarity that the filters let through, and that similarity
    let_through: float
    similar: float
    radius: int = RADIUS

    @property
    def guaranteed(self) -> int:
        """Pairs that differ in so many bits of the blocks always meet."""
        return self.blocks * (self.radius + 1) - 1

    def farthest(self, lanes: int) -> int:
        """Most differing bits, of so many words, that make a candidate."""
        share = differing_share(self.similar)
        return next(t for t in range(64 * lanes) if _within(64 * lanes, t, share) >= self.let_through)

    def masks(self) -> list[tuple[int, np.uint64]]:
        """(word, mask) of every table."""
        each = 64 // self.size
        return [(k // each, np.uint64(m)) for k in range(self.blocks) for m in covering_masks(list(range(k % each * self.size, (k % each + 1) * self.size)), self.radius)]


def block_plan(n: int, similar: float = SIMILAR, recall: float = RECALL, radius: int = RADIUS) -> BlockPlan:
    """Blocks for n fingerprints: a mask keeps about as many bits as buckets are wanted, and there are as many blocks as the recall needs."""
    share = differing_share(similar)
    kept = (1 << radius) / ((1 << (radius + 1)) - 1)
    size = min(64, max(16, math.ceil((math.log2(max(2, n)) - BUCKET_POWER) / kept)))
    blocks = max(2, math.ceil(math.log(1 - recall) / math.log(1 - _within(size, radius, share))))
    return BlockPlan(size, blocks, max(FILTER_LANES, -(-blocks // (64 // size))), 1 - (1 - recall) / 2, similar, radius)


def _remixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other 64 bits of each hash (a multiply and xor-shift mixer); lane 0: the hash itself."""
    if not lane:
        return hashes
    x = hashes + np.uint64(0x9E3779B97F4A7C15 * lane % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray) -> np.uint64:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def sketch(shingles: np.ndarray, lanes: int) -> np.ndarray:
    """The fingerprint of a set of shingles, lanes words long."""
    return np.array([_majority(_remixed(shingles, k)) for k in range(lanes)], np.uint64)


def _deal(nodes: DataFrame, plan: BlockPlan, block: int) -> DataFrame:
    """Every fingerprint in every table of a block; nodes: fp and sketch."""
    each = (1 << (plan.radius + 1)) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(enumerate(plan.masks()))[block * each : (block + 1) * each]
        for batch in batches:
            fps = batch.column(0)
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, plan.lanes)
            first, second = (pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(FILTER_LANES))
            for number, (lane, mask) in tables:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number)), pa.array((words[:, lane] & mask).view(np.int64)), fps, first, second], names=["tab", "masked", "fp", "s0", "s1"])

    return nodes.select("fp", "sketch").mapInArrow(deal, "tab long, masked long, fp long, s0 long, s1 long")


_OPEN = ("tab", "masked", "fp", "s0", "s1", "mark", "mark_fp")


def nearest_pairs(
    words: np.ndarray, roots: np.ndarray, marks: np.ndarray, farthest: int, nearest: int, earlier: Sequence[tuple[int, np.uint64]] = (), again: bool = False
) -> tuple[list[tuple[int, int, int]], np.ndarray, bool, np.ndarray]:
    """Of a bucket (fingerprints are columns of words): each member, its nearest members (with their distance) of other groups that neither has met; the new marks; whether any has more; and which members have more or are more to another.

    A mark is distance * members + place of the last member that was met; a member that met all has the largest mark.
    earlier: word and mask of the tables before this one. A pair that an earlier table holds is left to that one (again: it is
    given here too, but not told as more).
    """
    n = words.shape[1]
    out: list[tuple[int, int, int]] = []
    new, involved = np.full(n, 1 << 62, np.int64), np.zeros(n, bool)
    for at in range(0, n, 512):
        part = slice(at, min(n, at + 512))
        distance = np.zeros((part.stop - at, n), np.int64)
        for word in words:
            distance += np.bitwise_count(word[part, None] ^ word)
        near = distance <= farthest
        near[np.arange(part.stop - at), np.arange(at, part.stop)] = False
        near &= roots[part, None] != roots
        if not near.any():
            continue
        keys = distance * n + np.arange(n)
        near &= keys > marks[part, None]
        near &= distance * n + np.arange(at, part.stop)[:, None] > marks
        own = near
        if len(earlier):
            i, j = np.nonzero(near)
            for word, mask in earlier:
                apart = (words[word, at + i] ^ words[word, j]) & mask != 0
                i, j = i[apart], j[apart]
            own = np.zeros_like(near)
            own[i, j] = True
        given = near if again else own
        for i in np.flatnonzero(given.any(1)):
            others = np.flatnonzero(given[i])
            if len(others) > nearest:
                others = others[np.argpartition(keys[i, others], nearest - 1)[:nearest]]
                new[at + i] = keys[i, others].max()
            out.extend((at + int(i), j, int(distance[i, j])) for j in others.tolist())
            own[i, others] = False
        involved[part] |= own.any(1)
        involved |= own.any(0)
    return out, new, bool(involved.any()), involved


def _met(rows: DataFrame, plan: BlockPlan, nearest: int) -> DataFrame:
    """kind 0: a candidate (fp, other) and its distance as the mark; kind 1: a member of a bucket that has more, or is more to another, with its mark.

    rows: of the first round as dealt; later with marks, roots and `long`, the fingerprint of LONG_LANES words. In later rounds a pair is
    looked for only in the first of the tables that hold it, so a pair is not given once a table.
    """
    names = ("kind", "other", *_OPEN)
    later = "long" in rows.columns
    columns_of = [*_OPEN, "root", "long"] if later else [*_OPEN[:5]]
    lanes = max(LONG_LANES, plan.lanes) if later else FILTER_LANES
    farthest = plan.farthest(lanes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = plan.masks()
        held: list[list[np.ndarray]] = []
        pairs: list[np.ndarray] = []
        opened: list[np.ndarray] = []

        def close() -> None:
            if not held:
                return
            tabs, masked, fps, s0, s1, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            n = len(fps)
            if n < 2:
                return
            if later:
                marks, mark_fps, roots, long = rest
                # a mark in the table is a distance and a fingerprint, which may have gone; members are in the order of fingerprints
                own = np.where(marks < 0, -1, marks * n + np.searchsorted(fps, mark_fps, "right") - 1)
                words = np.frombuffer(b"".join(long.tolist()), np.uint64).reshape(n, lanes).T
            else:
                own, roots, words = np.full(n, -1, np.int64), fps, np.stack([s0, s1]).view(np.uint64)
            earlier = [(lane, mask) for lane, mask in tables[: int(tabs[0])] if lane < lanes]
            found, new, more, involved = nearest_pairs(words, roots, own, farthest, nearest, earlier, again=not later)
            if found:
                at = np.array(found)
                x = fps[at[:, :2]]
                pairs.append(np.unique(np.stack([x.min(1), x.max(1), at[:, 2]], 1), axis=0))
            if more:
                left = new < 1 << 62
                far, place = np.where(left, new // n, 1 << 20), np.where(left, new % n, 0)
                opened.append(np.stack([tabs, masked, fps, s0, s1, far, fps[place]])[:, involved])

        def flush() -> pa.RecordBatch:
            met = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 3), np.int64)
            rest = np.concatenate(opened, 1) if opened else np.zeros((len(_OPEN), 0), np.int64)
            zeros, none = np.zeros(len(met), np.int64), np.zeros(rest.shape[1], np.int64)
            columns = [np.append(zeros, none + 1), np.append(met[:, 1], none)]
            columns += [np.append({"fp": met[:, 0], "mark": met[:, 2]}.get(name, zeros), rest[k]) for k, name in enumerate(_OPEN)]
            pairs.clear()
            opened.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(columns_of))]
            ends = np.append(np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1, batch.num_rows)
            begin = 0
            for end in ends.tolist():
                own = (int(columns[0][begin]), int(columns[1][begin]))
                if own != key:
                    close()
                    key = own
                held.append([c[begin:end] for c in columns])
                begin = end
            if sum(map(len, pairs)) + sum(x.shape[1] for x in opened) > 100_000:
                yield flush()
        close()
        yield flush()

    ordered = rows.select(*columns_of).repartition("tab", "masked").sortWithinPartitions("tab", "masked", "fp")
    return cut(ordered.mapInArrow(search, ", ".join(f"{n} long" for n in names)), "met", last_use=True)


def _similar(pairs: DataFrame, bodies: DataFrame, least: float, words: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets of shingles have a Jaccard similarity of `least` or more; bodies: fp and body."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            same = []
            for a, first, second in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, x = a, np.unique(shingle_hashes(first.as_py(), words))
                y = np.unique(shingle_hashes(second.as_py(), words))
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(same, pa.bool_())).columns[:2], names=["a", "b"])

    first, second = (bodies.select(F.col("fp").alias(k), F.col("body").alias(f"body_{k}")) for k in "ab")
    return cut(pairs.join(second, "b").join(first, "a").select("a", "b", "body_a", "body_b").mapInArrow(compare, "a long, b long"), "similar", last_use=True)


def similar_groups(marked: DataFrame, plan: BlockPlan, least: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """(node, root) of every value of fp that is in a group, which all links that meet in a table hold together: pairs of texts whose shingle sets have a Jaccard similarity of `least` or more.

    marked: row_id, fp, sketch and body.
    """

    lanes = max(LONG_LANES, plan.lanes)

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [sketch(np.unique(shingle_hashes(text.as_py(), words)), lanes).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketches, pa.binary())], names=["fp", "body", "long"])

    nodes = cut(marked.where(F.length("sketch") > 0).groupBy("fp").agg(F.min(F.struct("row_id", "sketch")).alias("first")).select("fp", "first.row_id", "first.sketch"), "nodes", last_use=True)
    # a block at a time: the shuffle of one block's tables is gone before the next one's
    spent = [nodes, *(_met(_deal(nodes, plan, block), plan, NEAREST) for block in range(plan.blocks))]
    met = functools.reduce(DataFrame.union, spent[1:])
    # the texts of all that are near another, written once: later rounds have no others
    ends = met.select("fp").union(met.where("kind = 0").select("other")).distinct()
    bodies = cut(rows_with_bits(marked.select("row_id", "fp", "body"), nodes.join(ends, "fp").select("row_id"), "row_id").select("fp", "body"), "bodies", last_use=True)
    nearest, tested, roots = NEAREST, None, None
    while True:
        pending = met.where("kind = 0").groupBy(F.col("fp").alias("a"), F.col("other").alias("b")).agg(F.min("mark").alias("distance"))
        pending = cut(pending if tested is None else pending.join(tested, ["a", "b"], "left_anti"), "candidates")
        for parts in (*PARTS, None):
            if pending.isEmpty():
                break
            chosen = pending.select("a", "b")
            if parts:
                ends = pending.select(F.col("a").alias("node"), F.col("b").alias("other"), "*").union(pending.select(F.col("b"), F.col("a"), "*"))
                chosen = ends.groupBy("node", F.pmod(F.xxhash64("other"), F.lit(parts))).agg(F.min(F.struct("distance", "a", "b")).alias("first")).select("first.a", "first.b").distinct()
            chosen = cut(chosen, "chosen")
            same = _similar(chosen, bodies, least, words)
            tested = chosen if tested is None else tested.union(chosen)
            roots = extended_components(roots, same)
            if not parts:
                break
            pending = cut(_apart(pending.join(chosen, ["a", "b"], "left_anti"), roots), "candidates")
        more = met.where("kind = 1").select(*_OPEN)
        if roots is None:
            roots = connected_components(pending.select("a", "b"))  # none
        if more.isEmpty():
            discard(bodies, *spent)
            return roots
        if nearest == NEAREST:  # distances of longer fingerprints begin anew; texts that are not open are not met again
            more = more.withColumn("mark", F.lit(-1).cast("long"))
            near, bodies = bodies, cut(bodies.join(more.select("fp").distinct(), "fp").select("fp", "body").mapInArrow(longer, "fp long, body binary, long binary"), "open", last_use=True)
            discard(near)
        rows = more.join(roots, more.fp == roots.node, "left").select(*_OPEN, F.coalesce("root", "fp").alias("root")).join(bodies.select("fp", "long"), "fp")
        nearest *= GROWTH
        met = _met(rows, plan, nearest)
        spent.append(met)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not connected."""
    r = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    return pairs.join(r[0], "a", "left").join(r[1], "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def with_sketches(docs: DataFrame, plan: BlockPlan, text_col: str = "text", words: int = WORDS, prefix: str = "__cf_") -> DataFrame:
    """All columns of docs and, their names after prefix: row_id, fp (a hash of the set of shingles, 0 without words) and sketch (empty without words); written out."""
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(f"{prefix}row_id", T.LongType()), T.StructField(f"{prefix}fp", T.LongType()), T.StructField(f"{prefix}sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sketches = np.zeros(batch.num_rows, np.uint64), []
            for i, text in enumerate(batch.column(len(columns) + 1)):
                own = np.unique(shingle_hashes(text.as_py(), words))
                fps[i] = xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0
                sketches.append(sketch(own, plan.lanes).tobytes() if len(own) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64)), pa.array(sketches, pa.binary())], names=schema.names)

    numbered = docs.select("*", F.monotonically_increasing_id().alias(f"{prefix}row_id"), as_bytes(F.col(text_col)).alias(f"{prefix}body"))
    return cut(numbered.mapInArrow(run, schema), "shingles")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: BlockPlan | None = None) -> DataFrame:
    """One row, all columns, of each group: five-word shingles with a Jaccard similarity of SIMILAR or more, or a chain of such.

    The row of the smallest id stays, of rows with equal ids any one. Rows without an id all stay. Texts without words are one group.
    """
    plan = plan or block_plan(docs.count())
    held = with_sketches(docs, plan, text_col)
    marked = held.select(F.col(id_col).alias("id"), *(F.col(f"__cf_{c}").alias(c) for c in ("row_id", "fp", "sketch")), as_bytes(F.col(text_col)).alias("body"))
    roots = similar_groups(marked, plan)
    firsts = marked.where("id is not null").groupBy("fp").agg(F.min(F.struct("id", "row_id")).alias("first"))
    of = firsts.join(roots, firsts.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    keepers = cut(of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_id").alias("__cf_row_id")), "keepers", last_use=True)
    return rows_with_bits(held, keepers, "__cf_row_id", or_where=F.col(id_col).isNull()).select(*docs.columns)
