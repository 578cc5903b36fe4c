"""Quality rules on words and lines, with line frequency across documents.

Lines are normalised (A-Z lower-cased, digits made equal, white space made single) and hashed. For each
host the documents that hold a line are counted; a line above the host's limit is boilerplate and is
removed; a document that loses too large a part of its words is rejected.

A host's limit is the larger of `max_docs` documents and `max_share` of its documents, so it follows
the host at every size.

Defined results: a null text has no words and fails the base rules; null hosts are one host of their
own; repeated rows count as documents of their own and are all returned; lines without a word are
never counted; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.llm.common import as_bytes, cut

SYMBOLS = b"#*$%&|<>"
#: White space of words, and the bytes that continue a UTF-8 code point.
_NOT_COUNTED = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def line_key(line: bytes) -> int:
    """Signed 64-bit hash of the normalised line."""
    return np.uint64(xxhash.xxh64_intdigest(b" ".join(line.translate(_NORMAL).split()))).astype(np.int64).item()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = end = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def document_stats(text: bytes) -> tuple[tuple[int, int, int, int, int], dict[int, int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the words that each distinct line holds in all."""
    words = text.split()
    lines: dict[int, int] = {}
    seen: set[bytes] = set()
    repeats = 0
    for line in text.split(b"\n"):
        if n := len(line.split()):
            repeats += line in seen
            seen.add(line)
            key = line_key(line)
            lines[key] = lines.get(key, 0) + n
    return (len(words), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), repeats, repeated_words(words)), lines


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str, with_text: bool) -> DataFrame:
    """One row a document: number, id, host, the figures and the distinct lines; cut, so that numbers are stable."""
    schema = T.StructType(
        [
            T.StructField("row_id", T.LongType()),
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("host", T.StringType()),
            *[T.StructField(n, T.LongType()) for n in _STATS],
            T.StructField("lines", T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.IntegerType())]))),
            *([T.StructField("body", T.BinaryType())] if with_text else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [document_stats(text.as_py()) for text in batch.column(2)]
            pairs = [lines for _, lines in found]
            keys = pa.array([k for lines in pairs for k in lines], pa.int64())
            counts = pa.array([n for lines in pairs for n in lines.values()], pa.int32())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int32))
            columns = [pa.array(range(number, number + batch.num_rows), pa.int64()), batch.column(0), batch.column(1)]
            columns += [pa.array([stats[i] for stats, _ in found], pa.int64()) for i in range(len(_STATS))]
            columns.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([keys, counts], ["line", "words"])))
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns + ([batch.column(2)] if with_text else []), names=schema.names)

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), as_bytes(F.col(text_col)).alias("body"))
    return cut(chosen.mapInArrow(run, schema), "lines")


def _frequent(measured: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(host, line) above the host's limit. Counts are combined before the shuffle, so a line of a third of all documents is a row a task."""
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counted = measured.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("line_docs")).where(F.col("line_docs") > max_docs)
    return counted.join(hosts, counted.host.eqNullSafe(hosts.host)).where(F.col("line_docs") > F.col("host_docs") * max_share).select(counted.host, "line", "line_docs")


def _hits(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """The frequent lines of each document. Hot lines meet one row of the other side, so adaptive execution can split them."""
    held = measured.select("row_id", "host", F.explode("lines").alias("held")).select("row_id", "host", "held.line", "held.words")
    return held.alias("h").join(frequent.alias("f"), (F.col("h.line") == F.col("f.line")) & F.col("h.host").eqNullSafe(F.col("f.host"))).select("row_id", "h.line", "words")


def line_quality(
    docs: DataFrame, max_docs: int = 20, max_share: float = 0.001, min_left: float = 0.5, min_words: int = 50, max_repeat_pct: int = 50, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Figures, verdict of the base rules and of the line rule, for every document.

    base_failed: fewer than min_words words, or over max_repeat_pct per cent of them in repeated windows.
    kept: the base rules hold, and lines at or under the limits keep at least min_left of the words.
    """
    measured = _measured(docs, id_col, text_col, host_col, with_text=False)
    removed = _hits(measured, _frequent(measured, max_docs, max_share)).groupBy("row_id").agg(F.sum("words").alias("removed"), F.count(F.lit(1)).alias("lines"))
    removed_words = F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    depleted = F.col("n_words") - removed_words < min_left * F.col("n_words")
    return measured.drop("lines").join(removed, "row_id", "left").select("doc_id", *_STATS, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), removed_words.alias("n_removed_words"), F.coalesce("lines", F.lit(0)).alias("n_removed_lines"))


def remove_frequent_lines(docs: DataFrame, max_docs: int = 20, max_share: float = 0.001, min_left: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id and text of the documents that are not depleted, without the lines above the limits."""
    measured = _measured(docs, id_col, text_col, host_col, with_text=True)
    hits = _hits(measured.drop("body"), _frequent(measured.drop("body"), max_docs, max_share))
    gone = hits.groupBy("row_id").agg(F.sum("words").alias("removed"), F.collect_set("line").alias("gone"))
    left = measured.join(gone, "row_id", "left").where(F.col("n_words") - F.coalesce("removed", F.lit(0)) >= min_left * F.col("n_words"))
    schema = T.StructType([T.StructField("doc_id", measured.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for body, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if drop:
                    held = set(drop)
                    body = b"\n".join(line for line in body.split(b"\n") if not line.split() or line_key(line) not in held)
                texts.append(body.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return left.select("doc_id", "body", "gone").mapInArrow(rewrite, schema)


#: DuckDB: the same rows; normalised lines stand for their hashes.
LINE_QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM pos),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
raw AS (SELECT rid, source, unnest(string_split(body, chr(10))) AS line FROM d),
ln AS (SELECT rid, source, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM raw),
lw AS (SELECT rid, source, line, len(ws) AS words, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000') AS key FROM ln WHERE len(ws) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw GROUP BY rid),
hosts AS (SELECT source, count(*) AS host_docs FROM d GROUP BY source),
freq AS (SELECT l.source, l.key FROM (SELECT source, key, count(DISTINCT rid) AS n FROM lw GROUP BY source, key) l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE n > 20 AND n > host_docs * 0.001),
gone AS (SELECT rid, sum(words) AS removed, count(DISTINCT lw.key) AS lines FROM lw JOIN freq f ON lw.key = f.key AND lw.source IS NOT DISTINCT FROM f.source GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(body) - length(translate(body, '#*$%&|<>', '')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed, 0) AS removed, coalesce(lines, 0) AS lines
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed >= 0.5 * n_words) AS kept,
       removed::BIGINT AS n_removed_words, lines::BIGINT AS n_removed_lines
FROM base
"""
