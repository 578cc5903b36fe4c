"""Token ids in files of independent zstandard frames.

A file holds whole documents in ascending id order. Their ids, unsigned 32-bit little-endian, are cut
into frames between documents; every frame is a zstandard frame of its own. Two skippable frames end
the file: an index of the documents and the seek table of the public seekable format, which gives the
compressed and decompressed size and the checksum (low half of XXH64) of every frame. A reader reads
the tail, then only the frames of the documents it wants.

Files are written under a task's own name and renamed when whole, so a lost executor leaves no part of
a file behind, and a repeated task writes the same file again.

Defined results: a null text is empty (the end id alone); null ids come first, rows with equal ids are
ordered by text and all written; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.llm.common import as_bytes, new_path

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

#: Decompressed bytes after which a frame ends with its document.
FRAME_BYTES = 1 << 16
#: Words of each of the two generations whose ids a worker remembers.
CACHE_WORDS = 600_000
#: Words that go through the library at once.
ENCODE_WORDS = 2_000
#: A word that ends in ASCII signs after an ASCII letter; the tokenizer parts the two.
_SIGNS = re.compile(rb"(.*[A-Za-z])([!-/:-@\[-`{-~]+)", re.DOTALL)
#: Signs that byte-level tokenizers write for bytes, by the public rule: printable ones stand for themselves, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {b: b if b in _PRINTABLE else 256 + i for i, b in enumerate(sorted(range(256), key=lambda b: (b in _PRINTABLE, b)))}


class WordIds:
    """Ids of words by one tokenizer; frequent words stay, as a word that is used moves to the young generation."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # words of letters can go to the model at once where the steps before it do what _letters does
        probe = ["thing", "ÉÈãß", "Ünïcôde"]
        self._plain = all([t.id for t in self._tokenizer.model.tokenize(self._letters(w.encode()) or "")] == self._tokenizer.encode(w, add_special_tokens=False).ids for w in probe)
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _letters(self, word: bytes) -> str | None:
        """What the tokenizer's normaliser and splitter make of a word of Latin letters alone: lower case, a sign for each byte."""
        if word.isalpha():  # ASCII
            return word.lower().decode()
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0250" and unicodedata.is_normalized("NFC", text) and (low := text.lower()).isalpha():
            return low.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return None

    def _learn(self, words: list[bytes]) -> None:
        whole, tokenize = [], self._tokenizer.model.tokenize
        for word in words:
            if self._plain and (letters := self._letters(word)):
                ids = [t.id for t in tokenize(letters)]
                self._young[word] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                whole.append(word)
        for at in range(0, len(whole), ENCODE_WORDS):
            part = whole[at : at + ENCODE_WORDS]
            for word, code in zip(part, self._tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self._young[word] = np.array(code.ids, "<u4").tobytes()

    def _recall(self, words: set[bytes]) -> None:
        """Brings words into the young generation, where they are not."""
        young, old = self._young, self._old
        new, parted = set(), []
        for word in words:
            if (ids := old.get(word)) is not None:
                young[word] = ids
            elif b"<|" not in word and ((m := _SIGNS.fullmatch(word)) or not word.islower()) and (base := (m[1] if m else word)):
                # letters without their signs and in lower case, which the tokenizer makes of them anyway, are met far more often
                base = base.lower()
                sign = m[2] if m else b""
                if base == word:
                    new.add(word)
                    continue
                parted.append((word, base, sign))
                for x in (base, sign):
                    if x and x not in young:
                        if (ids := old.get(x)) is not None:
                            young[x] = ids
                        else:
                            new.add(x)
            else:
                new.add(word)
        self._learn(list(new))
        for word, base, sign in parted:
            young[word] = young[base] + (young[sign] if sign else b"")

    def of(self, text: bytes) -> bytes:
        """The tokenizer never joins what white space parts, so a text's ids are those of its words."""
        words = text.split()
        ids = list(map(self._young.get, words))
        if missing := {w for w, i in zip(words, ids, strict=True) if i is None}:
            self._recall(missing)
            ids = [self._young[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        if len(self._young) > CACHE_WORDS:
            self._old, self._young = self._young, {}
        return b"".join(ids)


_KNOWN: dict[str, WordIds] = {}


def encode(texts: list[bytes], path: str, end_id: int) -> Iterator[bytes]:
    """Ids of each whole text and end_id, as bytes."""
    if path not in _KNOWN:
        _KNOWN[path] = WordIds(path)
    end, known = struct.pack("<I", end_id), _KNOWN[path]
    for text in texts:
        yield known.of(text) + end


class FrameWriter:
    """Writes one file to an open binary stream."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self._out, self._limit = stream, frame_bytes
        self._zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self._held: list[bytes] = []
        self._size = 0
        self._table: list[tuple[int, int, int]] = []
        self._ids: list[int | None] = []
        self._lengths: list[int] = []
        self._frames: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._ids.append(doc_id)
        self._lengths.append(len(ids) // 4)
        self._frames.append(len(self._table))
        self.tokens += len(ids) // 4
        self._held.append(ids)
        self._size += len(ids)
        if self._size >= self._limit:
            self._end_frame()

    def _end_frame(self) -> None:
        if self._held:
            raw = b"".join(self._held)
            packed = self._zstd.compress(raw)
            self._out.write(packed)
            self._table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self._held, self._size = [], 0

    def finish(self) -> int:
        """Writes index and seek table; gives the number of documents."""
        self._end_frame()
        null = np.array([i is None for i in self._ids], np.uint8)
        index = b"".join([struct.pack("<Q", len(self._ids)), np.array([i or 0 for i in self._ids], "<i8").tobytes(), null.tobytes(), np.array(self._lengths, "<u4").tobytes(), np.array(self._frames, "<u4").tobytes()])
        packed = self._zstd.compress(index)
        self._out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        self._table.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *e) for e in self._table)
        self._out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self._table), HAS_CHECKSUMS, SEEKABLE_MAGIC))
        return len(self._ids)


class FrameReader:
    """Reads documents from one seekable file; only frames that are asked for are decompressed."""

    def __init__(self, source):
        self._in = source
        size = source.size()
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("not a file of frames with checksums")
        source.seek(size - 17 - 12 * frames)
        head = struct.unpack("<II", source.read(8))
        if head != (SKIPPABLE_SEEK_TABLE, 12 * frames + 9):
            raise ValueError("damaged seek table")
        table = np.frombuffer(source.read(12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self._table, self._starts = table[:-1], np.concatenate([[0], np.cumsum(table[:, 0])])
        source.seek(int(self._starts[frames - 1]) + 8)
        self._zstd = zstandard.ZstdDecompressor()
        index = self._zstd.decompress(source.read(int(table[-1, 0]) - 8))
        n = struct.unpack_from("<Q", index)[0]
        self.ids = np.frombuffer(index, "<i8", n, 8)
        self.null = np.frombuffer(index, np.uint8, n, 8 + 8 * n).astype(bool)
        self.lengths = np.frombuffer(index, "<u4", n, 8 + 9 * n).astype(np.int64)
        self.frames = np.frombuffer(index, "<u4", n, 8 + 13 * n).astype(np.int64)
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        self._in.seek(int(self._starts[k]))
        packed, size, checksum = (int(x) for x in self._table[k])
        raw = self._zstd.decompress(self._in.read(packed), max_output_size=size)
        self.frames_read += 1
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, rows: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(row in the index, ids) of the rows wanted, all if None, in file order."""
        begin = np.cumsum(self.lengths) - self.lengths
        loaded, raw, base = -1, b"", 0
        for row in range(len(self.ids)) if rows is None else sorted(rows):
            k = int(self.frames[row])
            if k != loaded:
                loaded, raw = k, self.frame(k)
                base = int(begin[np.searchsorted(self.frames, k)])
            at = 4 * (int(begin[row]) - base)
            yield row, raw[at : at + 4 * int(self.lengths[row])]

    def rows_of(self, doc_ids: Iterable[int]) -> list[int]:
        wanted = np.array(sorted(set(doc_ids)), np.int64)
        return np.flatnonzero(np.isin(self.ids, wanted) & ~self.null).tolist()


def _filesystem(directory: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(directory if "://" in directory else f"file://{os.path.abspath(directory.removeprefix('file:'))}")


@dataclass(frozen=True)
class TokenFiles:
    """A written directory: (file name, documents, ids) of each file, in id order. One entry a partition."""

    directory: str
    files: tuple[tuple[str, int, int], ...]

    def starts(self) -> list[int]:
        out, total = [], 0
        for _, _, tokens in self.files:
            out.append(total)
            total += tokens
        return out

    def documents(self, spark: SparkSession) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 and the place (file, frame) of every document, from the files."""
        if not self.files:
            return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame long")
        directory, files, starts = self.directory, self.files, self.starts()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = _filesystem(directory)
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    with fs.open_input_file(f"{root}/{files[k][0]}") as source:
                        reader = FrameReader(source)
                        sums = [zlib.crc32(ids) for _, ids in reader.documents()]
                        n = len(sums)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.ids, pa.int64(), mask=reader.null),
                                pa.array(starts[k] + np.cumsum(reader.lengths) - reader.lengths, pa.int64()),
                                pa.array(reader.lengths, pa.int64()),
                                pa.array(sums, pa.int64()),
                                pa.array([files[k][0]] * n, pa.string()),
                                pa.array(reader.frames, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "frame"],
                        )

        return spark.range(0, len(files), 1, len(files)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame long")

    def fetch(self, doc_ids: Iterable[int]) -> dict[int, list[int]]:
        """Ids of single documents, read on the driver; only their frames are decompressed."""
        wanted, out = set(doc_ids), {}
        fs, root = _filesystem(self.directory)
        for name, _, _ in self.files:
            with fs.open_input_file(f"{root}/{name}") as source:
                reader = FrameReader(source)
                for row, ids in reader.documents(reader.rows_of(wanted)):
                    out[int(reader.ids[row])] = np.frombuffer(ids, "<u4").tolist()
        return out


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, directory: str | None = None, frame_bytes: int = FRAME_BYTES, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes every whole text and writes the files; directory is a path or URI that all machines see."""
    directory = directory or new_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = _filesystem(directory)
        fs.create_dir(root, recursive=True)
        name, draft = f"tokens-{part:06d}.zst", f"{root}/.draft-{part:06d}-{attempt}"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with fs.open_output_stream(draft) as out:
            writer = FrameWriter(out, frame_bytes)

            def take(batch: pa.RecordBatch) -> None:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), tokenizer_path, end_id), strict=True):
                    writer.add(doc_id, ids)

            take(first)
            for batch in batches:
                take(batch)
            n = writer.finish()
        fs.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([n], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["part", "file", "docs", "tokens"])

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(F.col(text_col)).alias("body")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body")
    manifest = sorted(ordered.mapInArrow(run, "part long, file string, docs long, tokens long").collect())
    return TokenFiles(directory, tuple((r["file"], r["docs"], r["tokens"]) for r in manifest))
