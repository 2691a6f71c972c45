"""Token ids in Arrow files of equal-length sequences, written by tasks and read back without copying.

A part file holds the documents of one range of ids, in ascending order, as one stream of tokens cut into
rows of `SEQUENCE` ids. Columns, each of fixed-size lists: `ids`, in 16 bits where the vocabulary allows it;
`mask`, a bit that is set for tokens and not for padding; `ends`, a bit that is set for the last token of a
document. Only the last row of a part is padded. A second file beside it lists the part's document ids in the
same order. Rows are found by arithmetic, and a memory map of the
file gives them as views.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.bpe import byte_symbols
from tidemark.llm.common import pieces, staged
from tidemark.session import scratch_dir

SEQUENCE = 1024
#: Sequences in one record batch of a file.
BATCH_ROWS = 256
END_ID = 0
END = np.uint32(END_ID).astype("<u4").tobytes()
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
UNUSUAL = re.compile(f"[^\\t\\n\\r\\x20-\\x7e{LATIN}]")
#: Usual characters split as by the file's byte-level rule; a piece encodes alone as within its text.
QUICK = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\\s0-9{LATIN}]+|\\s+(?!\\S)|\\s+")
#: Distinct pieces in one generation of a worker's memory; it holds two, so frequent ones are never forgotten.
REMEMBERED = 300_000
MANIFEST = "part long, low long, path string, index_path string, n_docs long, n_ids long"


class Encoder:
    """The library's tokenizer with a memory of pieces, as the same words come again and again."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        split = self.library.pre_tokenizer.pre_tokenize_str(" it's  12\n")
        self.plain = self.library.normalizer is None and [p for p, _ in split] == ["Ġit", "'s", "Ġ", "Ġ12", "Ċ"]
        self.id_type = pa.uint16() if self.library.get_vocab_size() <= 1 << 16 else pa.uint32()
        self.model = self.library.model
        self.shown = dict(enumerate(byte_symbols()))
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        """A split piece goes to the library's model at once, in the printable form of its bytes."""
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))
        return np.array([t.id for t in tokens], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        split: list[list[str] | None] = []
        missing: set[str] = set()
        if len(self.recent) >= REMEMBERED:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        for text in texts:
            usual = self.plain and not UNUSUAL.search(text) and not any(t in text for t in self.added)
            split.append(QUICK.findall(text) if usual else None)
            if usual:
                missing.update(split[-1])
        for piece in missing:
            if piece not in recent:
                recent[piece] = older.get(piece) or self._piece(piece)
        rest = iter(self._encode([t for t, p in zip(texts, split, strict=True) if p is None]))
        return [next(rest) if p is None else b"".join([recent[x] for x in p]) for p in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    return pafs.FileSystem.from_uri(uri if urlsplit(uri).scheme else f"file://{uri}")


class PartWriter:
    """Appends documents to a part; holds less than one record batch of sequences."""

    def __init__(self, sink: pa.NativeFile, index: pa.NativeFile, length: int, id_type: pa.DataType) -> None:
        if length % 8:
            raise ValueError("the length of sequences must be a multiple of 8")
        self.length, self.id_type = length, id_type
        kinds = {"ids": id_type, "mask": pa.bool_(), "ends": pa.bool_()}
        self.schema = pa.schema([(name, pa.list_(kind, length)) for name, kind in kinds.items()])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.index_schema = pa.schema([("doc_id", pa.int64())])
        self.index = pa.ipc.new_file(index, self.index_schema)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.total = 0

    def add(self, documents: list[bytes]) -> None:
        """Documents as little-endian unsigned 32-bit integers, end id included."""
        ids = np.frombuffer(b"".join(documents), "<u4")
        ends = np.zeros(len(ids), bool)
        ends[np.cumsum([len(d) // 4 for d in documents]) - 1] = True
        self.held.append((ids.astype(self.id_type.to_pandas_dtype()), ends))
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.length * BATCH_ROWS:
            self._flush(whole=True)

    def name(self, doc_ids: pa.Array) -> None:
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids], schema=self.index_schema))

    def _flush(self, whole: bool) -> None:
        ids, ends = (np.concatenate(x) for x in zip(*self.held, strict=True))
        # Whole record batches but for the last one, so that a row's batch follows from its number.
        rows = len(ids) // (self.length * BATCH_ROWS) * BATCH_ROWS if whole else -(-len(ids) // self.length)
        cut = min(len(ids), rows * self.length)
        self.held, self.waiting = [(ids[cut:], ends[cut:])], len(ids) - cut
        padding = (0, rows * self.length - cut)
        columns = [np.pad(c, padding) for c in (ids[:cut], np.ones(cut, bool), ends[:cut])]
        for at in range(0, rows, BATCH_ROWS):
            part = slice(at * self.length, min(rows, at + BATCH_ROWS) * self.length)
            arrays = [
                pa.FixedSizeListArray.from_arrays(pa.array(column[part]), type=field.type)
                for column, field in zip(columns, self.schema, strict=True)
            ]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._flush(whole=False)
        self.writer.close()
        self.index.close()


class SequenceFile:
    """Random access to the sequences of a part: views into the mapped file, nothing copied."""

    def __init__(self, source: pa.NativeFile) -> None:
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for number in range(self.reader.num_record_batches):
            yield self._arrays(self.reader.get_batch(number))

    def _arrays(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids (rows, length), and mask and ends as packed bits (rows, length / 8), lowest bit first."""
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True).reshape(-1, self.length)
        bits = [
            np.frombuffer(batch.column(n).flatten().buffers()[1], np.uint8, ids.size // 8).reshape(len(ids), -1)
            for n in ("mask", "ends")
        ]
        return ids, *bits

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(a[row % BATCH_ROWS] for a in self._arrays(self.reader.get_batch(row // BATCH_ROWS)))


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=-1, bitorder="little").astype(bool)


def open_sequences(uri: str) -> SequenceFile:
    """A part file; mapped into memory where it lies in a local or mounted folder."""
    system, path = filesystem(uri)
    mapped = isinstance(system, pafs.LocalFileSystem)
    return SequenceFile(pa.memory_map(path) if mapped else system.open_input_file(path))


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text",
    length: int = SEQUENCE,
) -> DataFrame:
    """Writes the part files and returns their manifest, in ascending order of `low`.

    Each task writes the documents of its range of ids. The names of the files are its own, and only files
    named in the manifest count, so a task that is repeated or runs twice does no harm. Rows with equal ids
    follow each other by the hash of their text; null ids come first.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = picked.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(F.asc_nulls_first("id"), "tie").sortWithinPartitions(
        F.asc_nulls_first("id"), "tie"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, system, root = encoder(tokenizer), *filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        writer, n_docs = None, 0
        for batch in pieces(batches):
            if writer is None:
                system.create_dir(root, recursive=True)
                sink = system.open_output_stream(f"{root}/{name}.arrow")
                index = system.open_output_stream(f"{root}/{name}-docs.arrow")
                writer = PartWriter(sink, index, length, own.id_type)
                low = batch.column(0)[0].as_py()
            writer.add([data + END for data in own.encode([t or "" for t in batch.column(1).to_pylist()])])
            writer.name(batch.column(0).cast(pa.int64()))
            n_docs += batch.num_rows
        if writer is None:
            return
        writer.close()
        sink.close()
        index.close()
        row = [part, low, f"{folder}/{name}.arrow", f"{folder}/{name}-docs.arrow", n_docs, writer.total]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        names = ["part", "low", "path", "index_path", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return staged(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def _documents(sequences: SequenceFile) -> Iterator[tuple[int, int]]:
    """(ids, crc32) of each document of a part, from views of the file; keeps no more than one batch."""
    crc = size = 0
    for ids, mask, ends in sequences:
        flat = ids.reshape(-1)[unpacked(mask).reshape(-1)].astype("<u4")
        at = 0
        for end in (np.flatnonzero(unpacked(ends).reshape(-1)) + 1).tolist():
            yield size + end - at, zlib.crc32(flat[at:end], crc)
            crc, size, at = 0, 0, end
        crc, size = zlib.crc32(flat[at:], crc), size + len(flat) - at


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, start among all ids of all parts, n_tokens and ids_crc32, from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = filesystem(row["index_path"])
                with system.open_input_file(path) as index:
                    doc_ids = pa.ipc.open_file(index).read_all().column(0).combine_chunks()
                sizes, crcs = zip(*_documents(open_sequences(row["path"])), strict=True)
                if len(sizes) != row["n_docs"] or sum(sizes) != row["n_ids"]:
                    raise ValueError(f"{row['path']} doesn't hold what its manifest says")
                starts = row["base"] + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                columns = [doc_ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32"])

    # One row per part file, by ranges of paths and in a number that is told: so adaptive execution leaves each file
    # to a task of its own.
    files = max(1, manifest.count())
    spread = based.select("path", "index_path", "n_docs", "n_ids", "base").repartitionByRange(files, "path")
    return spread.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_file_digests(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Writes `docs` as token files in a new shared folder and reads them back, one row per row of `docs`.

    A null or empty text is the end id alone. Repeated ids give a row each, null ids come first. Other columns
    are ignored; an empty table writes no file and gives an empty result.
    """
    folder = folder or scratch_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, folder, id_col, text_col), id_col)
