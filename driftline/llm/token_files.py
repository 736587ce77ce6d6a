"""Token ids in Arrow stream files of equal-length sequences.

A file is an Arrow IPC stream whose batches have three fixed-size-list columns: ``ids`` (uint16, or
uint32 for large vocabularies), ``mask`` (true for tokens, false for padding) and ``ends`` (true on the last
token of a document). Documents follow one another in ascending id order and run on from one sequence
to the next; only the last sequence of a file is padded. All batches but the last have the same number
of sequences and are not compressed, so they take the same number of bytes: sequence ``i`` is
in batch ``i // rows`` at a known offset, and a memory-mapped file gives ids and masks as views without
a copy. Beside it lies a small stream with the ids and lengths of the file's documents.

Texts are range-partitioned by id and each task writes one file. A task's file name holds its attempt, and
only files in the returned manifest count, so a repeated or lost task leaves at most a stray file.

Tokenizing works on distinct words: pieces never reach across ASCII white space, which the tokenizer's
normaliser makes one blank and its splitter drops, so each distinct word is encoded once per worker
(``known_pieces``). A tokenizer with another normaliser or splitter gets whole texts.

Defined cases: null is the empty text, whose only token is the end id; rows with the same id are
ordered by the hash of their text and then by the text; an empty table makes an empty manifest; columns besides id and
text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.known_pieces import KnownPieces
from driftline.llm.texts import Words, padded, pieces, spread, text_bytes
from driftline.session import arrow_batches, materialise

LENGTH = 2048
ROWS = 16
#: Rows of texts that go to Python at once.
BATCH_ROWS = 1_000
_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: The normaliser and the splitter that cutting into words relies on.
_SPLITTER = [
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_TAIL = np.array([33 <= c < 127 and not chr(c).isalnum() and chr(c) not in "'<>|" for c in range(256)])
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_sequences long, head_bytes long, batch_bytes long"


class WordIds(KnownPieces):
    """Token ids of whole texts by way of their words.

    ASCII punctuation at the end of a word whose rest ends in an ASCII letter or digit is a piece of its own
    for the tokenizer's splitter, and is kept as a word of its own here. ASCII letters count in lower
    case, as they are encoded, except beside other characters or in what may be a special token. All this
    holds for the normaliser and splitter named in ``_SPLITTER``; another tokenizer file encodes whole texts.
    """

    def __init__(self, path: str):
        super().__init__(path)
        made = json.loads(self.tokenizer.to_str())
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["content"][:1] == "<" and
                    not _SPACE.search(t["content"]) for t in made["added_tokens"])
        self.by_word = plain and [made["normalizer"], made["pre_tokenizer"]] == _SPLITTER
        if self.by_word:
            self.join_by(made["added_tokens"])

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` after each, and their counts."""
        if not self.by_word:
            data, at = text_bytes(column)
            return self.joined(self.entries(data, padded(data), at[:-1], at[1:]), np.arange(len(at)), end)
        words = Words(*text_bytes(column))
        data, read = words.data, padded(words.data, lower=True)
        if len(words.start):
            solid = np.maximum.accumulate(np.where(_TAIL[data], -1, np.arange(len(data))))
            stem = solid[words.end - 1] + 1
            cut = (stem > words.start) & (stem < words.end)
            cut[cut] = _ALNUM[data[stem[cut] - 1]]
            words.insert(np.flatnonzero(cut), stem[cut])
        odd, upper = (np.concatenate([[0], np.cumsum(x)]) for x in ((data >= 128) | (data == 60), (data >= 65) & (data <= 90)))
        exact = (odd[words.end] > odd[words.start]) & (upper[words.end] > upper[words.start])
        own = spread(words.start[exact], (words.end - words.start)[exact])
        read[own] = data[own]
        return self.joined(self.entries(data, read, words.start, words.end), words.bounds, end)


def file_schema(dtype, length: int, rows: int, end: int, tokenizer: str) -> pa.Schema:
    fixed = lambda kind: pa.list_(pa.field("item", kind, nullable=False), length)
    return pa.schema([pa.field("ids", fixed(pa.from_numpy_dtype(dtype)), False), pa.field("mask", fixed(pa.bool_()), False),
                      pa.field("ends", fixed(pa.bool_()), False)],
                     {"layout": json.dumps({"length": length, "rows": rows, "end": end, "tokenizer": os.path.basename(tokenizer)})})


def _batch(schema: pa.Schema, length: int, ids: np.ndarray, n: int, ends: np.ndarray) -> pa.RecordBatch:
    mask = np.arange(len(ids)) < n
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type)
                                       for x, f in zip((ids, mask, ends), schema)], schema=schema)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = 2, length: int = LENGTH, rows: int = ROWS,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files under ``path`` (a folder that all executors share); the manifest has a row per file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, context = WordIds.of(tokenizer), TaskContext.get()
        fs, folder = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        schema = file_schema(words.dtype, length, rows, end, tokenizer)
        name = f"{folder.rstrip('/')}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        sink = writer = index = None
        head = schema.serialize().size  # the stream begins with its schema
        rest_ids, rest_ends = np.zeros(0, words.dtype), np.zeros(0, bool)
        n_docs = n_tokens = n_sequences = size = 0
        for b in pieces(batches, "t"):
            if writer is None:
                fs.create_dir(folder)
                sink = fs.open_output_stream(f"{name}.arrow")
                writer = pa.ipc.new_stream(sink, schema)
                kinds = pa.schema([("doc_id", b.schema.field(0).type), ("n_tokens", pa.int64())])
                side = fs.open_output_stream(f"{name}.docs")
                index = pa.ipc.new_stream(side, kinds)
            ids, count = words.encode(b.column(1), end)
            index.write_batch(pa.RecordBatch.from_arrays([b.column(0), pa.array(count)], schema=kinds))
            ends = np.zeros(len(ids), bool)
            ends[np.cumsum(count) - 1] = True
            n_docs, n_tokens = n_docs + len(count), n_tokens + len(ids)
            rest_ids, rest_ends = np.concatenate([rest_ids, ids]), np.concatenate([rest_ends, ends])
            full = len(rest_ids) // (rows * length) * rows * length
            for k in range(0, full, rows * length):
                before = max(sink.tell(), head)
                writer.write_batch(_batch(schema, length, rest_ids[k:k + rows * length], rows * length, rest_ends[k:k + rows * length]))
                size = sink.tell() - before
                n_sequences += rows
            rest_ids, rest_ends = rest_ids[full:], rest_ends[full:]
        if writer is None:
            return
        if len(rest_ids):
            more = -(-len(rest_ids) // length)
            pad = more * length - len(rest_ids)
            writer.write_batch(_batch(schema, length, np.pad(rest_ids, (0, pad)), len(rest_ids), np.pad(rest_ends, (0, pad))))
            n_sequences += more
        for x in (writer, sink, index, side):
            x.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "path": [f"{name}.arrow"], "n_docs": [n_docs],
                                          "n_tokens": [n_tokens], "n_sequences": [n_sequences], "head_bytes": [head], "batch_bytes": [size]})

    rows_in = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    ordered = rows_in.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "t").drop("h")
    with arrow_batches(docs.sparkSession, BATCH_ROWS):
        return materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


class TokenFile:
    """Random access to the sequences of one file. On a local file system nothing is copied."""

    def __init__(self, fs: pyarrow.fs.FileSystem, row: dict):
        name = row["path"]
        self.source = pa.memory_map(name) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(name)
        self.schema = pa.ipc.open_stream(self.source).schema
        layout = json.loads(self.schema.metadata[b"layout"])
        self.length, self.rows = layout["length"], layout["rows"]
        self.head, self.step, self.n_sequences = row["head_bytes"], row["batch_bytes"], row["n_sequences"]

    def batch(self, k: int) -> pa.RecordBatch:
        self.source.seek(self.head + k * self.step)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def batches(self) -> Iterator[pa.RecordBatch]:
        return (self.batch(k) for k in range(-(-self.n_sequences // self.rows)))

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask (Arrow bits) of sequence ``i``."""
        at = i % self.rows
        batch = self.batch(i // self.rows)
        ids = batch.column(0).values.to_numpy(zero_copy_only=True)[at * self.length:(at + 1) * self.length]
        return ids, batch.column(1).values.slice(at * self.length, self.length)


def read_documents(manifest: DataFrame, doc_type: str = "long", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``, from the files.

    Where a file begins among all ids is a running sum over the manifest, one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = files.repartition(max(1, manifest.count()), "part")
    uri = path

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pyarrow.fs.FileSystem.from_uri(uri)[0] if uri and "://" in uri else pyarrow.fs.LocalFileSystem()
        for row in (r for b in batches for r in b.to_pylist()):
            file, start = TokenFile(fs, row), row["base"]
            with fs.open_input_file(row["path"].removesuffix(".arrow") + ".docs") as side:
                names = (x for b in pa.ipc.open_stream(side) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
                rest = np.zeros(0, np.uint32)
                for batch in file.batches():
                    n = int(pc.sum(batch.column(1).values).as_py())
                    ids = np.concatenate([rest, batch.column(0).values.to_numpy()[:n].astype("<u4")])
                    ends = np.flatnonzero(batch.column(2).values.to_numpy(zero_copy_only=False)[:n]) + 1 + len(rest)
                    parts = np.split(ids, ends)
                    rest = parts.pop()
                    if not parts:
                        continue
                    keys = [next(names) for _ in parts]
                    if any(k[1] != len(p) for k, p in zip(keys, parts)):
                        raise ValueError(f"{row['path']} and its list of documents differ")
                    starts = start + np.cumsum([0, *map(len, parts)])
                    start = int(starts[-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[0] for k in keys]), pa.array(starts[:-1]), pa.array([len(p) for p in parts], pa.int64()),
                         pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()), *([pa.array([p.tobytes() for p in parts], pa.binary())] if with_ids else [])],
                        ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    return files.mapInArrow(read, f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long{', ids binary' if with_ids else ''}")
