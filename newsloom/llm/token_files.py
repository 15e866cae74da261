"""Token ids as Arrow stream files of fixed-size-list batches.

A file holds record batches of `rows` sequences; a sequence is a list of exactly `length` ids with a list of as many
mask bits. Every batch but the last has the same number of bytes and no compression, so a memory-mapped file gives any
sequence and its mask as a view (`TokenFile`). Documents follow each other in ascending id order, or as stored, without gaps; only the
last sequence of a file is padded, with mask 0. A second stream beside each file lists its documents.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.llm.shared import earlier, in_tasks, kept, sliced
from newsloom.llm.tokenizing import WordEncoder, worker
from newsloom.session import work_dir

#: Ids per sequence, sequences per record batch, and ids after which a file ends with its document.
SEQUENCE, BATCH_ROWS, FILE_IDS = 2048, 64, 16 << 20

MANIFEST = "part int, number int, file string, documents bigint, tokens bigint"

def id_type(tokenizer) -> pa.DataType:
    """The smallest unsigned type that holds every id of the tokenizer."""
    return pa.uint16() if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else pa.uint32()


def _uri(folder: str) -> str:
    return folder if ":/" in folder else f"file://{os.path.abspath(folder)}"


class _Writer:
    """One token file and its list of documents; both get their names when they are complete."""

    def __init__(self, folder: str, name: str, kind: pa.DataType, length: int, rows: int, key: pa.DataType):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.kind, self.length, self.rows = name, kind, length, rows
        self.held = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        self.sink = self.store.open_output_stream(f"{self.held}.arrows")
        lists = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = pa.ipc.new_stream(self.sink, lists)
        self.lists, self.key = lists, key
        self.buffer, self.tokens = bytearray(), 0
        self.keys, self.starts, self.counts = [], [], []

    def add(self, key, ids: bytes) -> None:
        values = np.frombuffer(ids, "<u4")
        self.keys.append(key)
        self.starts.append(self.tokens)
        self.counts.append(len(values))
        self.tokens += len(values)
        self.buffer += values.astype(self.kind.to_pandas_dtype()).tobytes()
        size = self.rows * self.length * self.kind.byte_width
        whole = len(self.buffer) // size * size
        for at in range(0, whole, size):
            self._batch(self.buffer[at : at + size])
        del self.buffer[:whole]

    def _batch(self, ids: bytes) -> None:
        values = np.frombuffer(ids, self.kind.to_pandas_dtype())
        room = -len(values) % self.length
        mask = np.arange(len(values) + room) < len(values)
        padded = np.append(values, np.zeros(room, values.dtype))
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(padded, self.kind), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.lists))

    def close(self) -> tuple[str, int, int]:
        if self.buffer:
            self._batch(bytes(self.buffer))
        self.stream.close()
        self.sink.close()
        index = pa.table({
            "id": pa.array(self.keys, self.key),
            "start": pa.array(self.starts, pa.int64()),
            "n_tokens": pa.array(self.counts, pa.int64()),
        })
        with self.store.open_output_stream(f"{self.held}.documents") as sink, pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index)
        for kind in ("documents", "arrows"):
            self.store.move(f"{self.held}.{kind}", f"{self.root}/{self.name}.{kind}")
        return self.name, len(self.keys), self.tokens


def stored_order(rows: DataFrame, *columns: Column) -> DataFrame:
    """`columns` of `rows` with file_number, file and row_number, which order rows as they were written.

    Spark names the files of a table by the partitions they were written from, in order, so a table that was sorted as a whole
    comes back in that order whatever tasks read it. `rows` that are no plain scan of Parquet files are written first.
    """
    place = [
        F.regexp_extract("_metadata.file_name", r"part-([0-9]+)", 1).cast("bigint").alias("file_number"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_number"),
    ]
    try:
        return rows.select(*columns, *place)
    except AnalysisException:
        return kept(rows).select(*columns, *place)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text",
    by_word: bool = True, length: int = SEQUENCE, rows: int = BATCH_ROWS, file_ids: int = FILE_IDS, as_stored: bool = False,
) -> DataFrame:
    """Writes all documents to `folder`, a URI every executor can write to, and returns the manifest.

    The manifest has one row per file: part and number (their order), file, documents, tokens. Documents are
    ordered by id, NULL first, equal ids by their text's hash, or with `as_stored` as their rows follow each other in the
    Parquet files they are read from (see `stored_order`); each ends with `end_id`. NULL and empty texts give the
    end id alone. A document never spans two files. Files get their final name when complete, and a task that runs
    twice writes the same files again. No documents give no files.
    """
    folder = _uri(folder)
    chosen = [F.col(id_column).alias("id"), F.col(text_column).alias("text")]
    if as_stored:
        numbered, order = stored_order(docs, *chosen), ["file_number", "file", "row_number"]
    else:
        numbered, order = docs.select(*chosen).withColumn("hash", F.xxhash64("text")), ["id", "hash"]
    ordered = numbered.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer, done = TaskContext.get().partitionId(), 0, None, []
        tool = worker(WordEncoder, tokenizer, by_word)
        kind = id_type(tool.tokenizer)
        for batch in sliced(batches, 1):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    name = f"part-{part:06d}-{number:05d}"
                    writer = _Writer(folder, name, kind, length, rows, batch.schema.field(0).type)
                writer.add(key, tool.encode(text.as_py() or "") + end)
                if writer.tokens >= file_ids:
                    done.append((part, number, *writer.close()))
                    writer, number = None, number + 1
        if writer is not None:
            done.append((part, number, *writer.close()))
        if done:
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*done), types)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "number", "file", "documents", "tokens"])

    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    return kept(in_tasks(ordered, write, MANIFEST))


class TokenFile:
    """A token file opened for random access; sequences and masks are views of the mapped file."""

    def __init__(self, folder: str, name: str):
        store, place = fs.FileSystem.from_uri(_uri(folder))
        path = f"{place}/{name}"
        if isinstance(store, fs.LocalFileSystem):
            source, index = pa.memory_map(f"{path}.arrows"), pa.memory_map(f"{path}.documents")
        else:
            source, index = store.open_input_file(f"{path}.arrows"), store.open_input_file(f"{path}.documents")
        self.stream = pa.ipc.open_stream(source)
        self.length = self.stream.schema.field("ids").type.list_size
        self.documents = pa.ipc.open_stream(index).read_all()
        self._batches: list[pa.RecordBatch] | None = None

    def sequence(self, at: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask bits of sequence `at`, counted from 0."""
        if self._batches is None:
            self._batches = list(self.stream)
        rows = self._batches[0].num_rows
        batch, row = self._batches[at // rows], at % rows
        cut = slice(row * self.length, (row + 1) * self.length)
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[cut]
        return ids, batch.column(1).flatten().slice(cut.start, self.length)

    def ids_by_batch(self) -> Iterator[np.ndarray]:
        """The ids batch after batch, without padding. Uses the stream up: open the file anew for anything else."""
        for batch in self.stream:
            count = batch.column(1).flatten().true_count
            yield batch.column(0).flatten().to_numpy(zero_copy_only=True)[:count]


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row (id, start, n_tokens, ids_crc32) per document, from the files that the manifest names.

    start counts the ids of all documents before it over all files; the files' own starts come from running sums over
    the files of a part and over the parts. A document's ids pass through in batches, however long it is.
    """
    files = earlier(manifest, [F.col("number")], before=F.col("tokens"))
    tasks = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                yield _documents(TokenFile(folder, name), before)

    shape = f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    return in_tasks(files.select("file", "before").repartition(tasks, "file"), read, shape)


def _documents(file: TokenFile, before: int) -> pa.RecordBatch:
    starts = file.documents.column("start").to_numpy()
    ends = starts + file.documents.column("n_tokens").to_numpy()
    sums = np.zeros(len(starts), np.int64)
    at = offset = 0
    for ids in file.ids_by_batch():
        wide = ids.astype("<u4")
        while at < len(starts) and starts[at] < offset + len(wide):
            part = wide[max(0, starts[at] - offset) : ends[at] - offset]
            sums[at] = zlib.crc32(part.tobytes(), int(sums[at]))
            if ends[at] > offset + len(wide):
                break
            at += 1
        offset += len(wide)
    return pa.RecordBatch.from_arrays(
        [
            file.documents.column("id").combine_chunks(),
            pa.array(starts + before),
            file.documents.column("n_tokens").combine_chunks(),
            pa.array(sums),
        ],
        ["id", "start", "n_tokens", "ids_crc32"],
    )


def token_folder(spark: SparkSession) -> str:
    """A fresh folder for token files below the shared folder."""
    return work_dir(spark, "tokens")
