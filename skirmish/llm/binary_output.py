"""Token ids as Arrow files of fixed-size lists, read back without copies.

Documents are sorted by id over range partitions. Each task encodes its
documents, joins their ids (an end id after each) and writes them as rows of
``length`` ids and as many mask bits into one Arrow IPC file, and where its
documents lie into a second one. All sequences have one length, so a place in
the ids is a row and an offset: a reader maps the file and takes views. The last
row of a file is filled up with zeros that the mask marks. Ids take 16 bits if
the vocabulary allows it, else 32.

Files are named anew by every attempt of a task, and a manifest lists those of
the attempts that counted; so tasks that run again do no harm.

Defined results: null texts are empty, documents without an id come first,
repeated rows are written as often as they come, an empty table has no files, a
very long text runs over as many rows as it needs, and other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path
from .tokens import encode_batches, encoder

LENGTH = 2048
ROWS = 256
_MANIFEST = "part int, ids_file string, docs_file string, n_docs long, n_ids long"


def _schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Cuts a stream of ids into rows and writes batches of them."""

    def __init__(self, sink, length: int, wide: bool):
        self.schema = _schema(length, wide)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.length, self.kind = length, np.uint32 if wide else np.uint16
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def _put(self, ids: np.ndarray, used: int) -> None:
        mask = np.arange(len(ids)) < used
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        self.total += len(ids)
        step = ROWS * self.length
        if self.size >= step:
            joined = np.concatenate(self.held)
            for at in range(0, len(joined) - step + 1, step):
                self._put(joined[at : at + step], step)
            rest = joined[len(joined) // step * step :]
            self.held, self.size = [rest], len(rest)

    def close(self) -> None:
        if self.size:
            ids = np.zeros(-(-self.size // self.length) * self.length, self.kind)
            ids[: self.size] = np.concatenate(self.held)
            self._put(ids, self.size)
        self.file.close()


def write(docs: DataFrame, tokenizer: str, folder: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents to ``folder`` (a URI that driver and executors reach) and return the manifest."""
    spark = docs.sparkSession

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = encoder(tokenizer).tokenizer.get_vocab_size() > 1 << 16
        part = TaskContext.get().partitionId()
        store, top = fs.FileSystem.from_uri(folder)
        name = f"{part:06d}-{uuid.uuid4().hex}"
        out, where, start = None, [], 0
        for rows, ids, sizes in encode_batches(batches, 1, tokenizer):
            if out is None:
                store.create_dir(top, recursive=True)
                sink = store.open_output_stream(f"{top}/ids-{name}.arrow")
                out = _Writer(sink, length, wide)
            out.add(ids)
            where.append(pa.RecordBatch.from_arrays([rows.column(0), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes)], ["doc_id", "start", "n_tokens"]))
            start += len(ids)
        if out is None:
            return
        out.close()
        sink.close()
        with store.open_output_stream(f"{top}/docs-{name}.arrow") as f, pa.ipc.new_file(f, where[0].schema) as w:
            for batch in where:
                w.write_batch(batch)
        row = [[part], [f"{folder}/ids-{name}.arrow"], [f"{folder}/docs-{name}.arrow"], [sum(b.num_rows for b in where)], [start]]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["part", "ids_file", "docs_file", "n_docs", "n_ids"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sent = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = sent.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(save, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


class Sequences:
    """One file of sequences; ids come as views of the mapped file."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _values(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.batch = k, self.reader.get_batch(k).column(0).values.to_numpy(zero_copy_only=True)
        return self.batch

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch = self.reader.get_batch(row // ROWS)
        at = row % ROWS
        return batch.column(0)[at].values.to_numpy(zero_copy_only=True), batch.column(1)[at].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, size: int) -> Iterator[np.ndarray]:
        """Views that together are the ids from a place on."""
        step = ROWS * self.length
        while size:
            k, at = divmod(start, step)
            view = self._values(k)[at : at + size]
            yield view
            start, size = start + len(view), size - len(view)


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: where each document's ids lie among all, and their checksum."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                sequences = Sequences(file["ids_file"])
                store, path = fs.FileSystem.from_uri(file["docs_file"])
                with store.open_input_file(path) as f, pa.ipc.open_file(f) as reader:
                    for k in range(reader.num_record_batches):
                        docs = reader.get_batch(k)
                        sums = []
                        for start, size in zip(docs.column(1).to_pylist(), docs.column(2).to_pylist(), strict=True):
                            crc = 0
                            for ids in sequences.ids(start, size):
                                crc = zlib.crc32(ids.astype("<u4").data, crc)
                            sums.append(crc)
                        start = pa.array(docs.column(1).to_numpy() + file["first"])
                        yield pa.RecordBatch.from_arrays([docs.column(0), start, docs.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a count of its own: by a column alone, adaptive execution would merge so few bytes into one task
    spread = files.repartition(max(1, manifest.count()))
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def output_folder(spark: SparkSession) -> str:
    """A new folder for files, as a URI, in the folder that the cluster shares."""
    path = new_path(spark, "sequences")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
