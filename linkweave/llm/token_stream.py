"""Token-ID output as Arrow stream files of fixed-size lists, with zero-copy random access.

Documents are dealt by ascending id over files. In a file the ids of all its documents, each with its end id, run on and
are cut into sequences of equal length: batches of fixed-size lists of ids (16 bits wide where the vocabulary allows)
and of masks of bits (eight to a byte, the lowest first), 0 for the padding of the last sequence. All batches but the
last have equal byte lengths, so a sequence's place follows from its number: nothing before it is read, and ids and
masks of a mapped file are views of it. (A byte for each id in the masks would take half as much again as the ids: 2.98
in place of 2.44 times the input on disk, measured.) A second stream, ``.index``, has each document's place. Files are written under a temporary name and
renamed, so that a task may run again. What reaches the driver is one row for each file.

Defined cases: a null text counts as empty and has the end id alone; a text longer than a batch runs over several, and is
read back a batch at a time; null ids go first; rows with equal ids follow each other, by their text's hash; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.tokens import encoder, vocabulary
from linkweave.runtime import fresh_path, pick, ship

TOKENIZER, END, LENGTH = "word_bpe_49k.json", 2, 2048
#: Sequences of a batch, and bytes of input (as the plan's statistics have it) for which there's a file at least.
BATCH, FILE_BYTES = 256, 256 << 20
#: Bytes after the last batch of a stream.
_CLOSING = 8


class SequenceWriter:
    """Appends ids to a stream file of fixed-size lists."""

    def __init__(self, sink, length: int = LENGTH, width: int = 2, batch: int = BATCH):
        self.length, self.batch = length, batch
        self.type = pa.uint16() if width == 2 else pa.uint32()
        self.dtype = np.uint16 if width == 2 else np.uint32
        self.schema = pa.schema(
            [pa.field("input_ids", pa.list_(pa.field("item", self.type, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.uint8(), False), -(-length // 8)), False)],
            metadata={"length": str(length), "batch": str(batch)},
        )
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.written = 0

    def _emit(self, ids: np.ndarray, real: int) -> None:
        mask = np.packbits((np.arange(len(ids)) < real).reshape(-1, self.length), axis=1, bitorder="little").ravel()
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), type=f.type) for x, t, f in zip((ids, mask), (self.type, pa.uint8()), self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def append(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.dtype))
        self.held += len(ids)
        full = self.length * self.batch
        if self.held >= full:
            every = np.concatenate(self.parts)
            for k in range(0, len(every) - full + 1, full):
                self._emit(every[k : k + full], full)
            self.parts = [every[len(every) // full * full :]]
            self.held = len(self.parts[0])

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.parts)
            self._emit(np.pad(ids, (0, -len(ids) % self.length)), len(ids))
        self.out.close()


class Sequences:
    """Random access to a stream file of ``size`` bytes by sequence number, without a copy if ``source`` is mapped."""

    def __init__(self, source, size: int):
        self.source = source
        self.schema = pa.ipc.open_stream(source).schema
        meta = self.schema.metadata
        self.length, self.per_batch = int(meta[b"length"]), int(meta[b"batch"])
        self.first = source.tell()
        self.room = size - _CLOSING - self.first  # of all batches
        self.held: tuple[int, pa.RecordBatch] | None = None
        self.step = 0
        if self.room > 0:
            self._batch(0)
            self.step = source.tell() - self.first

    def _batch(self, n: int) -> pa.RecordBatch:
        """The ``n``-th batch, the last one asked for being kept."""
        if self.held is None or self.held[0] != n:
            self.source.seek(self.first + n * self.step)
            self.held = n, pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        return self.held[1]

    def __len__(self) -> int:
        if not self.step:
            return 0
        last = -(-self.room // self.step) - 1
        return last * self.per_batch + self._batch(last).num_rows

    def views(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Views of the ids and of the mask's bytes of a sequence."""
        batch, row = self._batch(n // self.per_batch), n % self.per_batch
        return tuple(batch.column(k).slice(row, 1).flatten().to_numpy(zero_copy_only=True) for k in (0, 1))

    def __getitem__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A view of the ids of a sequence, and its mask as truth values."""
        ids, bits = self.views(n)
        return ids, np.unpackbits(bits, count=self.length, bitorder="little").view(bool)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of ``n`` ids from the ``start``-th of the file on, one for each batch that they lie in."""
        whole = self.length * self.per_batch
        while n:
            at = start % whole
            part = self._batch(start // whole).column(0).flatten().to_numpy(zero_copy_only=True)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def _bytes(rows: DataFrame) -> int:
    """Bytes of input, by the plan's statistics; those of the text, counted, where these know nothing."""
    known = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END, length: int = LENGTH) -> list[tuple[int, str, int, int]]:
    """Write ``docs`` below ``folder`` (a URI); (number, file, documents, ids) of each file, in order of ids.

    What comes back has one row for a file, not for a document.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or vocabulary(TOKENIZER)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("tie", F.xxhash64("text")).withColumn("at", F.monotonically_increasing_id())
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes(rows) // FILE_BYTES))
    # The last two keys spread rows of one id over files, still in order.
    order = ["doc_id", "tie", "at"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        encode = encoder(path)
        wide = encode.tokenizer.get_vocab_size() > 1 << 16
        context = TaskContext.get()
        number = context.partitionId()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        name = f"{base}/part-{number:06d}"
        fs.create_dir(base, recursive=True)
        mine = f"{base}/.part-{number:06d}.{context.taskAttemptId()}"
        n_docs = n_ids = 0
        with fs.open_output_stream(mine + ".arrows") as sink, fs.open_output_stream(mine + ".index") as index_sink:
            writer, index = SequenceWriter(sink, length, 4 if wide else 2), None
            for batch in batches:
                starts, sizes = [], []
                for text in batch.column("text"):
                    ids = np.append(np.frombuffer(encode(text.as_py() or ""), "<u4"), np.uint32(end))
                    writer.append(ids)
                    starts.append(n_ids)
                    sizes.append(len(ids))
                    n_ids += len(ids)
                n_docs += batch.num_rows
                rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "start", "n_tokens"])
                index = index or pa.ipc.new_stream(index_sink, rows.schema)
                index.write_batch(rows)
            writer.close()
            if index:
                index.close()
        if n_docs:
            fs.move(mine + ".arrows", name + ".arrows")
            fs.move(mine + ".index", name + ".index")
            yield pa.RecordBatch.from_pydict({"part": [number], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})
        else:
            fs.delete_file(mine + ".arrows")
            fs.delete_file(mine + ".index")

    made = dealt.mapInArrow(run, "part long, file string, n_docs long, n_ids long").collect()
    return sorted((r.part, r.file, r.n_docs, r.n_ids) for r in made)


def read(spark, folder: str, files: list[tuple[int, str, int, int]], id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all files' documents before it), n_tokens, ids_crc32."""
    ship(spark)
    before, rows = 0, []
    for _, file, _, n_ids in files:
        rows.append((file, before))
        before += n_ids
    table = spark.createDataFrame(rows, "file string, before long")

    def run(batches):
        fs = pa.fs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for file, offset in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with fs.open_input_file(file + ".arrows") as source, fs.open_input_file(file + ".index") as index:
                    sequences = Sequences(source, source.size())
                    for docs in pa.ipc.open_stream(index):
                        crcs, begin = [], docs.column("start").to_numpy()
                        for at, size in zip(begin.tolist(), docs.column("n_tokens").to_pylist(), strict=True):
                            crc = 0
                            for ids in sequences.ids(at, size):
                                crc = zlib.crc32(ids.astype("<u4"), crc)
                            crcs.append(crc)
                        yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(begin + offset), docs.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row for each file: the files, not the rows, are the work.
    return table.repartition(max(1, len(rows))).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_path(spark, "token-stream")
    return read(spark, folder, write(docs, folder), dict(docs.dtypes)["doc_id"])
