"""Best-fit packing of token sequences with a bounded number of open bins.

Open bins are kept by free space, in a bitset with one bit for each amount of space for which there is an open bin. A
piece goes to the bin with the least space that holds it: the lowest set bit from its length on. With all bins open, the
fullest closes first. Packers run side by side over shares of the pieces, dealt evenly whatever their ids, and take them
as they come, in lots of ``LOT`` pieces; a lot's long pieces are placed before its short ones (a lot of 1 is placing
strictly as they come). A packer holds one lot and its open bins, however large its share is.

Defined cases: a null text counts as empty and has the end id alone; a very long text is cut, its ids held at once; equal
lengths are placed in the order of their digests; repeated rows are packed each; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.tokens import encoder, vocabulary
from linkweave.runtime import pick, settle, ship

TOKENS, END = 2048, 0
TOKENIZER = "byte_bpe_50k.json"
#: Bins that a packer keeps open, pieces of a lot, and tokens of a packer's share: some 16 times as many bins as are open.
OPEN_BINS, LOT, SHARE = 1024, 1024, 2048 * 16384


class Packer:
    """``place(length)`` gives (sequence, offset); sequences are numbered from 0."""

    def __init__(self, capacity: int = TOKENS, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.spaces = 0  # bit s: there's an open bin with s tokens free
        self.n_open = self.n_bins = 0

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            self.spaces &= ~(1 << space)
        self.n_open -= 1
        return found

    def _put(self, number: int, space: int) -> None:
        if space:
            self.by_space[space].append(number)
            self.spaces |= 1 << space
            self.n_open += 1

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            number, space = self.n_bins, self.capacity
            self.n_bins += 1
        self._put(number, space - length)
        return number, self.capacity - space


def cut(n: int, capacity: int = TOKENS) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: a remainder goes first."""
    at = 0
    length = n % capacity or capacity
    while at < n:
        yield at, length
        at, length = at + length, capacity


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = TOKENS, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian 32-bit integers."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    path = tokenizer or vocabulary(TOKENIZER)
    last = int(end).to_bytes(4, "little")

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            who, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text")):
                data = encode(text.as_py() or "") + last
                for p, (at, size) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * at : 4 * (at + size)]
                    who.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column("doc_id").take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(parts: DataFrame, capacity: int = TOKENS, open_bins: int = OPEN_BINS, share: int = SHARE, lot: int = LOT) -> DataFrame:
    """``parts``, settled rows with a ``length`` of 1 to ``capacity``, with sequence_id and offset."""
    ship(parts.sparkSession)
    total = parts.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(1, -(-total // share))
    # An order that has nothing to do with lengths, so that a task that runs again packs alike.
    known = [c for c in ("doc_id", "piece", "ids_crc32") if c in parts.columns]
    dealt = parts.repartition(n).sortWithinPartitions(F.xxhash64(*known), *known) if known else parts.repartition(n)

    def run(batches):
        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            placed = np.empty((len(lengths), 2), np.int64)
            for at in range(0, len(lengths), lot):
                for k in at + np.argsort(-lengths[at : at + lot], kind="stable"):
                    placed[k] = packer.place(int(lengths[k]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base + placed[:, 0]), pa.array(placed[:, 1])],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"{name} {kind}" for name, kind in parts.dtypes)
    return dealt.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, with_ids: bool = False, **options) -> DataFrame:
    return pack(settle(pieces(docs, with_ids=with_ids, **options), "pieces"), options.get("capacity", TOKENS))


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
