"""Substring dedup: repeated paragraphs, by MinHash banding and exact verification, and their components.

Three kinds of paragraph. Lines of at least ``LINE`` words, with shorter lines in a row joined up to that size, are
compared by the Jaccard similarity of their five-word shingles: MinHash signatures in ``BANDS`` bands of ``ROWS`` rows
(a pair at 0.8 collides with probability 1 - (1 - 0.8^3)^6 = 0.986), colliding lines joined, and their exact Jaccard
verified. So are whole texts, whatever their size, with each other. Passages are windows
of ``PASSAGE`` words that begin where a window's hash is the least of ``PASSAGE`` windows in a row: whatever stretch of
2 * PASSAGE - 1 words two texts share, at any place, has a passage in common, which is verified by a second hash (edit
distance zero, 128 bits in all).

A text is stored once, with the places, digests and band keys of its paragraphs; nothing that occurs once leaves its
place: a bounded sieve holds back all but keys that may have a partner, and only those meet by a shuffle. Equal lines
(128 bits) are one from the start, so copies meet no bucket twice, and of buckets with the same members one is verified.
In a bucket each line looks for one link to each component met so far, and a bucket gives a spanning forest, not all
pairs. A bucket of more than ``BUCKET`` distinct lines or ``BUCKET_BYTES`` is dealt in blocks that share some ``HUBS`` of its lines; where
these don't connect all of it, the lines outside its largest component meet all its blocks. Each class of linked
paragraphs keeps its first (by row); others are removals. Documents that share a class are joined into components.

Defined cases: a null or empty text has no paragraphs and is its own class; a text of one word or more has one at least;
fewer than ``LINE`` words of short lines between two long ones are in no line; a very long text is one row, with memory
in proportion to it; repeated rows are copies of each other; of equal paragraphs in one text that at its first place
counts as first; a null id is a class's smallest only if all are null; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.llm.components import connected_components
from linkweave.llm.hot import join_unique, sieve
from linkweave.runtime import pick, settle, ship

SHINGLE, SIMILARITY = 5, 0.8
LINE, PASSAGE = 20, 25
BANDS, ROWS = 6, 3
#: Distinct lines, and their bytes, that are verified as one bucket, lines that the blocks of a larger one share, rows
#: worked on at once.
BUCKET, BUCKET_BYTES, HUBS, ROWS_AT_ONCE = 4000, 8 << 20, 8, 1000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(11)
#: MinHash permutations: odd multipliers, applied modulo 2^64, and offsets.
_MULTIPLIER = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSET = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` ** 0 … n - 1 modulo 2^64, kept from call to call up to the longest text."""
    held = _POWERS.get(base, np.ones(1, np.uint64))
    while len(held) < n:
        held = np.concatenate([held, held * (held[-1:] * np.uint64(base))])
        _POWERS[base] = held
    return held[:n]


class Runs:
    """Hashes of runs of words, from the words' hashes: a polynomial modulo 2^64, mixed, by differences of prefix sums."""

    def __init__(self, hashes: np.ndarray, base: np.uint64):
        self.base, self.n = int(base), len(hashes)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * _powers(pow(self.base, -1, 1 << 64), self.n), out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        if self.n < size:
            return np.empty(0, np.uint64)
        return _mix((self.sums[size:] - self.sums[: self.n + 1 - size]) * _powers(self.base, self.n)[size - 1 :])

    def at(self, places: np.ndarray, size: int) -> np.ndarray:
        return _mix((self.sums[places + size] - self.sums[places]) * _powers(self.base, self.n)[places + size - 1])


def windows(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    return Runs(hashes, base).all(size)


def selected(h: np.ndarray, width: int) -> np.ndarray:
    """Places of the least of each ``width`` hashes in a row (the last of equals); of all, if there are fewer."""
    if not len(h):
        return np.empty(0, np.int64)
    least, place, span = h, np.arange(len(h)), 1
    width = min(width, len(h))
    while span < width:
        step = min(span, width - span)
        right = least[step:] <= least[:-step]
        least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
        span += step
    return place[np.r_[True, place[1:] != place[:-1]]]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The distinct 64-bit hashes of five-word shingles (of the whole, if shorter), from the words' hashes."""
    return np.unique(windows(hashes, min(SHINGLE, len(hashes)), _BASES[0]))


def band_keys(low: np.ndarray) -> np.ndarray:
    """Signed 64-bit keys of the bands, a row for each signature, from signatures in columns."""
    low = low.reshape(BANDS, ROWS, -1)
    key = np.zeros((BANDS, low.shape[2]), np.uint64)
    for k in range(ROWS):
        key = _mix(key * _BASES[1] + low[:, k])
    return np.ascontiguousarray(key.T).view(np.int64)


def bands(sh: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of the signature."""
    return band_keys((sh[None, :] * _MULTIPLIER[:, None] + _OFFSET[:, None]).min(axis=1))[0].tolist()


def _bands_of(sh: np.ndarray, size: int, own: list[tuple[int, int]]) -> np.ndarray:
    low = np.empty((BANDS * ROWS, len(own) + 1), np.uint64)
    edges = np.array([x for a, n in own for x in (a, a + n - size + 1)], np.int64)
    x = np.full(len(sh) + 1, np.iinfo(np.uint64).max, np.uint64)
    for k in range(BANDS * ROWS):
        np.multiply(sh, _MULTIPLIER[k], out=x[:-1])
        x[:-1] += _OFFSET[k]
        low[k, 0] = x.min()
        if own:
            low[k, 1:] = np.minimum.reduceat(x, edges)[::2]
    return band_keys(low)


def text_bands(hashes: np.ndarray, own: list[tuple[int, int]]) -> list[list[int]]:
    """``bands`` of a text and of its disjoint, ascending (start, n) of at least ``SHINGLE`` words, in one pass."""
    size = min(SHINGLE, len(hashes))
    return _bands_of(windows(hashes, size, _BASES[0]), size, own).tolist()


def ranges(sizes: list[int]) -> list[tuple[int, int]]:
    """(start, n) in words of long lines and of short ones in a row, joined up to ``LINE`` words, from all lines' sizes.

    What is left at the end of such a row belongs to its last paragraph.
    """
    out: list[tuple[int, int]] = []
    at = held = 0
    joined = False  # whether the last paragraph is of this row of short lines

    def close():
        if held and joined:
            out[-1] = (out[-1][0], out[-1][1] + held)

    for n in sizes:
        if n >= LINE:
            close()
            out.append((at, n))
            held, joined = 0, False
        else:
            held += n
            if held >= LINE:
                out.append((at + n - held, held))
                held, joined = 0, True
        at += n
    close()
    return out


def jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _lists(counts: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _struct(**columns: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def paragraphs(docs: DataFrame) -> DataFrame:
    """From (doc_id, text), per row: row, doc_id, text (its words, in lower case, between single spaces), lines, passages.

    Rows are numbered here, in one pass with what's found in them. Lines, and the whole text beside them (kind 3), have
    start and n in words, a digest of 128 bits and band keys; passages have start and two hashes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = (np.empty(0, np.int64),) * 5 + (np.empty((0, BANDS), np.int64),)

    def of_text(data: bytes):
        every, sizes = [], []
        for line in data.translate(_LOWER).split(b"\n"):
            words = line.split()
            every += words
            sizes.append(len(words))
        if not every:
            return b"", none, none[:3]
        hashes, size, own = word_hashes(every), min(SHINGLE, len(every)), ranges(sizes)
        runs = Runs(hashes, _BASES[0])
        text = b" ".join(every)
        # Texts have digests of their own, so that no line is taken for a text.
        digests = [xxhash.xxh3_128_intdigest(text, 1), *(xxhash.xxh3_128_intdigest(b" ".join(every[a : a + n])) for a, n in own)]
        d = np.array([(x >> 64, x & (1 << 64) - 1) for x in digests], np.uint64).view(np.int64)
        at = np.array([(0, len(every)), *own], np.int64)
        first = runs.all(PASSAGE)
        places = selected(first, PASSAGE)
        second = Runs(hashes, _BASES[1]).at(places, PASSAGE)
        lines = np.array([3] + [0] * len(own)), at[:, 0], at[:, 1], d[:, 0], d[:, 1], _bands_of(runs.all(size), size, own)
        return text, lines, (places, first[places].view(np.int64), second.view(np.int64))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                made = [of_text(x.as_py() or b"") for x in some.column("text").cast(pa.binary())]
                what, start, n, h1, h2, keys = map(np.concatenate, zip(*(x[1] for x in made), strict=True))
                p_start, p1, p2 = map(np.concatenate, zip(*(x[2] for x in made), strict=True))
                flat = pa.array(keys.ravel())
                line = _struct(
                    kind=pa.array(what.astype(np.int8)), start=pa.array(start.astype(np.int32)), n=pa.array(n.astype(np.int32)), h1=pa.array(h1), h2=pa.array(h2),
                    bands=pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("row"), some.column("doc_id"), pa.array([x[0] for x in made], pa.binary()), _lists([len(x[1][0]) for x in made], line),
                        _lists([len(x[2][0]) for x in made], _struct(start=pa.array(p_start.astype(np.int32)), h1=pa.array(p1), h2=pa.array(p2))),
                    ],
                    names=["row", "doc_id", "text", "lines", "passages"],
                )

    numbered = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    return numbered.mapInArrow(run, f"row long, doc_id {kind}, text binary, lines array<struct<kind:tinyint,start:int,n:int,h1:bigint,h2:bigint,bands:array<bigint>>>, passages array<struct<start:int,h1:bigint,h2:bigint>>")


def verify(ids: list[int], lines: list[bytes], sides: list[int], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of a bucket's lines, or of two blocks of it (then only across): each line against components, until one links."""
    sets = [frozenset(shingles(word_hashes(x.split())).tolist()) for x in lines]
    groups: list[list[int]] = []
    out = []
    for k in range(len(ids)):
        linked = []
        for g, members in enumerate(groups):
            for m in members:
                if sides[k] != sides[m] or sides[k] == 2:
                    low, high = sorted((len(sets[k]), len(sets[m])))
                    if low >= similarity * high and jaccard(sets[k], sets[m]) >= similarity:
                        linked.append(g)
                        out.append((ids[k], ids[m]))
                        break
        merged = [k]
        for g in reversed(linked):
            merged = groups.pop(g) + merged
        groups.append(merged)
    return out


def _verify_sorted(batches, similarity: float):
    """``verify`` on each bucket of batches sorted by bucket; one call serves many buckets."""

    def links(rows: list) -> pa.RecordBatch:
        found = verify(*map(list, zip(*rows, strict=True)), similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    held, bucket = [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "x", "y", "id", "line", "side")]
        for key, x, y, *row in zip(*columns, strict=True):
            if (key, x, y) != bucket:
                if len(held) > 1:
                    yield links(held)
                held, bucket = [], (key, x, y)
            held.append(row)
    if len(held) > 1:
        yield links(held)


def _verified(rows: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Edges from (bucket, x, y, id, side) and (id, line)."""
    order = ["bucket", "x", "y"]
    met = rows.join(texts, "id").select(*order, "id", "line", "side")
    return met.repartition(*order).sortWithinPartitions(*order, "id").mapInArrow(lambda batches: _verify_sorted(batches, similarity), "a long, b long")


def line_links(keys: DataFrame, text_of, similarity: float = SIMILARITY) -> DataFrame:
    """From distinct (band, key, id): edges (a, b) between lines of at least the similarity.

    ``text_of`` maps a table of distinct ids to (id, line); only colliding lines are asked for.
    """
    keys = keys.select(F.xxhash64("band", "key").alias("bucket"), "id")
    sizes = settle(keys.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    met = settle(join_unique(sieve(keys, "bucket", sizes), sizes, "bucket"), "collisions")
    texts = settle(text_of(met.select("id").distinct()), "line-texts")
    met = settle(met.join(texts.select("id", F.octet_length("line").cast("long").alias("bytes")), "id"), "weighed")
    # Buckets with the same members are one; a set is known by its size and two hashes.
    sets = met.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("all"), F.bit_xor(F.xxhash64("id")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("t"))
    in_blocks = lambda n, size: F.greatest(F.ceil(n / BUCKET), F.ceil(size / BUCKET_BYTES)).cast("int")
    one = sets.groupBy("n", "all", "s", "t").agg(F.min("bucket").alias("bucket"))
    one = settle(one.select("bucket", "n", F.col("n").alias("size"), in_blocks(F.col("n"), F.col("all")).alias("blocks")), "buckets")
    met = settle(join_unique(met, one, "bucket"), "met")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(3), "id"), F.col("size")) < HUBS)
    inside = met.withColumn("x", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    edges = settle(_verified(inside.select("bucket", "x", F.col("x").alias("y"), "id", F.lit(2).alias("side")), texts, similarity), "line-links")
    big = met.filter("blocks > 1")
    if big.isEmpty():
        return edges
    # Lines outside the largest component of their bucket meet all blocks of it.
    named = big.join(connected_components(edges), F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id")).drop("node", "component")
    named = settle(named, "big-buckets")
    parts = named.groupBy("bucket", "part").agg(F.count("*").alias("of"), F.sum("bytes").alias("bytes"))
    largest = parts.groupBy("bucket").agg(F.max_by(F.struct("part", "of", "bytes"), "of").alias("x"), F.sum("of").alias("n"), F.sum("bytes").alias("all"))
    strips = in_blocks(F.col("n") - F.col("x.of"), F.col("all") - F.col("x.bytes"))
    largest = settle(largest.select("bucket", "n", F.col("x.part").alias("most"), strips.alias("strips")), "largest-parts")
    named = join_unique(named, largest, "bucket").filter("strips > 0")
    strip = F.pmod(F.xxhash64("id"), F.col("strips")).cast("int")
    outer = named.filter("part <> most").select("bucket", strip.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "id", F.lit(0).alias("side"))
    every = named.select("bucket", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("x"), block.alias("y"), "id", F.lit(1).alias("side"))
    return edges.unionByName(settle(_verified(outer.unionByName(every), texts, similarity), "line-links"))


def _slices(batches):
    """(id, line) from (text, starts, ns, h1s, h2s, wanted (id, h1, h2))."""
    for batch in batches:
        ids, out = [], []
        for text, start, n, h1, h2, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "n", "h1", "h2", "wanted")), strict=True):
            words = text.split(b" ")
            at = {(c, d): (a, b) for a, b, c, d in zip(start, n, h1, h2, strict=True)}
            for x in wanted:
                a, b = at[x["h1"], x["h2"]]
                ids.append(x["id"])
                out.append(b" ".join(words[a : a + b]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "line"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, repeats): rows (row, doc_id); repeats (row, start, n, kind, c1, c2, first): paragraphs of classes of several.

    (kind, c1, c2) is a class, and ``first`` the first row that has it.
    """
    ship(docs.sparkSession)
    every = settle(paragraphs(pick(docs, doc_id=id_col, text=text_col)), "paragraphs")
    lines = every.select("row", F.explode("lines").alias("x")).select("row", "x.*")
    distinct = lines.groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.min("row").alias("row"), F.min("kind").alias("kind"), *[F.min(F.get("bands", F.lit(k))).alias(f"b{k}") for k in range(BANDS)]
    )
    distinct = settle(distinct.select(F.monotonically_increasing_id().alias("id"), "*"), "lines")
    keys = distinct.select("id", "kind", F.posexplode(F.array(*[f"b{k}" for k in range(BANDS)])).alias("band", "key"))
    keys = keys.select("id", (F.col("band") + F.when(F.col("kind") == 3, BANDS).otherwise(0)).alias("band"), "key")  # texts meet texts

    def text_of(ids: DataFrame) -> DataFrame:
        wanted = distinct.select("id", "h1", "h2", "row").join(ids, "id", "left_semi").groupBy("row").agg(F.collect_list(F.struct("id", "h1", "h2")).alias("wanted"))  # of one text
        wanted = settle(wanted, "wanted-lines")
        texts = sieve(every.select("row", "text", *[F.col(f"lines.{c}").alias(c) for c in ("start", "n", "h1", "h2")]), "row", wanted)
        return texts.join(wanted, "row").mapInArrow(_slices, "id long, line binary")

    near = connected_components(line_links(keys, text_of))
    classes = distinct.select("id", "h1", "h2", "copies", "row").join(near, F.col("id") == F.col("node"), "left").withColumn("class", F.coalesce("component", "id"))
    whole = classes.groupBy("class").agg(F.sum("copies").alias("all"), F.min("row").alias("first"), F.count("*").alias("n")).filter("all > 1")
    whole = settle(whole.drop("all"), "line-classes")
    of_line = settle(join_unique(sieve(classes, "class", whole), whole, "class").select("h1", F.col("h2").alias("second"), "class", "first", F.col("copies").alias("n")), "repeated-lines")
    repeated = join_unique(sieve(lines.drop("bands"), "h1", of_line).withColumnRenamed("n", "size"), of_line, "h1").filter("h2 = second")
    repeated = repeated.select("row", "start", F.col("size").alias("n"), "kind", F.col("class").alias("c1"), F.lit(0).cast("long").alias("c2"), "first")

    passages = every.select("row", F.explode("passages").alias("x")).select("row", "x.*")
    often = settle(passages.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1"), "passage-hashes")
    met = settle(join_unique(sieve(passages, "h1", often), often, "h1"), "passages")
    shared = settle(met.groupBy("h1", F.col("h2").alias("second")).agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1"), "passage-classes")
    again = join_unique(met, shared, "h1").filter("h2 = second")
    again = again.select("row", "start", F.lit(PASSAGE).alias("n"), F.lit(1).cast("byte").alias("kind"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), "first")
    return every.select("row", "doc_id"), repeated.unionByName(again)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_repeated and n_removed paragraphs, spans to remove (words), class_id (smallest id reachable)."""
    rows, repeats = find(docs, id_col, text_col)
    repeats = settle(repeats, "repeats")
    nth = F.row_number().over(Window.partitionBy("row", "kind", "c1", "c2").orderBy("start"))
    gone = ~((F.col("first") == F.col("row")) & (F.col("nth") == 1))
    per_row = repeats.repartition("row").withColumn("nth", nth).groupBy("row").agg(
        F.count("*").alias("n_repeated"),
        F.sum(gone.cast("long")).alias("n_removed"),
        F.array_sort(F.collect_list(F.when(gone, F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n")).alias("end"))))).alias("removed"),
    )
    near = connected_components(repeats.select(F.col("row").alias("a"), F.col("first").alias("b")))
    base = settle(rows.join(near, rows["row"] == near["node"], "left").select("row", "doc_id", F.coalesce("component", "row").alias("class")), "row-classes")
    label = settle(base.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "class-labels")
    zero = F.lit(0).cast("long")
    return (
        join_unique(base, label, "class")
        .join(per_row, "row", "left")
        .select(
            "doc_id",
            F.coalesce("n_repeated", zero).alias("n_repeated"),
            F.coalesce("n_removed", zero).alias("n_removed"),
            F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
            "class_id",
        )
    )


def query(spark, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
