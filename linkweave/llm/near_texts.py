"""Near-duplicate texts by SimHash at a Jaccard similarity of word shingles, for which one fingerprint is too coarse.

Two texts at similarity J differ in each bit of a SimHash of their shingle sets with probability acos(2J / (1 + J)) / pi, so
at 0.8 in 15 % of them, while vantage-point trees prune only within a few bits. So texts get several short fingerprints
of bits of their own, few enough bits that near texts are often within ``simhash.DISTANCE``, and so many that a text has
``CHANCE`` chance partners at most in each. Their number is that which finds a pair at the similarity with probability
``RECALL``; both follow from the number of rows, as formulas, at every size.

All tables are searched by one forest of vantage-point trees, as a table's number stands in code words three bits apart
beside its bits. Candidates must also be near in 64 other bits, which chance partners seldom are. Each component of
candidates is then verified by exact Jaccard similarity, in buckets and blocks as paragraphs are.

Defined cases: equal texts (words, in any case, between any spaces) are one from the start; null and empty texts and
those without words are equal to each other; a text shorter than a shingle is one shingle; a very long text is counted in
chunks, its words held at once; an empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.components import connected_components
from linkweave.llm.hot import join_unique, sieve
from linkweave.llm.simhash import DISTANCE, links
from linkweave.llm.substring_dedup import SHINGLE, SIMILARITY, _mix, line_links, windows, word_hashes
from linkweave.runtime import beside, settle, ship

RECALL, CHANCE, DEVIATIONS = 0.95, 2.0, 3.6
#: Bits of a table at least and at most, shingles counted at once, and members of a shard: large, as short fingerprints lie
#: near many boundaries, and each further level of the tree copies a quarter of them.
LEAST_BITS, MOST_BITS, CHUNK, SHARD = 16, 40, 1 << 15, 1 << 17

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def differing(similarity: float) -> float:
    """The probability that a bit differs."""
    return acos(2 * similarity / (1 + similarity)) / pi


def within(bits: int, p: float, distance: int = DISTANCE) -> float:
    """The probability that at most ``distance`` of ``bits`` differ."""
    return sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(distance + 1))


def plan(rows: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a table, tables) for so many rows."""
    bits = next(b for b in range(LEAST_BITS, MOST_BITS + 1) if b == MOST_BITS or rows * within(b, 0.5) <= CHANCE)
    return bits, ceil(log(1 - recall) / log(1 - within(bits, differing(similarity))))


def code_words(n: int) -> list[int]:
    """``n`` numbers of which any two differ in three bits at least: each bit of a counter, three times."""
    return [sum(((k >> b) & 1) * 0b111 << 3 * b for b in range(8)) for k in range(n)]


def simhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` 64-bit SimHashes of distinct shingle hashes, each by bits of its own."""
    out = np.zeros(n, np.uint64)
    for k in range(n if len(shingles) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(shingles), CHUNK):
            h = _mix(shingles[at : at + CHUNK] + np.uint64((k + 1) * int(_BASE) % (1 << 64)))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)[0]
    return out


def prints(texts: DataFrame, bits: int, tables: int) -> DataFrame:
    """From (row, text): (row, h1, h2, beside, fps): a digest of the words, a SimHash, and the tables' fingerprints."""
    each = 64 // bits
    words = [k // each for k in range(tables)]
    marks = np.array(code_words(tables), np.uint64) << np.uint64(bits)
    shifts = np.array([k % each * bits for k in range(tables)], np.uint64)
    mask = np.uint64((1 << bits) - 1)

    def run(batches):
        for batch in batches:
            digests, others, fps = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                own = (text.as_py() or b"").translate(_LOWER).split()
                digests.append(xxhash.xxh3_128_intdigest(b" ".join(own)))
                hashes = word_hashes(own)
                made = simhashes(np.unique(windows(hashes, min(SHINGLE, len(own)), _BASE)) if own else np.empty(0, np.uint64), words[-1] + 2)
                others.append(made[-1])
                fps.append((made[words] >> shifts & mask) + marks)
            d = np.array([(x >> 64, x & (1 << 64) - 1) for x in digests], np.uint64).view(np.int64).reshape(-1, 2)
            flat = np.concatenate(fps).view(np.int64) if fps else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, tables), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.array(others, np.uint64).view(np.int64)), lists], names=["row", "h1", "h2", "beside", "fps"]
            )

    return texts.mapInArrow(run, "row long, h1 long, h2 long, beside long, fps array<bigint>")


def candidate_pairs(nodes: DataFrame, tables: int, most: int) -> DataFrame:
    """Edges (a, b) of nodes from (node, beside, fps) that are near in a table and in the bits beside."""
    tall = nodes.select("node", "beside", F.explode("fps").alias("fp"))
    # One node stands for all of a table's equal fingerprints; others are held against it.
    groups = settle(tall.groupBy("fp").agg(F.min(F.struct("node", "beside")).alias("x"), F.count("*").alias("n")).select("fp", F.col("x.node").alias("head"), F.col("x.beside").alias("of_head"), "n"), "table-fingerprints")
    often = groups.filter("n > 1")
    star = join_unique(sieve(tall, "fp", often), often, "fp").filter(f"node <> head AND bit_count(beside ^ of_head) <= {most}").select(F.col("head").alias("a"), F.col("node").alias("b"))
    met = settle(links(groups.select("fp", F.col("of_head").alias("beside")), DISTANCE, most, SHARD), "table-links")
    head = groups.select("fp", "head")
    ends = met.join(head.withColumnsRenamed({"fp": "a", "head": "x"}), "a").join(head.withColumnsRenamed({"fp": "b", "head": "y"}), "b")
    return star.unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))


def groups(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """From settled (row, text): (row, group), the same for near-duplicates and copies, over links."""
    ship(rows.sparkSession)
    bits, tables = plan(max(1, rows.count()), similarity)
    p = differing(similarity)
    most = min(64, int(64 * p + DEVIATIONS * sqrt(64 * p * (1 - p))))
    found = settle(prints(rows.select("row", "text"), bits, tables), "near-prints")
    nodes = found.groupBy("h1", "h2").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    nodes = settle(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "near-nodes")
    heads = found.select("row", "beside", "fps").join(nodes.select(F.col("first").alias("row"), "node"), "row")
    parts = settle(connected_components(candidate_pairs(settle(heads.select("node", "beside", "fps"), "near-heads"), tables, most)), "candidate-parts")

    def text_of(ids: DataFrame) -> DataFrame:
        wanted = settle(nodes.join(ids.withColumnRenamed("id", "node"), "node", "left_semi").select(F.col("first").alias("row"), F.col("node").alias("id")), "wanted-texts")
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        texts = sieve(rows.select("row", "text"), "row", wanted).join(wanted, "row")
        return texts.select("id", F.translate(F.coalesce("text", F.lit("")), upper, lower).cast("binary").alias("line"))

    keys = parts.select(F.lit(0).alias("band"), F.col("component").alias("key"), F.col("node").alias("id"))
    near = settle(connected_components(line_links(keys, text_of, similarity)), "near-parts")
    named = nodes.join(near, "node", "left").select("h1", F.col("h2").alias("second"), F.coalesce("component", "node").alias("group"), "n")
    return join_unique(found.select("row", "h1", "h2"), settle(named, "near-groups"), "h1").filter("h2 = second").select("row", "group")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, and one of its copies if rows repeat.

    Columns stay as they were. A row with a null id stays only where a group has no other.
    """
    plain, at = beside(docs)
    table = settle(plain.withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    of = settle(groups(table.select("row", at[text_col].alias("text")), similarity), "row-groups")
    who = table.select("row", at[id_col].alias("id")).join(of, "row").select("group", F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row")).alias("who"))
    first = who.groupBy("group").agg(F.min("who").alias("who")).select(F.col("who.row").alias("row"))
    return table.join(first, "row", "left_semi").drop("row").toDF(*docs.columns)
