"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming distance by vantage-point trees.

A tree over a bounded sample of fingerprints deals all of them over shards: each node has a vantage point and a radius,
one inside and one outside child. The sample grows with the number of shards, and shards that turn out large are dealt
again by trees of their own. A fingerprint belongs to one leaf; where it lies within the link distance of a
boundary that it's inside of, it also visits the leaves beyond, so each pair within the distance meets in a leaf
(triangle inequality). A leaf is searched by a tree of its own in the same way, down to blocks that are compared whole.
The sample shapes the shards, never the result: every pair within the distance is found.

Equal fingerprints are one node from the start, and a leaf gives a spanning forest of its links, not all pairs.

Defined cases: a null or empty text has fingerprint zero, linked like any other; a very long text's shingles are counted
in chunks; repeated rows each give a row; an empty table gives no rows; of equal ids any may stay in ``keep_one``; a null
id is never a component's smallest id unless all its ids are null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.components import connected_components
from linkweave.llm.hot import join_unique
from linkweave.runtime import beside, pick, settle, ship

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Fingerprints for each shard that shape them, members that a shard should have, and the shards' number in powers of two.
SAMPLE, SHARD, LEAST_DEPTH, MOST_DEPTH = 16, 16384, 6, 16
#: Times its due rows from which a shard is dealt again; shards dealt again at once, and fingerprints that shape each one's tree.
LARGE, AT_ONCE, RESAMPLE = 8, 1024, 512
#: Members of a block that is compared whole, fingerprints compared with it at once, shingles counted at once.
BLOCK, ROWS, CHUNK = 256, 4096, 1 << 15

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=SEED)  # one shingle: its own majority
    shingles = (b" ".join(x) for x in zip(*[islice(words, k, None) for k in range(size)]))
    n, ones = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in islice(shingles, CHUNK)), np.uint64, min(CHUNK, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Per row: the id (as ``doc_id``) and ``fp``, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), size) for x in batch.column("text").cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _vantage(sample: np.ndarray, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The point among a few whose distances spread most, and their median as the radius; None if none divides."""
    best = None
    for x in sample[:: max(1, len(sample) // tries)][:tries]:
        d = np.bitwise_count(sample ^ x).astype(np.int64)
        radius = int(np.median(d))
        if not (d > radius).any():
            radius -= 1
        inside = (d <= radius).sum()
        if 0 < inside < len(d):
            score = d.std() * min(inside, len(d) - inside)
            if best is None or score > best[0]:
                best = score, x, radius
    return best and best[1:]


def _split(at: tuple, fp: np.ndarray, member: np.ndarray, distance: int) -> tuple[tuple, tuple]:
    """(index, member) of those that go inside and of those that go outside."""
    x, radius = at
    d = np.bitwise_count(fp ^ x).astype(np.int64)
    inside = d <= radius
    # Members cross the boundary outward only: of two members that it parts, the inner one visits the outer's side.
    goes_in = np.where(member, inside, d - distance <= radius)
    goes_out = np.where(member, ~inside | (d + distance > radius), d + distance > radius)
    a, b = np.flatnonzero(goes_in), np.flatnonzero(goes_out)
    return (a, member[a]), (b, member[b] & ~inside[b])


def shard_tree(sample: np.ndarray, depth: int) -> list:
    """Nodes (vantage point, radius, inside child, outside child); a child below zero is leaf -1 - child."""
    nodes: list = []
    leaves = 0

    def grow(part: np.ndarray, left: int) -> int:
        nonlocal leaves
        at = _vantage(part) if left and len(part) >= 4 else None
        if at is None:
            leaves += 1
            return -leaves
        me = len(nodes)
        nodes.append(None)
        d = np.bitwise_count(part ^ at[0])
        nodes[me] = (*at, grow(part[d <= at[1]], left - 1), grow(part[d > at[1]], left - 1))
        return me

    grow(sample, depth)
    return nodes


def route(nodes: list, fp: np.ndarray, distance: int, member: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, index, member) for every leaf that a fingerprint belongs to or visits; visitors stay visitors."""
    out, todo = [], [(0 if nodes else -1, np.arange(len(fp)), np.ones(len(fp), bool) if member is None else member)]
    while todo:
        node, index, member = todo.pop()
        if not len(index):
            continue
        if node < 0:
            out.append((np.full(len(index), -1 - node), index, member))
            continue
        x, radius, inner, outer = nodes[node]
        (a, am), (b, bm) = _split((x, radius), fp[index], member, distance)
        todo += [(inner, index[a], am), (outer, index[b], bm)]
    return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))


class Forest:
    """Union-find over positions, worked on by whole arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while True:
            up = self.root[r]
            if (up == r).all():
                self.root[x] = r
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.root, high, low)


def link_within(fp: np.ndarray, member: np.ndarray, distance: int, beside: np.ndarray | None = None, most: int = 64) -> np.ndarray:
    """The root position of each fingerprint after all links of a member with a member or visitor.

    With ``beside``, fingerprints of other bits, these must be within ``most`` bits too.
    """
    forest = Forest(len(fp))
    todo = [(np.arange(len(fp)), member)]
    while todo:
        index, own = todo.pop()
        n_own = int(own.sum())
        if not n_own or len(index) < 2:
            continue
        at = None
        if n_own > BLOCK:
            sample = fp[index[own]]
            at = _vantage(sample[:: max(1, n_own // 512)])
        if at is not None:
            (a, am), (b, bm) = _split(at, fp[index], own, distance)
            # Where most cross, as in a dense group, parting doesn't help: compare as one block instead.
            if max(len(a), len(b)) < 0.9 * len(index) or max(am.sum(), bm.sum()) < 0.6 * n_own:
                todo += [(index[a], am), (index[b], bm)]
                continue
        mine = index[own]
        for i in range(0, len(index), ROWS):
            rows = index[i : i + ROWS]
            for j in range(0, n_own, BLOCK):
                part = mine[j : j + BLOCK]
                x, y = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[part][None, :]) <= distance)
                if beside is not None:
                    near = np.bitwise_count(beside[rows[x]] ^ beside[part[y]]) <= most
                    x, y = x[near], y[near]
                forest.join(rows[x], part[y])
    return forest.find(np.arange(len(fp)))


def _divide(sample: np.ndarray, times: float, distance: int) -> list:
    """A tree for a shard so many times too large, none where parting doesn't help, as in a dense group."""
    tree = shard_tree(sample, max(1, min(7, int(np.ceil(np.log2(times))))))
    leaf = route(tree, sample, distance)[0]
    return tree if tree and np.bincount(leaf).max() <= 0.7 * len(sample) else []


def _dealt(nodes: DataFrame, distance: int, shard: int) -> DataFrame:
    """(leaf, fp, member) for every shard that a fingerprint belongs to or visits, with ``beside`` if ``nodes`` has it."""
    more = [c for c in nodes.columns if c == "beside"]
    schema = "leaf long, fp long, member boolean" + ", beside long" * len(more)
    n = nodes.count()
    depth = min(MOST_DEPTH, max(LEAST_DEPTH, int(np.ceil(np.log2(max(1, n) / shard)))))
    sample = nodes.orderBy(F.xxhash64("fp"), "fp").limit(max(8192, SAMPLE << depth)).toPandas()["fp"].to_numpy(np.int64)  # 2^20 at most
    tree = shard_tree(sample.view(np.uint64), depth)

    def deal(frames):
        for pdf in frames:
            fp = pdf["fp"].to_numpy(np.int64)
            leaf, index, member = route(tree, fp.view(np.uint64), distance)
            yield pd.DataFrame({"leaf": leaf, "fp": fp[index], "member": member} | {c: pdf[c].to_numpy()[index] for c in more})

    dealt = nodes.select("fp", *more).mapInPandas(deal, schema)  # cheaper dealt twice than written and then shuffled
    ready, following = [], (1 << depth) + 1
    for _ in range(16):  # each time shards shrink by a third or so
        large = dealt.groupBy("leaf").agg(F.count("*").alias("rows")).filter(F.col("rows") > LARGE * shard).orderBy(F.desc("rows"), "leaf").limit(AT_ONCE)
        sizes = {r.leaf: r["rows"] for r in large.collect()}
        if not sizes:
            break
        mine = F.col("leaf").isin(list(sizes))
        ready.append(dealt.filter(~mine))
        dealt = settle(dealt.filter(mine), "large-shards")
        share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, int((RESAMPLE << 20) / v) + 1)])
        drawn = dealt.filter(F.col("member") & (F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share[F.col("leaf")])).select("leaf", "fp").toPandas()
        trees, starts = {}, {}
        for k, rows in sizes.items():
            trees[k] = _divide(drawn["fp"][drawn["leaf"] == k].to_numpy(np.int64).view(np.uint64), rows / shard, distance)
            starts[k], following = following, following + 129
        dense = [k for k in sizes if not trees[k]]
        if dense:
            ready.append(dealt.filter(F.col("leaf").isin(dense)))

        def again(frames, trees=trees, starts=starts):
            for pdf in frames:
                for k, group in pdf.groupby("leaf"):
                    if trees[k]:
                        fp = group["fp"].to_numpy(np.int64)
                        leaf, index, member = route(trees[k], fp.view(np.uint64), distance, group["member"].to_numpy(bool))
                        yield pd.DataFrame({"leaf": starts[k] + leaf, "fp": fp[index], "member": member} | {c: group[c].to_numpy()[index] for c in more})

        dealt = settle(dealt.mapInPandas(again, schema), "shards")
    for part in ready:
        dealt = dealt.unionByName(part)
    return dealt


def links(nodes: DataFrame, distance: int = DISTANCE, most: int = 64, shard: int | None = None) -> DataFrame:
    """From distinct, settled ``fp`` longs: edges (a, b) that connect all fingerprints within ``distance`` of each other.

    Shards have some ``shard`` members. Where ``nodes`` has ``beside``, a fingerprint of other bits, linked ones must be within ``most`` of these too.
    """
    ship(nodes.sparkSession)
    held = "beside" in nodes.columns

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64)
        beside = pdf["beside"].to_numpy(np.int64).view(np.uint64) if held else None
        root = link_within(fp.view(np.uint64), pdf["member"].to_numpy(bool), distance, beside, most)
        linked = root != np.arange(len(fp))
        return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]})

    return _dealt(nodes, distance, shard or SHARD).groupBy("leaf").applyInPandas(search, "a long, b long")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row: ``doc_id``, ``fp`` and ``component_id``, the smallest id reachable over links."""
    rows = settle(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-nodes")
    joined = connected_components(links(nodes, distance))
    named = settle(joined.join(nodes, joined["node"] == nodes["fp"]).select("fp", "component", "least"), "fingerprint-components")
    label = settle(named.groupBy("component").agg(F.min("least").alias("label"), F.count("*").alias("n")), "component-labels")
    labelled = join_unique(named, label, "component").select("fp", "label")
    of_fp = settle(nodes.join(labelled, "fp", "left").select("fp", F.coalesce("label", "least").alias("component_id"), "n"), "fingerprint-labels")
    return join_unique(rows, of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, and one of its copies if rows repeat.

    Columns stay as they were. Where all ids of a group are null, one row stays.
    """
    plain, at = beside(docs)
    table = settle(plain.withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    rows = settle(fingerprints(table.withColumn("one", F.struct(at[id_col].alias("id"), F.col("row"))), "one", f"_{docs.columns.index(text_col)}"), "fingerprints")
    # The smallest struct has the smallest id; nulls go last, so that a null id stays only where there's no other.
    rows = rows.select("fp", F.struct(F.col("doc_id.id").isNull().alias("none"), F.col("doc_id.id").alias("id"), F.col("doc_id.row").alias("row")).alias("who"))
    nodes = settle(rows.groupBy("fp").agg(F.min("who").alias("who")), "fingerprint-nodes")
    joined = connected_components(links(nodes))
    named = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("component", "fp").alias("component"), "who")
    first = named.groupBy("component").agg(F.min("who").alias("who")).select(F.col("who.row").alias("row"))
    return table.join(first, "row", "left_semi").drop("row").toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
