"""TF-IDF in long form: document frequencies, weights, top-k by shared tokens, fillers.

Groups (countries) are part of every key; nothing is a matrix and nothing reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.runtime import apart, let, settle

#: Targets of a group that may have a token before it's dropped, and pairs of a token that one task works off.
MAX_DF, PAIRS = 20000, 1 << 22
#: Weights of a side that make a block of a search.
BLOCK = 1 << 18


# Tokens are exploded with ``explode_outer``: for ``explode`` the optimiser adds a filter on their number, which makes them twice.


def term_counts(docs: DataFrame) -> DataFrame:
    """From (grp, id, tokens): (grp, id, token, tf)."""
    tall = docs.select("grp", "id", F.explode_outer("tokens").alias("token")).filter("token IS NOT NULL")
    return tall.groupBy("grp", "id", "token").agg(F.count("*").alias("tf"))


def _with_mark(tokens) -> Column:
    """Distinct tokens and the empty one, which no text has: its frequency is the number of documents."""
    return F.explode_outer(F.concat(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>"))), F.array(F.lit("")))).alias("token")


def document_frequency(docs: DataFrame) -> DataFrame:
    """From (grp, id, tokens): (grp, token, df, n, share); n counts the group's documents. Texts are read once.

    With a column ``times`` a row stands for so many documents of the same text.
    """
    times = F.sum("times") if "times" in docs.columns else F.count("*")
    rows = docs.select("grp", _with_mark(F.col("tokens")), *[c for c in ("times",) if c in docs.columns])
    counts = settle(rows.groupBy("grp", "token").agg(times.alias("df")), "token-counts")
    n = counts.filter("token = ''").select("grp", F.col("df").alias("n"))
    return counts.filter("token <> ''").join(n, "grp").withColumn("share", F.col("df") / F.col("n"))


def _idf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def idf(docs: DataFrame, max_df: int | None = None) -> DataFrame:
    """(grp, token, idf) of tokens in at most ``max_df`` of a group's documents: ln((1+n)/(1+df)) + 1."""
    found = document_frequency(docs)
    if max_df is not None:
        found = found.filter(F.col("df") <= max_df)
    return found.select("grp", "token", _idf(F.col("n"), F.col("df")).alias("idf"))


def weights(docs: DataFrame, idf_of: DataFrame) -> DataFrame:
    """(grp, id, token, w): (1 + ln tf) * idf, normalised per document over the tokens that idf has."""
    w = term_counts(docs).join(idf_of, ["grp", "token"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("grp", "id")))
    return w.select("grp", "id", "token", (F.col("w") / norm).alias("w"))


def fitted(first: DataFrame, targets: DataFrame, max_df: int = MAX_DF, most: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """Weights (grp, id, token, w, strips) of both sides, by the targets' frequencies of tokens in at most ``max_df`` of them.

    Texts are read and counted once. ``strips`` tells in how many parts a token's pairs are worked off, of ``most`` each:
    a posting list has ``max_df`` targets at most, but any number of first entities may have its token.
    """
    side = lambda df, k: df.select("grp", F.lit(k).alias("side"), "id", "tokens")
    tall = side(first, 1).unionByName(side(targets, 2)).select("grp", "side", "id", F.explode_outer("tokens").alias("token")).filter("token IS NOT NULL")
    counts = settle(tall.groupBy("grp", "side", "id", "token").agg(F.count("*").alias("tf")), "term-counts")
    n = targets.groupBy("grp").agg(F.count("*").alias("n"))
    df = counts.groupBy("grp", "token").agg(F.count_if(F.col("side") == 1).alias("qf"), F.count_if(F.col("side") == 2).alias("df"))
    known = df.filter(F.col("df").between(1, max_df)).join(n, "grp").select(
        "grp", "token", _idf(F.col("n"), F.col("df")).alias("idf"), F.greatest(F.lit(1), F.ceil(F.col("qf") * F.col("df") / most)).cast("int").alias("strips")
    )
    w = counts.join(known, ["grp", "token"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("grp", "side", "id")))
    out = settle(w.select("grp", "side", "id", "token", (F.col("w") / norm).alias("w"), "strips"), "weights")
    return out.filter("side = 1").drop("side"), out.filter("side = 2").drop("side")


def similarity(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """From weights of both sides: (grp, q, d, score) of pairs that share a token. Sums begin before the shuffle.

    With ``strips`` (of ``fitted``) a token's queries are dealt over so many tasks, and its targets go to each.
    """
    strips = F.col("strips") if "strips" in queries.columns else F.lit(1)
    q = queries.select("grp", F.col("id").alias("q"), "token", F.col("w").alias("wq"), F.pmod(F.xxhash64("id"), strips).cast("int").alias("strip"))
    d = targets.select("grp", F.col("id").alias("d"), "token", F.col("w").alias("wd"), F.explode(F.sequence(F.lit(0), strips - 1)).alias("strip"))
    return q.join(d, ["grp", "token", "strip"]).groupBy("grp", "q", "d").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))


def top_k(scored: DataFrame, k: int, least: float = 1e-6) -> DataFrame:
    """The k best targets of each query, ties by id; ``rank`` from 0. Spark prunes before the shuffle."""
    order = Window.partitionBy("grp", "q").orderBy(F.desc(F.round("score", 9)), "d")
    return scored.filter(F.col("score") > least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def search(queries: DataFrame, targets: DataFrame, k: int, block: int = BLOCK, least: float = 1e-6) -> DataFrame:
    """``top_k`` of ``similarity``, with pairs summed where they're ranked, so that none but the best are ever shuffled.

    Both sides are dealt by id in blocks of some ``block`` weights. Each pair of blocks of a group is one task, which
    sums a query's products over the posting lists of its tokens; partial results meet in a window.
    """
    queries, targets = (df.select("grp", "id", "token", "w").toDF("grp", "id", "token", "w") for df in (queries, targets))  # may be one table
    blocks = lambda df, name: df.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = F.broadcast(blocks(queries, "nq").join(blocks(targets, "nd"), "grp"))  # a row for each group
    deal = lambda df, mine, n, other, m: df.join(sizes, "grp").select(
        "grp", F.pmod(F.xxhash64("id"), n).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other), "id", "token", "w"
    )
    q, d = deal(queries, "bq", F.col("nq"), "bd", "nd"), deal(targets, "bd", F.col("nd"), "bq", "nq")
    grp, one, two = (dict(df.dtypes)[c] for df, c in ((targets, "grp"), (queries, "id"), (targets, "id")))

    def coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        """The values in order, and each row's place among them."""
        values = pc.unique(column)
        values = values.take(pc.sort_indices(values))
        return values, pc.index_in(column, value_set=values).to_numpy()

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        tokens = pc.unique(b["token"])
        a = a.filter(pc.is_in(a["token"], value_set=tokens))
        a_ids, of_a = coded(a["id"])
        b_ids, of_b = coded(b["id"])
        t, u = (pc.index_in(x["token"], value_set=tokens).to_numpy() for x in (a, b))
        by = np.argsort(u, kind="stable")
        lists = np.split(of_b[by], np.cumsum(np.bincount(u, minlength=len(tokens)))[:-1]) if len(tokens) else []
        products = np.split(b["w"].to_numpy()[by], np.cumsum([len(x) for x in lists])[:-1]) if len(tokens) else []
        by = np.argsort(of_a, kind="stable")
        t, w, ends = t[by], a["w"].to_numpy()[by], np.cumsum(np.bincount(of_a, minlength=len(a_ids)))
        out, at = [], 0
        for who, end in enumerate(ends.tolist()):
            s = np.zeros(len(b_ids))
            for x, y in zip(t[at:end].tolist(), w[at:end].tolist(), strict=True):
                s[lists[x]] += y * products[x]  # a list has each target once
            at = end
            found = np.flatnonzero(s >= max(np.partition(s, -k)[-k] - 1e-9, least)) if len(s) > k else np.flatnonzero(s)  # all that tie with the last
            found = found[np.lexsort((found, -np.round(s[found], 9)))[:k]]
            out.append((np.full(len(found), who), found, s[found]))
        i, j, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        first = b["grp"].chunk(0)[0] if len(b) else None
        return pa.table({"grp": pa.repeat(first, len(i)) if len(i) else b["grp"].slice(0, 0), "q": a_ids.take(pa.array(i)), "d": b_ids.take(pa.array(j)), "score": pa.array(s)})

    key = ["grp", "bq", "bd"]
    found = q.groupBy(*key).cogroup(d.groupBy(*key)).applyInArrow(best, f"grp {grp}, q {one}, d {two}, score double")
    return top_k(found, k, least)


def pair_cosine(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Scores of given pairs (grp, q, d), 0 where they share no token."""
    q = queries.select("grp", F.col("id").alias("q"), "token", F.col("w").alias("wq"))
    d = targets.select("grp", F.col("id").alias("d"), "token", F.col("w").alias("wd"))
    met = pairs.join(apart(q), ["grp", "q"]).join(apart(d), ["grp", "d", "token"]).groupBy("grp", "q", "d").agg(F.sum(F.col("wq") * F.col("wd")).alias("score"))
    return pairs.join(apart(met), ["grp", "q", "d"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _latin(docs: DataFrame) -> DataFrame:
    """Without documents of other scripts, and without tokens of digits alone."""
    text = F.array_join("tokens", " ")
    kept = docs.filter((F.octet_length(text) == F.length(text)) | text.rlike(r"^[\x00-\x7FÀ-ɏ\s]*$"))
    return kept.withColumn("tokens", F.filter("tokens", lambda t: F.translate(t, "0123456789", "") != ""))


def _shares(first: DataFrame, targets: DataFrame) -> DataFrame:
    """(grp, token, f1, f2): shares of the documents of both sides, in one pass over them."""
    side = lambda df, k: _latin(df).select("grp", F.lit(k).alias("side"), _with_mark(F.col("tokens")))
    count = lambda k: F.count_if(F.col("side") == k)
    counts = settle(side(first, 1).unionByName(side(targets, 2)).groupBy("grp", "token").agg(count(1).alias("c1"), count(2).alias("c2")), "token-counts")
    n = counts.filter("token = ''").select("grp", F.col("c1").alias("n1"), F.col("c2").alias("n2"))
    share = lambda k: F.when(F.col(f"c{k}") > 0, F.col(f"c{k}") / F.col(f"n{k}")).otherwise(1e-6).alias(f"f{k}")
    return counts.filter("token <> ''").join(n, "grp").select("grp", "token", share(1), share(2))


def fillers(first: DataFrame, targets: DataFrame, least: float = 0.001, times: float = 1.8) -> DataFrame:
    """(grp, token, f1, f2): tokens of at least ``least`` of targets, ``times`` as frequent there as in the first source."""
    return _shares(first, targets).filter((F.col("f2") >= least) & (F.col("f2") >= times * F.col("f1")))


def excess_fillers(first: DataFrame, targets: DataFrame, excess: float = 0.004, times: float = 1.15, common: float = 0.005) -> DataFrame:
    """As fillers, against the median ratio of common tokens: f2 - shrink * f1 >= excess and f2 >= times * shrink * f1."""
    both = _shares(first, targets)
    shrink = both.filter(F.col("f1") > common).groupBy("grp").agg(F.median(F.col("f2") / F.col("f1")).alias("shrink"))
    met = both.join(shrink, "grp", "left").withColumn("shrink", F.coalesce("shrink", F.lit(1.0)))
    scaled = F.col("shrink") * F.col("f1")
    return met.filter((F.col("f2") - scaled >= excess) & (F.col("f2") >= times * scaled))


def without_fillers(tokens, found):
    """Tokens not in the array ``found``; all of them, if none is left.

    The fillers that occur are found first, by hashing, so that each token is held against those few.
    """
    none = F.array().cast("array<string>")

    def of(t, gone):
        return let(F.filter(t, lambda x: ~F.array_contains(gone, x)), lambda kept: F.when(F.size(kept) == 0, t).otherwise(kept))

    return let(tokens, lambda t: let(F.array_intersect(t, F.coalesce(found, none)), lambda gone: of(t, gone)))
