"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by the leading bits of a key's hash. It starts as one bucket; a bucket over the byte limit
splits on one more bit, others stay. Levels are worked off 16 at a time: bytes are summed by 16 further bits (a hash
aggregate with map-side combine, at most 65,536 rows a bucket), and each prefix sum gives the depth at which a bucket
first fits. Only buckets still over the limit go on to the next 16 bits.

Rows whose keys have the same hash can't be told apart by bits. If such rows exceed the limit they are dealt over
overflow shards, ``<prefix>+<n>``, by running sums of bytes, as bounded pieces of the table and never as one group.

Defined cases: a null key hashes like the empty string; a null text has 0 bytes; repeated rows each count; a row larger
than the limit has a shard by itself; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.runtime import pick, settle

#: Bits of the hash in use, and how many are worked off at once.
BITS, STEP = 64, 16
#: Bytes of text that a shard may hold, by default. Small, as a shard is the unit that a reader fetches at random.
LIMIT = 1 << 20


def hash_bits(key: Column) -> Column:
    """64 characters 0 or 1: the leading bits of the key's MD5."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4)
    spread = F.concat(*[F.lpad(F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(BITS // 32)])
    return spread


def directory(sizes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """From (bits, n_bytes): the leaf buckets (prefix) that fit, and those of all 64 bits that don't."""
    open_rows, leaves = sizes.withColumn("prefix", F.lit("")), None
    for start in range(0, BITS, STEP):
        cells = open_rows.groupBy("prefix", F.substring("bits", start + 1, STEP).alias("next")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")
        )
        levels = range(0 if start == 0 else 1, STEP + 1)
        sums = (
            cells.select("prefix", "next", "n_bytes", "n_rows", F.explode(F.array(*[F.lit(k) for k in levels])).alias("k"))
            .groupBy("prefix", F.expr("substring(next, 1, k)").alias("more"))
            .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))
            .select(F.concat("prefix", "more").alias("prefix"), "n_bytes", "n_rows")
        )
        # A bucket exists where the one above it is over the limit; it's a leaf where it isn't itself.
        over = F.col("n_bytes") > limit
        sums = settle(sums, "shard-directory")
        parents = sums.filter(over & (F.length("prefix") < start + STEP)).select(F.col("prefix").alias("above"))
        is_root = (F.length("prefix") == 0) if start == 0 else F.lit(False)
        children = sums.filter(F.length("prefix") > (0 if start == 0 else start))
        known = children.join(parents, F.expr("substring(prefix, 1, length(prefix) - 1)") == F.col("above"), "left_semi")
        if start:
            # the first level of a later step hangs below buckets found over the limit in the step before
            first = children.filter(F.length("prefix") == start + 1)
            known = known.filter(F.length("prefix") > start + 1).unionByName(first)
        fits = known.filter(~over).unionByName(sums.filter(is_root & ~over))
        leaves = fits if leaves is None else leaves.unionByName(fits)
        still = sums.filter(over & (F.length("prefix") == start + STEP)).select(F.col("prefix").alias("full"))
        if still.isEmpty():
            return leaves, sizes.limit(0).select(F.lit("").alias("full"))
        open_rows = (
            open_rows.drop("prefix")
            .withColumn("prefix", F.substring("bits", 1, start + STEP))
            .join(still, F.col("prefix") == F.col("full"), "left_semi")
        )
    return leaves, still


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of ``df``: the id, ``n_bytes``, the hash's ``bits``, ``depth`` and ``shard`` (its prefix of bits)."""
    rows = settle(
        pick(df, doc_id=id_col, text=text_col).select(
            "doc_id", hash_bits(F.col("doc_id")).alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
        ),
        "shard-sizes",
    )
    leaves, full = directory(rows.select("bits", "n_bytes"), limit)
    # Leaves cover each hash once. Those up to the first step's depth span whole cells of 2^16; deeper ones are rare.
    leaves = settle(leaves.select("prefix"), "shard-leaves")
    shallow = leaves.filter(F.length("prefix") <= STEP)
    cells = shallow.select(
        "prefix",
        F.explode(F.sequence(F.lit(0), F.pow(F.lit(2.0), STEP - F.length("prefix")).cast("long") - 1)).alias("tail"),
    ).select(
        "prefix",
        F.concat("prefix", F.expr(f"right(lpad(conv(cast(tail as string), 10, 2), {STEP}, '0'), {STEP} - length(prefix))")).alias("cell"),
    )  # at most 2^16 rows by construction, so safe to broadcast
    cell = F.substring("bits", 1, STEP)
    at_once = rows.join(F.broadcast(cells), cell == F.col("cell"), "left").select("doc_id", "n_bytes", "bits", "prefix")
    done = at_once.filter(F.col("prefix").isNotNull())
    depths = [r[0] for r in leaves.filter(F.length("prefix") > STEP).select(F.length("prefix")).distinct().collect()]
    if depths:
        deep = at_once.filter(F.col("prefix").isNull()).drop("prefix")
        tries = deep.withColumn("try", F.explode(F.array(*[F.lit(d) for d in sorted(depths)])))
        hits = tries.join(
            leaves.filter(F.length("prefix") > STEP), F.expr("substring(bits, 1, try)") == F.col("prefix"), "inner"
        ).select("doc_id", "n_bytes", "bits", "prefix")
        done = done.unionByName(hits)
    out = done.select("doc_id", "n_bytes", "bits", F.length("prefix").alias("depth"), F.concat(F.lit("b"), F.col("prefix")).alias("shard"))
    if not full.isEmpty():
        out = out.unionByName(_overflow(rows.join(full, F.col("bits") == F.col("full"), "left_semi"), limit))
    return out


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Deal rows of one hash over shards by running bytes: within a file's partition, then over partitions' totals.

    ``rows`` are read from a settled table, so that partitions hold the same rows whenever they are computed again.
    Each partition fills shards of its own; within it, a row joins the shard where its running sum by halves falls:
    rows of at most half the limit share shards of less than the limit, larger rows stay alone.
    """
    part = rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    part = settle(part, "shard-overflow")
    big = F.col("n_bytes") * 2 > limit
    order = Window.partitionBy("bits", "part", "big").orderBy("at")
    run = part.withColumn("big", big).withColumn("before", F.sum("n_bytes").over(order) - F.col("n_bytes"))
    name = F.when(F.col("big"), F.concat(F.lit("l"), F.row_number().over(order))).otherwise(
        F.concat(F.lit("s"), F.floor(F.col("before") / F.lit(max(1, limit // 2))))
    )
    return run.select(
        "doc_id", "n_bytes", "bits", F.length("bits").alias("depth"),
        F.concat(F.lit("b"), F.col("bits"), F.lit("+"), F.col("part"), name).alias("shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "depth", "shard")


SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8) AS x FROM documents),
b AS (SELECT doc_id, n_bytes, ('0x' || x)::UBIGINT AS v FROM h),
p AS (SELECT k, CASE WHEN k = 0 THEN 0 ELSE v >> (32 - k) END AS prefix, sum(n_bytes) AS s
      FROM b, range(0, 33) AS r(k) GROUP BY 1, 2),
a AS (SELECT b.doc_id, b.n_bytes, b.v, min(p.k) AS depth
      FROM b JOIN p ON p.prefix = (CASE WHEN p.k = 0 THEN 0 ELSE b.v >> (32 - p.k) END) AND p.s <= {LIMIT}
      GROUP BY b.doc_id, b.n_bytes, b.v)
SELECT doc_id, n_bytes, depth::INTEGER AS depth,
       'b' || substr(right(repeat('0', 32) || bin(v), 32), 1, depth::INTEGER) AS shard
FROM a
"""
