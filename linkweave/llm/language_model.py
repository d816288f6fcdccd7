"""Language-model scores: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Counts of all training tokens are summed over the cluster. The model's classes are the ``CLASSES`` most frequent words,
the end of a text, ``BINS`` bins of the next ``LOOKUP`` words by falling frequency, each of about the same mass, and one
class for all other words; in a bin and in the last class a word's probability is its smoothed share of their counts. The
two words before predict the next: a context vector (their embeddings, each weighted by its place) times the
target's vector, plus a bias that begins as the log unigram probability.

Every partition trains on all its training documents, from parameters warmed up on a bounded sample; parameters are then
averaged, by number of tokens, in a tree of groups of ``FAN`` models. For scores the normaliser of every pair of context
words is tabulated by one matrix product, exp(A) @ exp(B + bias).T, so that each token's log-probability is normalised
exactly.

The ``LOOKUP`` most frequent words of at most ``WORD_BYTES`` bytes are broadcast with their counts, a bounded size. Other
words' counts reach their documents by a join. Where more words tie than there's room for, some of them, by a hash, are
in the lookup and others in the last class; the end always has its class.

Defined cases: a very long text is scored whole, with memory in proportion to it; a null text counts as empty and has the end token alone; a null id counts as the empty string (so it's held
out); repeated rows count and are scored each; with no training documents all words are unknown; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.runtime import pick, settle, ship

#: Words with a class of their own, bins of others, dimensions, noise samples to a batch and their weight, tokens to a batch.
CLASSES, BINS, DIMENSIONS, NOISE, RATIO, TOKENS = 2046, 64, 24, 128, 16, 2048
RATE = 0.07
#: Words whose counts are broadcast, their longest size; documents that warm up the model; models averaged at once.
LOOKUP, WORD_BYTES, WARM_DOCS, FAN = 200_000, 64, 2000, 32
#: Distinct words that a counting task holds before it hands them on.
HELD = 400_000
REST, LAST = 0, 1
END = b"\n"  # no word has white space

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c) over training documents, the end token among them."""

    def run(batches):
        counts: Counter = Counter()

        def full():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                if not is_held_out(doc_id):
                    counts.update(words_of(text.as_py()))
                    counts[END] += 1
                if len(counts) > HELD:
                    yield full()
        if counts:
            yield full()

    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class LogBilinear:
    """Parameters, their training and their tables."""

    def __init__(self, unigram: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7):
        rng = np.random.default_rng(seed)
        k = len(unigram)
        self.noise = unigram / unigram.sum()
        self.context = rng.normal(0, 0.1, (k, dimensions)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (k, dimensions)).astype(np.float32)
        self.places = np.ones((2, dimensions), np.float32)
        self.places[1] = 0.5
        self.bias = np.log(self.noise).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.target, self.places, self.bias)])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for name in ("context", "target", "places", "bias"):
            old = getattr(self, name)
            setattr(self, name, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    @staticmethod
    def _add(values: np.ndarray, spent: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
        """A step of Adagrad on the rows named, gradients of one row summed first."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        total, rows = np.add.reduceat(grads[order], starts, axis=0), rows[starts]
        spent[rows] += total * total
        values[rows] += rate * total / np.sqrt(spent[rows])

    def train(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, rng: np.random.Generator, spent: dict) -> None:
        """One step on tokens ``w`` after ``b``, after ``a`` (class numbers): ascend the NCE objective."""
        if not spent:
            spent |= {n: np.full(getattr(self, n).shape, 1.0, np.float32) for n in ("context", "target", "bias", "places")}
            spent["cdf"] = np.cumsum(self.noise)
        noise = np.minimum(np.searchsorted(spent["cdf"], rng.random(NOISE)), len(self.noise) - 1)
        rb, ra = self.context[b], self.context[a]
        h = rb * self.places[0] + ra * self.places[1]
        log_noise = np.log(RATIO * self.noise).astype(np.float32)
        tw, tn = self.target[w], self.target[noise]
        pos = np.einsum("ij,ij->i", h, tw) + self.bias[w] - log_noise[w]
        neg = h @ tn.T + (self.bias[noise] - log_noise[noise])
        g = 1 / (1 + np.exp(pos))
        gn = -(RATIO / NOISE) / (1 + np.exp(-neg))
        dh = g[:, None] * tw + gn @ tn
        rows = np.concatenate([w, noise])
        self._add(self.target, spent["target"], rows, np.concatenate([g[:, None] * h, gn.T @ h]), RATE)
        self._add(self.bias[:, None], spent["bias"][:, None], rows, np.concatenate([g, gn.sum(axis=0)])[:, None], RATE)
        self._add(self.context, spent["context"], np.concatenate([b, a]), np.concatenate([dh * self.places[0], dh * self.places[1]]), RATE)
        step = np.stack([(dh * rb).sum(axis=0), (dh * ra).sum(axis=0)])
        spent["places"] += step * step
        self.places += RATE * step / np.sqrt(spent["places"])

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of targets (with bias) after each word, and of targets two words after each."""
        return (self.context * self.places[0]) @ self.target.T + self.bias, (self.context * self.places[1]) @ self.target.T

    def normaliser(self) -> np.ndarray:
        """log of the sum over all targets, for each (word before, word before that)."""
        near, far = self.tables()
        return np.log(np.exp(near) @ np.exp(far).T)


class Lookup:
    """Class and count of the broadcast words, by falling count, and each word's share of its class as a logarithm."""

    def __init__(self, words: list[bytes], counts: np.ndarray, classes: int, bins: int = BINS):
        self.index = {w: k for k, w in enumerate(words)}
        self.counts = counts
        self.classes = np.arange(len(words)) + 2
        tail = counts[classes:].astype(np.float64)
        if len(tail):
            before = np.cumsum(tail) - tail
            self.classes[classes:] = 2 + classes + np.minimum(bins - 1, before * bins // tail.sum()).astype(np.int64)
        if END in self.index:
            self.classes[self.index[END]] = LAST
        self.n_classes = 2 + classes + bins
        binned = self.classes >= 2 + classes
        mass, size = np.zeros(self.n_classes), np.zeros(self.n_classes)
        np.add.at(mass, self.classes[binned], counts[binned])
        np.add.at(size, self.classes[binned], 1)
        self.inner = np.zeros(len(words))
        of = self.classes[binned]
        self.inner[binned] = np.log10(counts[binned] + 0.1) - np.log10(mass[of] + 0.1 * size[of])

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each word is, -1 where it isn't."""
        get = self.index.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def class_of(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.classes[places], REST) if len(self.classes) else np.zeros(len(places), np.int64)


def _examples(batches, lookup: Lookup, training: bool = True):
    """(two words before, word before, word) classes of documents, in chunks of about TOKENS."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            if training and is_held_out(doc_id):
                continue
            held.append(np.concatenate([[LAST, LAST], lookup.class_of(lookup.places(words_of(text.as_py()))), [LAST]]))
            size += len(held[-1]) - 2
            if size >= TOKENS:
                yield from _cut(held)
                held, size = [], 0
    if held:
        yield from _cut(held)


def _cut(held: list[np.ndarray]):
    a, b, w = (np.concatenate([x[k : len(x) - 2 + k] for x in held]) for k in range(3))
    for k in range(0, len(w), TOKENS):
        yield a[k : k + TOKENS], b[k : k + TOKENS], w[k : k + TOKENS]


def _train(rows: DataFrame, lookup, start, seed: int) -> DataFrame:
    """(part, n, model): what each partition learns from its training documents."""

    def run(batches):
        table, (unigram, flat) = lookup.value, start.value
        model, rng, spent, n = LogBilinear(unigram), np.random.default_rng(seed), {}, 0
        if flat is not None:
            model.load(flat)
        for a, b, w in _examples(batches, table):
            model.train(a, b, w, rng, spent)
            n += len(w)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64()), "model": pa.array([model.flat().tobytes()], pa.binary())})

    return rows.mapInArrow(run, "part long, n long, model binary")


def _average(models: DataFrame) -> bytes | None:
    """The mean model by tokens, over a tree of groups of FAN models."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(m, np.float32) * np.float64(n) for m, n in zip(pdf["model"], pdf["n"], strict=True))
        n = int(pdf["n"].sum())
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN], "n": [n], "model": [(total / n).astype(np.float32).tobytes()]})

    models = settle(models, "models")
    while models.count() > 1:
        models = settle(models.groupBy(F.floor(F.col("part") / FAN).alias("of")).applyInPandas(mean, "part long, n long, model binary"), "models")
    row = models.select("model").first()
    return None if row is None else bytes(row[0])


def _frequent(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, about LOOKUP at most, by falling count, from a histogram of counts; the end is always there."""
    step = F.floor(F.log2("c") * 32)
    room, least, part = LOOKUP, None, None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # bounded: 32 for each doubling
        if row["count"] > room:
            part = row["step"], 0.9 * room / row["count"]
            break
        room, least = room - row["count"], row["step"]
    taken = F.col("word") == END
    if least is not None:
        taken = taken | (step >= least)
    if part is not None:
        taken = taken | ((step == part[0]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(part[1] * (1 << 20))))
    top = counts.filter(taken).toPandas()
    order = sorted(zip(-top["c"].to_numpy(np.int64), map(bytes, top["word"]), strict=True))
    return [w for _, w in order], np.array([-c for c, _ in order], np.int64)


def fit(rows: DataFrame, counts: DataFrame):
    """From (doc_id, text) and (word, c): totals, the broadcast lookup and the trained model."""
    spark = rows.sparkSession
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, c = _frequent(counts.filter(F.octet_length("word") <= WORD_BYTES))
    table = Lookup(words, c, CLASSES)
    unigram = np.zeros(table.n_classes)
    np.add.at(unigram, table.classes, c)
    unigram[REST] += n - c.sum()
    rest_n, rest_v = float(unigram[REST]), v - len(words)
    unigram = np.maximum(unigram, 0.1)
    lookup = spark.sparkContext.broadcast(table)
    ends = int(c[words.index(END)]) if END in words else 0
    # Rows are drawn by their place, so that copies of one text are drawn apart.
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, ends // WARM_DOCS))) == 0
    sample = rows.withColumn("drawn", drawn).filter("drawn").drop("drawn")
    flat = None
    for part, seed in ((sample.repartition(1), 1), (rows, 2)):
        begin = spark.sparkContext.broadcast((unigram, flat))
        learnt = _average(_train(part, lookup, begin, seed))
        flat = flat if learnt is None else np.frombuffer(learnt, np.float32)
    model = LogBilinear(unigram)
    if flat is not None:
        model.load(flat)
    return {"n": int(n), "v": int(v), "rest_n": rest_n, "rest_v": rest_v}, lookup, model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score (the model's), in log10."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    counts = settle(count_words(rows), "word-counts")
    return score_by(rows, counts, *fit(rows, counts))


def score_by(rows: DataFrame, counts: DataFrame, totals: dict, lookup, model: LogBilinear) -> DataFrame:
    """``score`` of (doc_id, text) by what ``fit`` gave."""
    spark = rows.sparkSession
    tables = spark.sparkContext.broadcast((model.flat(), np.maximum(model.noise, 1e-12), model.normaliser()))
    base_floor = np.log10(totals["n"] + 0.1 * (totals["v"] + 1))
    rest_floor = np.log10(totals["rest_n"] + 0.1 * (totals["rest_v"] + 1))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ready: dict = {}

    def run(batches):
        table = lookup.value
        if not ready:
            flat, noise, z = tables.value
            ready["all"] = (*LogBilinear(noise).load(flat).tables(), z)
        near, far, z = ready["all"]
        log_c = np.log10(table.counts + 0.1)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("held_out", "n_tokens", "n_known", "base", "score", "rare")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                words = [*words_of(text.as_py()), END]
                at = table.places(words)
                classes = table.class_of(at)
                past = np.concatenate([[LAST, LAST], classes])
                a, b = past[:-2], past[1:-1]
                logs = (near[b, classes] + far[a, classes] - z[b, a]).sum(dtype=np.float64) / np.log(10)
                known = at >= 0
                c = log_c[at[known]]
                out["held_out"].append(is_held_out(doc_id))
                out["n_tokens"].append(len(words))
                out["n_known"].append(int(known.sum()))
                out["base"].append(c.sum() - len(words) * base_floor)
                out["score"].append(logs + table.inner[at[known]].sum() - (~known).sum() * rest_floor)
                out["rare"].append(list(Counter(words[k] for k in np.flatnonzero(~known)).items()))
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=False)]
            rare = pa.array([[{"word": w, "n": n} for w, n in x] for x in out["rare"]], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, rare], names=["doc_id", *out])

    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:bigint>>")
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    more = (
        scored.select("row", F.explode("rare").alias("x"))
        .select("row", "x.word", "x.n")
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("found"))
    )
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
