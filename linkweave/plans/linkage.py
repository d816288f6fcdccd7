"""One linkage run from files to files: prepare, block, compare, learn or load, decide, write and validate.

``train`` learns both stages on labelled files and keeps models and the decision below ``paths.work``; ``infer`` links
other files by them and writes ``matching_results.tsv`` and ``candidate_pairs.tsv`` below ``paths.out``; ``check`` holds
both against the output rules. ``python -m linkweave.plans.linkage train|infer|check`` does the same with paths from the
environment, and ends with 1 if a rule is broken and 2 if a file can't be read.

Neural encoders and pair scorers are slots: ``vectors`` makes vectors of texts, ``scorers`` add a column of scores to
candidate pairs. Every table that's read more than once is settled.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import text as tx
from linkweave.operators import adapt, blocking, context, decide, dense, evaluate, features, learn, records, sparse, validate
from linkweave.operators.sparse import MAX_DF
from linkweave.runtime import settle
from linkweave.sources import tables as src
from linkweave.sources.tables import Decision, Paths

PAIR = ["s1", "src", "tgt"]
HEADERS = {"matching_results.tsv": ("source1_entity_id", "matched_entity_ids"), "candidate_pairs.tsv": ("source1_entity_id", "candidate_entity_ids")}


def gram_vectors(rows: DataFrame) -> DataFrame:
    """From (grp, id, text): (grp, id, vec), hashed 3-grams; the encoder that needs no training."""
    return dense.hashed_vectors(rows.select("grp", "id", tx.char_grams(F.col("text")).alias("tokens")), 256).select("grp", "id", "vec")


@dataclass(frozen=True)
class Settings:
    """Sizes of a run; the defaults are the production ones."""

    dense: int = 40
    reverse: int = 5
    sparse: int = 25
    cap_dense: int = 20
    cap_sparse: int = 5
    max_df: int = MAX_DF
    subset: int = 800_000
    folds: int = 4
    first: str = "gbt"
    learners: tuple[str, ...] = ("gbt", "forest")
    least_p1: float = 0.001
    early_stop: float | None = None
    vectors: Callable[[DataFrame], DataFrame] = gram_vectors
    scorers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


def prepare(spark: SparkSession, paths: Paths, split: str) -> tuple[DataFrame, DataFrame]:
    """Normalised records of the first source and of both targets, with src, and names without each country's fillers."""
    raw = records.union_sources(*[src.read_entities(spark, paths.source(split, k)) for k in (1, 2, 3)])
    rows = records.normalize(raw.select(F.col("entity_id").alias("id"), F.col("country").alias("grp"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "src"))
    rows = settle(rows.withColumn("enc", records.encoder_text(F.col("name"), F.col("address"))), "records")
    names = rows.select("grp", "id", "src", tx.tokens(F.col("name_c")).alias("tokens"))
    found = sparse.fillers(names.filter("src = 1"), names.filter("src > 1"))
    full = records.apply_fillers(rows, found)
    full = settle(full.withColumn("ftext", records.full_text(F.col("enc"), F.col("ctext"))), "records")
    return full.filter("src = 1"), full.filter("src > 1")


def _group(country, number):
    """Searches stay in one country and one target source."""
    return F.concat_ws("|", number.cast("string"), country)


def candidates(first: DataFrame, targets: DataFrame, settings: Settings) -> DataFrame:
    """(s1, src, tgt, grp, ranks and scores of all paths) that the rule keeps, each pair once."""
    both = first.withColumn("src", F.explode(F.array(F.lit(2), F.lit(3))))
    q, d = (df.withColumn("grp", _group(F.col("grp"), F.col("src"))) for df in (both, targets))

    def tokens(df: DataFrame) -> DataFrame:
        name, skeleton, address = (tx.tokens(F.col(c)) for c in ("name_f", "name_fk", "addr_n"))
        return df.select("grp", "id", tx.typed_tokens(name, skeleton, address).alias("tokens"))

    vq, vd = (settle(settings.vectors(df.select("grp", "id", F.col("enc").alias("text"))), "vectors") for df in (q, d))
    wq, wd = sparse.fitted(tokens(q), tokens(d), settings.max_df)
    back = dense.top_k(vd, vq, settings.reverse).select("grp", F.col("q").alias("d"), F.col("d").alias("q"), "rank")
    paths = {"dense": dense.top_k(vq, vd, settings.dense), "rdense": back, "sparse": sparse.search(wq, wd, settings.sparse)}
    pairs = blocking.union_paths(paths).join(d.select(F.col("id").alias("d"), "grp", "src"), "d")
    # settled here, or the cosines would search anew
    scored = settle(dense.pair_dot(pairs, vq.select("id", "vec").dropDuplicates(["id"]), vd).withColumnRenamed("score", "dense_s"), "dense-pairs")
    scored = settle(scored.join(sparse.pair_cosine(scored.select("grp", "q", "d"), wq, wd).select("q", "d", F.col("score").alias("sparse_s")), ["q", "d"]), "scored-pairs")
    for path in ("dense", "sparse"):
        scored = blocking.rank_within(scored, ["q", "src"], f"{path}_s", f"{path}_r2")
    kept = blocking.apply_rule(scored, settings.cap_dense, settings.cap_sparse)
    return settle(kept.withColumnsRenamed({"q": "s1", "d": "tgt"}), "candidates")


def compare(pairs: DataFrame, first: DataFrame, targets: DataFrame) -> DataFrame:
    """``pairs`` with the 62 features, five cosines, both names' frequencies and the context of both retrieval scores."""
    out = features.pair_features(pairs, first, targets)
    group = lambda df: df.withColumn("grp", _group(F.col("grp"), F.col("src")))
    both = group(first.withColumn("src", F.explode(F.array(F.lit(2), F.lit(3)))))
    cosines = features.fitted_cosines(pairs.select("grp", F.col("s1").alias("q"), F.col("tgt").alias("d")), both, group(targets))
    out = out.join(cosines.select(F.col("q").alias("s1"), F.col("d").alias("tgt"), *features.COSINES), ["s1", "tgt"])
    often = lambda df, key, name: context.name_frequency(df.select("id", "src", "grp", "name_f"), ["src", "grp", "name_f"]).select(F.col("id").alias(key), F.col("freq").cast("double").alias(name))
    out = out.join(often(first, "s1", "freq1"), "s1").join(often(targets, "tgt", "freq2"), "tgt")
    for path in ("dense", "sparse"):
        out = context.group_context(out, f"{path}_s", f"{path[0]}ctx")
    return out


def columns(rows: DataFrame) -> list[str]:
    """What the learners read: every number that isn't a key, a label or a fold."""
    return [c for c, kind in rows.dtypes if kind in ("double", "float", "int", "bigint") and c not in (*PAIR, "y", "fold")]


def _second(rows: DataFrame, settings: Settings) -> DataFrame:
    return features.second_stage(rows, {name: score(rows.select(*PAIR)) for name, score in settings.scorers.items()}, "p1")


def train(spark: SparkSession, paths: Paths, settings: Settings = Settings()) -> Decision:
    """Learn both stages on the training files; the decision with the best macro F0.5 out of fold is kept and returned."""
    first, targets = prepare(spark, paths, "train")
    truth = src.explode_truth(src.read_truth(spark, paths.truth()), first.select(F.col("id").alias("s1")), targets.select(F.col("id").alias("tgt")))
    truth = settle(truth.select(*PAIR), "truth")
    compared = settle(compare(candidates(first, targets, settings), first, targets), "compared")
    names = columns(compared)
    keys = settle(learn.training_keys(first.select(F.col("id").alias("s1")), settings.subset, settings.folds), "training-keys")
    universe = keys.select("s1")
    rows = settle(learn.label(compared.join(keys, "s1"), truth), "training-rows")
    stage1 = learn.fit_folds(rows, names, settings.folds, settings.first, paths.kept("train", "stage1"), settings.early_stop)
    # Context is of all candidates; those in training rows have the model that hasn't seen them.
    fold = rows.select(*PAIR, "fold", "y")
    every = learn.predict(compared.join(fold, PAIR, "left"), names, stage1, "p1")
    second = settle(_second(every, settings).filter("fold IS NOT NULL"), "second-stage")
    more = columns(second)
    out = second
    for name in settings.learners:
        out = learn.predict(out, more, learn.fit_folds(second, more, settings.folds, name, paths.kept("train", "stage2"), settings.early_stop), f"p_{name}")
    out = settle(out.select(*PAIR, "y", "fold", "p1", *[f"p_{x}" for x in settings.learners]), "out-of-fold")
    tried = []

    def score(scored: DataFrame) -> float:
        """The best macro F0.5 over the grid of decisions."""
        scores = decide.config_scores(scored.select(*PAIR, "p"), truth, universe)
        tried.append(scores.orderBy(F.desc("macro_f"), "rule", "excl", "x", "bias").first())
        return float(tried[-1].macro_f) if tried[-1] else 0.0

    blend, _ = learn.best_blend(out, [f"p_{x}" for x in settings.learners], score)
    row = max(filter(None, tried), key=lambda r: r.macro_f, default=None)
    chosen = Decision(rule=row.rule, excl=row.excl, t=row.x, floor=row.x, empty_bias=row.bias, blend=[c.removeprefix("p_") for c in blend]) if row else Decision(blend=list(settings.learners))
    src.write_text(spark, paths.kept("train", "decision.json"), chosen.dumps())
    src.write_text(spark, paths.kept("train", "columns.txt"), "\n".join([",".join(names), ",".join(more)]))
    return chosen


def _kept(spark: SparkSession, paths: Paths, name: str, learner: str, folds: int) -> list:
    models = [learn.load_model(spark, f"{paths.kept('train', name)}/{learner}-{k}", learner) for k in range(folds)]
    if None in models:
        raise FileNotFoundError(f"no whole set of models below {paths.kept('train', name)}; run train first")
    return models


def infer(spark: SparkSession, paths: Paths, split: str = "test", settings: Settings = Settings()) -> DataFrame:
    """Link the files of ``split`` by what ``train`` kept; both outputs are written, and the matches returned."""
    decision = Decision.loads(src.read_text(spark, paths.kept("train", "decision.json")))
    names, more = (line.split(",") for line in src.read_text(spark, paths.kept("train", "columns.txt")).split("\n"))
    first, targets = prepare(spark, paths, split)
    compared = compare(candidates(first, targets, settings), first, targets).withColumn("fold", F.lit(None).cast("int"))
    scored = settle(learn.predict(compared, names, _kept(spark, paths, "stage1", settings.first, settings.folds), "p1"), "first-stage")
    out = _second(scored, settings)
    for name in decision.blend:
        out = learn.predict(out, more, _kept(spark, paths, "stage2", name, settings.folds), f"p_{name}")
    out = settle(out.select(*PAIR, "p1", learn.blend(*[f"p_{x}" for x in decision.blend]).alias("p")), "second-stage")
    src.write_parquet(learn.as_floats(out.filter("p > 0.01")), paths.kept(split, "p2.parquet"))
    matches = settle(decide.by_config(out, decision).select(*PAIR, "p"), "matches")
    packed = adapt.package(out.select(*PAIR, F.col("p1").alias("p")), matches, settings.least_p1)
    universe = first.select(F.col("id").alias("s1"))
    for file, lists in (("matching_results.tsv", adapt.id_lists(matches, "tgt", "p")), ("candidate_pairs.tsv", adapt.id_lists(packed, "tgt", "score"))):
        src.write_id_lists(universe, lists, f"{paths.out}/{file}", HEADERS[file])
    return matches


def check(spark: SparkSession, paths: Paths, split: str = "test") -> DataFrame:
    """(file, rule, n, sample): the output rules on both files, and matches outside their candidates (a warning)."""
    universe = src.read_entities(spark, paths.source(split, 1)).select(F.col("entity_id").alias("s1"))
    known = records.union_sources(*[src.read_entities(spark, paths.source(split, k)) for k in (2, 3)]).select(F.col("entity_id").alias("id"))
    reports = [
        validate.validate_file(spark, f"{paths.out}/{file}", header, universe, known).select(F.lit(file).alias("file"), "rule", "n", F.col("sample").cast("string").alias("sample"))
        for file, header in HEADERS.items()
    ]
    matches, packed = (src.read_truth(spark, f"{paths.out}/{file}") for file in HEADERS)
    outside = validate.outside_candidates(matches, packed).agg(F.count("*").alias("n"), F.min("s1").alias("sample"))
    return reports[0].unionByName(reports[1]).unionByName(outside.select(F.lit("matching_results.tsv").alias("file"), F.lit("outside candidates").alias("rule"), "n", "sample"))


def main(argv: list[str]) -> int:
    spark = SparkSession.builder.getOrCreate()
    paths = Paths.from_env(dict(os.environ))
    try:
        if argv[0] == "train":
            print(train(spark, paths).dumps())
        elif argv[0] == "infer":
            infer(spark, paths)
        report = check(spark, paths).collect() if argv[0] in ("infer", "check") else []
    except (UnicodeDecodeError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return 2
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        print(error, file=sys.stderr)
        return 2
    broken = [r for r in report if r.n and r.rule != "outside candidates"]
    for r in report:
        if r.n:
            print(f"{'warning' if r.rule == 'outside candidates' else 'error'}: {r.file}: {r.rule}: {r.n}, such as {r.sample}")
    return 1 if broken else 0


if __name__ == "__main__":
    if len(sys.argv) != 2 or sys.argv[1] not in ("train", "infer", "check"):
        sys.exit("usage: python -m linkweave.plans.linkage train|infer|check")
    sys.exit(main(sys.argv[1:]))
