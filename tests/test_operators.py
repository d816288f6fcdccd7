import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.functions import similarity as sim
from linkweave.functions import text as tx
from linkweave.operators import blocking, decide, dense, evaluate, features, learn, records, sparse, validate
from linkweave.plans import linkage
from linkweave.plans.catalog import QUERIES
from linkweave.sources import tables as src
from linkweave.sources.tables import Decision
from linkweave.streaming.incremental import score_stream


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, want",
    [("Éclair & Söhne's", "eclair and sohnes"), (None, ""), ("№16", "no 16"), ("Straße", "strasse"), ("  a--b ", "a b")],
)
def test_base(spark, raw, want):
    assert one(spark, tx.base, raw) == want


def test_other_scripts(spark):
    assert one(spark, lambda c: tx.base(c, True), "श्री गणेश").startswith("shri")


@pytest.mark.parametrize("raw, want", [("L.L.C.", "llc"), ("i b m", "ibm"), ("l l c foo", "llc foo")])
def test_initials(spark, raw, want):
    assert one(spark, lambda c: tx.merge_initials(tx.base(c)), raw) == want


def test_skeleton(spark):
    skel = lambda c: F.array_join(tx.skeleton(tx.name_tokens(c)), " ")
    assert one(spark, skel, "Shree Ganesh Traders") == "sr gns trdrs"
    assert one(spark, lambda c: F.array_join(tx.skeleton(tx.tokens(c)), " "), "gnes tredrs 134") == "gns trdrs 134"


def test_names(spark):
    got = lambda raw: one(spark, tx.name_fields, raw)
    assert got("ryfoods.com").name_n == "ryfoods" and got("ryfoods.com").is_dom
    assert got("M/s Darsh Trading").name_n == "darsh traders"
    assert got("Old Shop Ltd dba New Shop Private Limited").name_alt == "old shop"
    assert got("Old Shop Ltd dba New Shop Private Limited").legal == "ltd pvt"
    assert got("The Of").name_c == "the of"
    assert got("Foo Foo Bar | www.foo.com (ID: 30420)").name_n == "foo bar"


def test_addresses(spark):
    got = lambda raw: one(spark, tx.address_fields, raw)
    assert got("12b sector5").addr_n == "12 b sector 5"
    assert got("N°16 Rue X, 59000 Lille, Nord") .addr_n.endswith("hdf")
    assert got("5 Main Street, 12345-6789").zip == "12345"
    french = lambda raw: one(spark, lambda c: F.array_join(tx.french_address(tx.address_tokens(c)), " "), raw)
    assert french("N° 13 crs Foch").startswith("13 cours")
    assert french("28 B quai").startswith("28 bis")


def test_typed_tokens(spark):
    rows = spark.createDataFrame([(["a"], ["b"], ["33", "rue", "prevert"])], "n array<string>, k array<string>, a array<string>")
    got = rows.select(tx.typed_tokens(F.col("n"), F.col("k"), F.col("a")).alias("t")).first().t
    assert {"n:a", "k:b", "a:rue", "d:33", "hs:33_prevert"} <= set(got)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: row[j - 1] + 1 if b[j - 1] == x else max(left, row[j]), initial=0))
    return row[-1]


def test_ratio_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(12))) for _ in range(2))
        want = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100
        assert math.isclose(sim.ratio(a, b), want)
        assert sim.partial(a, b) >= sim.ratio(a, b) - 1e-9 or not a or not b or len(a) == len(b)
    assert sim.partial("", "a") == 0 and sim.partial("", "") == 100 and sim.jaro_winkler("", "") == 1


def test_numbers(spark):
    fit = lambda a, b: spark.range(1).select(sim.fits(F.lit(a), F.lit(b)).alias("y")).first().y
    assert fit("3890", "890") and fit("1914", "191") and not fit("8326", "8315")
    rows = spark.createDataFrame([(["02610"], ["2610"], "", "")], "a array<string>, b array<string>, z1 string, z2 string")
    got = rows.select(sim.number_features(*map(F.col, ("a", "b", "z1", "z2"))).alias("f")).first().f
    assert got.hno_eq == 1 and got.zip_eq == -1 and got.num_jac == 1


def test_expected_f_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(s, 2 + k % 2, k, rng.random()) for s in range(100) for k in range(rng.randrange(1, 7))]
    pairs = spark.createDataFrame(rows, "s1 long, src long, tgt long, p double")
    got = {(r.s1, r.tgt) for r in decide.expected_f(pairs, 0.4).collect()}
    want = set()
    for s in range(100):
        mine = sorted(((-p, c, t) for s1, c, t, p in rows if s1 == s and p >= 0.2))
        p = [-x[0] for x in mine]
        ef = [1.25 * sum(p[:k]) / (k + 0.25 * sum(p)) for k in range(1, len(p) + 1)]
        if ef and max(ef) > math.prod(1 - x for x in p):
            want |= {(s, mine[k][2]) for k in range(ef.index(max(ef)) + 1) if p[k] >= 0.4}
    assert got == want


def test_exact_prefix_against_enumeration():
    rng = random.Random(6)
    for _ in range(30):
        p = sorted((rng.random() for _ in range(rng.randrange(1, 6))), reverse=True)
        best, size = math.prod(1 - x for x in p), 0
        for k in range(1, len(p) + 1):
            value = 0.0
            for truth in itertools.product((0, 1), repeat=len(p)):
                weight = math.prod(x if t else 1 - x for x, t in zip(p, truth, strict=True))
                tp, fn = sum(truth[:k]), sum(truth[k:])
                value += weight * (1.25 * tp / (1.25 * tp + 0.25 * fn + k - tp) if tp else 0)
            if value > best + 1e-12:
                best, size = value, k
        assert decide.exact_prefix(p) == size


def test_f05(spark):
    universe = spark.createDataFrame([(1,), (2,), (3,)], "s1 long")
    pred = spark.createDataFrame([(1, 2, 47), (1, 2, 193), (1, 3, 812), (2, 2, 5)], "s1 long, src long, tgt long")
    truth = spark.createDataFrame([(1, 2, 47), (1, 3, 812)], "s1 long, src long, tgt long")
    got = {r.s1: r.f for r in evaluate.per_entity(universe, pred, truth).collect()}
    assert math.isclose(got[1], 5 / 7) and got[2] == 0 and got[3] == 1


def test_rule_with_null_ranks(spark):
    rows = spark.createDataFrame([(1, None, 3, None), (2, None, 9, None), (3, 30, None, 0)], "d long, dense_r2 long, sparse_r2 long, rdense_r long")
    assert [r.d for r in blocking.apply_rule(rows).orderBy("d").collect()] == [1, 3]


def test_predict_uses_unseen_folds(spark):
    rows = spark.createDataFrame([(k, float(k % 10), None if k % 7 == 0 else float(k % 3), int(k % 10 > 4), k // 10 % 2) for k in range(200)], "id long, a double, b double, y int, fold int")
    models = learn.fit_folds(rows, ["a", "b"], 2)
    got = learn.predict(rows, ["a", "b"], models).collect()
    assert sum((r.p > 0.5) == bool(r.y) for r in got) > 190


def test_models_are_kept_and_stop_early(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = spark.createDataFrame([(k, float(k % 10), rng.randrange(2), k // 10 % 2) for k in range(200)], "id long, a double, y int, fold int")  # nothing to learn
    path = str(tmp_path / "models")
    first = learn.fit_folds(rows, ["a"], 2, path=path, early_stop=0.01)
    assert all(len(m.treeWeights) < 20 for m in first)  # the loss falls no more after a few rounds
    monkeypatch.setitem(learn.LEARNERS, "gbt", None)  # nothing is fitted again
    again = learn.fit_folds(rows, ["a"], 2, path=path)
    a, b = ({r.id: r.p for r in learn.predict(rows, ["a"], m).collect()} for m in (first, again))
    assert a == b
    assert learn.load_model(spark, path + "/none", "gbt") is None


def test_blend_and_gate(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.2), (0, 0.4, 0.1), (1, 0.3, 0.95), (0, 0.35, 0.3)], "y int, a double, b double")
    loss = lambda df: -df.agg(learn.log_loss(F.col("y"), F.col("p")).alias("x")).first().x
    chosen, value = learn.best_blend(rows, ["a", "b"], loss)
    assert chosen == ["a", "b"] and value > max(loss(rows.withColumn("p", F.col(c))) for c in "ab")
    assert learn.best_blend(rows, ["a"], loss)[0] == ["a"]
    assert learn.passes_gate(0.9, 0.91) and not learn.passes_gate(0.9, 0.89) and learn.passes_gate(0.9, 0.895, 0.01)


def test_paths_and_small_files(spark, tmp_path):
    paths = src.Paths.from_env({"LINKWEAVE_OUT": "/o"}, "/r")
    assert (paths.source("test", 2), paths.truth(), paths.kept("train", "x"), paths.out) == ("/r/dataset/test_source2.tsv", "/r/dataset/train_ground_truth.tsv", "/r/work/train/x", "/o")
    at = f"{tmp_path}/deep/decision.json"
    for text in ("first", src.Decision(t=0.7).dumps()):
        src.write_text(spark, at, text)
        assert src.read_text(spark, at) == text
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["decision.json"]


def test_check_and_its_exit_codes(spark, tmp_path, monkeypatch, capsys):
    from linkweave.plans import linkage

    paths = src.Paths(f"{tmp_path}/data", f"{tmp_path}/work", f"{tmp_path}/out")
    for k in (1, 2, 3):
        src.write_tsv(spark.createDataFrame([(f"S{k}-{n}", "a", "b", "US") for n in (1, 2)], src.ENTITY), paths.source("test", k))
    for name, root in (("DATA", paths.data), ("WORK", paths.work), ("OUT", paths.out)):
        monkeypatch.setenv(f"LINKWEAVE_{name}", root)
    universe = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    for file, ids in (("matching_results.tsv", "S2-1,S3-2"), ("candidate_pairs.tsv", "S2-1")):
        src.write_id_lists(universe, spark.createDataFrame([("S1-1", ids)], "s1 string, ids string"), f"{paths.out}/{file}", linkage.HEADERS[file])
    assert linkage.main(["check"]) == 0 and "warning" in capsys.readouterr().out  # a match outside its candidates
    bad = src.Paths(paths.data, paths.work, f"{tmp_path}/bad")
    monkeypatch.setenv("LINKWEAVE_OUT", bad.out)
    for file, header in linkage.HEADERS.items():
        src.write_id_lists(universe, spark.createDataFrame([("S1-1", "S2-9")], "s1 string, ids string"), f"{bad.out}/{file}", header)
    assert linkage.main(["check"]) == 1 and "unknown id" in capsys.readouterr().out
    assert linkage.main(["infer"]) == 2  # nothing was learnt


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from linkweave.runtime import shared_root

    unset = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(cluster)


def test_tsv_round_trip(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\ta "b\t\tFR\nS2-2\tx\n')
    got = src.read_entities(spark, str(tmp_path / "s.tsv")).orderBy("entity_id").collect()
    assert got[0].business_name == 'a "b' and got[0].src == 2 and got[1].country == ""
    universe = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    lists = spark.createDataFrame([("S1-1", "S2-3,S2-1,S2-3")], "s1 string, ids string")
    src.write_id_lists(universe, lists, str(tmp_path / "out"))
    assert {(r.s1, r.ids) for r in src.read_truth(spark, str(tmp_path / "out")).collect()} == {("S1-1", "S2-3,S2-1"), ("S1-2", "")}
    assert src.Decision.loads(src.Decision(t=0.7).dumps()).t == 0.7


def test_validator(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-9"), ("S1-1", ""), ("S1-7", "X-1"), ("S1-8", None)], "s1 string, ids string")
    universe = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    got = {r.rule: r.n for r in validate.validate(lists, universe, spark.createDataFrame([("S2-1",)], "id string")).collect()}
    assert got == {"duplicate s1": 1, "duplicate id": 1, "self match": 1, "wrong prefix": 1, "missing s1": 1, "unexpected s1": 2, "unknown id": 2}


def test_stream_scores_pairs_once(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2, 3), (1, 2, 4)], "s1 long, src long, tgt long")
    for k in range(2):
        pairs.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
        score_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), lambda df: df.withColumn("p", F.lit(0.5))).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_records_and_pair_features(spark):
    raw = spark.createDataFrame(
        [(1, "US", "Shree Ganesh Traders Pvt Ltd", "12b Main Road, 560001", 2), (2, "US", "Ganesh Traders d/b/a Sri Ganesh", "12 main rd 560001", 2), (3, "US", None, None, 2), (4, "France", "Boulangerie SARL", "N° 28 b rue de Lille, Nord", 2)],
        "id int, grp string, name string, address string, src int",
    )
    rows = records.apply_fillers(records.normalize(raw), spark.createDataFrame([("US", "traders")], "grp string, token string"))
    by_id = {r.id: r for r in rows.collect()}
    assert by_id[3].name_n == by_id[3].addr_n == by_id[3].zip == ""
    assert by_id[1].zip == "560001" and by_id[2].name_alt != ""
    assert "traders" not in by_id[1].name_f.split() and by_id[1].ctext.endswith(by_id[1].addr_n)
    assert "bis" in by_id[4].addr_n.split() and "hdf" in by_id[4].addr_n.split()
    pairs = spark.createDataFrame([(1, 2, 2), (1, 2, 3), (3, 2, 3), (1, 2, 9)], "s1 int, src int, tgt int")
    out = {(r.s1, r.tgt): r for r in features.pair_features(pairs, rows, rows).collect()}
    assert set(out) == {(1, 2), (1, 3), (3, 3)}
    assert len(out[1, 2]) == 3 + 62
    for (a, b), r in out.items():
        one, two = by_id[a], by_id[b]
        assert r.n_ratio == pytest.approx(sim.ratio(one.name_c, two.name_c))
        assert r.a_pratio == pytest.approx(sim.partial(one.addr_n, two.addr_n))
        assert r.nx_jw == pytest.approx(sim.jaro_winkler(one.name_f, two.name_f))
        assert r.n_common == len(set(one.name_c.split()) & set(two.name_c.split()))
    assert out[1, 2].zip_eq == 1 and out[1, 3].zip_eq == -1 and out[1, 2].has_alt == 1 and out[3, 3].n_exact == 1
    assert records.unseen(raw, raw.filter("grp = 'US'")).collect()[0].grp == "France"


def test_config_grid_is_the_rule_itself(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), 2 + int(t) % 2, int(t), round(float(p), 3)) for s, t, p in zip(rng.integers(0, 12, 200), rng.integers(0, 40, 200), rng.random(200), strict=True)]
    pairs = spark.createDataFrame(list({r[:3]: r for r in rows}.values()), "s1 long, src int, tgt long, p double")
    grid = decide.config_grid(pairs).toPandas()
    for config in (Decision(rule="thr", t=0.7, excl=True), Decision(rule="thr", t=0.4, excl=False), Decision(floor=0.3, empty_bias=1.6, excl=True), Decision(floor=0.6, excl=False)):
        want = {(r.s1, r.src, r.tgt) for r in decide.by_config(pairs, config).collect()}
        x, bias = (config.t, 1.0) if config.rule == "thr" else (config.floor, config.empty_bias)
        mine = grid[(grid.excl == config.excl) & (grid.rule == config.rule) & (grid.x == x) & (grid.bias == bias)]
        assert set(zip(mine.s1, mine.src, mine.tgt, strict=True)) == want
    with pytest.raises(ValueError, match="unknown rule"):
        decide.by_config(pairs, Decision(rule="other"))


def test_validate_file(spark, tmp_path):
    universe = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    header = ("source1_entity_id", "matched_entity_ids")

    def report(text):
        path = tmp_path / "lists.tsv"
        path.write_text(text)
        return {r.rule: r.n for r in validate.validate_file(spark, str(path), header, universe).collect() if r.n}

    (tmp_path / "bytes.tsv").write_bytes(b"source1_entity_id\tmatched_entity_ids\nS1-1\tS2-\xff\nS1-2\t\n")
    assert {r.rule: r.n for r in validate.validate_file(spark, str(tmp_path / "bytes.tsv"), header, universe).collect() if r.n} == {"encoding error": 1}
    assert report("") == {"empty file": 1}
    assert report("source1_entity_id,matched_entity_ids\n") == {"comma-separated": 1}
    assert report("a\tb\n") == {"header": 1}
    assert report("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-4\nS1-2\t\n") == {}
    assert report("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nbroken\nS1-1\tS1-2,X-1\n") == {
        "malformed row": 1, "duplicate s1": 1, "duplicate id": 1, "self match": 1, "wrong prefix": 1, "missing s1": 1,
    }


def test_second_stage_fills_missing_scores(spark):
    pairs = spark.createDataFrame([(1, 2, 5, 0.9), (1, 3, 6, 0.2), (2, 2, 5, 0.4)], "s1 int, src int, tgt int, p double")
    ce = spark.createDataFrame([(1, 2, 5, 0.7)], "s1 int, src int, tgt int, ce double")
    out = {(r.s1, r.tgt): r for r in features.second_stage(pairs, {"ce": ce}).collect()}
    assert out[1, 6].ce == -1 and out[2, 5].cectx_tmax == 0.7 and out[2, 5].tmargin == pytest.approx(-0.5) and out[1, 5].other_max == 0.2


def test_sample_depends_on_keys_alone(spark):
    rows = spark.range(1000)
    a, b = ({r.id for r in learn.sample(df, "id", 50).collect()} for df in (rows, rows.repartition(7)))
    assert a == b and len(a) == 50


def test_vectors_cost_a_pass_for_each_place(spark):
    rows = spark.range(400).select("id", F.array(*[F.concat(F.lit(f"{k}-"), F.col("id").cast("string")) for k in range(6)]).alias("tokens"))
    began = time.time()
    out = dense.hashed_vectors(rows, 2048).select(F.size("vec").alias("n"), F.round(dense.dot(F.col("vec"), F.col("vec")), 9).alias("one")).distinct().collect()
    assert [tuple(r) for r in out] == [(2048, 1.0)]
    assert time.time() - began < 15


def test_vectors_are_not_broadcast(spark, tmp_path):
    spark.range(50).select("id", F.lit("red ring").alias("name")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    v = dense.hashed_vectors(rows.select("id", tx.char_grams(F.col("name")).alias("tokens")))
    met = dense.pair_dot(v.select(F.col("id").alias("q"), (F.col("id") + 1).alias("d")), v, v)
    assert met.count() == 49 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def broadcast_columns(df):
    """What a plan sends to every executor, by the columns' names."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return set(re.findall(r"(\w+)#", " ".join(re.findall(r"BroadcastExchange[^\n]*\nInput[^\n]*?: \[(.*)\]", plan))))


def test_cosines_broadcast_no_weights(spark, tmp_path):
    spark.range(50).selectExpr("id % 2 AS grp", "id", "concat('red ring ', id) AS name").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).withColumn("tokens", tx.tokens(F.col("name")))
    met = sparse.pair_cosine(rows.select("grp", F.col("id").alias("q"), (F.col("id") + 2).alias("d")), *sparse.fitted(rows, rows))
    assert met.filter("score > 0").count() == 48 and not {"w", "wq", "wd"} & broadcast_columns(met)


def test_rule_grid_searches_once_and_broadcasts_no_truth(spark):
    out = QUERIES["blocking_rule_grid"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and not {"p_name", "q", "d"} & broadcast_columns(out)


@pytest.mark.parametrize("together", [1, 7, 1 << 17])
def test_config_scores_are_those_of_the_grid(spark, monkeypatch, together):
    monkeypatch.setattr(decide, "TOGETHER", together)
    rng = np.random.default_rng(5)
    rows = {(f"e{min(s, 9)}", 2 + int(t) % 2, int(t)): round(float(p), 2) for s, t, p in zip(rng.integers(0, 30, 300), rng.integers(0, 60, 300), rng.random(300), strict=True)}
    pairs = spark.createDataFrame([(*k, p) for k, p in rows.items()], "s1 string, src int, tgt long, p double")
    truth = spark.createDataFrame([k for k in rows if k[2] % 3 == 0] + [("e4", 2, 999), ("alone", 2, 5), ("outside", 3, 7)], "s1 string, src int, tgt long")
    universe = spark.createDataFrame([(f"e{k}",) for k in range(8)] + [("e9",), ("e9",), ("alone",), ("empty",)], "s1 string")
    config = ["excl", "rule", "x", "bias"]
    want = {tuple(r[c] for c in config): r.macro_f for r in evaluate.grid_scores(decide.config_grid(pairs), truth, universe, config).collect()}
    scores = decide.config_scores(pairs, truth, universe)
    assert {tuple(r[c] for c in config): r.macro_f for r in scores.collect()} == pytest.approx(want, abs=1e-12) and len(want) == 46
    assert "Generate" not in scores._jdf.queryExecution().executedPlan().toString()


def test_config_grid_multiplies_no_pairs(spark):
    plan = QUERIES["config_grid"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_matched_cosines_compare_copies_once(spark, monkeypatch):
    names, places = ["red ring", "blue ring", "", None, "old red bolt"], ["main 1", None, "high 2"]
    rows = [(f"g{i % 2}", i % 3, i, names[i % 5], names[i % 4], places[i % 3]) for i in range(200)] + [(None, 1, 998, "a", "b", "c"), ("g0", None, 999, "a", "b", "c")]
    every = spark.createDataFrame(rows, "grp string, size int, id long, name_c string, name_f string, addr_n string")
    one, two = every.filter("id % 3 <> 1"), every.filter("id % 3 <> 0")
    pairs = one.select("grp", "size", F.col("id").alias("q")).join(two.select("grp", "size", F.col("id").alias("d")), ["grp", "size"]).drop("size")
    want = {(r.q, r.d): tuple(round(r[c], 9) for c in features.COSINES) for r in features.fitted_cosines(pairs, one, two).collect()}
    compared, cosine = [], features._cosine
    monkeypatch.setattr(features, "_cosine", lambda pairs, *rest: compared.append(pairs.count()) or cosine(pairs, *rest))
    found = features.matched_cosines(one, two, ["grp", "size"]).collect()
    assert {(r.q, r.d): tuple(round(r[c], 9) for c in features.COSINES) for r in found} == want
    assert len(found) == len(want) > compared[0]


def test_feature_cosines_make_pairs_last(spark):
    plan = QUERIES["feature_cosines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "p_size" not in plan and "p_name" not in plan


def test_feature_cosines_broadcast_no_records(spark):
    plan = QUERIES["feature_cosines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sent = plan.count("BroadcastExchange")
    assert sent == plan.count("BroadcastHashJoin [grp#") <= 2, plan  # the groups' sizes alone, for either side


@pytest.mark.parametrize(("block", "k"), [(1 << 18, 3), (40, 3), (40, 200)])
def test_search_is_top_k_of_similarity(spark, block, k):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(12)}"
    rows = [(f"g{i % 3}", f"{'é' * (i % 2)}{i}", i < 60, [word() for _ in range(rng.randrange(5))]) for i in range(150)]  # ties, and records without tokens
    every = spark.createDataFrame([*rows, ("one side", "x", True, ["w1"])], "grp string, id string, first boolean, tokens array<string>")
    q, d = sparse.fitted(every.filter("first"), every.filter("NOT first"), 20)
    want, found = sparse.top_k(sparse.similarity(q, d), k), sparse.search(q, d, k, block)
    tell = lambda df: sorted((r.grp, r.q, r.d, round(r.score, 9), r["rank"]) for r in df.collect())
    assert tell(found) == tell(want) and found.count() > 100
    assert sparse.search(q.filter("false"), d, k, block).count() == 0


def test_candidates_shuffle_no_pair_that_shares_a_token(spark, monkeypatch):
    plans, settle = {}, linkage.settle
    monkeypatch.setattr(linkage, "settle", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or settle(df, name))
    rows = [("US", f"S{k}-{i}", k, f"red ring {i}", f"red ring {i}", f"rd rng {i}", f"main {i}") for k in (1, 2, 3) for i in range(6)]
    every = spark.createDataFrame(rows, "grp string, id string, src int, enc string, name_f string, name_fk string, addr_n string")
    linkage.candidates(every.filter("src = 1"), every.filter("src > 1"), linkage.Settings(dense=3, reverse=1, sparse=3))
    assert not re.search(r"Join \[[^]]*token", plans["dense-pairs"])


def test_candidates_are_searched_once(spark, monkeypatch):
    plans, settle = {}, linkage.settle
    monkeypatch.setattr(linkage, "settle", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or settle(df, name))
    rows = [("US", f"S{k}-{i}", k, f"red ring {i}", f"red ring {i}", f"rd rng {i}", f"main {i}") for k in (1, 2, 3) for i in range(6)]
    every = spark.createDataFrame(rows, "grp string, id string, src int, enc string, name_f string, name_fk string, addr_n string")
    out = linkage.candidates(every.filter("src = 1"), every.filter("src > 1"), linkage.Settings(dense=3, reverse=1, sparse=3))
    assert {(r.s1[1:], r.tgt[2:]) for r in out.collect()} >= {(f"1-{i}", f"-{i}") for i in range(6)}
    assert "FlatMapCoGroups" not in plans["scored-pairs"]
