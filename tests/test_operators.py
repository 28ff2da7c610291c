"""Operators on literal rows: nulls, ties, repeats, empty tables, plans."""

import json
import os
import random
import time

import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from quern.functions import udfs
from quern.ml import models
from quern.operators import aggregates, joins, ranks, relational, text
from quern.plans.pipeline import Pipeline
from quern.plans.quality import QualityError, Rule, column_checks, enforce, report
from quern.sources import generate, readers, writers
from quern.sources.snapshots import Conflict, SnapshotTable
from quern.streaming import windows


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


# ---- ranks ---------------------------------------------------------------------------------------------------------
def test_rank_forms_agree(spark):
    rnd = random.Random(3)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, 1e300, -1e-300]
    data = [tuple(rnd.choice([rnd.random() * 100, float(rnd.randint(0, 5)), rnd.choice(odd)]) for _ in range(3)) + (7.0, None) for _ in range(700)]
    df = spark.createDataFrame(data, "a double, b double, c double, same double, none double").repartition(3)
    want = sorted(map(str, ranks.rank_statistics_by_row_number(df, df.columns, [1, 2, 350, 600, 5000]).collect()))
    assert want == sorted(map(str, ranks.rank_statistics(df, df.columns, [1, 2, 350, 600, 5000]).collect()))
    assert want == sorted(map(str, ranks.rank_statistics_by_prefix_sum(df, df.columns, [1, 2, 350, 600, 5000]).collect()))


def test_ranks_of_shuffled_numbers(spark):
    cols = [f"c{k}" for k in range(10)]
    data = list(zip(*(random.Random(k).sample(range(50), 50) for k in range(10))))
    got = ranks.rank_statistics(spark.createDataFrame([tuple(map(float, r)) for r in data], cols), cols, [3, 8]).collect()
    assert {(r.col, r["rank"], r.value) for r in got} == {(c, k, k - 1.0) for c in cols for k in (3, 8)}
    with pytest.raises(ValueError):
        ranks.rank_statistics(spark.range(3), ["id"], [0])
    assert ranks.rank_statistics(spark.range(0), ["id"], [1]).count() == 0


def test_rank_statistics_of_uneven_columns(spark):
    """One far outlier, an exponential tail, equal values, a few values, ends of the range of doubles, and values that aren't finite."""
    rnd = random.Random(12)
    n, inf, nan = 4000, float("inf"), float("nan")
    cols = {
        "far": [float(k) for k in range(n - 1)] + [1e300],
        "tail": [rnd.expovariate(1e-3) ** 4 for _ in range(n)],
        "equal": [7.5] * n,
        "two": [float(k % 2) for k in range(n)],
        "wide": [-1.7e308, 1.7e308] * (n // 2),
        "odd": [-inf] * 100 + [inf] * 200 + [nan] * 300 + [None] * 400 + [rnd.gauss(0, 1) for _ in range(n - 1000)],
    }
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(4)
    ranks_ = [1, 100, 101, 1999, 3099, 3100, 3101, 3300, 3301, 3600, 3601, n]
    want = sorted(map(str, ranks.rank_statistics_by_row_number(df, list(cols), ranks_).collect()))
    assert want == sorted(map(str, ranks.rank_statistics(df, list(cols), ranks_, few=20).collect()))
    assert want == sorted(map(str, ranks.rank_statistics(df, list(cols), ranks_).collect()))



# ---- relational ----------------------------------------------------------------------------------------------------
def test_predicates_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 0, True, [2.0, 1.0]), ("b", None, 4, None, [1.0]), ("c", 6, 4, False, [-1.0, 3.0])], "k string, x int, y int, happy boolean, v array<double>")
    assert [r.q for r in relational.ratio(df, "x", "y", "q").collect()] == [None, None, 1.5]
    assert [r.k for r in relational.not_true(df, F.col("happy")).collect()] == ["c"]
    assert [r.k for r in relational.first_above_second(df, "v").collect()] == ["a"]
    assert [r.k for r in relational.at_least_half(df, "x", "y").collect()] == ["a", "c"]
    assert [r.s for r in df.select(relational.sum_positive("v").alias("s")).collect()] == [3.0, 1.0, 3.0]
    assert [r.e for r in df.select(relational.element("v", 1).alias("e")).collect()] == [1.0, None, 3.0]
    assert [r.code for r in relational.encode(df, "k", {"a": 0, "b": 1}, 2, "code").collect()] == [0, 1, 2]
    assert relational.project_non_null(df, F.col("k"), F.col("x") + 1).count() == 2


def test_sets_keep_what_they_should(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "n int") for v in ([1, 1, 2, 3, 4, 4, None], [3, 4]))
    assert sorted(map(str, (r.n for r in relational.subtract_keeping_repeats(a, b).collect()))) == ["1", "1", "2", "None"]
    assert sorted(r.n for r in relational.intersection(a, b).collect()) == [3, 4]
    assert relational.union_all(a, b).count() == 9


def test_order_and_partitions(spark, capsys):
    df = spark.createDataFrame([(k % 3, -k) for k in range(30)], "a int, b int")
    parts = relational.partitioned_sorted(df, 4, "a", "b").rdd.glom().collect()
    assert all(p == sorted(p) for p in parts) and all(sum(any(r.a == k for r in p) for p in parts) == 1 for k in range(3))
    assert [r.b for r in relational.top(df, 3, F.asc("b")).collect()] == [-29, -28, -27]
    assert "TakeOrderedAndProject" in plan(relational.top(df, 3, F.asc("b")), capsys)
    assert relational.cut_lineage(df).count() == 30
    assert len(relational.sorted_groups(df, "a", ["b"]).first()["items"]) == 10
    assert relational.sample_by_key(spark.range(10_000), "id", 100).count() == relational.sample_by_key(spark.range(10_000).repartition(3), "id", 100).count()


def test_pushdown_and_join_plans(spark, small, capsys):
    out = plan(readers.read_table(spark, small, "part").where("p_size > 10").select("p_partkey"), capsys)
    assert "GreaterThan(p_size,10)" in out and "p_name" not in out
    n, r = (readers.read_table(spark, small, t) for t in ("nation", "region"))
    out = plan(joins.by_equal_length(n.hint("merge"), "n_name", r, "r_name"), capsys)
    assert "Cartesian" not in out and "NestedLoop" not in out
    out = plan(joins.co_located(n.select(F.col("n_nationkey").alias("k")), n.select(F.col("n_regionkey").alias("k")), "k", 3).hint("merge"), capsys)
    assert "ENSURE_REQUIREMENTS" not in out or "Broadcast" in out


def test_joins(spark):
    scores = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 1.0), (3, 2.0)], "k int, s double")
    homes = spark.createDataFrame([(1, 10), (1, 20), (2, 30), (4, 40)], "k int, a int")
    assert sorted(map(tuple, joins.best_then_join(scores, homes, "k", "s").collect())) == [(1, 7.0, 10), (1, 7.0, 20), (2, 1.0, 30)]
    assert sorted(map(tuple, joins.join_then_best(scores, homes, "k", "s", "a").collect())) == [(1, 7.0, 10), (2, 1.0, 30)]
    g = {r.k: (r.s, r.a) for r in joins.cogroup("k", s=(scores, "s"), a=(homes, "a")).collect()}
    assert g == {1: ([5.0, 7.0], [10, 20]), 2: ([1.0], [30]), 3: ([2.0], []), 4: ([], [40])}
    assert sorted(map(tuple, joins.with_lookup(scores, homes, "k").collect())) == sorted(map(tuple, joins.with_lookup(scores, homes, "k", 0).collect())) == [(1, 5.0, 10), (1, 7.0, 10), (2, 1.0, 30)]


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 3.0), (2, None, None)], "k int, n string, v double")
    assert sorted(map(tuple, aggregates.one_each(df, "k", "n").collect()), key=str) == [(1, "a", 3.0), (2, None, None)]
    assert aggregates.one_each(df, "k").count() == 2
    d = aggregates.describe(df, "v").first()
    assert (d["count"], d.mean, d["min"], d["max"]) == (2, 2.5, 2.0, 3.0) and abs(d.stddev - 0.5**0.5) < 1e-12
    assert [tuple(r) for r in aggregates.label_index(df, "n").collect()] == [("a", 0.0), ("b", 1.0)]
    seen, o = aggregates.with_observed(df, "o", F.sum("v").alias("total"), F.max("k").alias("most"))
    seen.collect()
    assert o.get == {"total": 5.0, "most": 2}


# ---- text ----------------------------------------------------------------------------------------------------------
def test_tokens_and_reports(spark):
    df = spark.createDataFrame([("happy  Happy bird  ", 1), ("", 1), ("   ", 2), (None, 2)], "value string, k int")
    assert [r.w for r in df.select(text.tokens("value").alias("w")).collect()] == [["happy", "", "Happy", "bird"], [""], [], None]
    assert {r.word: r.n for r in text.word_count(df).collect()} == {"happy": 1, "": 2, "Happy": 1, "bird": 1}
    assert {r.word: r.n for r in text.word_count_without(spark.createDataFrame([("The panda, THE-end",)], ["value"]), {"the"}, ",-").collect()} == {"panda": 1, "end": 1}
    got = {r.k: (r.longest_word, r.mentions, r.average_words) for r in text.report_card(df.where("value IS NOT NULL"), "k", "value", "happy").collect()}
    assert got == {1: (5, 2, 2.5), 2: (0, 0, 0.0)}


# ---- sources and sinks ---------------------------------------------------------------------------------------------
def test_files(spark, tmp_path):
    d = str(tmp_path)
    with open(f"{d}/a.json", "w") as f:
        f.write('{"name": "panda", "n": 1}\n{"name": "bear", "n": 2}\n')
    assert readers.read_json(spark, f"{d}/a.json", 1.0).count() == readers.read_json(spark, f"{d}/a.json", schema="name string").count() == 2
    assert [r.n for r in readers.read_json_lines_with(spark, f"{d}/a.json", "panda", "name string, n int").collect()] == [1]
    with open(f"{d}/p.csv", "w") as f:
        f.write("creator,stars\na,3\nb,20\n")
    assert readers.read_csv(spark, f"{d}/p.csv").where("stars > 10").first().creator == "b"
    one = spark.createDataFrame([(1, "x")], "k int, v string")
    writers.append(one, f"{d}/t")
    writers.append(one.withColumn("more", F.lit(b"y")), f"{d}/t")
    assert readers.read_parquet(spark, f"{d}/t", merge=True, binary_as_string=True).where("more = 'y'").count() == 1
    assert readers.read_file_by_sql(spark, f"{d}/t", "k").count() == 2
    writers.write_json_by(one.unionByName(one), f"{d}/j", "k")
    assert os.path.isdir(f"{d}/j/k=1")
    writers.write_by_prefix(one, "v", 1, f"{d}/w")
    writers.compact(spark, f"{d}/t", f"{d}/c", 1)
    writers.delete_where(spark, f"{d}/c", "k = 1", f"{d}/e")
    assert spark.read.parquet(f"{d}/e").count() == 0
    writers.write_both(one, lambda x: writers.write_parquet(x, f"{d}/b1"), lambda x: writers.write_parquet(x.select("k"), f"{d}/b2"))
    assert spark.read.parquet(f"{d}/b2").columns == ["k"]
    assert writers.publish(one, {"rows": "count(*) > 0"}, f"{d}/pub", f"{d}/stage") == {"rows": True} and spark.read.parquet(f"{d}/pub").count() == 1
    assert writers.publish(one, {"rows": "count(*) > 5"}, f"{d}/no", f"{d}/stage") == {"rows": False} and not os.path.exists(f"{d}/no")
    with open(f"{d}/log", "w") as f:
        f.writelines(json.dumps({"Event": e}) + "\n" for e in ("Start", "End", "Other"))
    assert readers.read_event_log(spark, f"{d}/log", ("Start", "End")).count() == 2
    os.makedirs(f"{d}/old")
    assert readers.oldest_file(f"{d}/old") is None
    for k, name in enumerate("ba"):
        open(f"{d}/old/{name}", "w").close()
        os.utime(f"{d}/old/{name}", (time.time(), 1000 + k))
    assert readers.oldest_file(f"{d}/old") == "b"
    with pytest.raises(AnalysisException):
        spark.read.parquet(f"{d}/nowhere").count()


def test_tables_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, writers.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    writers.register(old, "olds", "kept_olds")
    writers.save_table(new, "news", (2, "k"))
    assert readers.read_catalog(spark, "kept_olds").join(readers.read_catalog(spark, "news"), "k").count() == 1
    assert readers.require(old.withColumn("x", F.lit(1)), "k int, v string").columns == ["k", "v"]
    with pytest.raises(TypeError):
        readers.require(old, "k bigint")


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    p = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        writers.write_jdbc(spark.range(5), url, "numbers", p)
    except PySparkException as e:
        pytest.skip(f"no Derby driver: {e}")
    assert readers.read_jdbc(spark, url, "numbers", p, ("id", 0, 5, 2)).count() == 5


def test_generated(spark):
    df = generate.individuals(spark, 2000, 3)
    assert df.count() == 2000 and df.where("happy <> (attributes[0] > 0.5)").count() == 0
    assert 850 < df.agg(F.avg(F.col("zip").cast("int"))).first()[0] < 1150
    assert generate.individuals(spark, 10, 2, same_id=True).select("id").distinct().count() == 1


# ---- functions, errors ---------------------------------------------------------------------------------------------
def test_functions(spark):
    udfs.register(spark)
    df = spark.createDataFrame([("aé", 1, [1, None, 2]), (None, 2, []), ("xyz", 3, None)], "s string, n long, a array<int>")
    df.createOrReplaceTempView("f")
    assert [tuple(r) for r in spark.sql("SELECT str_len(s), add_five(n) FROM f ORDER BY n").collect()] == [(2, 6), (None, 7), (3, 8)]
    assert spark.sql("SELECT our_avg(n) FROM f").first()[0] == 2.0
    assert [r.t for r in df.select(udfs.array_sum("a").alias("t")).collect()] == [3, 0, None]
    assert [r.x for r in df.select(udfs.add_row(1)("n").alias("x")).collect()] == [2, 3, 4]
    assert [r.x for r in df.select(udfs.add_in_struct(1, "n")(F.struct("n")).alias("x")).collect()] == [2, 3, 4]
    got = udfs.pipe_lookup(df, "n", "sed 's/$/ b a b/'").collect()
    assert sorted((r.key, r.tokens) for r in got) == [(k, ["a", "b"]) for k in "123"]


def test_errors_surface_at_the_action(spark):
    bad = spark.range(3).select((F.lit(1) / F.col("id")).alias("x"))
    with pytest.raises(PySparkException):
        bad.collect()
    assert spark.range(3).select(F.try_divide(F.lit(1), F.col("id")).alias("x")).agg(F.count_if(F.col("x").isNull())).first()[0] == 1


# ---- quality, pipelines --------------------------------------------------------------------------------------------
def test_quality(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    rules = [Rule("positive", "v > 0", action="drop"), Rule("known", "v IS NOT NULL"), Rule("enough", "count(*) > 1", "query", "fail")]
    assert {r.rule: (r.n_rows, r.n_failed) for r in report(df, rules).collect()} == {"positive": (3, 2), "known": (3, 1), "enough": (3, 0)}
    kept, dropped = enforce(df, rules)
    assert [r.k for r in kept.collect()] == [1] and {r.k: r.failed_rules for r in dropped.collect()} == {2: ["positive"], 3: ["positive"]}
    with pytest.raises(QualityError):
        enforce(df, rules, most_dropped=0.5)
    with pytest.raises(QualityError):
        enforce(df, [Rule("many", "count(*) > 9", "query", "fail")])
    assert {r.check: r.n_failed for r in column_checks(df, {"k": "int"}, {"v": (0, 10)}, ["v"]).collect()} == {"range_v": 1, "not_null_v": 1}
    with pytest.raises(QualityError):
        column_checks(df, {"k": "string"})


def test_pipeline(spark):
    p = Pipeline(spark, {"raw": spark.createDataFrame([("a", 3), ("b", 20)], "creator string, stars int")})

    @p.view
    def popular(raw):
        return raw.where("stars > 10")

    @p.table
    def stored(popular):
        return popular.select("creator")

    p.sql("shouted", "SELECT upper(creator) AS c FROM {stored}", "stored")
    assert p.run("shouted")["shouted"].first().c == "B"
    p.view(lambda missing: missing)
    with pytest.raises(KeyError):
        p.run()


# ---- streams -------------------------------------------------------------------------------------------------------
def batches(spark, path, *rows):
    """A folder with one JSON file a batch, read a file at a time."""
    os.makedirs(path)
    for k, b in enumerate(rows):
        with open(f"{path}/{k}.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in b)
        os.utime(f"{path}/{k}.json", (1000 + k, 1000 + k))
    return path


def test_stream_windows_and_late_rows(spark, tmp_path):
    at = lambda m, s=0: f"2024-01-01T00:{m:02d}:{s:02d}Z"
    p = batches(spark, f"{tmp_path}/w", [{"timestamp": at(1), "word": "a"}, {"timestamp": at(12), "word": "a"}], [{"timestamp": at(2), "word": "a"}, {"timestamp": at(3), "word": "b"}])
    s = readers.stream_json(spark, p, "timestamp timestamp, word string", 1)
    got = windows.collected(windows.tumbling_count(s, "timestamp", "10 minutes", "word"), "complete")
    assert sorted((r.window.start.minute, r.word, r.n) for r in got.collect()) == [(0, "a", 2), (0, "b", 1), (10, "a", 1)]
    a = batches(spark, f"{tmp_path}/a", [{"k": "x", "t": at(1), "v": 1}], [{"k": "x", "t": at(40), "v": 2}], [{"k": "x", "t": at(41), "v": 4}], [{"k": "y", "t": at(2), "v": 3}])
    b = batches(spark, f"{tmp_path}/b", [{"k": "x", "t": at(1, 3), "v": 1}], [{"k": "x", "t": at(40, 4), "v": 2}], [{"k": "z", "t": at(41), "v": 4}], [{"k": "y", "t": at(2, 1), "v": 3}])
    left = readers.stream_json(spark, a, "k string, t timestamp, v int", 1)
    right = readers.stream_json(spark, b, "k string, t timestamp, v int", 1).withColumnsRenamed({"t": "t2", "v": "v2"})
    out = windows.collected(windows.interval_join(left, right, "k", "t", "t2", "5 seconds", "10 seconds", "5 seconds"), "append")
    assert sorted((r.k, r.v, r.v2) for r in out.collect()) == [("x", 1, 1), ("x", 2, 2)], "the late pair of y is dropped"
    with pytest.warns(UserWarning):
        windows.interval_join(left, right, "k", "t", "t2", "5 minutes", "10 seconds")
    with pytest.warns(UserWarning):
        windows.equality_join(left, right, "k")


def test_stream_sinks_and_restart(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    with open(f"{tmp_path}/in/1.txt", "w") as f:
        f.write("a b\nb\n")
    s = readers.stream_text(spark, f"{tmp_path}/in")
    seen = {}
    for expected in ([("a", 1), ("b", 2)], [("a", 1), ("b", 2), ("c", 1)]):
        q = windows.start_batches(windows.word_count(s.select("value")), "complete", f"{tmp_path}/ck", lambda df, k: seen.update({k: sorted(map(tuple, df.collect()))}), available_now=True)
        q.awaitTermination()
        assert seen[max(seen)] == expected
        with open(f"{tmp_path}/in/2.txt", "w") as f:
            f.write("c\n")
    q = windows.start(readers.stream_rate(spark).select("value"), "append", "noop", f"{tmp_path}/ck2")
    time.sleep(1)
    q.stop()


# ---- models --------------------------------------------------------------------------------------------------------
def test_stages(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1), ("b", 2), (None, 3)], "t string, n int")
    assert [r.c for r in models.WordCount(inputCol="t", outputCol="c").transform(df).collect()] == [2, 1, None]
    with pytest.raises(TypeError):
        models.WordCount(inputCol="n", outputCol="c").transform(df)
    m = models.LabelIndexer(inputCol="t", outputCol="i").fit(df)
    assert [r.i for r in m.transform(df).collect()] == [0, 1, None] and dict(m.transform(df).dtypes)["i"] == "int"
    m.write().overwrite().save(f"file://{tmp_path}/m")
    assert models.LabelIndexerModel.load(f"file://{tmp_path}/m").transform(df).collect() == m.transform(df).collect()


def test_models(spark):
    rnd = random.Random(1)
    rows = [(float(y), float(rnd.random() < (0.8 if y else 0.2)), float(rnd.random() < 0.5), "hot text" if y else "cold words") for y in (rnd.randint(0, 1) for _ in range(300))]
    df = spark.createDataFrame(rows, "label double, f double, g double, t string")
    v = models.assembler("f", "g").transform(df)
    params = models.bernoulli_parameters(df, "label", ["f", "g"]).collect()
    from pyspark.ml.classification import NaiveBayes

    nb = NaiveBayes(modelType="bernoulli").fit(v)
    theta = {(p.label, p.feature): p.log_theta for p in params}
    for k, y in enumerate((0.0, 1.0)):
        for j, f in enumerate("fg"):
            assert abs(nb.theta.toArray()[k][j] - theta[y, f]) < 1e-9
    best = models.bernoulli_score({"f": 1.0, "g": 0.0}, params)
    assert max(best, key=best.get) == 1.0
    assert len(models.export_csv(models.logistic(v)).split(",")) == 3
    assert models.search(v.select("label", "features"), [0.1, 1.0]).avgMetrics[0] > 0.6
    assert models.text_to_bayes("t").fit(df).transform(df).where("prediction = label").count() == 300
    assert models.select_top(v, 1).first().selected.size == 1
    assert models.word_vectors(df, "t", 4, least=1).getVectors().count() == 4
    assert models.scaler(v).transform(v).first().scaled.size == 2
    i = models.indexer("t").fit(df)
    assert models.unindexer("t", i.labels).transform(i.transform(df)).where("t <> t_back").count() == 0


# ---- versioned tables ----------------------------------------------------------------------------------------------
def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshot_table(spark, tmp_path, monkeypatch):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(LookupError):
        t.read()
    one = t.append(spark.createDataFrame([(1, "a"), (2, None)], "k long, v string"), sort=["k"])
    two = t.append(spark.createDataFrame([(3, "c", 0.5)], "k long, v string, w double"), partition_by=["v"])
    assert values(t.read().select("k", "v")) == [(1, "a"), (2, None), (3, "c")]
    assert t.read().where("w is null").count() == 2 and t.read(version=one).columns == ["k", "v"]
    with pytest.raises(TypeError):
        t.append(spark.createDataFrame([("x",)], "k string"))
    three = t.delete("v = 'a'")  # unknown keeps the row with a null
    assert values(t.read().select("k")) == [(2,), (3,)] and t.read(version=two).count() == 3
    assert t.delete("k = 99") > three and values(t.read().select("k")) == [(2,), (3,)]
    t.overwrite(t.read().where("k = 2"))
    assert values(t.read().select("k")) == [(2,)]
    at = {r.id: r for r in t.snapshots().collect()}
    assert [at[k].operation for k in sorted(at)] == ["append", "append", "delete", "delete", "overwrite"] and at[one].sorted_by == ["k"]
    assert values(t.read(as_of=t._state()[1]["snapshots"][str(two)]["at"]).select("k")) == [(1,), (2,), (3,)]
    t.compact(1)
    assert t.files().count() == 1 and t.files().first().n_rows == 1


def test_snapshot_branches_and_cleanup(spark, tmp_path, monkeypatch):
    t, rows = SnapshotTable(spark, f"file://{tmp_path}/t"), lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    t.append(rows(1))
    assert t.publish(rows(2), {"no_null": "every(k is not null)"}) == {"no_null": True} and values(t.read()) == [(1,), (2,)]
    assert t.publish(rows(None), {"no_null": "every(k is not null)"}) == {"no_null": False} and values(t.read()) == [(1,), (2,)]
    t.branch("b")
    t.append(rows(3), "b")
    assert t.read().count() == 2 and t.read("b").count() == 3
    t.append(rows(4))
    with pytest.raises(Conflict):  # main has moved on since
        t.fast_forward("b")
    t.drop_branch("b")
    with pytest.raises(KeyError):
        t.read("b")
    # a writer that saw an older state tries again with the newer one
    stale, state = t._state(), t._state
    seen = iter([stale])
    t.append(rows(5))
    monkeypatch.setattr(t, "_state", lambda: next(seen, None) or state())
    t.append(rows(6))
    assert values(t.read()) == [(1,), (2,), (4,), (5,), (6,)]
    assert t.expire(time.time() + 1) > 0 and t.snapshots().count() == 1
    gone = t.remove_orphans(time.time() + 5)
    assert any(g.startswith("data/") for g in gone) and any(g.startswith("state/") for g in gone)
    assert values(t.read()) == [(1,), (2,), (4,), (5,), (6,)] and t.remove_orphans(time.time() + 5) == []
