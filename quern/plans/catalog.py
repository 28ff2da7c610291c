"""Maps each query name to its callable and, where SQL can express it, to its SQL.

Each callable takes (spark, sf_dir) and runs over whole tables. SQL runs in DuckDB over views named like the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import udfs
from quern.operators import aggregates, joins, ranks, relational, text
from quern.plans import pipeline, quality
from quern.session import importable
from quern.sources import generate, readers, writers
from quern.streaming import windows

_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: readers.read_table(importable(spark), sf_dir, table), spark, sf_dir)

        run.__name__, run.__doc__ = name, f.__doc__
        _queries[name] = run
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r(c, n: int = 4):
    """Rounded, so that sums in another order are equal."""
    return F.round(c, n)


RANK_COLS, RANKS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], [1, 100, 5000]
_RANKS_SQL = "SELECT col, rank, value FROM (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY value) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value FROM lineitem" for c in RANK_COLS) + ")) WHERE rank IN (1, 100, 5000)"


#: Added before rounding where averages of a few two-digit prices would lie half way between two results.
NO_TIE = 0.0000123


# ---- rank statistics ----------------------------------------------------------------------------------------------
@query(_RANKS_SQL)
def rank_stats(t, spark, d):
    return ranks.rank_statistics(t("lineitem"), RANK_COLS, RANKS)


@query(_RANKS_SQL)
def rank_stats_prefix_sum(t, spark, d):
    return ranks.rank_statistics_by_prefix_sum(t("lineitem"), RANK_COLS, RANKS)


@query("SELECT 'l_discount' AS col, l_discount AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_tax', l_tax, count(*) FROM lineitem GROUP BY 2")
def rank_frequencies(t, spark, d):
    return ranks.frequencies(t("lineitem"), ["l_discount", "l_tax"])


# ---- projections and filters --------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem")
def project_ratio(t, spark, d):
    return relational.ratio(t("lineitem"), "l_extendedprice", "l_quantity", "unit_price", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status_code FROM orders")
def case_encode(t, spark, d):
    return relational.encode(t("orders"), "o_orderstatus", {"F": 0, "O": 1}, 2, "status_code").select("o_orderkey", "status_code")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45")
def filter_threshold(t, spark, d):
    return relational.at_least(t("lineitem"), "l_quantity", 45).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT doc_id, quality FROM labels WHERE NOT (toxic = 1)")
def filter_not_true(t, spark, d):
    return relational.not_true(t("labels"), F.col("toxic") == 1).select("doc_id", "quality")


@query("SELECT vec_id, label FROM embeddings WHERE embedding[1] > embedding[2]")
def array_compare_filter(t, spark, d):
    return relational.first_above_second(t("embeddings"), "embedding").select("vec_id", "label")


@query("SELECT s_suppkey FROM (SELECT s_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS back FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey) WHERE back >= n / 3.0 / 2")
def filter_half(t, spark, d):
    by = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg((F.count("*") / 3).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("back"))
    return relational.at_least_half(by.join(t("supplier"), "s_suppkey", "left_semi"), "back", "n").select("s_suppkey")


@query("SELECT o_orderkey, l_extendedprice / l_quantity AS squeeze FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 400000")
def explode_structs(t, spark, d):
    dear = t("orders").where("o_totalprice > 400000")
    lines = t("lineitem").join(dear.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.array("l_extendedprice", "l_quantity").alias("attributes"))).alias("items"))
    nested = dear.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return relational.exploded_ratio(nested, "o_orderkey", "items", "attributes", "squeeze")


@query("SELECT o_orderkey, l_extendedprice / l_quantity AS squeeze FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def explode_structs_all(t, spark, d):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.array("l_extendedprice", "l_quantity").alias("attributes"))).alias("items"))
    nested = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return relational.exploded_ratio(nested, "o_orderkey", "items", "attributes", "squeeze")


@query("SELECT vec_id, pos - 1 AS pos, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)")
def explode_array(t, spark, d):
    return t("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v"))


@query("SELECT vec_id, round(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: CAST(x AS DOUBLE))), 4) AS positive FROM embeddings")
def sum_positive(t, spark, d):
    return t("embeddings").select("vec_id", r(relational.sum_positive(F.col("embedding").cast("array<double>"))).alias("positive"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, embedding[1] > 0.5 AS squishy FROM embeddings")
def array_element(t, spark, d):
    e = relational.element("embedding", 0)
    return t("embeddings").select("vec_id", e.cast("double").alias("first"), (e > 0.5).alias("squishy"))


@query("SELECT o_orderkey, CAST(o_totalprice AS INTEGER) AS whole_price FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders)")
def cast_projection(t, spark, d):
    return t("orders").select("o_orderkey", F.col("o_totalprice").cast("int").alias("whole_price"))


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 1)")
def deny_list(t, spark, d):
    return relational.without(t("documents"), t("labels").where("toxic = 1"), "doc_id").select("doc_id", "source")


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS n_kept, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS n_rejected FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)")
def deny_list_counts(t, spark, d):
    return relational.without_counted(t("documents"), t("labels").where("toxic = 1"), "doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND p_brand = 'Brand#12'")
def pushed_filter(t, spark, d):
    return readers.require(t("part"), "p_partkey bigint, p_name string, p_brand string, p_size int").where("p_size > 10 AND p_brand = 'Brand#12'").select("p_partkey", "p_name")


@query("SELECT range AS id FROM range(10)")
def range_view(t, spark, d):
    return spark.range(10)


@query("SELECT range AS id FROM range(10) WHERE range % 2 = 0")
def even_view(t, spark, d):
    return spark.sql("SELECT id FROM {r} WHERE id % 2 = 0", r=spark.range(10))


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 12")
def sql_view(t, spark, d):
    return spark.sql("SELECT p_partkey, p_size FROM {part} WHERE p_size < 12", part=t("part"))


@query("SELECT n_nationkey, n_name FROM nation")
def sql_over_file(t, spark, d):
    return readers.read_file_by_sql(spark, f"{d}/nation.parquet", "n_nationkey, n_name")


@query("SELECT d.doc_id FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, 1 AS seen FROM labels) l USING (doc_id) WHERE seen IS NULL")
def null_predicate(t, spark, d):
    seen = t("labels").select("doc_id", F.lit(1).alias("seen")).distinct()
    return t("documents").join(seen, "doc_id", "left").where(F.col("seen").isNull()).select("doc_id")


@query("SELECT event_id, user_id + 5 AS shifted FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL AND user_id + 5 IS NOT NULL")
def project_non_null(t, spark, d):
    e = t("events").where(F.get_json_object("props", "$.k").try_cast("int").isNotNull())
    return relational.project_non_null(e, F.col("event_id"), (F.col("user_id") + 5).alias("shifted"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE contains(props, 'k')")
def json_from_strings(t, spark, d):
    return t("events").where(F.col("props").contains("k")).select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# ---- joins --------------------------------------------------------------------------------------------------------
def _co(t):
    return t("customer").select("c_custkey", "c_name"), t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(t, spark, d):
    return joins.join(*_co(t), "c_custkey")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(t, spark, d):
    return joins.join(*_co(t), "c_custkey", "left_outer")


@query("SELECT o_custkey AS c_custkey, c_name, o_orderkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey")
def join_right(t, spark, d):
    return joins.join(*_co(t), "c_custkey", "right_outer")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(t, spark, d):
    return joins.join(*_co(t), "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def join_anti(t, spark, d):
    dear = t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.join(_co(t)[0], dear, "c_custkey", "left_anti")


@query("SELECT a.n_regionkey, a.n_name AS a_n_name, b.n_name AS b_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(t, spark, d):
    return joins.self_pairs(t("nation"), "n_regionkey", "n_name")


@query("SELECT c_mktsegment, event_type FROM (SELECT DISTINCT c_mktsegment FROM customer) JOIN (SELECT DISTINCT event_type FROM events) ON length(c_mktsegment) = length(event_type)")
def join_equal_length(t, spark, d):
    return joins.by_equal_length(t("customer").select("c_mktsegment").distinct(), "c_mktsegment", t("events").select("event_type").distinct(), "event_type")


@query("SELECT n_name, pattern FROM nation JOIN (SELECT DISTINCT substr(r_name, 1, 1) AS pattern FROM region) ON regexp_matches(n_name, pattern)")
def join_pattern(t, spark, d):
    patterns = t("region").select(F.substring("r_name", 1, 1).alias("pattern")).distinct()
    return joins.by_pattern(t("nation"), "n_name", patterns, "pattern").select("n_name", "pattern")


@query("SELECT n_name AS left_name, r_name AS right_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_structs(t, spark, d):
    j = joins.as_structs(t("nation").withColumnRenamed("n_regionkey", "k"), t("region").withColumnRenamed("r_regionkey", "k"), "k")
    return j.select(F.col("left.n_name").alias("left_name"), F.col("right.r_name").alias("right_name"))


@query("SELECT c_custkey, o_totalprice, c_name FROM (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey")
def best_score_then_join(t, spark, d):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return joins.best_then_join(o, t("customer").select("c_custkey", "c_name"), "c_custkey", "o_totalprice")


@query("SELECT c_custkey, max(o_totalprice) AS o_totalprice, min(c_nationkey) AS c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_then_best_score(t, spark, d):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return joins.join_then_best(o, t("customer").select("c_custkey", "c_nationkey"), "c_custkey", "o_totalprice", "c_nationkey")


@query("SELECT c_custkey, o_totalprice, c_name FROM (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) RIGHT JOIN customer ON o_custkey = c_custkey")
def best_score_outer(t, spark, d):
    o = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return joins.best_then_join(o, t("customer").select("c_custkey", "c_name"), "c_custkey", "o_totalprice", "right_outer")


@query("SELECT k, coalesce(len(c), 0) AS n_customers, coalesce(len(s), 0) AS n_suppliers, c[1] AS first_customer, s[1] AS first_supplier FROM (SELECT c_nationkey AS k, list(c_custkey ORDER BY c_custkey) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, list(s_suppkey ORDER BY s_suppkey) AS s FROM supplier GROUP BY 1) USING (k)")
def cogroup_two(t, spark, d):
    g = joins.cogroup("k", c=(t("customer").withColumnRenamed("c_nationkey", "k"), "c_custkey"), s=(t("supplier").withColumnRenamed("s_nationkey", "k"), "s_suppkey"))
    return g.select("k", F.size("c").cast("long").alias("n_customers"), F.size("s").cast("long").alias("n_suppliers"), F.get("c", F.lit(0)).alias("first_customer"), F.get("s", F.lit(0)).alias("first_supplier"))


@query("SELECT k, (SELECT count(*) FROM customer WHERE c_nationkey = k) AS n_customers, (SELECT count(*) FROM supplier WHERE s_nationkey = k) AS n_suppliers, count(*) AS n_nations FROM (SELECT n_nationkey AS k FROM nation) GROUP BY 1")
def cogroup_three(t, spark, d):
    g = joins.cogroup("k", c=(t("customer").withColumnRenamed("c_nationkey", "k"), "c_custkey"), s=(t("supplier").withColumnRenamed("s_nationkey", "k"), "s_suppkey"), n=(t("nation").withColumn("k", F.col("n_nationkey")), "n_name"))
    return g.select("k", *(F.size(c).cast("long").alias(f"n_{name}") for c, name in (("c", "customers"), ("s", "suppliers"), ("n", "nations"))))


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_broadcast(t, spark, d):
    small = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return joins.with_lookup(t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), small, "l_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT o_orderkey, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_co_located(t, spark, d):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = t("orders").select("o_orderkey"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.co_located(a, b, "o_orderkey", n).groupBy("o_orderkey").agg(F.count("*").alias("n_lines"))


@query("SELECT round(sqrt(avg((p - o_totalprice) ^ 2)), 4) AS rmse FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def join_rmse(t, spark, d):
    p = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("p"))
    return joins.rmse(p, t("orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), "k", "p", "o_totalprice").select(r(F.col("rmse")).alias("rmse"))


# ---- aggregates ---------------------------------------------------------------------------------------------------
@query("SELECT c_nationkey, max(c_acctbal) AS max_balance FROM customer GROUP BY 1")
def group_max(t, spark, d):
    return aggregates.by_group(t("customer"), "c_nationkey", max_balance=F.max("c_acctbal"))


@query("SELECT c_nationkey, min(c_acctbal) AS min_balance, max(c_acctbal) AS max_balance FROM customer GROUP BY 1")
def group_min_max(t, spark, d):
    return aggregates.by_group(t("customer"), "c_nationkey", min_balance=F.min("c_acctbal"), max_balance=F.max("c_acctbal"))


@query("SELECT c_mktsegment, min(c_acctbal) AS min_balance, round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY 1")
def group_min_mean(t, spark, d):
    return aggregates.by_group(t("customer"), "c_mktsegment", min_balance=F.min("c_acctbal"), mean_balance=r(F.avg("c_acctbal")))


@query("SELECT p_brand, min(p_size) AS min_size, max(p_retailprice) AS max_price FROM part GROUP BY 1")
def group_mixed(t, spark, d):
    out = t("part").groupBy("p_brand").agg({"p_size": "min", "p_retailprice": "max"})
    return out.withColumnsRenamed({"min(p_size)": "min_size", "max(p_retailprice)": "max_price"})


@query("SELECT c AS col, count(v) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS stddev, min(v) AS min, max(v) AS max FROM (SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY 1")
def describe(t, spark, d):
    return aggregates.describe(t("lineitem"), "l_quantity", "l_extendedprice").withColumn("mean", r(F.col("mean"))).withColumn("stddev", r(F.col("stddev")))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def dedupe_first(t, spark, d):
    return aggregates.one_each(t("events"), "user_id", "event_id").select("user_id", "event_id")


@query("SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_returnflag = 'R'")
def filtered_sum(t, spark, d):
    return t("lineitem").where("l_returnflag = 'R'").agg(r(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, max(l_extendedprice) AS dearest, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_two_keys(t, spark, d):
    return aggregates.by_group(t("lineitem"), ["l_returnflag", "l_linestatus"], quantity=r(F.sum("l_quantity"), 2), dearest=F.max("l_extendedprice"), n=F.count("*"))


@query("SELECT label, max(CAST(embedding[3] AS DOUBLE)) AS third FROM embeddings GROUP BY 1")
def group_max_element(t, spark, d):
    return aggregates.by_group(t("embeddings"), "label", third=F.max(relational.element("embedding", 2).cast("double")))


@query("SELECT count(*) AS n_groups, round(avg(m), 4) AS mean FROM (SELECT l_partkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)")
def key_average_count(t, spark, d):
    by = aggregates.by_group(t("lineitem"), "l_partkey", m=F.avg("l_extendedprice"))
    return by.agg(F.count("*").alias("n_groups"), r(F.avg("m")).alias("mean"))


@query("SELECT l_quantity, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_quantity < 10 GROUP BY 1")
def sum_over_small(t, spark, d):
    return aggregates.sum_over_small(t("lineitem"), "l_quantity", 10)


@query("SELECT round(sum(l_tax), 4) AS total, max(l_tax) AS most, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem")
def accumulated(t, spark, d):
    return t("lineitem").agg(r(F.sum("l_tax")).alias("total"), F.max("l_tax").alias("most"), F.countDistinct("l_suppkey").alias("n_suppliers"))


@query("SELECT DISTINCT p_brand FROM part")
def distinct_values(t, spark, d):
    return t("part").select("p_brand").distinct()


@query("SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS label_index FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def label_index(t, spark, d):
    return aggregates.label_index(t("customer"), "c_mktsegment")


# ---- text ---------------------------------------------------------------------------------------------------------
@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def word_count(t, spark, d):
    return text.word_count(t("documents"), "text", empties=False)


@query(r"SELECT word, count(*) AS n FROM (SELECT lower(trim(unnest(regexp_split_to_array(text, '[ .,\n]')))) AS word FROM documents) WHERE word <> '' AND word NOT IN ('the', 'of', 'de', 'and') GROUP BY 1")
def word_count_stop(t, spark, d):
    return text.word_count_without(t("documents"), {"the", "of", "de", "and"}, ".,\n", "text")


@query("SELECT source, max(coalesce(list_max(list_transform(w, lambda x: length(x))), 0)) AS longest_word, CAST(sum(len(list_filter(w, lambda x: lower(x) = 'the'))) AS BIGINT) AS mentions, round(sum(len(w)) / count(*), 4) AS average_words FROM (SELECT source, CASE WHEN text <> '' AND trim(text, ' ') = '' THEN [] ELSE string_split(rtrim(text, ' '), ' ') END AS w FROM documents) GROUP BY 1")
def report_card(t, spark, d):
    return text.report_card(t("documents"), "source", "text", "the").withColumn("average_words", r(F.col("average_words")))


# ---- windows, order -----------------------------------------------------------------------------------------------
@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) + 0.0000123, 4) AS relative FROM customer")
def relative_to_window_avg(t, spark, d):
    return relational.relative_to_neighbours(t("customer"), "c_nationkey", ["c_custkey"], "c_acctbal", "relative").select("c_custkey", r(F.col("relative") + NO_TIE).alias("relative"))


@query("SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 0.0000123, 4) AS relative FROM part")
def relative_to_window_range(t, spark, d):
    return relational.relative_to_range(t("part"), "p_brand", "p_size", "p_retailprice", "relative", 5).select("p_partkey", r(F.col("relative") + NO_TIE).alias("relative"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size, p_retailprice DESC, p_partkey")
def order_two_keys(t, spark, d):
    return relational.ordered(t("part").select("p_partkey", "p_size", "p_retailprice"), F.asc("p_size"), F.desc("p_retailprice"), F.asc("p_partkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(t, spark, d):
    return relational.top(t("orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos, event_id FROM events")
def secondary_sort(t, spark, d):
    return relational.positions(t("events"), "user_id", "ts", "event_id").select("user_id", "pos", "event_id")


@query("SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS first_key FROM customer GROUP BY 1")
def sorted_groups(t, spark, d):
    g = relational.sorted_groups(t("customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", ["c_custkey"])
    return g.select("c_mktsegment", F.size("items").cast("long").alias("n"), F.get("items", F.lit(0))["c_custkey"].alias("first_key"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def partitioned_sort(t, spark, d):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return relational.partitioned_sorted(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), n, "l_orderkey", "l_linenumber")


# ---- sets, samples ------------------------------------------------------------------------------------------------
@query("SELECT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_subtract_keep_repeats(t, spark, d):
    return relational.subtract_keeping_repeats(t("orders").select(F.col("o_custkey").alias("k")), t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
def set_intersect(t, spark, d):
    return relational.intersection(t("orders").select(F.col("o_custkey").alias("k")), t("customer").select(F.col("c_custkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t, spark, d):
    return relational.union_all(t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")))


@query()
def sample_bernoulli(t, spark, d):
    return relational.sample(t("orders").select("o_orderkey"), 0.1, 7)


@query()
def sample_stratified(t, spark, d):
    return relational.stratified(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": 0.05, "O": 0.5}, 7)


@query("SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS BIGINT) % 1000 < 100")
def sample_by_key(t, spark, d):
    return relational.sample_by_key(t("orders").select("o_orderkey"), "o_orderkey", 100)


# ---- streaming ----------------------------------------------------------------------------------------------------
_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark, d):
    s = readers.stream_parquet(spark, d, _EVENTS, "events.parquet")
    return s.withColumn("ts", F.expr("to_timestamp(concat(cast(ts AS string), 'Z'))") if spark.conf.get("spark.sql.session.timeZone") != "UTC" else F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS stop, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_count(t, spark, d):
    out = windows.collected(windows.tumbling_count(_events(spark, d), "ts", "10 minutes", "event_type"), "complete")
    ntz = lambda c: F.to_utc_timestamp(c, "UTC").cast("timestamp_ntz")
    return out.select(ntz(F.col("window.start")).alias("start"), ntz(F.col("window.end")).alias("stop"), "event_type", "n")


@query("SELECT event_type AS word, count(*) AS count FROM events GROUP BY 1")
def stream_word_count(t, spark, d):
    return windows.collected(windows.word_count(_events(spark, d), "event_type"), "complete")


@query("SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 5 SECOND AND a.ts + INTERVAL 5 SECOND")
def interval_join(t, spark, d):
    a = _events(spark, d).select("user_id", F.col("event_id").alias("a_id"), F.col("ts").alias("a_ts"))
    b = _events(spark, d).select("user_id", F.col("event_id").alias("b_id"), F.col("ts").alias("b_ts"))
    out = windows.interval_join(a, b, "user_id", "a_ts", "b_ts", "5 seconds", "10 seconds", "5 seconds")
    return windows.collected(out, "append").select("user_id", "a_id", "b_id")


# ---- functions ----------------------------------------------------------------------------------------------------
@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n, n_chars FROM documents")
def udf_str_len(t, spark, d):
    return t("documents").select("doc_id", udfs.str_len()("text").alias("n"), "n_chars")


@query("SELECT c_custkey, c_custkey + 5 AS five, c_custkey + 5 AS by_batches, c_custkey + 5 AS native FROM customer")
def udf_add(t, spark, d):
    c = F.col("c_custkey")
    return t("customer").select(c, udfs.add(5)(c).alias("five"), udfs.add_by_batches(5)(c).alias("by_batches"), (c + 5).alias("native"))


@query("SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean, round(sum(c_acctbal), 4) AS total FROM customer GROUP BY 1")
def udf_grouped(t, spark, d):
    return t("customer").groupBy("c_nationkey").agg(udfs.mean_by_group()("c_acctbal").alias("mean"), udfs.total()("c_acctbal").alias("total")).select("c_nationkey", r(F.col("mean")).alias("mean"), r(F.col("total")).alias("total"))


@query("SELECT n_name AS value, CAST(length(n_name) AS BIGINT) AS length FROM nation")
def udf_partition(t, spark, d):
    return udfs.lengths_by_partition(t("nation"), "n_name")


@query("SELECT o_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS total FROM (SELECT DISTINCT o_orderkey FROM orders) JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def array_sum(t, spark, d):
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("a"))
    return t("orders").select("o_orderkey").distinct().join(g, "o_orderkey").select("o_orderkey", udfs.array_sum("a").alias("total"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, 2 AS n_tokens, 'a-b' || n_nationkey AS joined FROM nation")
def pipe_lookup(t, spark, d):
    return udfs.pipe_lookup(t("nation"), "n_nationkey", "sed 's/.*/& b& a b&/'").select("key", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "-").alias("joined"))


# ---- generators, pipelines, quality, tables -----------------------------------------------------------------------
@query()
def generated(t, spark, d):
    return generate.individuals(spark, 1000, 4).withColumn("attributes", F.size("attributes"))


@query("SELECT p_brand, p_partkey, p_retailprice, n, round(mean_price, 4) AS mean_price FROM part JOIN (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS mean_price FROM part GROUP BY 1) USING (p_brand) WHERE p_size > 10")
def pipeline_summary(t, spark, d):
    p = pipeline.Pipeline(spark, {"raw": t("part")})

    @p.view
    def popular(raw):
        return raw.where("p_size > 10").select("p_brand", "p_partkey", "p_retailprice")

    p.sql("stats", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS mean_price FROM {raw} GROUP BY p_brand", "raw")

    @p.view
    def summary(popular, stats):
        return popular.join(stats, "p_brand")

    return p.run("summary")["summary"]


_RULES = [quality.Rule("has_text", "n_chars > 0", action="drop"), quality.Rule("short", "n_chars <= 5000", action="drop"), quality.Rule("enough", "count(*) >= 100", kind="query", action="fail")]


@query("SELECT 'has_text' AS rule, count(*) AS n_rows, count(*) FILTER (WHERE NOT n_chars > 0) AS n_failed FROM documents UNION ALL SELECT 'short', count(*), count(*) FILTER (WHERE NOT n_chars <= 5000) FROM documents UNION ALL SELECT 'enough', count(*), CAST(count(*) < 100 AS BIGINT) FROM documents")
def quality_report(t, spark, d):
    return quality.report(t("documents"), _RULES)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 AND n_chars <= 5000")
def quality_kept(t, spark, d):
    return quality.enforce(t("documents").select("doc_id", "n_chars"), _RULES)[0]


@query('SELECT \'row_count\' AS "check", CAST(count(*) AS DOUBLE) AS value, count(*) >= 500 AS ok FROM orders WHERE o_totalprice > 0 UNION ALL SELECT \'null_share_o_custkey\', coalesce(avg(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0.0 END), 0), coalesce(avg(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0.0 END), 0) <= 0.01 FROM orders WHERE o_totalprice > 0')
def quality_validate(t, spark, d):
    return quality.validate(t("orders"), 500, {"o_custkey": 0.01}, "o_totalprice > 0")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT -c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 = 0 AND c_custkey > 0")
def upsert(t, spark, d):
    c = t("customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(c.where("c_custkey % 10 = 0 AND c_custkey > 0").withColumn("c_custkey", -F.col("c_custkey")))
    return writers.upsert(c, new, ["c_custkey"])
