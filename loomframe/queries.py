"""Queries over the test tables, each beside the DuckDB statement that gives the same rows.

A query goes through the public verbs and returns the plan of its result; doubles are rounded on both sides,
since sums are taken in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import loomframe as lf
from loomframe.functions import calculate as C
from loomframe.learn.tuning import k_fold_plan
from loomframe.operators.plotting import group_means, rolling_average
from loomframe.plans.frame import PID, Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def load(spark: SparkSession, sf: str, table: str, *columns: str, order: list[str] | None = None) -> Frame:
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return Frame.from_spark(df.select(*columns) if columns else df, order=order, name=table)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def named(f: Frame, df: DataFrame, digits: int = 4) -> DataFrame:
    """A plan over physical features with the features' names."""
    return rounded(df.select(*[F.col(c).alias(f._names[int(c[1:])]) for c in df.columns if c.startswith("f") and c[1:].isdigit()]), digits)


def one_row(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


# -- selection -------------------------------------------------------------------------------------------------------


@query("filter_query_string", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(spark, sf):
    return load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").points.copy("l_quantity > 45").to_spark()


@query("filter_text", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return load(spark, sf, "orders", "o_orderkey", "o_orderstatus").points.copy("o_orderstatus == F").to_spark()


@query("delete_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice <= 100000)")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderkey", "o_totalprice")
    f.points.delete("o_totalprice <= 100000")
    return f.to_spark()


#: No gap is at the first or last event, where directional fills raise.
GAPS = "CASE WHEN event_id % 7 = 3 AND event_id > (SELECT min(event_id) FROM events) AND event_id < (SELECT max(event_id) FROM events) THEN NULL ELSE value END"


def gapped(spark, sf, order=False) -> Frame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    first, last = events.agg(F.min("event_id"), F.max("event_id")).first()
    df = events.select("event_id", F.when((F.col("event_id") % 7 == 3) & (F.col("event_id") > first) & (F.col("event_id") < last), None).otherwise(F.col("value")).alias("value"))
    return Frame.from_spark(df, order=["event_id"] if order else None)


@query("filter_missing", f"SELECT event_id, {GAPS} AS value FROM events WHERE {GAPS} IS NULL")
def _(spark, sf):
    return gapped(spark, sf).points.copy("value is missing").to_spark()


@query("filter_any_negative", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey < 0 OR c_acctbal < 0")
def _(spark, sf):
    return load(spark, sf, "customer", "c_custkey", "c_acctbal").points.copy(lf.match.anyNegative).to_spark()


@query("filter_function", "SELECT n_nationkey, n_name FROM nation WHERE length(n_name) > 7")
def _(spark, sf):
    return load(spark, sf, "nation", "n_nationkey", "n_name").points.copy(lambda p: len(p["n_name"]) > 7).to_spark()


@query("count_points", "SELECT count(*) AS n FROM lineitem WHERE l_discount >= 0.05")
def _(spark, sf):
    return one_row(spark, n=load(spark, sf, "lineitem", "l_discount").points.count("l_discount >= 0.05"))


@query("retain_columns", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    f = load(spark, sf, "orders")
    f.features.retain(["o_orderkey", "o_custkey"])
    return f.to_spark()


@query("delete_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    f = load(spark, sf, "orders")
    f.features.delete(["o_orderdate", "o_orderpriority"])
    return f.to_spark()


@query("sort_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderkey", "o_totalprice", order=["o_orderkey"])
    f.points.sort("o_totalprice", reverse=True)
    return f.points.copy(number=100).to_spark()


@query("sort_multi_key", "SELECT row_number() OVER (ORDER BY s_nationkey, s_acctbal, s_suppkey) - 1 AS place, s_suppkey FROM supplier")
def _(spark, sf):
    f = load(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal", order=["s_suppkey"])
    f.points.sort(["s_nationkey", "s_acctbal"])
    return f.to_spark(pid=True).select(F.col(PID).alias("place"), "s_suppkey")


@query("point_range", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) WHERE p BETWEEN 10 AND 200")
def _(spark, sf):
    return load(spark, sf, "orders", "o_orderkey", order=["o_orderkey"]).points.copy(start=10, end=200).to_spark()


@query("unique_points", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(spark, sf):
    return load(spark, sf, "lineitem", "l_returnflag", "l_linestatus").points.unique().to_spark()


@query("count_elements", "SELECT count(*) FILTER (p_size > 25) + count(*) FILTER (p_retailprice > 25) AS n FROM part")
def _(spark, sf):
    return one_row(spark, n=load(spark, sf, "part", "p_size", "p_retailprice").countElements("> 25"))


@query("count_unique_elements", "SELECT v AS value, count(*) AS n FROM (SELECT p_brand AS v FROM part UNION ALL SELECT p_type FROM part) GROUP BY v")
def _(spark, sf):
    f = load(spark, sf, "part", "p_brand", "p_type")
    return f._long([0, 1]).groupBy("value").agg(F.count("*").alias("n"))


@query("matching_elements", "SELECT p_partkey, p_size > 25 AS p_size FROM part")
def _(spark, sf):
    f = load(spark, sf, "part", "p_partkey", "p_size")
    flags = f.matchingElements("> 25", features="p_size")
    both, a, b = f._beside(flags)
    return both.select(a[0].alias("p_partkey"), b[0].alias("p_size"))


@query("transform_elements", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    f.transformElements({"F": "final", "O": "open"}, features="o_orderstatus")
    return f.to_spark()


# -- statistics --------------------------------------------------------------------------------------------------------

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_each = lambda f: ", ".join(f"{f(c)} AS {c}" for c in COLUMNS)
STATISTICS = {
    "mean": lambda c: f"round(avg({c}), 4)", "median": lambda c: f"round(median({c}), 4)", "min": lambda c: f"min({c}) + 0.0", "max": lambda c: f"max({c})",
    "sum": lambda c: f"round(sum({c}), 2)", "variance": lambda c: f"round(var_samp({c}), 2)", "standard deviation": lambda c: f"round(stddev_samp({c}), 4)",
    "population standard deviation": lambda c: f"round(stddev_pop({c}), 4)", "unique count": lambda c: f"count(DISTINCT {c})", "count": lambda c: f"count({c})",
    "proportion missing": lambda c: f"round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 4)", "proportion zero": lambda c: f"round(avg(CASE WHEN {c} = 0 THEN 1 ELSE 0 END), 4)",
    "mode": lambda c: f"(SELECT quantile_disc(v, 0.5) FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY {c} QUALIFY n = max(n) OVER ()))",
    "median absolute deviation": lambda c: f"(SELECT round(median(abs({c} - m)), 4) FROM lineitem, (SELECT median({c}) AS m FROM lineitem))",
}


def _statistic(name: str):
    def run(spark, sf):
        f = load(spark, sf, "lineitem", *COLUMNS)
        return named(f, f.feature_statistics(name), 2 if name in ("sum", "variance") else 4).select(*[(F.col(c) + 0.0).alias(c) if name == "min" else c for c in COLUMNS])

    return run


for _s, _sql in STATISTICS.items():
    _from = "" if _s in ("mode", "median absolute deviation") else " FROM lineitem"
    query(f"stats_{_s.replace(' ', '_')}", f"SELECT {_each(_sql)}{_from}")(_statistic(_s))


@query("stats_quartiles", " UNION ALL ".join(f"SELECT {i} AS q, {_each(lambda c, p=p: f'round(quantile_cont({c}, {p}), 4)')} FROM lineitem" for i, p in enumerate((0.25, 0.5, 0.75))))
def _(spark, sf):
    f = load(spark, sf, "lineitem", *COLUMNS)
    row = f.feature_statistics("quartiles")
    return rounded(row.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("q"), "*").select("q", *[F.element_at(f"f{i}", F.col("q") + 1).alias(c) for i, c in enumerate(COLUMNS)]))


@query("points_statistics", "SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3, 4) AS mean, greatest(l_quantity, l_discount, l_tax) AS max, round(list_aggregate([l_quantity, l_discount, l_tax], 'median'), 4) AS median FROM lineitem")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    v = f.features.copy(["l_quantity", "l_discount", "l_tax"])
    keys = f.features.copy(["l_orderkey", "l_linenumber"])._df.select(PID, F.col("f0").alias("l_orderkey"), F.col("f1").alias("l_linenumber"))
    for s in ("mean", "max", "median"):
        keys = keys.join(v.points.statistics(s)._df.select(PID, F.col("f0").alias(s)), PID)
    return rounded(keys.drop(PID))


@query("report", "SELECT 'c_acctbal' AS feature, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(median(c_acctbal), 4) AS median, count(DISTINCT c_acctbal) AS unique_count FROM customer UNION ALL SELECT 'c_nationkey', round(avg(c_nationkey), 4), round(quantile_cont(c_nationkey, 0.25), 4), round(median(c_nationkey), 4), count(DISTINCT c_nationkey) FROM customer")
def _(spark, sf):
    r = load(spark, sf, "customer", "c_acctbal", "c_nationkey").features.report()
    df = r.to_spark()
    return rounded(df.select(F.col("pointNames").alias("feature"), "mean", F.col("Q1").alias("q1"), "median", F.col("uniqueCount").cast("long").alias("unique_count")))


GROUPED = {"mean": "round(avg(o_totalprice), 2)", "median": "round(median(o_totalprice), 2)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "sum": "round(sum(o_totalprice), 2)", "standard deviation": "round(stddev_samp(o_totalprice), 2)", "unique count": "count(DISTINCT o_totalprice)", "count": "count(o_totalprice)"}


def _grouped(name: str):
    def run(spark, sf):
        f = load(spark, sf, "orders", "o_orderpriority", "o_totalprice")
        return named(f, f.group_statistics(["f0"], name), 2)

    return run


for _s, _sql in GROUPED.items():
    query(f"group_{_s.replace(' ', '_')}", f"SELECT o_orderpriority, {_sql} AS o_totalprice FROM orders GROUP BY o_orderpriority")(_grouped(_s))


@query("group_median_absolute_deviation", "SELECT o_orderpriority, round(median(abs(o_totalprice - m)), 2) AS o_totalprice FROM orders JOIN (SELECT o_orderpriority AS k, median(o_totalprice) AS m FROM orders GROUP BY k) ON k = o_orderpriority GROUP BY o_orderpriority")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderpriority", "o_totalprice")
    return named(f, f.group_statistics(["f0"], "median absolute deviation"), 2)


@query("group_mode", "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS l_quantity FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_quantity QUALIFY n = max(n) OVER (PARTITION BY l_returnflag)) GROUP BY l_returnflag")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_returnflag", "l_quantity")
    return named(f, f.group_statistics(["f0"], "mode"))


@query("group_multi_key", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY ALL")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    return named(f, f.group_statistics(["f0", "f1"], "mean"))


@query("group_count_only", "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    got = load(spark, sf, "lineitem", "l_returnflag").groupByFeature("l_returnflag", countUniqueValueOnly=True)
    return spark.createDataFrame(list(got.items()), "value string, n long")


@query("group_means_interval", "SELECT c_mktsegment AS \"group\", round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, count(c_acctbal) AS n FROM customer GROUP BY c_mktsegment")
def _(spark, sf):
    return rounded(group_means(load(spark, sf, "customer", "c_acctbal", "c_mktsegment"), "c_acctbal", "c_mktsegment"))


@query("rolling_average", "SELECT round(x, 1) AS x, round(y, 1) AS y FROM (SELECT avg(s_acctbal) OVER w AS x, avg(s_nationkey) OVER w AS y, count(*) OVER w AS n FROM supplier WINDOW w AS (ORDER BY s_acctbal, s_suppkey ROWS 19 PRECEDING)) WHERE n = 20")
def _(spark, sf):
    return rounded(rolling_average(load(spark, sf, "supplier", "s_suppkey", "s_acctbal", "s_nationkey", order=["s_suppkey"]), "s_acctbal", "s_nationkey"), 1)


# -- merges --------------------------------------------------------------------------------------------------------------


def _merged(left, right, point, feature, key):
    left.merge(right, point=point, feature=feature, onFeature=key)
    return left.to_spark()


def _orders_customers(spark, sf):
    o = Frame.from_spark(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("key"), "o_orderkey"))
    c = Frame.from_spark(spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), "c_name"))
    return o, c


_C = "(SELECT c_custkey AS key, c_name FROM customer WHERE c_custkey % 3 <> 0)"
_O = "(SELECT o_custkey AS key, o_orderkey FROM orders)"
for _point, _how in (("intersection", "JOIN"), ("left", "LEFT JOIN"), ("union", "FULL JOIN")):
    query(f"merge_{_point}_union", f"SELECT key, o_orderkey, c_name FROM {_O} o {_how} {_C} c USING (key)")(lambda spark, sf, p=_point: _merged(*_orders_customers(spark, sf), p, "union", "key"))
    query(f"merge_{_point}_intersection", f"SELECT key FROM {_O} o {_how} {_C} c USING (key)")(lambda spark, sf, p=_point: _merged(*_orders_customers(spark, sf), p, "intersection", "key"))
    query(f"merge_{_point}_left", f"SELECT key, o_orderkey FROM {_O} o {_how} {_C} c USING (key)")(lambda spark, sf, p=_point: _merged(*_orders_customers(spark, sf), p, "left", "key"))


@query("merge_strict_union", "SELECT s_suppkey AS key, s_name, round(s_acctbal, 4) AS s_acctbal FROM supplier")
def _(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    a, b = (Frame.from_spark(s.select(F.col("s_suppkey").alias("key"), c)) for c in ("s_name", "s_acctbal"))
    return rounded(_merged(a, b, "strict", "union", "key"))


@query("merge_reconciled", "SELECT c_custkey AS key, c_acctbal AS v FROM customer")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    halves = [Frame.from_spark(c.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 2 == k, F.col("c_acctbal")).alias("v"))) for k in (0, 1)]
    return _merged(*halves, "union", "union", "key")


# -- reshaping ---------------------------------------------------------------------------------------------------------------


@query("melt", "SELECT l_orderkey, l_linenumber, ft, v FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR ft IN (l_discount, l_tax))")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax")
    f.points.splitByCollapsingFeatures(["l_discount", "l_tax"], "ft", "v")
    return f.to_spark()


@query("pivot", "SELECT o_orderpriority, max(n) FILTER (s = 'F') AS F, max(n) FILTER (s = 'O') AS O, max(n) FILTER (s = 'P') AS P FROM (SELECT o_orderpriority, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority")
def _(spark, sf):
    counts = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    f = Frame.from_spark(counts)
    f.points.combineByExpandingFeatures("o_orderstatus", "n")
    return f.to_spark().select("o_orderpriority", "F", "O", "P")


@query("split_by_parsing", "SELECT p_partkey, split_part(p_brand, '#', 1) AS word, split_part(p_brand, '#', 2) AS number FROM part")
def _(spark, sf):
    f = load(spark, sf, "part", "p_partkey", "p_brand")
    f.features.splitByParsing("p_brand", "#", ["word", "number"])
    return f.to_spark()


@query("one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT AS \"o_orderstatus=F\", (o_orderstatus = 'O')::BIGINT AS \"o_orderstatus=O\", (o_orderstatus = 'P')::BIGINT AS \"o_orderstatus=P\" FROM orders")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    f.replaceFeatureWithBinaryFeatures("o_orderstatus")
    return f.to_spark()


@query("int_codes", "SELECT o_orderkey, code AS o_orderpriority FROM orders JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY o_orderpriority) USING (o_orderpriority)")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderkey", "o_orderpriority", order=["o_orderkey"])
    f.transformFeatureToIntegers("o_orderpriority")
    return f.to_spark()


@query("repeat", "SELECT r_regionkey, r_name FROM region, range(3)")
def _(spark, sf):
    return load(spark, sf, "region", "r_regionkey", "r_name").points.repeat(3, True).to_spark()


@query("append", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderkey", "o_totalprice")
    low = f.points.copy("o_totalprice < 50000")
    low.points.append(f.points.copy("o_totalprice > 300000"))
    return low.to_spark()


@query("transpose", "SELECT max(r_regionkey) FILTER (r_regionkey = 0) AS a, max(r_regionkey) FILTER (r_regionkey = 4) AS e FROM region")
def _(spark, sf):
    f = load(spark, sf, "region", "r_regionkey", order=["r_regionkey"])
    return f.T._df.select(F.col("f0").alias("a"), F.col("f4").alias("e"))


@query("map_reduce", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def _(spark, sf):
    got = load(spark, sf, "part", "p_name").points.mapReduce(lambda p: [(w, 1) for w in p[0].split(" ")], lambda k, v: (k, len(v)))
    return got._df.select(F.col("f0").alias("word"), F.col("f1").alias("n"))


# -- fills and normalisation -----------------------------------------------------------------------------------------------------

_E = f"(SELECT event_id, {GAPS} AS v FROM events)"
FILLS = {
    "constant": f"SELECT event_id, coalesce(v, 0) AS value FROM {_E}",
    "mean": f"SELECT event_id, round(coalesce(v, avg(v) OVER ()), 4) AS value FROM {_E}",
    "median": f"SELECT event_id, round(coalesce(v, (SELECT median(v) FROM {_E})), 4) AS value FROM {_E}",
    "forward": f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS value FROM {_E}",
    "backward": f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_E}",
    "interpolate": f"SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (p - pp) / (np - pp) END, 4) AS value FROM (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS pp, last_value(v IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER b AS np, first_value(v IGNORE NULLS) OVER b AS nv FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS p FROM {_E}) WINDOW a AS (ORDER BY event_id), b AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
}
_HOW = {"constant": 0.0, "mean": lf.fill.mean, "median": lf.fill.median, "forward": lf.fill.forwardFill, "backward": lf.fill.backwardFill, "interpolate": lf.fill.interpolate}


def _filled(how: str):
    def run(spark, sf):
        f = gapped(spark, sf, order=how in ("forward", "backward", "interpolate"))
        f.features.fillMatching(_HOW[how], lf.match.missing, features="value")
        return rounded(f.to_spark())

    return run


for _h, _sql in FILLS.items():
    query(f"fill_{_h}", _sql)(_filled(_h))


@query("fill_mode", "SELECT o_orderkey, coalesce(s, (SELECT s FROM (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS s, count(*) AS n FROM orders GROUP BY s) WHERE s IS NOT NULL ORDER BY n DESC, s LIMIT 1)) AS p FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS s FROM orders)")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p"))
    f = Frame.from_spark(df)
    f.features.fillMatching(lf.fill.mode, lf.match.missing, features="p")
    return f.to_spark()


NORMAL = {
    "meanNormalize": "p_retailprice - avg(p_retailprice) OVER ()",
    "meanStandardDeviationNormalize": "(p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER ()",
    "range0to1Normalize": "(p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())",
    "percentileNormalize": "((rank() OVER (ORDER BY p_retailprice) - 1) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) / (count(*) OVER () - 1)",
}


def _normal(how: str):
    def run(spark, sf):
        f = load(spark, sf, "part", "p_partkey", "p_retailprice")
        f.features.normalize(how, features="p_retailprice")
        return rounded(f.to_spark())

    return run


for _h, _sql in NORMAL.items():
    query(f"normalize_{_h}", f"SELECT p_partkey, round({_sql}, 4) AS p_retailprice FROM part")(_normal(_h))


# -- similarity and metrics ---------------------------------------------------------------------------------------------------------


def _pairs(sql: str, names=("l_quantity", "l_extendedprice", "l_discount")) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS feature, {', '.join(f'round({sql.format(a=a, b=b)}, 4) AS {b}' for b in names)} FROM lineitem" for a in names)


def _similar(kind: str):
    def run(spark, sf):
        got = load(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_discount").features.similarities(kind)
        return rounded(got.to_spark().withColumnRenamed("pointNames", "feature"))

    return run


for _k, _sql in {"correlation": "corr({a}, {b})", "covariance": "covar_samp({a}, {b})"}.items():
    query(f"similarity_{_k}", _pairs(_sql))(_similar(_k))

METRICS = {
    "rootMeanSquareError": "sqrt(avg(pow(k - p, 2)))", "meanAbsoluteError": "avg(abs(k - p))", "rSquared": "1 - avg(pow(k - p, 2)) / var_pop(k)", "fractionIncorrect": "avg((k <> p)::INT)",
    "fractionCorrect": "avg((k = p)::INT)", "cosineSimilarity": "sum(k * p) / (sqrt(sum(k * k)) * sqrt(sum(p * p)))", "recall": "count(*) FILTER (k = 1 AND p = 1) / count(*) FILTER (k = 1)",
    "precision": "count(*) FILTER (k = 1 AND p = 1) / count(*) FILTER (p = 1)", "specificity": "count(*) FILTER (k <> 1 AND p <> 1) / count(*) FILTER (k <> 1)", "f1Score": "2.0 * count(*) FILTER (k = 1 AND p = 1) / (count(*) FILTER (k = 1) + count(*) FILTER (p = 1))",
}


def _metric(name: str):
    def run(spark, sf):
        f = load(spark, sf, "labels", "quality", "toxic")
        value = getattr(C, name)(f.features.copy("quality"), f.features.copy("toxic"))
        return one_row(spark, value=round(float(value), 6))

    return run


for _m, _sql in METRICS.items():
    query(f"metric_{_m}", f"SELECT round({_sql}, 6) AS value FROM (SELECT quality AS k, toxic AS p FROM labels)")(_metric(_m))


@query("confusion_matrix", "SELECT 'predicted_' || a AS point, count(*) FILTER (quality = 0) AS known_0, count(*) FILTER (quality = 1) AS known_1 FROM labels RIGHT JOIN (SELECT DISTINCT quality AS a FROM labels) ON toxic = a GROUP BY a")
def _(spark, sf):
    f = load(spark, sf, "labels", "quality", "toxic")
    return C.confusionMatrix(f.features.copy("quality"), f.features.copy("toxic")).to_spark().withColumnRenamed("pointNames", "point")


# -- arithmetic ------------------------------------------------------------------------------------------------------------------------


def _arithmetic(op: Callable[[Frame, Frame], Frame]):
    def run(spark, sf):
        f = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax")
        a = f.features.copy("l_quantity")
        b = f.features.copy("l_tax")
        b.features.setNames(["l_quantity"])
        got = op(a, b)
        keys, x, y = f._beside(got)
        return rounded(keys.select(x[0].alias("l_orderkey"), x[1].alias("l_linenumber"), y[0].alias("v")))

    return run


for _n, (_op, _sql) in {
    "add": (lambda a, b: a + b, "l_quantity + l_tax"), "sub": (lambda a, b: a - b, "l_quantity - l_tax"), "mul": (lambda a, b: a * b, "l_quantity * l_tax"), "scalar_div": (lambda a, b: a / 7, "l_quantity / 7"),
    "floordiv": (lambda a, b: a // 7, "floor(l_quantity / 7)"), "mod": (lambda a, b: (a - 25) % 7, "(l_quantity - 25) - 7 * floor((l_quantity - 25) / 7)"), "pow": (lambda a, b: a**2, "pow(l_quantity, 2)"),
}.items():
    query(f"elementwise_{_n}", f"SELECT l_orderkey, l_linenumber, round({_sql}, 4) AS v FROM lineitem")(_arithmetic(_op))


# rounded so finely that no mean is halfway between two results, where the order of a sum would decide
@query("stretch_sub_mean", "SELECT round(l_quantity - avg(l_quantity) OVER (), 9) AS l_quantity, round(l_tax - avg(l_tax) OVER (), 9) AS l_tax FROM lineitem")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_quantity", "l_tax")
    return rounded((f - f.features.mean().stretch).to_spark(), 9)


@query("matrix_multiply", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2 + l_tax * 3, 4) AS v FROM lineitem")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    got = f.features.copy(["l_quantity", "l_tax"]) @ lf.data([[2.0], [3.0]])
    both = f._df.join(got._df.select(PID, F.col("f0").alias("v")), PID)
    return rounded(both.select(F.col("f0").alias("l_orderkey"), F.col("f1").alias("l_linenumber"), "v"))


# -- learning -----------------------------------------------------------------------------------------------------------------------------


@query("residuals", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - (a + b * l_quantity), 2) AS residual FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    got = C.residuals(f.features.copy("l_extendedprice"), f.features.copy("l_quantity"))
    both, x, y = f._beside(got)
    return rounded(both.select(x[0].alias("l_orderkey"), x[1].alias("l_linenumber"), y[0].alias("residual")), 2)


@query("ridge", "SELECT round(sum(l_quantity * l_extendedprice) / (sum(l_quantity * l_quantity) + 10), 4) AS w FROM lineitem")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_quantity", "l_extendedprice")
    model = lf.train("RidgeRegression", f, "l_extendedprice", lamb=10)
    return one_row(spark, w=round(float(model.getAttributes()["w"][0][0]), 4))


_NEAR = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS p FROM embeddings),
n AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.p) AS r FROM e a, e b QUALIFY r <= 5),
c AS (SELECT vec_id, label, count(*) AS n, min(r) AS f FROM n GROUP BY ALL)
SELECT vec_id, label AS predicted FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, f) = 1"""


@query("knn_classify", _NEAR)
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    f = Frame.from_spark(e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]), order=["vec_id"])
    x = f.features.copy([f"e{i}" for i in range(64)])
    got = lf.trainAndApply("KNNClassifier", x, f.features.copy("label"), x, k=5)
    return f._df.join(got._df.select(PID, F.col("f0").alias("predicted")), PID).select(F.col("f0").alias("vec_id"), "predicted")


@query("train_test_sizes", "SELECT count(*) - round_even(count(*) * 0.3, 0)::BIGINT AS train, round_even(count(*) * 0.3, 0)::BIGINT AS test FROM orders")
def _(spark, sf):
    a, b = load(spark, sf, "orders", "o_orderkey").trainAndTestSets(0.3)
    return one_row(spark, train=a._df.count(), test=b._df.count())


@query("kfold_sizes", "SELECT i::INT AS fold, (SELECT count(*) FROM supplier) // 7 + (i < (SELECT count(*) FROM supplier) % 7)::INT AS n FROM range(7) t(i)")
def _(spark, sf):
    return k_fold_plan(load(spark, sf, "supplier", "s_suppkey"), 7, 42).groupBy("fold").agg(F.count("*").alias("n"))


# -- more verbs ----------------------------------------------------------------------------------------------------------------------------

_TESTS = {"Zero": "{c} = 0", "NonZero": "{c} <> 0", "Positive": "{c} > 0", "Negative": "{c} < 0"}


def _matched(name: str):
    def run(spark, sf):
        f = load(spark, sf, "customer", "c_custkey", "c_nationkey", "c_acctbal")
        flags = f.matchingElements(getattr(lf.match, name), features=["c_nationkey", "c_acctbal"])
        both, a, b = f._beside(flags)
        return both.select(a[0].alias("c_custkey"), b[0].alias("n"), b[1].alias("b"))

    return run


def _any_all(name: str):
    def run(spark, sf):
        f = load(spark, sf, "customer", "c_nationkey", "c_acctbal")
        return f.points.copy(getattr(lf.match, name)).to_spark()

    return run


for _t, _sql in _TESTS.items():
    _n, _b = _sql.format(c="c_nationkey"), _sql.format(c="c_acctbal")
    query(f"match_{_t[0].lower()}{_t[1:]}", f"SELECT c_custkey, {_n} AS n, {_b} AS b FROM customer")(_matched(_t[0].lower() + _t[1:]))
    query(f"filter_any{_t}", f"SELECT c_nationkey, c_acctbal FROM customer WHERE {_n} OR {_b}")(_any_all(f"any{_t}"))
    query(f"filter_all{_t}", f"SELECT c_nationkey, c_acctbal FROM customer WHERE {_n} AND {_b}")(_any_all(f"all{_t}"))

for _t, _sql in {"anyMissing": "value IS NULL", "allMissing": "FALSE", "anyNonMissing": "TRUE", "allNonMissing": "value IS NOT NULL"}.items():
    query(f"filter_{_t}", f"SELECT * FROM (SELECT event_id, {GAPS} AS value FROM events) WHERE {_sql}")(lambda spark, sf, t=_t: gapped(spark, sf).points.copy(getattr(lf.match, t)).to_spark())


@query("points_extract", "SELECT o_orderkey, o_totalprice, o_totalprice > 200000 AS taken FROM orders")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderkey", "o_totalprice")
    taken = f.points.extract("o_totalprice > 200000")
    return taken.to_spark().withColumn("taken", F.lit(True)).unionByName(f.to_spark().withColumn("taken", F.lit(False)))


@query("points_retain", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    f.points.retain("o_orderstatus != O")
    return f.to_spark()


@query("points_insert", "SELECT CASE WHEN p < 5 THEN p WHEN own THEN p + 5 ELSE p END AS place, r_regionkey FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS p, n_nationkey AS r_regionkey, TRUE AS own FROM nation UNION ALL SELECT 4 + row_number() OVER (ORDER BY r_regionkey), r_regionkey, FALSE FROM region) WHERE NOT own OR p < 5 UNION ALL SELECT p + 5, k FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS p, n_nationkey AS k FROM nation) WHERE p >= 5")
def _(spark, sf):
    f = Frame.from_spark(spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("r_regionkey")), order=["r_regionkey"])
    f.points.insert(5, load(spark, sf, "region", "r_regionkey", order=["r_regionkey"]))
    return f.to_spark(pid=True).withColumnRenamed(PID, "place")


@query("points_replace", "SELECT p AS place, CASE WHEN p = 2 THEN 77 WHEN p = 4 THEN 88 ELSE r_regionkey END AS r_regionkey FROM (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS p, r_regionkey FROM region)")
def _(spark, sf):
    f = load(spark, sf, "region", "r_regionkey", order=["r_regionkey"])
    f.points.replace([[77], [88]], points=[2, 4], featureNames=["r_regionkey"])
    return f.to_spark(pid=True).select(F.col(PID).alias("place"), F.col("r_regionkey").cast("long").alias("r_regionkey"))


@query("points_permute", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS place, s_suppkey FROM supplier")
def _(spark, sf):
    f = load(spark, sf, "supplier", "s_suppkey", order=["s_suppkey"])
    f.points.permute()
    places = f.to_spark(pid=True).select(F.col(PID).alias("place"), "s_suppkey")
    f.points.sort("s_suppkey")
    return places.select("place").join(f.to_spark(pid=True).select(F.col(PID).alias("place"), "s_suppkey"), "place")


@query("points_transform", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2, 4) AS l_quantity FROM lineitem")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    f.points.transform(lambda p: [p[0], p[1], p[2] * 2])
    return rounded(f.to_spark()).select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")


@query("points_matching", "SELECT s_suppkey, s_acctbal > 1000 AS hit FROM supplier")
def _(spark, sf):
    f = load(spark, sf, "supplier", "s_suppkey", "s_acctbal")
    both, a, b = f._beside(f.points.matching("s_acctbal > 1000"))
    return both.select(a[0].alias("s_suppkey"), b[0].alias("hit"))


@query("transform_function", "SELECT p_partkey, (CASE WHEN p_size > 25 THEN p_size / 2.0 ELSE p_size END)::DOUBLE AS p_size FROM part")
def _(spark, sf):
    f = load(spark, sf, "part", "p_partkey", "p_size")
    f.transformElements(lambda v: v / 2 if v > 25 else v, features="p_size")
    return rounded(f.to_spark())


@query("features_extract", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    f.features.extract("o_orderstatus")
    return f.to_spark()


@query("features_append", "SELECT s_suppkey, s_acctbal, s_acctbal * 2 AS twice FROM supplier")
def _(spark, sf):
    f = load(spark, sf, "supplier", "s_suppkey", "s_acctbal", order=["s_suppkey"])
    more = f.features.copy("s_acctbal") * 2
    more.features.setNames(["twice"])
    f.features.append(more)
    return f.to_spark()


@query("features_insert", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    f = load(spark, sf, "supplier", "s_suppkey", "s_acctbal", order=["s_suppkey"])
    f.features.insert("s_acctbal", load(spark, sf, "supplier", "s_suppkey", "s_nationkey", order=["s_suppkey"]).features.copy("s_nationkey"))
    return f.to_spark()


@query("features_sort", "SELECT c_acctbal, c_custkey, c_nationkey FROM customer")
def _(spark, sf):
    f = load(spark, sf, "customer", "c_nationkey", "c_custkey", "c_acctbal")
    f.features.sort()
    return f.to_spark()


@query("features_matching", "SELECT 'c_acctbal' AS feature, min(c_acctbal) < 0 AS hit FROM customer UNION ALL SELECT 'c_custkey', min(c_custkey) < 0 FROM customer")
def _(spark, sf):
    got = load(spark, sf, "customer", "c_acctbal", "c_custkey").features.matching(lf.match.anyNegative)
    return got.to_spark().select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("boolean").alias("hit")) for c in ("c_acctbal", "c_custkey")])).alias("r")).select("r.feature", "r.hit")


@query("flatten", "SELECT sum(r_regionkey * (2 * r_regionkey + 1))::BIGINT AS a, count(*) * 2 AS n FROM region")
def _(spark, sf):
    f = Frame.from_spark(spark.read.parquet(f"{sf}/region.parquet").select(F.lit(0).cast("long").alias("zero"), "r_regionkey"), order=["r_regionkey"])
    f.flatten()
    cols = f._cols
    total = F.lit(0)
    for i, c in enumerate(cols):
        total = total + F.col(c) * i
    return f._df.select(total.cast("long").alias("a"), F.lit(len(cols)).cast("long").alias("n"))


@query("replace_rectangle", "SELECT n_nationkey, CASE WHEN n_nationkey BETWEEN 3 AND 7 THEN -1 ELSE n_regionkey END AS n_regionkey FROM nation")
def _(spark, sf):
    f = load(spark, sf, "nation", "n_nationkey", "n_regionkey", order=["n_nationkey"])
    f.replaceRectangle(-1, 3, "n_regionkey", 7, "n_regionkey")
    return f.to_spark().select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_regionkey").cast("long").alias("n_regionkey"))


def _logical(op):
    def run(spark, sf):
        f = load(spark, sf, "customer", "c_custkey", "c_acctbal")
        a, b = (f.matchingElements(q, features="c_acctbal") for q in ("> 1000", "< 5000"))
        both, x, y = f._beside(op(a, b))
        return both.select(x[0].alias("c_custkey"), y[0].cast("boolean").alias("v"))

    return run


for _n, (_op, _sql) in {"and": (lambda a, b: a & b, "c_acctbal > 1000 AND c_acctbal < 5000"), "or": (lambda a, b: a | b, "c_acctbal > 1000 OR c_acctbal < 5000"), "xor": (lambda a, b: a ^ b, "(c_acctbal > 1000) <> (c_acctbal < 5000)"), "invert": (lambda a, b: ~a, "NOT c_acctbal > 1000")}.items():
    query(f"logical_{_n}", f"SELECT c_custkey, {_sql} AS v FROM customer")(_logical(_op))

for _m, _sql in {
    "truePositive": "(count(*) FILTER (k = 1 AND p = 1))::DOUBLE", "trueNegative": "(count(*) FILTER (k <> 1 AND p <> 1))::DOUBLE", "falsePositive": "(count(*) FILTER (k <> 1 AND p = 1))::DOUBLE", "falseNegative": "(count(*) FILTER (k = 1 AND p <> 1))::DOUBLE",
    "balancedAccuracy": "(count(*) FILTER (k = 1 AND p = 1) / count(*) FILTER (k = 1) + count(*) FILTER (k <> 1 AND p <> 1) / count(*) FILTER (k <> 1)) / 2",
}.items():
    query(f"metric_{_m}", f"SELECT round({_sql}, 6) AS value FROM (SELECT quality AS k, toxic AS p FROM labels)")(_metric(_m))

for _n, (_op, _sql) in {
    "radd": (lambda a, b: 3 + a, "3 + l_quantity"), "rsub": (lambda a, b: 3 - a, "3 - l_quantity"), "rmul": (lambda a, b: 3 * a, "3 * l_quantity"), "rtruediv": (lambda a, b: 3 / a, "3 / l_quantity"),
    "neg": (lambda a, b: -a, "-l_quantity"), "abs": (lambda a, b: abs(a - 25), "abs(l_quantity - 25)"), "truediv": (lambda a, b: b / a, "l_tax / l_quantity"),
}.items():
    query(f"elementwise_{_n}", f"SELECT l_orderkey, l_linenumber, round({_sql}, 4) AS v FROM lineitem")(_arithmetic(_op))


# -- whole-table and typed matchers, linear algebra, validation, files, streams --------------------------------------------------------


@query("calculate_on_elements", "SELECT p_partkey * 2 AS p_partkey, p_size * 2 AS p_size FROM part")
def _(spark, sf):
    return load(spark, sf, "part", "p_partkey", "p_size").calculateOnElements(lambda v: v * 2).to_spark()


@query("contains_zero", "SELECT (SELECT count(*) > 0 FROM nation WHERE n_regionkey = 0) AS region, (SELECT count(*) > 0 FROM supplier WHERE s_suppkey = 0) AS supplier")
def _(spark, sf):
    return one_row(spark, region=load(spark, sf, "nation", "n_regionkey").containsZero(), supplier=load(spark, sf, "supplier", "s_suppkey").containsZero())


@query("identical", "SELECT TRUE AS same, FALSE AS changed, TRUE AS near")
def _(spark, sf):
    f = load(spark, sf, "orders", "o_orderkey", "o_totalprice", order=["o_orderkey"])
    g = f.copy()
    g.transformElements(lambda v: v + 1, features="o_totalprice")
    return one_row(spark, same=f.isIdentical(f.copy()), changed=f.isIdentical(g), near=f.isApproximatelyEqual(f.copy()))


@query("shape", "SELECT count(*) AS points, 3::BIGINT AS features FROM lineitem")
def _(spark, sf):
    n, p = load(spark, sf, "lineitem", "l_orderkey", "l_tax", "l_discount").shape
    return one_row(spark, points=n, features=F.lit(p).cast("long"))


@query("unflatten", "SELECT n_nationkey - n_nationkey % 5 AS first, n_nationkey - n_nationkey % 5 + 4 AS last FROM nation WHERE n_nationkey % 5 = 0")
def _(spark, sf):
    f = load(spark, sf, "nation", "n_nationkey", order=["n_nationkey"])
    f.flatten()
    f.unflatten((5, 5))
    return f._df.select(F.col("f0").cast("long").alias("first"), F.col("f4").cast("long").alias("last"))


@query("index_element", "SELECT n_name AS name FROM nation WHERE n_nationkey = 7")
def _(spark, sf):
    return one_row(spark, name=load(spark, sf, "nation", "n_nationkey", "n_name", order=["n_nationkey"])[7, "n_name"])


@query("index_slice", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 9")
def _(spark, sf):
    return load(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey", order=["n_nationkey"])[3:9, ["n_nationkey", "n_name"]].to_spark()


@query("point_view", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 1 OFFSET 4")
def _(spark, sf):
    return load(spark, sf, "supplier", "s_suppkey", "s_acctbal", order=["s_suppkey"]).pointView(4).to_spark()


@query("feature_view", "SELECT s_acctbal FROM supplier")
def _(spark, sf):
    return load(spark, sf, "supplier", "s_suppkey", "s_acctbal").featureView("s_acctbal").to_spark()


@query("features_count", "SELECT 2::BIGINT AS n")
def _(spark, sf):
    return one_row(spark, n=F.lit(load(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").features.count(lf.match.allNonMissing) - 1).cast("long"))


@query("features_permute", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    f = load(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    f.features.permute([2, 0, 1])
    return f.to_spark()


@query("features_transform", "SELECT p_partkey, p_size * 10 AS p_size FROM part")
def _(spark, sf):
    f = load(spark, sf, "part", "p_partkey", "p_size", order=["p_partkey"])
    f.features.transform(lambda v: [x * 10 for x in v], features="p_size")
    return f.to_spark().select("p_partkey", F.col("p_size").cast("long").alias("p_size"))


@query("features_replace", "SELECT s_suppkey, -s_acctbal AS s_acctbal FROM supplier")
def _(spark, sf):
    f = load(spark, sf, "supplier", "s_suppkey", "s_acctbal", order=["s_suppkey"])
    f.features.replace(-f.features.copy("s_acctbal"), features="s_acctbal")
    return f.to_spark()


@query("features_repeat", "SELECT r_regionkey AS a, r_regionkey AS b FROM region")
def _(spark, sf):
    f = load(spark, sf, "region", "r_regionkey").features.repeat(2, True)
    return f._df.select(F.col("f0").alias("a"), F.col("f1").alias("b"))


@query("features_unique", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    r = spark.read.parquet(f"{sf}/region.parquet")
    return Frame.from_spark(r.select("r_regionkey", "r_name", F.col("r_regionkey").alias("again"))).features.unique().to_spark()


@query("points_fill_matching", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(spark, sf):
    f = load(spark, sf, "customer", "c_custkey", "c_acctbal", order=["c_custkey"])
    f.points.fillMatching(0, lf.match.negative)
    return f.to_spark().select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query("normalize_rangeNormalize", "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) * 4 - 2, 4) AS p_retailprice FROM part")
def _(spark, sf):
    f = load(spark, sf, "part", "p_partkey", "p_retailprice")
    f.features.normalize(lambda a, b=None: C.rangeNormalize(a, b, -2, 2), features="p_retailprice")
    return rounded(f.to_spark())


@query("elementwise_multiply", "SELECT round(l_quantity * l_tax, 4) AS v FROM lineitem")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_quantity", "l_tax")
    a, b = f.features.copy("l_quantity"), f.features.copy("l_tax")
    b.features.setNames(["l_quantity"])
    return rounded(C.elementwiseMultiply(a, b)._df.select(F.col("f0").alias("v")))


@query("elementwise_power", "SELECT round(pow(l_tax, 2.0), 6) AS v FROM lineitem")
def _(spark, sf):
    return rounded(C.elementwisePower(load(spark, sf, "lineitem", "l_tax"), 2)._df.select(F.col("f0").alias("v")), 6)


#: Sums of products of two features: a square table that has an inverse.
_GRAM = "SELECT sum(s_acctbal * s_acctbal)::DOUBLE / 1000000 AS a, sum(s_acctbal)::DOUBLE / 1000 AS b, count(*)::DOUBLE AS d FROM supplier"


def _gram_frame(spark, sf) -> Frame:
    a, b, d = spark.read.parquet(f"{sf}/supplier.parquet").agg(F.sum(F.col("s_acctbal") * F.col("s_acctbal")) / 1e6, F.sum("s_acctbal") / 1e3, F.count("*").cast("double")).first()
    return lf.data([[float(a), float(b)], [float(b), float(d)]], featureNames=["x", "y"])


def _xy(f: Frame, digits: int) -> DataFrame:
    return rounded(f._df.select(F.col("f0").cast("double").alias("x"), F.col("f1").cast("double").alias("y")), digits)


@query("matrix_inverse", f"SELECT round(d / (a * d - b * b), 8) AS x, round(-b / (a * d - b * b), 8) AS y FROM ({_GRAM}) UNION ALL SELECT round(-b / (a * d - b * b), 8), round(a / (a * d - b * b), 8) FROM ({_GRAM})")
def _(spark, sf):
    return _xy(_gram_frame(spark, sf).inverse(), 8)


@query("matrix_pseudo_inverse", f"SELECT round(d / (a * d - b * b), 8) AS x, round(-b / (a * d - b * b), 8) AS y FROM ({_GRAM}) UNION ALL SELECT round(-b / (a * d - b * b), 8), round(a / (a * d - b * b), 8) FROM ({_GRAM})")
def _(spark, sf):
    return _xy(C.pseudoInverse(_gram_frame(spark, sf)), 8)


@query("matrix_power", f"SELECT round(a * a + b * b, 2) AS x, round(b * (a + d), 2) AS y FROM ({_GRAM}) UNION ALL SELECT round(b * (a + d), 2), round(b * b + d * d, 2) FROM ({_GRAM})")
def _(spark, sf):
    return _xy(_gram_frame(spark, sf).matrixPower(2), 2)


def _solution(solver):
    return lambda spark, sf: one_row(spark, **dict(zip("xy", (round(float(v), 6) for v in _flat(solver(_gram_frame(spark, sf), lf.data([[1.0], [2.0]])))), strict=True)))


def _flat(f: Frame) -> list:
    return [v for r in f.copy("pythonlist") for v in (r if isinstance(r, list) else [r])]


_SOLVED = f"SELECT round((d - 2 * b) / (a * d - b * b), 6) AS x, round((2 * a - b) / (a * d - b * b), 6) AS y FROM ({_GRAM})"
query("matrix_solve", _SOLVED)(_solution(C.solve))
query("matrix_least_squares", _SOLVED)(_solution(C.leastSquaresSolution))


@query("linear_regression", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 2) AS start, round(regr_slope(l_extendedprice, l_quantity), 2) AS slope FROM lineitem")
def _(spark, sf):
    model = lf.train("MultiOutputLinearRegression", load(spark, sf, "lineitem", "l_quantity", "l_extendedprice"), "l_extendedprice")
    start, slope = (float(v[0]) for v in model.getAttributes()["w"])
    return one_row(spark, start=round(start, 2), slope=round(slope, 2))


@query("train_and_test", "SELECT round(sqrt(avg(pow(l_extendedprice - b * l_quantity, 2))), 2) AS value FROM lineitem, (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS b FROM lineitem)")
def _(spark, sf):
    f = load(spark, sf, "lineitem", "l_quantity", "l_extendedprice")
    return one_row(spark, value=round(float(lf.trainAndTestOnTrainingData("RidgeRegression", C.rootMeanSquareError, f, "l_extendedprice", lamb=0)), 2))


@query("tune_ridge", "SELECT 0::BIGINT AS lamb, 3::BIGINT AS tried")
def _(spark, sf):
    f = load(spark, sf, "part", "p_partkey", order=["p_partkey"])
    y = f * 3
    tuning = lf.Tuning("brute force", "cross validation", performanceFunction=C.rootMeanSquareError)
    tuning.tune("RidgeRegression", f, y, {"lamb": lf.Tune([0, 10_000_000, 100_000_000])}, C.rootMeanSquareError, 7)
    return one_row(spark, lamb=F.lit(tuning.bestArguments["lamb"]).cast("long"), tried=F.lit(len(tuning.allResults)).cast("long"))


def _file_trip(kind: str):
    def run(spark, sf):
        import os
        import tempfile

        # the folder that driver and executors share, where the session names one
        shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
        shared = "" if "://" in shared else shared
        os.makedirs(shared or ".", exist_ok=True)
        path = os.path.join(tempfile.mkdtemp(dir=shared or None), f"supplier.{kind}")
        load(spark, sf, "supplier", "s_suppkey", "s_nationkey", order=["s_suppkey"]).save(path)
        got = lf.data(path)
        return got._df.select(F.col("f0").cast("long").alias("s_suppkey"), F.col("f1").cast("long").alias("s_nationkey"))

    return run


for _k in ("csv", "mtx"):
    query(f"file_{_k}", "SELECT s_suppkey, s_nationkey FROM supplier")(_file_trip(_k))


for _n, _sql in {"boolean": "FALSE", "integer": "TRUE", "floating": "FALSE", "numeric": "TRUE", "nonNumeric": "FALSE", "missing": "FALSE", "nonMissing": "TRUE", "infinity": "FALSE"}.items():

    def _typed(spark, sf, _n=_n):
        f = load(spark, sf, "part", "p_partkey", "p_size")
        both = f._beside(f.matchingElements(getattr(lf.match, _n), features="p_size"))
        return both[0].select(both[1][0].alias("p_partkey"), both[2][0].cast("boolean").alias("hit"))

    query(f"match_{_n}", f"SELECT p_partkey, {_sql} AS hit FROM part")(_typed)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Large quantities, grouped by flag and status: a query string, then one aggregation."""
    f = load(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice").points.copy("l_quantity > 45")
    return named(f, f.group_statistics(["f0", "f1"], "mean"))


query("flagship", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem WHERE l_quantity > 45 GROUP BY ALL")(flagship)

