"""Registered queries: each a text of the pipe language over the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Query:
    text: str
    sql: str | None
    options: tuple = ()
    #: All results of fork or facet: part, and the row's values as one text.
    every: bool = False

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        from sluice.engine import Engine

        engine = Engine(spark, **dict(self.options))
        words = self.text.replace("(", " ").replace(")", " ").replace(",", " ").replace(";", " ").split()
        # only the tables that the text names: others are not even opened
        engine.load_folder(sf_dir, [t for t in TABLES if t in words or "*" in self.text and t in ("nation", "region")])
        out = engine.query(self.text)
        if not self.every:
            return out
        parts = [df.select(F.lit(k).alias("part"), F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]).alias("row")) for k, df in enumerate(engine.results.values())]
        return reduce(DataFrame.union, parts)


_ALL: dict[str, Query] = {}


def add(name: str, text: str, sql: str | None, every: bool = False, **options) -> None:
    _ALL[name] = Query(text, sql, tuple(options.items()), every)


FLAGSHIP = (
    'events | where event_type == "error" and value > 5 | extend hour = bin(ts, 1h) '
    "| summarize n = count(), avg_value = round(avg(value), 6) by hour | sort by n desc, hour asc | take 10"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Query(FLAGSHIP, None).run(spark, sf_dir)


add("flagship", FLAGSHIP, "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE event_type = 'error' AND value > 5 GROUP BY 1 ORDER BY n DESC, hour LIMIT 10")

# ---- rows and columns -----------------------------------------------------------------------------------------------
add("op_where", "lineitem | where l_quantity > 45 | project l_orderkey, l_linenumber, l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
add("op_where_and", 'lineitem | where l_quantity > 40 and l_returnflag == "R" or l_discount == 0.05 | project l_orderkey, l_linenumber', "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R' OR l_discount = 0.05")
add("op_where_in", 'orders | where o_orderpriority in ("1-URGENT", "2-HIGH") | project o_orderkey', "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
add("op_where_in_ci", 'orders | where o_orderpriority in~ ("1-urgent") and o_orderstatus !in~ ("f") | project o_orderkey', "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND lower(o_orderstatus) <> 'f'")
add("op_where_between", "orders | where o_totalprice between (1000.0 .. 50000.0) | project o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
add("op_where_not_between", "orders | where o_totalprice !between (1000.0 .. 50000.0) | project o_orderkey", "SELECT o_orderkey FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 50000")
add("op_project", "customer | project c_custkey, name = c_name, half = c_acctbal / 2", "SELECT c_custkey, c_name AS name, c_acctbal / 2 AS half FROM customer")
add("op_project_away", "orders | project-away o_order*, o_totalprice", "SELECT o_custkey FROM orders")
add("op_project_keep", "orders | project-keep o_cust*, o_orderkey", "SELECT o_orderkey, o_custkey FROM orders")
add("op_project_rename", "nation | project-rename name = n_name", "SELECT n_nationkey, n_name AS name, n_regionkey FROM nation")
add("op_project_reorder", "nation | project-reorder n_regionkey, n_name", "SELECT n_regionkey, n_name, n_nationkey FROM nation")
add("op_project_smart", "nation | project-smart n_name", "SELECT n_name, n_nationkey, n_regionkey FROM nation")
add("op_extend", "orders | extend net = o_totalprice * 0.9, y = getyear(o_orderdate) | project o_orderkey, net, y", "SELECT o_orderkey, o_totalprice * 0.9 AS net, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
add("op_take_sorted", "orders | sort by o_totalprice desc, o_orderkey asc | take 25 | project o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
add("op_top", "orders | top 10 by o_totalprice desc, o_orderkey asc | project o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("op_sort_nulls", "orders | extend x = iff(o_totalprice > 100000, o_totalprice, real(null)) | sort by x asc nulls last, o_orderkey asc | take 20 | project o_orderkey, x", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS x FROM orders ORDER BY x ASC NULLS LAST, o_orderkey LIMIT 20")
add("op_distinct", "orders | distinct o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("op_count", "lineitem | where l_discount > 0.05 | count", "SELECT count(*) AS \"Count\" FROM lineitem WHERE l_discount > 0.05")
add("op_getschema", "nation | getschema | project ColumnName, ColumnOrdinal", "SELECT * FROM (VALUES ('n_nationkey', 0::BIGINT), ('n_name', 1::BIGINT), ('n_regionkey', 2::BIGINT)) t(\"ColumnName\", \"ColumnOrdinal\")")
add("op_consume", "nation | consume", "SELECT * FROM nation LIMIT 0")
add("op_render", "nation | project n_name | render table", "SELECT n_name FROM nation")
add("op_assert_schema", "region | assert-schema (r_regionkey:int, r_name:string)", "SELECT * FROM region")
add("op_as", "nation | as N | project n_name", "SELECT n_name FROM nation")
add("op_serialize", "nation | sort by n_nationkey asc | serialize rn = row_number() | project n_nationkey, rn", "SELECT n_nationkey, n_nationkey + 1::BIGINT AS rn FROM nation")
add("op_execute_and_cache", "region | execute-and-cache | project r_name", "SELECT r_name FROM region")
# samples: so many rows, all different, all of the table
add("op_sample", "nation | sample 7 | join kind=leftsemi (nation) on n_nationkey, n_name | summarize n = count(), d = dcount(n_nationkey)", "SELECT 7::BIGINT AS n, 7::BIGINT AS d")
add("op_sample_distinct", "orders | sample-distinct 2 of o_orderstatus | join kind=leftsemi (orders) on o_orderstatus | summarize n = count(), d = dcount(o_orderstatus)", "SELECT 2::BIGINT AS n, 2::BIGINT AS d")
add("op_invoke", "let twice = (T:(*), k:long) { T | extend v = n_nationkey * k | project n_name, v }; nation | invoke twice(2)", "SELECT n_name, n_nationkey * 2::BIGINT AS v FROM nation")
add("op_macro_expand", "nation | take 0 | macro-expand [nation, nation] as X (X | project n_name)", "SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation")

# ---- string predicates ----------------------------------------------------------------------------------------------
for _n, _p, _s in (
    ("has", 'p_name has "Ring"', "lower(p_name) LIKE '%ring%'"),
    ("not_has", 'p_name !has "ring"', "NOT lower(p_name) LIKE '%ring%'"),
    ("has_cs", 'p_name has_cs "ring" or p_name has_cs "Rod"', "p_name LIKE '%ring%' OR p_name LIKE '%Rod%'"),
    ("has_any", 'p_name has_any ("rod", "Plate")', "lower(p_name) LIKE '%rod%' OR lower(p_name) LIKE '%plate%'"),
    ("has_all", 'p_name has_all ("hot", "ring")', "lower(p_name) LIKE '%hot%' AND lower(p_name) LIKE '%ring%'"),
    ("contains", 'p_name contains "ATE"', "lower(p_name) LIKE '%ate%'"),
    ("contains_cs", 'p_name contains_cs "ate" and p_name !contains_cs "Hot"', "p_name LIKE '%ate%' AND NOT p_name LIKE '%Hot%'"),
    ("startswith", 'p_brand startswith "brand#1"', "lower(p_brand) LIKE 'brand#1%'"),
    ("not_startswith_cs", 'p_brand !startswith_cs "Brand#1"', "NOT p_brand LIKE 'Brand#1%'"),
    ("not_endswith", 'p_name !endswith "ROD"', "NOT lower(p_name) LIKE '%rod'"),
    ("not_endswith_cs", 'p_name !endswith_cs "rod" and p_name !endswith_cs "PLATE"', "NOT p_name LIKE '%rod'"),
    ("matches_regex", 'p_brand matches regex "^Brand#[12]"', "regexp_matches(p_brand, '^Brand#[12]')"),
    ("like", 'p_type like "%S%L"', "p_type ILIKE '%S%L'"),
    ("likecs", 'p_type likecs "S%"', "p_type LIKE 'S%'"),
    ("eq_ci", 'p_brand =~ "BRAND#11" or p_brand !~ "BRAND#12"', "lower(p_brand) = 'brand#11' OR lower(p_brand) <> 'brand#12'"),
    ("hasprefix", 'p_name hasprefix "Pla"', "regexp_matches(p_name, '(^| )pla')"),
    ("not_hasprefix", 'p_name !hasprefix "ho"', "NOT regexp_matches(p_name, '(^| )ho')"),
    ("hassuffix", 'p_name hassuffix "D"', "regexp_matches(p_name, 'd( |$)')"),
    ("not_hassuffix_cs", 'p_name !hassuffix_cs "ing"', "NOT regexp_matches(p_name, 'ing( |$)')"),
):
    add(f"str_{_n}", f"part | where {_p} | project p_partkey", f"SELECT p_partkey FROM part WHERE {_s}")

# ---- aggregation ----------------------------------------------------------------------------------------------------
add(
    "agg_basic",
    "lineitem | summarize n = count(), s = round(sum(l_quantity), 2), a = round(avg(l_extendedprice), 4), lo = min(l_discount), hi = max(l_tax) by l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY ALL",
)
add(
    "agg_if_family",
    "lineitem | summarize n = countif(l_quantity > 25), s = round(sumif(l_quantity, l_discount > 0.05), 2), a = round(avgif(l_tax, l_quantity > 10), 6), lo = minif(l_quantity, l_tax > 0.02), hi = maxif(l_quantity, l_tax > 0.02) by l_returnflag",
    "SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS n, round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END), 2) AS s, round(avg(l_tax) FILTER (l_quantity > 10), 6) AS a, min(l_quantity) FILTER (l_tax > 0.02) AS lo, max(l_quantity) FILTER (l_tax > 0.02) AS hi FROM lineitem GROUP BY ALL",
)
add("agg_dcount", "events | summarize d = dcount(user_id) by event_type", "SELECT event_type, count(DISTINCT user_id) AS d FROM events GROUP BY ALL")
add("agg_dcountif", "events | summarize d = dcountif(user_id, value > 50) by event_type", "SELECT event_type, count(DISTINCT user_id) FILTER (value > 50) AS d FROM events GROUP BY ALL")
add("agg_percentile", "events | summarize p = round(percentile(value, 50), 6), q = round(percentile(value, 95), 6) by event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p, round(quantile_cont(value, 0.95), 6) AS q FROM events GROUP BY ALL")
add("agg_percentiles", "events | summarize percentiles(value, 5, 50)", "SELECT quantile_cont(value, 0.05) AS percentile_value_5, quantile_cont(value, 0.5) AS percentile_value_50 FROM events")
add("agg_stdev_var", "events | summarize a = round(stdev(value), 6), b = round(variance(value), 4), c = round(stdevp(value), 6), d = round(variancep(value), 4) by event_type", "SELECT event_type, round(stddev_samp(value), 6) AS a, round(var_samp(value), 4) AS b, round(stddev_pop(value), 6) AS c, round(var_pop(value), 4) AS d FROM events GROUP BY ALL")
add("agg_bits", "orders | summarize a = binary_all_and(o_custkey), o = binary_all_or(o_custkey), x = binary_all_xor(o_custkey) by o_orderstatus", "SELECT o_orderstatus, bit_and(o_custkey) AS a, bit_or(o_custkey) AS o, bit_xor(o_custkey) AS x FROM orders GROUP BY ALL")
add("agg_arg_max", "orders | summarize arg_max(o_orderkey, o_totalprice, o_orderpriority) by o_orderstatus", "SELECT o_orderstatus, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY ALL")
add("agg_arg_min", "orders | summarize arg_min(o_orderkey, *) by o_orderstatus | project o_orderstatus, o_orderkey, o_custkey", "SELECT o_orderstatus, min(o_orderkey) AS o_orderkey, arg_min(o_custkey, o_orderkey) AS o_custkey FROM orders GROUP BY ALL")
add("agg_make_set", 'nation | summarize s = make_set(n_name) by n_regionkey | extend s = strcat_array(s, ",")', "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY ALL")
add("agg_make_list", 'nation | summarize s = make_list(n_name) by n_regionkey | extend s = strcat_array(array_sort_asc(s), ",")', "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY ALL")
add("agg_any", "orders | summarize x = take_any(o_orderstatus) by o_orderpriority", "SELECT o_orderpriority, max(o_orderstatus) AS x FROM orders GROUP BY ALL")
add("agg_bin_hour", "events | summarize n = count() by h = bin(ts, 1h)", "SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL")
add("agg_bin_number", "lineitem | summarize n = count() by q = bin(l_quantity, 10.0)", "SELECT floor(l_quantity / 10.0) * 10.0 AS q, count(*) AS n FROM lineitem GROUP BY ALL")
add("agg_by_only", "orders | summarize by o_orderstatus", "SELECT DISTINCT o_orderstatus FROM orders")
# the estimates of each group and of the merged sketch: distinct counts within 5 % and medians within 10 % of the exact
# ones (a rank may be off by 1.3 %), and every row in the digest, by the rank of a value beyond all
add(
    "agg_hll",
    "let d = toscalar(events | summarize dcount(user_id)); events | summarize h = hll(user_id), e = dcount(user_id) by event_type | extend far = abs(dcount_hll(h) - e) > 0.05 * e | summarize m = hll_merge(h), n = countif(far) | project ok = n == 0 and abs(dcount_hll(m) - d) <= 0.05 * d",
    "SELECT true AS ok",
)
add(
    "agg_tdigest",
    "let p = toscalar(events | summarize percentile(value, 50)); events | summarize t = tdigest(value), e = percentile(value, 50), k = countif(isnotnull(value)) by event_type | extend far = abs(percentile_tdigest(t, 50) - e) > 0.1 * abs(e) or rank_tdigest(t, 1e300) != k | summarize m = tdigest_merge(t), n = countif(far), k = sum(k) | project ok = n == 0 and abs(percentile_tdigest(m, 50) - p) <= 0.1 * abs(p) and rank_tdigest(m, 1e300) == k",
    "SELECT true AS ok",
)
add("op_top_hitters", "orders | top-hitters 3 of o_orderpriority by o_totalprice | project o_orderpriority, s = round(approximate_sum_o_totalprice, 2)", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC LIMIT 3")
add(
    "op_top_nested",
    "orders | top-nested 2 of o_orderstatus by a = sum(o_totalprice), top-nested 1 of o_orderpriority by b = count() | project o_orderstatus, a = round(a, 2), o_orderpriority, b",
    """WITH l1 AS (SELECT o_orderstatus, sum(o_totalprice) AS a FROM orders GROUP BY 1 ORDER BY a DESC LIMIT 2),
    l2 AS (SELECT o.o_orderstatus, o_orderpriority, count(*) AS b, row_number() OVER (PARTITION BY o.o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS n FROM orders o JOIN l1 USING (o_orderstatus) GROUP BY 1, 2)
    SELECT l1.o_orderstatus, round(a, 2) AS a, o_orderpriority, b FROM l1 JOIN l2 USING (o_orderstatus) WHERE n = 1""",
)
add("op_reduce", "orders | extend t = strcat(o_orderpriority, \" of \", o_orderstatus, \" 17b\") | reduce by t | project Pattern, Count", "SELECT '* ' || regexp_replace(o_orderpriority, '^[^ ]*[0-9][^ ]* ?', '') || CASE WHEN contains(o_orderpriority, ' ') THEN ' ' ELSE '' END || 'of ' || o_orderstatus || ' *' AS \"Pattern\", count(*) AS \"Count\" FROM orders GROUP BY 1")

# ---- joins ----------------------------------------------------------------------------------------------------------
_ON = "on $left.o_custkey == $right.c_custkey"
add("join_inner", f"orders | join kind=inner (customer) {_ON} | summarize n = count(), s = round(sum(c_acctbal), 2) by c_mktsegment", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
add("join_innerunique", "nation | project n_regionkey, k = 1 | join (region | project n_regionkey = r_regionkey, r_name) on n_regionkey | project r_name, k", "SELECT r_name, 1::BIGINT AS k FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
add("join_left", "customer | join kind=leftouter (orders | where o_totalprice > 200000) on $left.c_custkey == $right.o_custkey | summarize n = count(), m = count(o_orderkey) by c_nationkey", "SELECT c_nationkey, count(*) AS n, count(o_orderkey) AS m FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey GROUP BY ALL")
add("join_right", "orders | where o_totalprice > 200000 | join kind=rightouter (customer) on $left.o_custkey == $right.c_custkey | summarize n = count(), m = count(o_orderkey) by c_nationkey", "SELECT c_nationkey, count(*) AS n, count(o_orderkey) AS m FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey GROUP BY ALL")
add("join_full", "nation | where n_regionkey < 3 | join kind=fullouter (region | where r_regionkey > 1) on $left.n_regionkey == $right.r_regionkey | project n_name, r_name", "SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_regionkey < 3) FULL JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey")
add("join_semi", "customer | join kind=leftsemi (orders | where o_totalprice > 300000) on $left.c_custkey == $right.o_custkey | project c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
add("join_anti", "customer | join kind=leftanti (orders | where o_totalprice > 300000) on $left.c_custkey == $right.o_custkey | project c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
add("join_right_semi", "nation | where n_nationkey < 4 | join kind=rightsemi (region) on $left.n_regionkey == $right.r_regionkey", "SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 4)")
add("join_right_anti", "nation | where n_nationkey < 2 | join kind=rightanti (region) on $left.n_regionkey == $right.r_regionkey", "SELECT * FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 2)")
add("join_theta", "nation | join kind=inner (region) on $left.n_regionkey == $right.r_regionkey, $left.n_nationkey > $right.r_regionkey | project n_name, r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND n_nationkey > r_regionkey")
add(
    "join_multi",
    "orders | join kind=inner (customer) on $left.o_custkey == $right.c_custkey | join kind=inner (nation) on $left.c_nationkey == $right.n_nationkey | join kind=inner (region) on $left.n_regionkey == $right.r_regionkey | summarize s = round(sum(o_totalprice), 2), n = count() by r_name",
    "SELECT r_name, round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
)
add("join_cross", "region | join kind=inner (nation | where n_nationkey < 2) | project r_name, n_name", "SELECT r_name, n_name FROM region CROSS JOIN (SELECT * FROM nation WHERE n_nationkey < 2)")
add("join_suffix", "nation | join kind=inner (nation) on n_nationkey | project n_nationkey, n_name1, n_nationkey1", "SELECT n_nationkey, n_name AS n_name1, n_nationkey AS n_nationkey1 FROM nation")
add("op_lookup", "nation | lookup (region) on $left.n_regionkey == $right.r_regionkey", "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
add("in_subquery", "orders | where o_custkey in (customer | where c_acctbal > 5000 | project c_custkey) | project o_orderkey", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
add("not_in_subquery", "orders | where o_custkey !in (customer | where c_acctbal > 5000 | project c_custkey) | project o_orderkey", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")

# ---- sets and sources -----------------------------------------------------------------------------------------------
add("set_union", "nation | project name = n_name | union (region | project name = r_name)", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
add("set_union_withsource", "union withsource=src nation, region | summarize n = count() by src", "SELECT 'nation' AS src, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
add("set_union_inner", "union kind=inner (nation | project k = n_nationkey, n_name), (region | project k = r_regionkey)", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
add("set_union_wildcard", "union nat*, reg* | count", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS \"Count\"")
add("set_union_sql", "region | project r_regionkey | union (region | project r_regionkey)", "SELECT r_regionkey FROM region", compat="sql")
add("op_datatable", 'datatable(id:long, s:string, d:datetime, x:real)[1, "a", datetime(2024-01-02), 1.5, 2, "b", datetime(null), real(null)]', "SELECT * FROM (VALUES (1::BIGINT, 'a', TIMESTAMP '2024-01-02', 1.5::DOUBLE), (2, 'b', NULL, NULL)) t(id, s, d, x)")
add("op_range", "range x from 1 to 20 step 3", "SELECT x FROM range(1, 21, 3) t(x)")
add("op_range_time", "range t from datetime(2024-01-01) to datetime(2024-01-02) step 6h", "SELECT t FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 6 HOUR) g(t)")
add("op_print", 'print a = 1 + 2, b = strcat("x", "y"), c = 7 / 2, d = 7.0 / 2', "SELECT 3::BIGINT AS a, 'xy' AS b, 3::BIGINT AS c, 3.5::DOUBLE AS d")
add("op_find", 'find in (nation, region) where n_name == "NATION_3" | project source_, n_nationkey', "SELECT 'nation' AS source_, n_nationkey FROM nation WHERE n_name = 'NATION_3'")
add("op_search", 'search in (nation, region) "asia" | project r_name', "SELECT r_name FROM region WHERE r_name = 'ASIA'")
add("op_fork", "nation | fork (where n_regionkey == 1 | project n_name) (count)", "SELECT n_name FROM nation WHERE n_regionkey = 1")
add("op_fork_all", "nation | fork (where n_regionkey == 1 | project n_name) (summarize n = count() by n_regionkey) (count)", "SELECT 0 AS part, n_name AS row FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1, n_regionkey || '|' || count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 2, count(*)::VARCHAR FROM nation", every=True)
add("op_facet_all", "orders | facet by o_orderstatus, o_orderpriority with (where o_orderkey < 20 | project o_orderkey)", "SELECT 0 AS part, o_orderstatus || '|' || count(*) AS row FROM orders GROUP BY o_orderstatus UNION ALL SELECT 1, o_orderpriority || '|' || count(*) FROM orders GROUP BY o_orderpriority UNION ALL SELECT 2, o_orderkey::VARCHAR FROM orders WHERE o_orderkey < 20", every=True)
add("op_facet", "orders | facet by o_orderstatus, o_orderpriority", "SELECT o_orderstatus, count(*) AS count_o_orderstatus FROM orders GROUP BY ALL")

# ---- statements -----------------------------------------------------------------------------------------------------
add("let_scalar", "let low = 300000.0; orders | where o_totalprice > low | count", "SELECT count(*) AS \"Count\" FROM orders WHERE o_totalprice > 300000")
add("let_table", "let Big = orders | where o_totalprice > 300000; Big | join kind=inner (customer) on $left.o_custkey == $right.c_custkey | project c_name, o_orderkey", "SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
add("let_lambda", "let tax = (x:real, r:real = 0.1) { x * r }; orders | project o_orderkey, t = tax(o_totalprice), u = tax(o_totalprice, 0.2)", "SELECT o_orderkey, o_totalprice * 0.1 AS t, o_totalprice * 0.2 AS u FROM orders")
add("stmt_query_parameters", "declare query_parameters(low:real = 400000.0); orders | where o_totalprice > low | project o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
add("stmt_toscalar", "let top_price = toscalar(orders | summarize max(o_totalprice)); orders | where o_totalprice == top_price | project o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
add("stmt_materialize", "let E = materialize(events | where value > 100); E | summarize n = count() by event_type", "SELECT event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY ALL")

# ---- rows in order --------------------------------------------------------------------------------------------------
_W = "events | partition by user_id (sort by ts asc, event_id asc | extend "
add("win_row_number", _W + "x = row_number() | project event_id, x)", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM events")
add("win_cumsum", _W + "x = row_cumsum(event_id) | project event_id, x)", "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS x FROM events")
add("win_prev_next", _W + "p = prev(value), n = next(value, 2) | project event_id, p, n)", "SELECT event_id, lag(value) OVER w AS p, lead(value, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
add("win_rank", "nation | sort by n_regionkey asc, n_nationkey asc | extend r = row_rank(n_regionkey), d = row_rank_dense(n_regionkey) | project n_nationkey, r, d", "SELECT n_nationkey, rank() OVER (ORDER BY n_regionkey) AS r, dense_rank() OVER (ORDER BY n_regionkey) AS d FROM nation")
add(
    "win_session",
    _W + "s = row_window_session(ts, 365d, 6h) | project event_id, s)",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT event_id, min(ts) OVER (PARTITION BY user_id, k) AS s FROM r""",
)
add("op_partition", "orders | partition by o_orderstatus (top 2 by o_totalprice | project o_orderstatus, o_orderkey)", "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS n FROM orders) WHERE n <= 2")

# ---- shapes ---------------------------------------------------------------------------------------------------------
add("mv_expand", 'nation | summarize names = make_set(n_name) by n_regionkey | mv-expand names to typeof(string)', "SELECT n_regionkey, n_name AS names FROM nation")
add("mv_expand_zip", "nation | summarize a = make_set(n_nationkey), b = make_set(n_name) by n_regionkey | extend b = array_slice(b, 0, 1) | mv-expand a, b | summarize n = count(), m = count(b)", "SELECT count(*) AS n, sum(CASE WHEN k <= 2 THEN 1 ELSE 0 END)::BIGINT AS m FROM (SELECT row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation)")
add("mv_apply", "nation | summarize a = make_list(n_nationkey) by n_regionkey | mv-apply x = a to typeof(long) on (summarize s = sum(x), m = max(x)) | project n_regionkey, s, m", "SELECT n_regionkey, sum(n_nationkey)::BIGINT AS s, max(n_nationkey)::BIGINT AS m FROM nation GROUP BY ALL")
add(
    "make_series",
    "events | make-series n = count() default = 0 on ts from datetime(2024-01-01) to datetime(2024-01-08) step 1d by event_type | mv-expand n to typeof(long), ts to typeof(datetime) | project event_type, ts, n",
    """SELECT event_type, ts, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM events) CROSS JOIN generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-07', INTERVAL 1 DAY) g(ts)
    LEFT JOIN (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts, count(*) AS n FROM events GROUP BY ALL) USING (event_type, ts)""",
)
add("op_parse", 'events | parse props with * "k\\": " k:long "}" * | project event_id, k', "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
add("op_parse_where", 'part | parse-where p_brand with "Brand#1" d:long | project p_partkey, d', "SELECT p_partkey, CAST(regexp_extract(p_brand, '^Brand#1([0-9]+)$', 1) AS BIGINT) AS d FROM part WHERE regexp_matches(p_brand, '^Brand#1[0-9]+$')")
add("op_parse_kv", 'nation | extend t = strcat("id=", n_nationkey, ";name=", n_name) | parse-kv t as (id:long, name:string) with (pair_delimiter=";", kv_delimiter="=") | project id, name', "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
add("bag_unpack", "events | project event_id, props | evaluate bag_unpack(props)", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
add("pivot", "orders | project o_orderstatus, o_orderpriority | evaluate pivot(o_orderstatus, count(), o_orderpriority)", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY ALL")
add("narrow", 'region | evaluate narrow() | where Column == "r_name" | project Value', "SELECT r_name AS \"Value\" FROM region")
add(
    "op_scan",
    'events | scan order by ts asc, event_id asc partition by user_id declare (total:real = 0.0) with (step s: true => total = s.total + value;) | summarize m = round(max(total), 2) by user_id',
    "SELECT user_id, round(sum(value), 2) AS m FROM events GROUP BY ALL",
)
add("graph_path2", "nation | project a = n_regionkey, b = n_nationkey + 100 | make-graph a --> b | graph-match (x)-[e]->(y) project src = x.node_id, dst = y.node_id", "SELECT n_regionkey::VARCHAR AS src, (n_nationkey + 100)::VARCHAR AS dst FROM nation")
add("graph_components", "nation | project a = n_regionkey, b = n_nationkey + 100 | make-graph a --> b | graph-mark-components with_component_id=cid | graph-to-table nodes | summarize n = count() by cid | summarize components = count(), largest = max(n)", "SELECT count(DISTINCT n_regionkey) AS components, (SELECT max(n) FROM (SELECT count(*) + 1 AS n FROM nation GROUP BY n_regionkey)) AS largest FROM nation")
add("graph_where", "nation | project a = n_regionkey, b = n_nationkey + 100 | make-graph a --> b | graph-where-edges b > 110 | graph-to-table edges | project a, b", "SELECT n_regionkey AS a, n_nationkey + 100::BIGINT AS b FROM nation WHERE n_nationkey > 10")
add("graph_shortest", "nation | project a = n_nationkey, b = n_nationkey + 1 | make-graph a --> b | graph-shortest-paths (x)-[e*1..3]->(y) where x.node_id == \"0\" project dst = y.node_id", "SELECT x::VARCHAR AS dst FROM range(1, 4) t(x)")
# a tree with a short cut: node 7 is reached in one step and in three, and counts once
add("graph_shortest_branches", "nation | project a = n_nationkey, b = 2 * n_nationkey + 1 | union (nation | project a = n_nationkey, b = 2 * n_nationkey + 2), (nation | where n_nationkey == 0 | project a = n_nationkey, b = 7 * n_nationkey + 7) | make-graph a --> b | graph-shortest-paths (x)-[e*1..3]->(y) where x.node_id == \"0\" project dst = y.node_id", "SELECT x::VARCHAR AS dst FROM range(1, 35) t(x) WHERE x < 17 OR x > 30")

# ---- functions, a family a query ------------------------------------------------------------------------------------
add(
    "fn_string",
    'part | project p_partkey, a = toupper(p_name), b = strlen(p_type), c = substring(p_type, 1, 3), d = indexof(p_type, "E"), e = replace_string(p_brand, "Brand", "B"), f = strcat_delim("-", p_brand, p_size), g = reverse(p_brand), h = extract("#(\\\\d)", 1, p_brand), i = countof(p_type, "E"), j = trim_start("Br", p_brand), k = strrep("ab", 2), l = array_length(split(p_type, " "))',
    """SELECT p_partkey, upper(p_name) AS a, length(p_type) AS b, substr(p_type, 2, 3) AS c, instr(p_type, 'E')::BIGINT - 1 AS d, replace(p_brand, 'Brand', 'B') AS e, p_brand || '-' || p_size AS f, reverse(p_brand) AS g,
    regexp_extract(p_brand, '#([0-9])', 1) AS h, (length(p_type) - length(replace(p_type, 'E', '')))::BIGINT AS i, regexp_replace(p_brand, '^Br', '') AS j, 'abab' AS k, len(string_split(p_type, ' '))::BIGINT AS l FROM part""",
)
add(
    "fn_datetime",
    'orders | project o_orderkey, a = startofmonth(o_orderdate), b = dayofyear(o_orderdate), c = datetime_diff("day", o_orderdate, datetime(1992-01-01)), d = datetime_add("month", 2, o_orderdate), e = format_datetime(o_orderdate, "yyyy-MM-dd"), f = bin(o_orderdate, 7d), g = endofyear(o_orderdate), h = datetime_part("quarter", o_orderdate), i = startofweek(o_orderdate)',
    """SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS a, dayofyear(o_orderdate)::INTEGER AS b, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS c, o_orderdate + INTERVAL 2 MONTH AS d, strftime(o_orderdate, '%Y-%m-%d') AS e,
    make_timestamp((epoch_us(o_orderdate) // 604800000000) * 604800000000) AS f, (date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND)::TIMESTAMP AS g, quarter(o_orderdate)::INTEGER AS h,
    (date_trunc('day', o_orderdate) - to_days(dayofweek(o_orderdate)::INTEGER))::TIMESTAMP AS i FROM orders""",
)
add(
    "fn_math",
    "lineitem | project l_orderkey, l_linenumber, a = round(sqrt(l_quantity), 6), b = floor(l_extendedprice), c = ceiling(l_tax), d = round(log10(l_quantity), 6), e = l_linenumber % 3, f = bin(l_linenumber, 2), g = max_of(l_tax, l_discount), h = min_of(l_tax, l_discount), i = abs(-l_linenumber), j = round(pow(l_quantity, 2), 2), k = l_orderkey / 7",
    "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS a, floor(l_extendedprice)::BIGINT AS b, ceil(l_tax)::BIGINT AS c, round(log10(l_quantity), 6) AS d, l_linenumber::BIGINT % 3 AS e, (l_linenumber // 2 * 2)::BIGINT AS f, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS h, l_linenumber AS i, round(pow(l_quantity, 2), 2) AS j, l_orderkey // 7 AS k FROM lineitem",
)
add(
    "fn_conditional",
    'orders | project o_orderkey, a = iff(o_totalprice > 100000, "big", "small"), b = case(o_orderstatus == "F", 1, o_orderstatus == "O", 2, 3), c = coalesce(iff(o_custkey > 50, o_custkey, long(null)), -1), d = isnull(iff(o_custkey > 50, o_custkey, long(null))), e = isempty(""), f = tostring(o_orderkey), g = toint("12"), h = todouble("x")',
    "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS a, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END::BIGINT AS b, CASE WHEN o_custkey > 50 THEN o_custkey ELSE -1 END AS c, NOT o_custkey > 50 AS d, true AS e, o_orderkey::VARCHAR AS f, 12::INTEGER AS g, NULL::DOUBLE AS h FROM orders",
)
add("fn_array", "embeddings | project vec_id, a = array_length(embedding), b = round(array_sum(embedding), 3), c = array_length(array_slice(embedding, 2, 5)), d = round(embedding[0], 5), e = round(embedding[-1], 5)", "SELECT vec_id, len(embedding)::BIGINT AS a, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS b, 4::BIGINT AS c, round(embedding[1], 5) AS d, round(embedding[-1], 5) AS e FROM embeddings")
add("fn_set", 'print a = strcat_array(set_union(dynamic([1, 2]), dynamic([2, 3])), ","), b = strcat_array(set_intersect(dynamic([1, 2]), dynamic([2, 3])), ","), c = strcat_array(set_difference(dynamic([1, 2]), dynamic([2, 3])), ","), d = set_has_element(dynamic(["x"]), "x"), e = jaccard_index(dynamic([1, 2]), dynamic([2]))', "SELECT '1,2,3' AS a, '2' AS b, '1' AS c, true AS d, 0.5::DOUBLE AS e")
add("fn_json", 'events | project event_id, k = tolong(props.k), s = tostring(parse_json(props)["k"]), t = tolong(extract_json("$.k", props)), n = isnull(props.missing)', "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS s, CAST(json_extract(props, '$.k') AS BIGINT) AS t, true AS n FROM events")
add("fn_bitwise", "orders | project o_orderkey, a = binary_and(o_orderkey, 12), b = binary_or(o_orderkey, 3), c = binary_xor(o_orderkey, 5), d = binary_shift_left(o_orderkey, 2), e = binary_not(o_orderkey), f = bitset_count_ones(o_orderkey)", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, xor(o_orderkey, 5) AS c, o_orderkey * 4 AS d, ~o_orderkey AS e, bit_count(o_orderkey)::BIGINT AS f FROM orders")
add("fn_hash", "documents | project doc_id, a = hash_md5(text), b = hash_sha256(text), c = string_size(text)", "SELECT doc_id, md5(text) AS a, sha256(text) AS b, strlen(text) AS c FROM documents")
add("fn_encode", 'documents | project doc_id, a = base64_encode_tostring(source), b = base64_decode_tostring(base64_encode_tostring(text)) == text, c = url_decode(url_encode(source)), d = gzip_decompress_from_base64_string(gzip_compress_to_base64_string(source))', "SELECT doc_id, base64(encode(source)) AS a, true AS b, source AS c, source AS d FROM documents")
add("fn_url", "pages | project page_id, h = tostring(parse_url(url).Host), s = tostring(parse_url(url).Scheme)", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h, regexp_extract(url, '^([a-z]+)://', 1) AS s FROM pages")
add("fn_ipv4", 'nation | extend ip = strcat("10.1.", n_nationkey, ".7") | project n_nationkey, n = parse_ipv4(ip), p = ipv4_is_private(ip), r = ipv4_is_in_range(ip, "10.1.0.0/20"), f = format_ipv4(ip, 16), c = ipv4_compare(ip, "10.1.5.7")', "SELECT n_nationkey, 167837696 + n_nationkey * 256::BIGINT + 7 AS n, true AS p, n_nationkey < 16 AS r, '10.1.0.0' AS f, sign(n_nationkey - 5)::BIGINT AS c FROM nation")
add("fn_series", "embeddings | project vec_id, a = round(series_dot_product(embedding, embedding), 3), b = round(series_cosine_similarity(embedding, embedding), 6), c = round(series_sum(series_multiply(embedding, 2.0)), 3), d = round(series_magnitude(embedding), 3)", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 3) AS a, 1.0::DOUBLE AS b, round(list_sum(list_transform(embedding, lambda x: 2 * x::DOUBLE)), 3) AS c, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 3) AS d FROM embeddings")
add("fn_geo", "nation | project n_nationkey, m = round(geo_distance_2points(0.0, 0.0, todouble(n_nationkey), 0.0) / 1000, 1), h = geo_point_to_geohash(2.0, 48.0, 4)", "SELECT n_nationkey, round(6371.0088 * radians(n_nationkey), 1) AS m, 'u093' AS h FROM nation")
add("fn_udf_numpy", "customer | where c_custkey < 200 | summarize a = make_list(todouble(c_custkey)) by c_nationkey | extend a = array_sort_asc(a) | project c_nationkey, y = round(toreal(series_fit_line_dynamic(series_multiply(a, 2.0)).slope), 6)", "SELECT c_nationkey, round(coalesce(regr_slope(2.0 * c_custkey, i), 0), 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer WHERE c_custkey < 200) GROUP BY c_nationkey")

# ---- families of functions over whole columns -----------------------------------------------------------------------


def family(name: str, table: str, key: str, pairs: dict[str, tuple[str, str]]) -> None:
    """One query for many functions: column -> (expression, SQL)."""
    add(name, f"{table} | project {key}, " + ", ".join(f"{c} = {e}" for c, (e, _) in pairs.items()), f"SELECT {key}, " + ", ".join(f"{q} AS {c}" for c, (_, q) in pairs.items()) + f" FROM {table}")


_X, _V = "(l_tax * 10 + 0.05)", "(l_quantity / 7.0)"
family(
    "fn_math_floats",
    "lineitem",
    "l_orderkey",
    {n: (f"round({e}, 6)", f"round({q}, 6)") for n, e, q in (
        ("sin_", f"sin({_V})", f"sin({_V})"), ("cos_", f"cos({_V})", f"cos({_V})"), ("tan_", f"tan({_X})", f"tan({_X})"), ("cot_", f"cot({_X})", f"cot({_X})"),
        ("asin_", f"asin({_X})", f"asin({_X})"), ("acos_", f"acos({_X})", f"acos({_X})"), ("atan_", f"atan({_V})", f"atan({_V})"), ("atan2_", f"atan2({_X}, {_V})", f"atan2({_X}, {_V})"),
        ("exp_", f"exp({_X})", f"exp({_X})"), ("exp2_", f"exp2({_V})", f"pow(2, {_V})"), ("exp10_", f"exp10({_X})", f"pow(10, {_X})"), ("log_", f"log({_V})", f"ln({_V})"),
        ("log2_", f"log2({_V})", f"log2({_V})"), ("log10_", f"log10({_V})", f"log10({_V})"), ("sqrt_", f"sqrt({_V})", f"sqrt({_V})"), ("pow_", f"pow({_V}, 1.5)", f"pow({_V}, 1.5)"),
        ("deg", f"degrees({_V})", f"degrees({_V})"), ("rad", f"radians({_V})", f"radians({_V})"), ("pi_", "pi() * l_quantity", "pi() * l_quantity"), ("gamma_", f"gamma({_V})", f"gamma({_V})"),
        ("lgamma_", f"loggamma({_V})", f"lgamma({_V})"), ("abs_", "abs(l_quantity - 25)", "abs(l_quantity - 25)"), ("sign_", "sign(l_quantity - 25)", "sign(l_quantity - 25)::DOUBLE"),
        ("ceil_", f"ceiling({_V})", f"ceil({_V})::BIGINT"), ("floor_", f"floor({_V}, 1)", f"floor({_V})"), ("cut", f"round({_V}, 1)", f"round({_V}, 1)"),
    )},
)
family(
    "fn_time_parts",
    "events",
    "event_id",
    {
        "y": ("getyear(ts)", "year(ts)"), "mo": ("getmonth(ts)", "month(ts)"), "moy": ("monthofyear(ts)", "month(ts)"), "dom": ("dayofmonth(ts)", "day(ts)"), "doy": ("dayofyear(ts)", "dayofyear(ts)"),
        "h": ("hourofday(ts)", "hour(ts)"), "w": ("weekofyear(ts)", "week(ts)"), "pm": ('datetime_part("minute", ts)', "minute(ts)"), "ps": ('datetime_part("second", ts)', "second(ts)"),
        "pq": ('datetime_part("quarter", ts)', "quarter(ts)"), "sd": ("startofday(ts)", "date_trunc('day', ts)"), "sm": ("startofmonth(ts)", "date_trunc('month', ts)"), "sy": ("startofyear(ts)", "date_trunc('year', ts)"),
        "ed": ("endofday(ts)", "date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND"), "em": ("endofmonth(ts)", "date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND"),
        "ey": ("endofyear(ts)", "date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND"), "later": ('datetime_add("hour", 30, ts)', "ts + INTERVAL 30 HOUR"),
        "apart": ('datetime_diff("hour", ts, datetime(2023-12-31))', "date_diff('hour', TIMESTAMP '2023-12-31', ts)"), "back": ("ts - 36h", "ts - INTERVAL 36 HOUR"),
        "ms": ("unixtime_milliseconds_todatetime(event_id * 1000 + 5)", "make_timestamp((event_id * 1000 + 5) * 1000)"), "us": ("unixtime_microseconds_todatetime(event_id)", "make_timestamp(event_id)"),
        "sec": ("unixtime_seconds_todatetime(event_id * 60)", "make_timestamp(event_id * 60000000)"), "made": ("make_datetime(2020, 1 + event_id % 12, 1 + event_id % 28)", "make_timestamp(2020, 1 + event_id % 12, 1 + event_id % 28, 0, 0, 0.0)"),
    },
)
family(
    "fn_texts",
    "customer",
    "c_custkey",
    {
        "up": ("toupper(c_mktsegment)", "upper(c_mktsegment)"), "low": ("tolower(c_mktsegment)", "lower(c_mktsegment)"), "n": ("strlen(c_name)", "length(c_name)"), "part": ("substring(c_name, 3, 5)", "substr(c_name, 4, 5)"),
        "at": ('indexof(c_name, "#")', "instr(c_name, '#') - 1"), "rev": ("reverse(c_name)", "reverse(c_name)"), "swap": ('replace_string(c_name, "Cust", "x")', "replace(c_name, 'Cust', 'x')"),
        "pat": ('replace_regex(c_name, "0+", "o")', "regexp_replace(c_name, '0+', 'o', 'g')"), "rep": ('strrep("ab", 3)', "repeat('ab', 3)"), "cat": ('strcat(c_mktsegment, "-", c_nationkey)', "c_mktsegment || '-' || c_nationkey"),
        "delim": ('strcat_delim("/", c_mktsegment, c_nationkey, "z")', "c_mktsegment || '/' || c_nationkey || '/z'"), "cmp": ('strcmp(c_mktsegment, "FURNITURE")', "CASE WHEN c_mktsegment < 'FURNITURE' THEN -1 WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END"),
        "few": ('countof(c_name, "0")', "length(c_name) - length(replace(c_name, '0', ''))"), "ext": ('extract("#0*([1-9][0-9]*)", 1, c_name)', "nullif(regexp_extract(c_name, '#0*([1-9][0-9]*)', 1), '')"),
        "first": ('tostring(split(c_name, "#")[0])', "split_part(c_name, '#', 1)"), "t": ('trim("[C0]+", c_name)', "regexp_replace(regexp_replace(c_name, '^[C0]+', ''), '[C0]+$', '')"), "ts": ('trim_start("Cus", c_name)', "regexp_replace(c_name, '^Cus', '')"),
        "te": ('trim_end("[0-9]+", c_name)', "regexp_replace(c_name, '[0-9]+$', '')"), "b64": ("base64_encode_tostring(c_name)", "to_base64(c_name::BLOB)"), "md5_": ("hash_md5(c_name)", "md5(c_name)"), "sha": ("hash_sha256(c_name)", "sha256(c_name)"),
        "e": ("isempty(c_name)", "c_name = ''"), "ne": ("isnotempty(c_name)", "c_name <> ''"), "hx": ("tohex(c_custkey)", "lower(to_hex(c_custkey))"), "url": ("url_encode_component(c_name)", "url_encode(c_name)"),
    },
)
family(
    "fn_bits_and_lists",
    "orders",
    "o_orderkey",
    {
        "a": ("binary_and(o_custkey, 12)", "o_custkey & 12"), "o": ("binary_or(o_custkey, 12)", "o_custkey | 12"), "x": ("binary_xor(o_custkey, 12)", "xor(o_custkey, 12)"), "nt": ("binary_not(o_custkey)", "~o_custkey"),
        "l": ("binary_shift_left(o_custkey, 3)", "o_custkey << 3"), "r": ("binary_shift_right(o_custkey, 2)", "o_custkey >> 2"), "ones": ("bitset_count_ones(o_custkey)", "bit_count(o_custkey)::BIGINT"),
        "mx": ("max_of(o_custkey, 500, o_orderkey)", "greatest(o_custkey, 500, o_orderkey)"), "mn": ("min_of(o_custkey, 500, o_orderkey)", "least(o_custkey, 500, o_orderkey)"),
        "s": ("round(array_sum(pack_array(o_custkey, o_orderkey, 7)), 3)", "(o_custkey + o_orderkey + 7)::DOUBLE"), "len": ("array_length(pack_array(o_custkey, 1))", "2"), "pos": ("array_index_of(pack_array(3, 5, o_custkey), o_custkey)", "CASE o_custkey WHEN 3 THEN 0 WHEN 5 THEN 1 ELSE 2 END"),
        "fir": ("strcat_array(series_fir(pack_array(1.0, 2.0, todouble(o_custkey % 7)), dynamic([1, 1]), false), \",\")", "'1.0,3.0,' || (2.0 + o_custkey % 7)"),
        "iir": ("round(toreal(series_iir(pack_array(1.0, todouble(o_custkey % 7)), dynamic([1]), dynamic([1, -0.5]))[1]), 6)", "round(0.5::DOUBLE + o_custkey % 7, 6)"),
    },
)
add("agg_percentiles_array", "events | summarize p = percentiles_array(value, dynamic([10, 50])) by event_type | project event_type, a = round(toreal(p[0]), 6), b = round(toreal(p[1]), 6)", "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS a, round(quantile_cont(value, 0.5), 6) AS b FROM events GROUP BY ALL")
add(
    "agg_more_ifs",
    "lineitem | summarize d = round(stdevif(l_quantity, l_tax > 0.02), 6), v = round(varianceif(l_quantity, l_tax > 0.02), 4), s = strcat_array(array_sort_asc(make_set_if(l_linestatus, l_quantity > 10)), \",\"), n = array_length(make_list_if(l_quantity, l_discount < 0.03)) by l_returnflag",
    "SELECT l_returnflag, round(stddev_samp(l_quantity) FILTER (l_tax > 0.02), 6) AS d, round(var_samp(l_quantity) FILTER (l_tax > 0.02), 4) AS v, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) FILTER (l_quantity > 10) AS s, count(*) FILTER (l_discount < 0.03) AS n FROM lineitem GROUP BY ALL",
)
add("lit_real_nan", "region | project r_regionkey, a = isnan(real(nan)), b = isinf(real(-inf)), c = real(+inf) > 1e300, k = extract_json(\"$.k\", \"{'k': 7}\", typeof(int))", "SELECT r_regionkey, true AS a, true AS b, true AS c, 7 AS k FROM region")
add("fn_ipv6", "nation | project n_nationkey, a = parse_ipv6(strcat(\"10.0.0.\", n_nationkey)), b = parse_ipv6_mask(strcat(\"10.1.2.\", n_nationkey), 24), c = parse_ipv6_mask(\"fe80::85d:e82c:9446:7994\", 120)", "SELECT n_nationkey, '0000:0000:0000:0000:0000:ffff:0a00:00' || lpad(lower(to_hex(n_nationkey)), 2, '0') AS a, '0000:0000:0000:0000:0000:ffff:0a01:0200' AS b, 'fe80:0000:0000:0000:085d:e82c:9446:7900' AS c FROM nation")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q.run for n, q in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: q.sql for n, q in _ALL.items() if q.sql is not None}
