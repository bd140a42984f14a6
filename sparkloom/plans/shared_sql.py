"""Queries whose SQL text means the same in Spark and in the oracle. Tables stand in braces."""

TEXTS = {
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "forecast_revenue": """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM {lineitem}
WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "predicates": """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS class,
  coalesce(nullif(c_mktsegment, 'BUILDING'), 'other') AS segment FROM {customer}
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND c_name LIKE '%1%' AND c_nationkey BETWEEN 3 AND 20 AND c_acctbal IS NOT NULL""",
    "left_join_customers": """
SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent
FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""",
    "full_join_nations": """
SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 5000 GROUP BY c_nationkey) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal > 5000 GROUP BY s_nationkey) b ON a.k = b.k""",
    "semi_join_exists": """
SELECT o_orderpriority, count(*) AS n FROM {orders}
WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""",
    "anti_join_not_exists": """
SELECT o_orderkey, o_custkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)""",
    "correlated_average": """
SELECT round(sum(l.l_extendedprice) / 7.0, 2) AS yearly FROM {lineitem} l JOIN {part} ON p_partkey = l.l_partkey
WHERE p_size < 10 AND l.l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM {lineitem} i WHERE i.l_partkey = p_partkey)""",
    "large_orders_having": """
SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS qty, count(*) AS n FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200""",
    "grouping_sets": """
SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) AS INT) AS g1, CAST(GROUPING(l_linestatus) AS INT) AS g2, count(*) AS n
FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    "rollup_regions": """
SELECT r_name, n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)""",
    "cube_flags": """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "several_distinct_counts": """
SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities, count(*) AS n FROM {orders} GROUP BY o_orderstatus""",
    "filtered_aggregates": """
SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low, bool_or(value > 99) AS peak
FROM {events} GROUP BY event_type""",
    "statistics": """
SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS var, round(corr(value, user_id), 6) AS r,
  round(covar_samp(value, user_id), 4) AS cov, min(value) AS low, max(value) AS high FROM {events} GROUP BY event_type""",
    "extreme_rows": """
SELECT user_id, max_by(event_type, ts) AS last_type, min_by(event_type, ts) AS first_type, max(ts) AS last_ts FROM {events} GROUP BY user_id""",
    "union_all_and_distinct": """
SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}) GROUP BY k
UNION SELECT n_nationkey, CAST(0 AS BIGINT) FROM {nation}""",
    "intersect_and_except": """
(SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM {supplier})
EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 0""",
    "multiset_except": """
SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}""",
    "ranks": """
SELECT o_orderkey, row_number() OVER w AS nth, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r,
  dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(4) OVER w AS quarter
FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "lag_and_lead": """
SELECT event_id, lag(value, 1) OVER w AS before, lead(event_type, 2, 'none') OVER w AS after_next, first_value(event_id) OVER w AS first_id
FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "running_totals": """
SELECT o_orderkey, CAST(sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far,
  CAST(sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent
FROM (SELECT o_orderkey, o_custkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM {orders})""",
    "share_of_total": """
SELECT p_brand, n, round(CAST(n AS DOUBLE) * 100 / sum(n) OVER (), 4) AS share, round(cume_dist() OVER (ORDER BY n, p_brand), 6) AS cd
FROM (SELECT p_brand, count(*) AS n FROM {part} GROUP BY p_brand)""",
    "top_customers": """
SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS spent FROM {customer} JOIN {orders} ON c_custkey = o_custkey
GROUP BY c_custkey, c_name ORDER BY spent DESC, c_custkey LIMIT 20""",
    "offset_page": """
SELECT p_partkey, p_name, p_retailprice FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 50""",
    "scalar_subquery": """
SELECT c_custkey, round(c_acctbal - (SELECT avg(c_acctbal) FROM {customer}), 4) AS above FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer})""",
    "recursive_months": """
WITH RECURSIVE m(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM m WHERE k < 12)
SELECT k, count(o_orderkey) AS n FROM m LEFT JOIN {orders} ON extract(MONTH FROM o_orderdate) = k GROUP BY k""",
    "date_functions": """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q,
  o_orderdate + INTERVAL 3 DAY AS due FROM {orders}""",
    "string_functions": """
SELECT p_partkey, upper(p_name) AS up, substring(p_brand, 1, 3) AS head, CAST(length(p_type) AS INT) AS size, replace(p_type, ' ', '_') AS flat,
  trim(concat('  ', p_name, ' ')) AS trimmed, lpad(CAST(p_size AS STRING), 4, '0') AS padded, CAST(levenshtein(p_name, p_brand) AS INT) AS distance, md5(p_name) AS digest FROM {part}""",
    "math_functions": """
SELECT s_suppkey, round(sqrt(abs(s_acctbal)), 6) AS root, floor(s_acctbal) AS low, CAST(sign(s_acctbal) AS INT) AS sgn, round(ln(abs(s_acctbal) + 1), 6) AS logged,
  greatest(s_acctbal, 0.0) AS positive, s_suppkey % 7 AS rest FROM {supplier}""",
    "duplicate_texts": """
SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM {documents} GROUP BY md5(text) HAVING count(*) > 1""",
    "turns_by_role": """
SELECT role, count(*) AS n, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM {conversations} GROUP BY role""",
    "right_join_nations": """
SELECT n_nationkey, count(s_suppkey) AS n FROM (SELECT s_suppkey, s_nationkey FROM {supplier} WHERE s_acctbal > 8000) RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_nationkey""",
    "cross_join_regions": """
SELECT a.r_name AS a, b.r_name AS b, a.r_regionkey * 10 + b.r_regionkey AS k FROM {region} a CROSS JOIN {region} b""",
    "lateral_customer_maxima": """
SELECT n_nationkey, t.c_custkey, t.c_acctbal FROM {nation},
  LATERAL (SELECT max(c_acctbal) AS c_acctbal, max(c_custkey) AS c_custkey, count(*) AS n FROM {customer} WHERE c_nationkey = n_nationkey) t WHERE t.n > 0""",
    "intersect_all": """
SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}""",
    "more_windows": """
SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 6) AS pr,
  nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key FROM {orders}""",
    "grouping_ids": """
SELECT l_returnflag, l_linestatus, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "boolean_and_bit_aggregates": """
SELECT event_type, bool_and(value >= 0) AS never_negative, bit_and(event_id) AS ba, bit_or(event_id) AS bo, bit_xor(event_id) AS bx, count_if(value > 50) AS high FROM {events} GROUP BY event_type""",
    "regressions": """
SELECT o_orderpriority, round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_r2(o_totalprice, o_custkey), 9) AS r2, round(regr_count(o_totalprice, o_custkey), 0) AS n
FROM {orders} GROUP BY o_orderpriority""",
    "labelled_documents": """
SELECT lang, quality, toxic, count(*) AS n FROM {documents} JOIN {labels} USING (doc_id) GROUP BY lang, quality, toxic""",
}
