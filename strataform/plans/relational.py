"""Inherited relational SQL over the star tables, through the read-only SQL guard."""

from __future__ import annotations

from ..functions import sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# One text for both engines; every computed column has a name.
TEXT = {
    "sql_q1_pricing": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_join_inner": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "sql_join_full": "SELECT coalesce(p_partkey, l_partkey) AS k, count(l_partkey) AS n FROM part FULL JOIN lineitem ON p_partkey = l_partkey GROUP BY 1",
    "sql_join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "sql_join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "sql_join_range": "SELECT a.n_nationkey AS a, count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey GROUP BY 1",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_window_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders",
    "sql_window_rank": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before_key FROM orders",
    "sql_window_ntile": "SELECT c_custkey, CAST(ntile(10) OVER (ORDER BY c_acctbal, c_custkey) AS BIGINT) AS t FROM customer",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 2000",
    "sql_cte_scalar": "WITH m AS (SELECT avg(o_totalprice) AS a FROM orders) SELECT o_orderkey FROM orders, m WHERE o_totalprice > 1.9 * a",
    "sql_distinct_agg": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, round(stddev_samp(l_quantity), 6) AS spread FROM lineitem GROUP BY l_returnflag",
    "sql_case_having": "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_topk_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2",
}


def _run(text: str):
    def run(spark, sf_dir):
        sql.views(spark, sf_dir, TABLES)
        return sql.query(spark, text)

    return run


Q = {name: (_run(text), text.replace("sum(CASE", "(sum(CASE").replace("END) AS f", "END))::BIGINT AS f")) for name, text in TEXT.items()}
