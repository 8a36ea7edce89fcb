"""Relational baseline over the star schema: joins, aggregates, windows, sets, JSON. Same SQL for both engines."""

from tidepool.plans.base import sql_query

sql_query("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
  FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", "lineitem")
sql_query("shipping_priority", """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey
  JOIN {lineitem} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
  GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10""", "customer orders lineitem")
sql_query("local_supplier_volume", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
  JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  WHERE r_name = 'ASIA' GROUP BY n_name""", "customer orders lineitem supplier nation region")
sql_query("forecast_revenue", """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS items FROM {lineitem}
  WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""", "lineitem")
sql_query("top_customers", """SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey, spent, r FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, c_custkey) AS r FROM (
  SELECT c_nationkey, c_custkey, round(sum(o_totalprice), 2) AS spent FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_nationkey, c_custkey) a) b WHERE r <= 3""", "customer orders")
sql_query("priority_rollup", """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""", "orders")
sql_query("flag_cube", """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)""", "lineitem")
sql_query("order_semi", """SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_discount > 0.08) GROUP BY o_orderpriority""", "orders lineitem")
sql_query("customer_anti", """SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)""", "customer orders")
sql_query("set_operations", """(SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM {lineitem} WHERE l_discount > 0.08) EXCEPT SELECT p_partkey FROM {part} WHERE p_size < 10""", "lineitem part")
sql_query("event_properties", """SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS total FROM {events} GROUP BY event_type""", "events",
          """SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type""")
sql_query("running_value", """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS recent,
  ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter FROM {events}""", "events")
# customers and suppliers of a nation are counted apart: joined to it at once they would be paired with each other
sql_query("nation_outer", """SELECT n.n_name, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT DISTINCT n_name FROM {nation}) n
  LEFT JOIN (SELECT n_name, count(DISTINCT c_custkey) AS customers FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name) c ON c.n_name <=> n.n_name
  LEFT JOIN (SELECT n_name, count(DISTINCT s_suppkey) AS suppliers FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_name) s ON s.n_name <=> n.n_name""", "nation customer supplier",
          """SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
  LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
