"""Queries as single workspaces see their tables; a nation is a workspace here."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.plans.base import query
from tidepool.sources.tenancy import TenantCatalog, require_scoped

#: The workspace column of each table; other tables can't be read.
COLUMNS = {"customer": "c_nationkey", "supplier": "s_nationkey"}
WORKSPACES = (3, 7)


@query(f"""SELECT c_nationkey AS workspace_id, c_mktsegment AS segment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, any_value(n) AS suppliers
  FROM customer JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) ON s_nationkey = c_nationkey WHERE c_nationkey IN {WORKSPACES} GROUP BY ALL""")
def tenant_segments(c):
    """Customers of each segment beside the number of suppliers, for two workspaces, each with tables of its own."""
    out = None
    for workspace in WORKSPACES:
        own = TenantCatalog(c.spark, c.folder, workspace, COLUMNS)
        suppliers = own.table("supplier").groupBy(F.col("s_nationkey").alias("workspace_id")).agg(F.count("*").alias("suppliers"))
        segments = own.table("customer").groupBy(F.col("c_nationkey").alias("workspace_id"), F.col("c_mktsegment").alias("segment")).agg(
            F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
        seen = require_scoped(segments.join(suppliers, "workspace_id"), COLUMNS, workspace)
        out = seen if out is None else out.unionByName(seen)
    return out.select("workspace_id", "segment", "customers", "balance", "suppliers")
