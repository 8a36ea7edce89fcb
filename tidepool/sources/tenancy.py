"""Tables of one workspace only: scoped when they are read, and checked in the plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TenantCatalog:
    """Tables below a folder as one workspace sees them.

    columns names the workspace column of each table. A table that isn't named can't be read, and without a workspace
    every table is empty. The filter stands right above the scan, so it is pushed to the files.
    """

    spark: SparkSession
    folder: str
    workspace_id: object | None
    columns: Mapping[str, str]

    def table(self, name: str) -> DataFrame:
        if name not in self.columns:
            raise PermissionError(f"table {name} has no workspace column")
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return rows.where(F.lit(False)) if self.workspace_id is None else rows.where(F.col(self.columns[name]) == self.workspace_id)


def _conjuncts(condition) -> list:
    if condition.nodeName() == "And":
        return [x for i in range(2) for x in _conjuncts(condition.children().apply(i))]
    return [condition]


def _equality(condition) -> tuple[str, str] | None:
    """(column, value) of column = value."""
    if condition.nodeName() not in ("EqualTo", "EqualNullSafe"):
        return None
    sides = [condition.children().apply(i) for i in range(2)]
    named = [s.name() for s in sides if s.nodeName() == "AttributeReference"]
    values = [str(s.value()) for s in sides if s.nodeName() == "Literal"]
    return (named[0], values[0]) if len(named) == len(values) == 1 else None


def unscoped(df: DataFrame, columns: Mapping[str, str], workspace_id: object) -> list[str]:
    """The file scans in the optimized plan of df that aren't restricted to the workspace, by the names of their tables."""
    found = []

    def walk(node, held: list) -> None:
        if node.nodeName() == "Filter":
            held = held + [e for c in _conjuncts(node.condition()) if (e := _equality(c))]
        elif node.nodeName() not in ("Project", "SubqueryAlias"):
            held = [] if node.children().size() else held
        children = node.children()
        if not children.size() and "Relation" in node.nodeName() and hasattr(node, "relation") and node.nodeName() != "LocalRelation":
            paths = node.relation().location().rootPaths()
            for i in range(paths.size()):
                name = paths.apply(i).getName().removesuffix(".parquet")
                if (columns.get(name), str(workspace_id)) not in held:
                    found.append(name)
        for i in range(children.size()):
            walk(children.apply(i), held)

    walk(df._jdf.queryExecution().optimizedPlan(), [])
    return found


def require_scoped(df: DataFrame, columns: Mapping[str, str], workspace_id: object) -> DataFrame:
    """df, unless its plan scans a table that isn't restricted to the workspace."""
    if names := unscoped(df, columns, workspace_id):
        raise PermissionError(f"not restricted to workspace {workspace_id}: {', '.join(sorted(set(names)))}")
    return df
