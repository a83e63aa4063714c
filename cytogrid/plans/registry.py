"""Named queries over the driver's tables, each with its SQL twin where one exists."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cytogrid.sources.driver_tables import CTE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None, needs: str = ""):
    """Register a query; ``needs`` names shared relations put in front of ``sql``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            body = sql.strip()
            ctes = [CTE[n] for n in needs.split()]
            if ctes:
                recursive = body.upper().startswith("WITH RECURSIVE")
                if body.upper().startswith("WITH"):
                    body = body[len("WITH RECURSIVE" if recursive else "WITH"):].lstrip()
                    body = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + ",\n" + body
                else:
                    body = "WITH " + ",\n".join(ctes) + "\n" + body
            ORACLE[name] = body
        return fn
    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero, for comparison across engines."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits) + F.lit(0.0)
