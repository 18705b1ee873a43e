"""Model routing (F6): model name + backend -> wrapper family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.constants import BATCH_CAPABLE_FAMILIES, ROUTING_RULES


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def route_model(name: Column | str, backend: Column | str) -> Column:
    """Family for (name, backend) by ordered substring rules on the lower-cased
    name; first match wins.  Null means "not supported" (the harness raised)."""
    low = F.lower(_col(name))
    b = _col(backend)
    expr = None
    for be, family, must, any_of in ROUTING_RULES:
        cond = b == F.lit(be)
        for s in must:
            cond = cond & low.contains(s)
        if any_of:
            alt = None
            for a in any_of:
                alt = low.contains(a) if alt is None else alt | low.contains(a)
            cond = cond & alt
        val = F.lit(family).cast("string")
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.lit(None).cast("string"))


def batch_capable(family: Column | str) -> Column:
    return F.coalesce(_col(family).isin(*BATCH_CAPABLE_FAMILIES), F.lit(False))


def route_sql(name: str, backend: str) -> str:
    """DuckDB twin of ``route_model``."""
    low = f"lower({name})"
    whens = []
    for be, family, must, any_of in ROUTING_RULES:
        conds = [f"{backend} = '{be}'"] + [f"contains({low}, '{s}')" for s in must]
        if any_of:
            conds.append("(" + " OR ".join(f"contains({low}, '{a}')" for a in any_of) + ")")
        val = f"'{family}'" if family else "CAST(NULL AS VARCHAR)"
        whens.append(f"WHEN {' AND '.join(conds)} THEN {val}")
    return "CASE " + " ".join(whens) + " ELSE CAST(NULL AS VARCHAR) END"
