"""Aggregate functions as Spark SQL expressions, with DISTINCT, FILTER and ORDER BY."""

from __future__ import annotations

from lakeweave.functions.scalar import Typed, number, text

AGGREGATES = {"count", "sum", "total", "avg", "min", "max", "group_concat", "string_agg"}
#: Functions that need an OVER clause, and their class (None: that of the first argument).
WINDOWS = {"row_number": "int", "rank": "int", "dense_rank": "int", "ntile": "int", "percent_rank": "real", "cume_dist": "real", "lag": None, "lead": None, "first_value": None, "last_value": None, "nth_value": None}


def is_aggregate(name: str, n_args: int, star: bool, windowed: bool = False) -> bool:
    """min and max aggregate with one argument only."""
    if name in ("min", "max"):
        return n_args == 1
    return name in AGGREGATES or windowed and name in WINDOWS


def aggregate(name: str, args: list[Typed], star: bool, distinct: bool, where: str, over: str, order: str = "") -> Typed:
    """One aggregate call. ``where`` is a FILTER clause, ``over`` an OVER clause, either may be empty."""
    if name in ("min", "max", "sum", "avg", "total") and len(args) != 1 or name == "count" and not star and len(args) != 1:
        raise ValueError(f"wrong number of arguments to function {name}()")
    inner = "*" if star or not args else ("DISTINCT " if distinct else "") + number(args[0])
    if name == "count":
        return f"count({inner}){where}{over}", "int"
    kind = "int" if args[0][1] == "bool" else args[0][1]
    if name == "sum":
        return f"sum({inner}){where}{over}", kind
    if name == "avg":
        return f"avg({inner}){where}{over}", "real"
    if name == "total":
        inner = ("DISTINCT " if distinct else "") + f"CAST({number(args[0])} AS DOUBLE)"
        return f"coalesce(sum({inner}){where}{over}, 0D)", "real"
    if name in ("min", "max"):
        return f"{name}({number(args[0])}){where}{over}", kind
    separator = args[1][0] if len(args) > 1 else "','"
    value = ("DISTINCT " if distinct else "") + text(args[0])
    if over:  # lists in a window have no WITHIN GROUP
        return f"array_join(collect_list({value}){where}{over}, {separator})", "text"
    return f"listagg({value}, {separator}){order}{where}", "text"


def window(name: str, args: list[Typed], over: str) -> Typed:
    """One ranking or value function over a window."""
    kind = WINDOWS[name] or (args[0][1] if args else "any")
    values = [number(args[0])] if args else []
    values += [f"CAST({x[0]} AS INT)" if i == 0 and name in ("lag", "lead", "nth_value") else x[0] for i, x in enumerate(args[1:])]
    if name == "ntile":
        values = [f"CAST({args[0][0]} AS INT)"]
    out = f"{name}({', '.join(values)}){over}"
    return (f"CAST({out} AS BIGINT)" if kind == "int" and WINDOWS[name] == "int" else out), "int" if kind == "bool" else kind
