"""Small helpers for writing the oracle SQL texts (DuckDB dialect).

Oracle queries are hand-written SQL; these helpers only format the select lists
(doubles are rounded to 6 places on both sides) and the parameter literals.
"""

from __future__ import annotations

import datetime as dt

from shockspark.operators.windows import CrisisWindow


def d(x) -> str:
    """A DATE literal."""
    if isinstance(x, str):
        x = dt.date.fromisoformat(x)
    return f"DATE '{x.isoformat()}'"


def cols(*items: str) -> str:
    """Select list; ``name:d`` rounds a double to 6 places, ``expr AS name:d`` too."""
    out = []
    for it in items:
        if it.endswith(":d"):
            body = it[:-2]
            if " AS " in body:
                expr, name = body.rsplit(" AS ", 1)
                out.append(f"round({expr}, 6) AS {name}")
            else:
                out.append(f"round({body}, 6) AS {body}")
        else:
            out.append(it)
    return ",\n  ".join(out)


def window_where(w: CrisisWindow, col: str = "date") -> str:
    return f"{col} BETWEEN {d(w.pre_start)} AND {d(w.post_end)}"


def double_round(sql: str) -> str:
    """Rewrite every ``round(x, 6)`` of an oracle text into the two-step decimal
    rounding the Spark side applies (``functions.exprs.r6``): to 9 places, then
    HALF_UP to 6 on the decimal value (DuckDB's ``round`` on a double scales in binary
    and can round a decimal tie the other way)."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = sql[j + 6:k]
        out.append(sql[i:j])
        stripped = inner.rstrip()
        if stripped.endswith(", 6"):
            arg = double_round(stripped[:-3])
            out.append(f"CAST(round(CAST({arg} AS DECIMAL(38, 9)), 6) AS DOUBLE)")
        else:
            out.append("round(" + double_round(inner) + ")")
        i = k + 1
