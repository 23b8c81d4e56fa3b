"""Window primitives over series keyed ``(code, date)``.

A series has one row per key and date, so a window group never holds more rows than the covered period
has days: the largest group is bounded by the calendar, not by how popular a code is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str = "code", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def avg_last(value: Column | str, k: int, w: WindowSpec) -> Column:
    """Mean of the last ``k`` rows; a shorter frame at the series start is averaged as it is."""
    return F.avg(value).over(w.rowsBetween(-(k - 1), 0))


def max_prior(value: Column | str, k: int, w: WindowSpec) -> Column:
    """Maximum of the ``k`` rows before the current one."""
    return F.max(value).over(w.rowsBetween(-k, -1))


def count_last(k: int, w: WindowSpec) -> Column:
    """Rows in the last-``k`` frame. The running row number gives the same count without a frame."""
    return F.least(F.row_number().over(w), F.lit(k)).cast("bigint")


@dataclass(frozen=True)
class Slide:
    """``how`` (avg, full_avg, stddev, max or min) of the last ``k`` values of a column."""

    how: str
    value: str
    k: int


# What a stretch of rows carries for each statistic.
_PARTS = {"sum": ("n", "s"), "moments": ("n", "u", "v"), "max": ("x",), "min": ("x",)}
_KIND = {"avg": "sum", "full_avg": "sum", "stddev": "moments", "max": "max", "min": "min"}


def _one_row(kind: str, value: str) -> dict[str, Column]:
    """A stretch of a single row; a NULL value counts as no row."""
    column = F.col(value).cast("double")
    if kind in ("max", "min"):
        return {"x": column}
    known, n = F.coalesce(column, F.lit(0.0)), column.isNotNull().cast("bigint")
    return {"n": n, "s": known} if kind == "sum" else {"n": n, "u": known, "v": F.lit(0.0)}


def _combined(kind: str, a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Two neighbouring stretches as one; parts of ``b`` are NULL before the series starts.

    Spread is carried as mean and squared deviations, which do not cancel as sums of squares would.
    """
    if kind == "max":
        return {"x": F.greatest(a["x"], b["x"])}
    if kind == "min":
        return {"x": F.least(a["x"], b["x"])}
    b = {part: F.coalesce(c, F.lit(0)) for part, c in b.items()}
    n = a["n"] + b["n"]
    if kind == "sum":
        return {"n": n, "s": a["s"] + b["s"]}
    gap = b["u"] - a["u"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    return {"n": n, "u": a["u"] + gap * share, "v": a["v"] + b["v"] + gap * gap * a["n"] * share}


def sliding(
    df: DataFrame, outputs: dict[str, Slide], key: str = "code", order: str = "date"
) -> DataFrame:
    """Add long sliding statistics at a cost that grows with log k instead of k.

    A frame aggregate visits all k rows of its frame again for every row. Here stretches of 1, 2, 4, … rows
    are built by combining a stretch with the one that ends where it begins, and a frame of k rows is put
    together from at most log2(k) + 1 stretches. Each step is a ``lag`` on the same partitioning and order, so
    one exchange and one sort serve all of them. NULL values are skipped and frames at the series start are
    short, as with a plain frame; ``full_avg`` is NULL until k values are there.
    """
    w = series(key, order)
    columns = df.columns
    longest: dict[tuple[str, str], int] = {}
    for o in outputs.values():
        longest[_KIND[o.how], o.value] = max(longest.get((_KIND[o.how], o.value), 1), o.k)

    def name(kind: str, value: str, level: int, part: str) -> str:
        return f"_{kind}_{value}_{level}_{part}"

    def stretch(kind: str, value: str, level: int, back: int = 0) -> dict[str, Column]:
        parts = {p: F.col(name(kind, value, level, p)) for p in _PARTS[kind]}
        return {p: F.lag(c, back).over(w) for p, c in parts.items()} if back else parts

    df = df.withColumns(
        {name(kind, v, 0, p): c for kind, v in longest for p, c in _one_row(kind, v).items()}
    )
    for level in range(1, max(k.bit_length() for k in longest.values())):
        older, step = {}, {}
        for (kind, v), k in longest.items():
            if k < 2**level:
                continue
            for p, c in stretch(kind, v, level - 1, 2 ** (level - 1)).items():
                older[name(kind, v, level, f"{p}_older")] = c
            before = {p: F.col(name(kind, v, level, f"{p}_older")) for p in _PARTS[kind]}
            for p, c in _combined(kind, stretch(kind, v, level - 1), before).items():
                step[name(kind, v, level, p)] = c
        df = df.withColumns(older).withColumns(step).drop(*older)

    pieces: dict[str, list[dict[str, Column]]] = {}
    lagged: dict[str, Column] = {}
    for out, o in outputs.items():
        kind, top = _KIND[o.how], o.k.bit_length() - 1
        if kind in ("max", "min"):
            # Overlapping stretches do no harm to an extreme.
            places = [(top, 0)] + ([(top, o.k - 2**top)] if o.k > 2**top else [])
        else:
            places, back = [], 0
            for level in range(top, -1, -1):
                if o.k >> level & 1:
                    places.append((level, back))
                    back += 2**level
        pieces[out] = []
        for i, (level, back) in enumerate(places):
            parts = stretch(kind, o.value, level, back)
            lagged.update({f"_{out}_{i}_{p}": c for p, c in parts.items()})
            pieces[out].append({p: F.col(f"_{out}_{i}_{p}") for p in parts})
    df = df.withColumns(lagged)
    for i in range(1, max(len(p) for p in pieces.values())):
        step = {}
        for out, o in outputs.items():
            if i < len(pieces[out]):
                for p, c in _combined(_KIND[o.how], pieces[out][0], pieces[out][i]).items():
                    step[f"_{out}_0_{p}"] = c
        df = df.withColumns(step)

    results = []
    for out, o in outputs.items():
        total = pieces[out][0]
        if o.how in ("max", "min"):
            value = total["x"]
        elif o.how == "stddev":
            value = F.when(total["n"] > 1, F.sqrt(total["v"] / (total["n"] - 1)))
        else:
            enough = total["n"] > 0 if o.how == "avg" else total["n"] == o.k
            value = F.when(enough, total["s"] / total["n"])
        results.append(value.alias(out))
    return df.select(*columns, *results)


def latest(df: DataFrame, key: str = "code", order: str = "date") -> DataFrame:
    """One row per key: the one with the greatest ``order``, of which a key has one. An aggregate, so it combines before the
    shuffle; a value for each column, for a struct of them could not be aggregated by hash."""
    others = [c for c in df.columns if c != key]
    picked = [(F.max(c) if c == order else F.max_by(c, order)).alias(c) for c in others]
    return df.groupBy(key).agg(*picked).select(key, *others)


def tail_rows(df: DataFrame, n: int, key: str = "code", order: str = "date") -> DataFrame:
    """Last ``n`` rows of every series."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
