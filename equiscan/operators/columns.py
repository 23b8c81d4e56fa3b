"""Column selection by alias map. Everything here works on schema metadata only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename_map(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Keep the columns named in ``aliases`` under their canonical name, in map order.

    Old and new source names may map to one target; the one that comes first in the input wins.
    """
    chosen: dict[str, str] = {}
    for source in df.columns:
        target = aliases.get(source)
        if target is not None and target not in chosen:
            chosen[target] = source
    ordered = [t for t in dict.fromkeys(aliases.values()) if t in chosen]
    return df.select([F.col(f"`{chosen[t]}`").alias(t) for t in ordered])


def unknown_columns(df: DataFrame, aliases: dict[str, str]) -> list[str]:
    """Input columns no alias covers; :func:`rename_map` drops them."""
    return [c for c in df.columns if c not in aliases]


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required columns a batch lacks; a non-empty answer means the batch is skipped."""
    return [c for c in required if c not in df.columns]
