"""From raw text columns to a typed table with roles, in one call."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions import cleaning, inference
from tallyweir.operators import roles


@dataclass(frozen=True)
class Prepared:
    """A typed table, the kind of each column that was text, its roles, and what was done on the way."""

    table: DataFrame
    kinds: dict[str, str]
    roles: dict
    notes: dict[str, object] = field(default_factory=dict)


def cleaned(raw: DataFrame, row_id: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Typed columns without total lines, infinities or spelling variants, and the kinds found.

    ``row_id`` numbers the rows from 0 in the order of the file, where one is
    known: exported index columns and an unlabelled last row of sums need it. It
    is not typed itself. The order of steps is that of a reader: tokens that
    mean nothing, then lines that are no records, then types, then values.
    """
    kept = inference.without_index_columns(raw, row_id) if row_id else raw
    kept = inference.without_total_lines(kept)
    df, kinds = inference.typed(kept, spellings=True)
    if row_id:
        df = inference.without_sum_row(df, row_id)
    numbers = [c for c, kind in df.dtypes if kind in ("double", "float")]
    df = df.withColumns({c: cleaning.finite(F.col(f"`{c}`")) for c in numbers})
    return df, kinds


def prepared(raw: DataFrame, row_id: str | None = None, metric: str | None = None) -> Prepared:
    """:func:`cleaned`, then the columns' roles, with stray codes of rating columns cleared. The table is held for the calls that follow."""
    df, kinds = cleaned(raw, row_id)
    df = (df.drop(row_id) if row_id else df).persist()
    found = roles.roles(df, metric)
    for name in found["ratings"]:
        df = inference.without_stray_codes(df, name)
    return Prepared(df, kinds, found, {"ratings": sorted(found["ratings"]), "columns": len(df.columns)})
