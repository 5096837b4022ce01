"""Column roles: operators work on canonical names, and bind() gives any table these names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Roles:
    """Expressions of a row's id, group, coarse and exact block, ordinal index, and values by name."""

    row_id: Column
    grp: Column
    blk: Column
    strict_blk: Column
    idx: Column
    values: dict[str, Column] = field(default_factory=dict)


def bind(df: DataFrame, roles: Roles, extra: tuple[str, ...] = ()) -> DataFrame:
    names = {"row_id": roles.row_id, "grp": roles.grp, "blk": roles.blk, "strict_blk": roles.strict_blk, "idx": roles.idx, **roles.values}
    return df.select(*(c.alias(n) for n, c in names.items()), *extra)
