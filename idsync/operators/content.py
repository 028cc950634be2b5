"""Provider tables with their contracts.

A :class:`Content` is one provider's rows of one object type. It is immutable: every operation
returns a new one. ``_pos`` keeps the order of the source, which decides what "first" means.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idsync.functions.dates import is_valid_date

POS = "_pos"


@dataclass(frozen=True)
class Contract:
    """Columns of an object type: required ones, optional ones that must not be null, optional nullable ones, dates."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    nullable: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()


CONTRACTS = {
    "match": Contract(("match_date", "home_team_id", "away_team_id"), ("competition_id", "season_id"), ("matchday",), ("match_date",)),
    "team": Contract(("team_name",), ("competition_id", "season_id")),
    "player": Contract(("player_name", "team_id"), (), ("player_nickname", "birth_date", "jersey_number"), ("birth_date",)),
}


class ContractError(ValueError):
    """A provider table that doesn't meet its contract."""


@dataclass(frozen=True)
class Content:
    """One provider's rows of one object type."""

    object_type: str
    provider: str
    data: DataFrame
    block: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if not isinstance(self.data, DataFrame):
            raise ContractError("content needs a DataFrame")
        if self.id_field not in self.data.columns:
            raise ContractError(f"content of {self.provider} has no column {self.id_field}")

    @property
    def id_field(self) -> str:
        return f"{self.provider}_{self.object_type}_id"

    @classmethod
    def of(cls, object_type: str, provider: str, data: DataFrame, *, block: tuple[str, ...] = (), order_by: str | None = None) -> Content:
        """Cast the contract's columns to text and fix the order of rows.

        ``order_by`` names a numeric column that holds the order (null last); without it rows are
        numbered by id inside their block.
        """
        plain = cls(object_type, provider, data, tuple(block))
        contract = CONTRACTS.get(object_type, Contract(()))
        known = {plain.id_field, *contract.required, *contract.optional, *contract.nullable} & set(data.columns)
        data = data.withColumns({c: F.col(c).cast("string") for c in sorted(known)})
        if POS not in data.columns:
            at = F.col(order_by).cast("long") if order_by else F.row_number().over(Window.partitionBy(*block).orderBy(plain.id_field)).cast("long")
            data = data.withColumn(POS, at)
        return cls(object_type, provider, data, tuple(block))

    def with_data(self, data: DataFrame) -> Content:
        return replace(self, data=data)

    def violations(self) -> DataFrame:
        """(check, rows): how many rows break each check of the contract; one aggregation."""
        contract = CONTRACTS.get(self.object_type, Contract(()))
        missing = [c for c in (self.id_field, *contract.required) if c not in self.data.columns]
        if missing:
            raise ContractError(f"content of {self.provider} lacks {', '.join(missing)}")
        checks = {f"{c} is null": F.col(c).isNull() for c in (self.id_field, *contract.required, *contract.optional) if c in self.data.columns}
        checks |= {f"{c} is no date": F.col(c).isNotNull() & ~is_valid_date(F.col(c).cast("string")) for c in contract.dates if c in self.data.columns}
        counts = self.data.agg(*(F.count_if(c).alias(f"n{i}") for i, c in enumerate(checks.values())))
        rows = F.array(*(F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("rows")) for i, name in enumerate(checks)))
        return counts.select(F.explode(rows).alias("v")).select("v.check", "v.rows")

    def validate(self) -> Content:
        """Raise unless all rows meet the contract."""
        broken = [f"{r['check']} in {r['rows']} rows" for r in self.violations().filter("rows > 0").collect()]
        if broken:
            raise ContractError(f"content of {self.provider}: " + "; ".join(broken))
        return self

    def id_columns(self) -> list[str]:
        return [c for c in self.data.columns if f"_{self.object_type}_id" in c]

    def sorted(self, columns: list[str]) -> DataFrame:
        """The rows in order of ``columns``, for a last step that is read in order."""
        return self.data.orderBy(*columns)

    def merge(self, right: Content | None) -> Content:
        """Attach the right side's ids by the right side's own id; ids already present win."""
        if right is None:
            return self
        if right.object_type != self.object_type:
            raise ContractError(f"cannot merge {right.object_type} into {self.object_type}")
        if right.id_field not in self.data.columns:
            raise ContractError(f"{right.id_field} is not a column of the left side")
        ids = [c for c in right.id_columns() if c != right.id_field]
        keys = [*self.block, right.id_field]
        other = right.data.filter(F.col(right.id_field).isNotNull()).select(*keys, *(F.col(c).alias(f"{c}_y") for c in ids))
        joined = self.data.join(other, keys, "left")
        for c in ids:
            joined = joined.withColumn(c, F.coalesce(c, f"{c}_y") if c in self.data.columns else F.col(f"{c}_y")).drop(f"{c}_y")
        return self.with_data(joined)

    def append(self, right: Content | DataFrame | None) -> Content:
        """Rows of the right side below; columns that one side lacks are null there."""
        if right is None:
            return self
        if isinstance(right, Content):
            if right.object_type != self.object_type:
                raise ContractError(f"cannot append {right.object_type} to {self.object_type}")
            right = right.data
        return self.with_data(self.data.unionByName(right, allowMissingColumns=True))
