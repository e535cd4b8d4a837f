"""Schema contracts: compare, decide, align. Only metadata is read."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaDriftError

Contract = Mapping[str, str]


@dataclass(frozen=True)
class Drift:
    """How an incoming schema differs from a contract."""

    added: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    retyped: list[str] = field(default_factory=list)

    @property
    def is_clean(self) -> bool:
        return not (self.added or self.missing or self.retyped)


def contract_of(df: DataFrame) -> dict[str, str]:
    """The schema of a frame as a contract, for comparing a day with the day before."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def check_schema(df: DataFrame, expected: Contract, required: Collection[str] | None = None) -> Drift:
    """Columns that are new, absent although required, or of another type."""
    found = contract_of(df)
    needed = expected if required is None else required
    return Drift(
        added=sorted(c for c in found if c not in expected),
        missing=sorted(c for c in needed if c not in found),
        retyped=sorted(c for c in expected if c in found and found[c] != expected[c]),
    )


def enforce(
    drift: Drift, retyped_ok: Collection[str] | None = None, allow_added: bool = True
) -> list[str]:
    """Raise on drift that must stop a load and return notes on drift that may pass.

    Missing columns always stop it. Type changes pass for the columns in `retyped_ok`, which
    are those the load casts anyway; None accepts any.
    """
    if drift.missing:
        raise SchemaDriftError(f"missing required columns: {drift.missing}")
    if drift.added and not allow_added:
        raise SchemaDriftError(f"unexpected columns: {drift.added}")
    hard = [] if retyped_ok is None else [c for c in drift.retyped if c not in retyped_ok]
    if hard:
        raise SchemaDriftError(f"columns changed type: {hard}")
    notes = [f"added column {c}" for c in drift.added]
    return notes + [f"retyped column {c}" for c in drift.retyped]


def align(df: DataFrame, schema: T.StructType, fill_missing: bool = False) -> DataFrame:
    """Project to the contract with its types. An absent column is an error unless filling is asked for.

    Casts use `try_cast`, so a value that does not fit becomes NULL, which a not-null
    expectation then reports, instead of failing the read half way.
    """
    absent = [f.name for f in schema.fields if f.name not in df.columns]
    if absent and not fill_missing:
        raise SchemaDriftError(f"missing required columns: {absent}")
    return df.select(
        *[
            F.lit(None).cast(f.dataType).alias(f.name)
            if f.name in absent
            else F.col(f.name).try_cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
