"""Data contracts checked row by row; every failure of a row is kept.

A failing row is set aside with the list of its failures, and the good rows go
on. (Rejecting a whole batch for one row would lose the good ones.)
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.config import TableSpec
from doorflux.operators.clean import SOURCE_TIME

#: Column of failures: one entry per failed check of the row.
FAILURES = "failures"
#: Whether a flagged row met its contract.
PASSED = "passed"
_FAILURE_TYPE = "array<struct<column:string,check:string,failure_case:string>>"
_REPEATED = "_repeated"


@dataclass(frozen=True)
class Field:
    """One column of a contract."""

    name: str
    type: str
    nullable: bool = False
    at_least: int | None = None
    unique: bool = False
    derived: bool = False  # computed from a checked field: never fails by itself


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]

    @property
    def names(self) -> list[str]:
        return [field.name for field in self.fields]

    @property
    def ddl(self) -> str:
        return ", ".join(f"{field.name} {field.type}" for field in self.fields)

    @property
    def unique_fields(self) -> list[Field]:
        return [field for field in self.fields if field.unique]


CONTRACTS = {
    "dim_stores": Contract((
        Field("store_id", "bigint", unique=True),
        Field("store_name", "string"),
    )),
    "fact_traffic": Contract((
        Field("recorded_at", "timestamp_ntz"),
        Field("visitors_in", "bigint", at_least=0),
        Field("visitors_out", "bigint", at_least=0),
        Field("device_position", "string", nullable=True),
        Field("store_id", "bigint"),
        Field("year", "int", derived=True),
        Field("month", "int", derived=True),
    )),
    "fact_errors": Contract((
        Field("log_id", "bigint", unique=True),
        Field("store_id", "bigint"),
        Field("device_code", "int", nullable=True),
        Field("logged_at", "timestamp_ntz"),
        Field("error_code", "int", nullable=True),
        Field("error_message", "string", nullable=True),
        Field("year", "int", derived=True),
        Field("month", "int", derived=True),
    )),
}


def contract_for(spec: TableSpec) -> Contract | None:
    return CONTRACTS.get(spec.dest_table)


def check_columns(df: DataFrame, contract: Contract) -> DataFrame:
    """Exactly the contract's columns, in its order; an error if one is missing."""
    missing = [name for name in contract.names if name not in df.columns]
    if missing:
        raise ValueError(f"columns missing for the contract: {missing}")
    carried = [SOURCE_TIME] if SOURCE_TIME in df.columns else []
    return df.select(*contract.names, *carried)


def flag(
    df: DataFrame, contract: Contract, check_unique: bool = True, taken: DataFrame | None = None
) -> DataFrame:
    """The rows with contract types, an array of all their failures, and whether
    they passed. ``taken`` holds rows whose unique keys may not come again. ``df`` is
    read twice if a key must be unique: hand in rows that have been written.

    Catalyst pushes a filter below the projections and repeats their expressions
    there, so ``passed`` holds each column once and does not use ``failures``.
    """
    df = check_columns(df, contract)
    repeated = {}
    if check_unique:
        for field in contract.unique_fields:
            df = _mark_repeated(df, field, taken)
            repeated[field.name] = F.col(f"{_REPEATED}_{field.name}").isNotNull()
    types = {column.name: column.dataType.simpleString() for column in df.schema}
    typed = {field.name: _typed(field, types) for field in contract.fields}
    checks = [
        (field, check, failed)
        for field in contract.fields
        for check, failed in _checks(field, typed[field.name], types, repeated)
    ]
    passes = [_passes(field, typed[field.name], types, repeated) for field in contract.fields]
    passes = [each for each in passes if each is not None]
    passed = reduce(Column.__and__, passes) if passes else F.lit(True)
    failures = F.array_compact(F.array(*[_failure(*check) for check in checks]))
    # Good rows, which are most, skip the building of the array.
    failures = F.when(passed, F.array()).otherwise(failures)
    carried = [SOURCE_TIME] if SOURCE_TIME in types else []
    return df.select(
        *[column.alias(name) for name, column in typed.items()],
        *carried,
        failures.cast(_FAILURE_TYPE).alias(FAILURES),
        passed.alias(PASSED),
    )


def accepted(flagged: DataFrame) -> DataFrame:
    return flagged.filter(PASSED).drop(FAILURES, PASSED)


def rejected(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.coalesce(F.col(PASSED), F.lit(False))).drop(PASSED)


def failure_cases(flagged: DataFrame) -> DataFrame:
    """One row per failed check, with the row it belongs to."""
    keys = [name for name in flagged.columns if name not in (FAILURES, PASSED)]
    # Outer, and filtered by what it yields: no filter to repeat below it.
    cases = flagged.select(*keys, F.inline_outer(FAILURES))
    return cases.filter(F.col("check").isNotNull())


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys held by more than one row, with the number of rows that hold them.

    The count is combined before the shuffle, so a key that many rows share
    still sends one row per task.
    """
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def _mark_repeated(df: DataFrame, field: Field, taken: DataFrame | None) -> DataFrame:
    """Add a column that is set where the key is repeated in ``df`` or already ``taken``.

    Nothing is run or written here. Adaptive execution knows the true number of
    such keys when it joins them: few are broadcast and the rows stay where they are;
    many make a sort-merge join, whose hot keys it splits.
    """
    key = F.col(field.name).try_cast(field.type)
    mark = f"{_REPEATED}_{field.name}"
    batch = df.select(key.alias(mark))
    keys = repeated_keys(batch, mark).select(mark)
    if taken is not None:
        known = taken.select(F.col(field.name).cast(field.type).alias(mark))
        distinct = batch.filter(F.col(mark).isNotNull()).distinct()
        keys = keys.unionAll(known.join(distinct, mark, "left_semi")).distinct()
    return df.join(keys, key == F.col(mark), "left")


def _typed(field: Field, types: dict[str, str]) -> Column:
    column = F.col(field.name)
    return column if types[field.name] == field.type else column.try_cast(field.type)


def _checks(
    field: Field, typed: Column, types: dict[str, str], repeated: dict[str, Column]
) -> list[tuple[str, Column]]:
    """The checks of a field, each with the condition under which it fails."""
    raw = F.col(field.name)
    checks = []
    if field.derived:
        return checks
    if types[field.name] != field.type:
        checks.append((f"coerce:{field.type}", raw.isNotNull() & typed.isNull()))
    if not field.nullable:
        checks.append(("not_null", raw.isNull()))
    if field.at_least is not None:
        checks.append((f"at_least:{field.at_least}", typed < field.at_least))
    if field.name in repeated:
        checks.append(("unique", repeated[field.name]))
    return checks


def _passes(
    field: Field, typed: Column, types: dict[str, str], repeated: dict[str, Column]
) -> Column | None:
    """Whether a field meets all its checks (NULL counts as no)."""
    passes = None
    if field.derived:
        return passes
    if field.at_least is not None:
        passes = typed >= field.at_least
        if field.nullable:
            passes = passes | F.col(field.name).isNull()
    elif not field.nullable:
        passes = typed.isNotNull()
    elif types[field.name] != field.type:
        passes = F.col(field.name).isNull() | typed.isNotNull()
    if field.name in repeated:
        unique = ~repeated[field.name]
        passes = unique if passes is None else passes & unique
    return passes


def _failure(field: Field, check: str, failed: Column) -> Column:
    return F.when(
        failed,
        F.struct(
            F.lit(field.name).alias("column"),
            F.lit(check).alias("check"),
            F.col(field.name).cast("string").alias("failure_case"),
        ),
    )
