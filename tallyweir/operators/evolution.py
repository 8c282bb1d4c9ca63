"""Schemas that change by field id, and staged publication."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.operators.contracts import Rule, contract_results
from tallyweir.operators.rules import merge_upsert

_WIDER = {("int", "bigint"), ("smallint", "int"), ("tinyint", "int"), ("tinyint", "smallint"), ("smallint", "bigint"), ("float", "double"), ("date", "timestamp_ntz")}


def evolved(batches: list[tuple[DataFrame, dict[str, int]]], schema: list[tuple[int, str, str]]) -> DataFrame:
    """Batches, each with the field ids of its own column names, under the present schema of (field id, name, type).

    Columns follow their id through renames and reorders; ids that a batch lacks are null, ids that the schema lacks are
    left out, so a name that is added again does not bring old values back. A type that got narrower raises.
    """
    parts = []
    for rows, ids in batches:
        name_of = {i: n for n, i in ids.items()}
        columns = []
        for i, name, kind in schema:
            if i not in name_of:
                columns.append(F.lit(None).cast(kind).alias(name))
                continue
            was = rows.schema[name_of[i]].dataType.simpleString()
            if was != kind and (was, kind) not in _WIDER:
                raise ValueError(f"{name} can't become {kind} from {was}")
            columns.append(F.col(name_of[i]).cast(kind).alias(name))
        parts.append(rows.select(*columns))
    return functools.reduce(DataFrame.unionByName, parts)


def publish_staged(target: DataFrame, staged: DataFrame, keys: list[str], rules: list[Rule], as_of: str = "1970-01-01") -> DataFrame:
    """The target with the staged change applied, after the change has passed its rules; else raises."""
    failed = contract_results(staged, "staged", rules, as_of).where("status = 'error'").collect()  # one row a rule
    if failed:
        raise ValueError("staged change: " + "; ".join(f"{r['check']}({r['column']})" for r in failed))
    return merge_upsert(target, staged, keys)
