"""SQL functions: substring edit distance and its bounded form, for spark.sql()."""

from __future__ import annotations

import inspect

from pyspark.sql import SparkSession

_DISTANCE = """
    CASE WHEN q IS NULL OR s IS NULL THEN NULL WHEN length(q) = 0 THEN 0 ELSE aggregate(
        filter(split(s, ''), x -> x <> ''), named_struct('row', sequence(0, length(q)), 'best', length(q)),
        (state, x) -> named_struct(
            'row', aggregate(sequence(1, length(q)), array(0), (made, i) -> concat(made, array(least(made[i - 1] + 1, state.row[i] + 1, state.row[i - 1] + if(substring(q, i, 1) = x, 0, 1))))),
            'best', least(state.best, aggregate(sequence(1, length(q)), array(0), (made, i) -> concat(made, array(least(made[i - 1] + 1, state.row[i] + 1, state.row[i - 1] + if(substring(q, i, 1) = x, 0, 1)))))[length(q)])),
        state -> state.best) END"""

FUNCTIONS = {
    "sed": ("q STRING, s STRING", "INT", _DISTANCE),
    "sed_within": ("q STRING, s STRING, delta INT", "BOOLEAN", "sed(q, s) <= delta"),
}


def register(spark: SparkSession) -> None:
    """Make sed(q, s) and sed_within(q, s, delta) temporary functions of the session; they are SQL, not Python."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {inspect.cleandoc(body)}")
