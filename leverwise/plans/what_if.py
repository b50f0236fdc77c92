"""The what-if round trip: apply changes, feed the calculator, take its results back, show the outcome."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from leverwise.operators.merge import splice
from leverwise.operators.overlay import apply_changes, calc_inputs, merge_calculated, resolved_values
from leverwise.session import held
from leverwise.sources.tables import Tables


def what_if_round(
    t: Tables, changes: DataFrame, calculate: Callable[[DataFrame], DataFrame], now: Column
) -> tuple[Tables, DataFrame]:
    """The bundle after one round, and the resolved values of the datasets that were recalculated.

    ``calculate`` is the external model: from calculator input to (dataset_id, object_path, attr_name, value).
    """
    # Each of these frames is read several times below, so it is written once.
    t = t.replace(scenario_change=held(apply_changes(t, changes)))
    merged = merge_calculated(t, held(calculate(calc_inputs(t))), now)
    t = t.replace(value=held(splice(t.value, merged.value, merged.touched, "dataset_id")), dataset=merged.dataset)
    return t, resolved_values(t, datasets=merged.touched)
