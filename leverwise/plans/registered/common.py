"""Constants the registered queries share."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leverwise.functions.sizes import by_size
from leverwise.session import held

NOW_TEXT = "2024-06-01 00:00:00"
NOW_SQL = f"cast('{NOW_TEXT}' as timestamp_ntz)"


def now() -> Column:
    """The fixed time stamp of all registered writes."""
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def held_inputs(t, *names: str):
    """The bundle with some reshaped tables and batches written once, for plans that read them many times."""
    t = t.replace(part=by_size(t.part))
    return t.replace(**{name: held(getattr(t, name)) for name in names})


# Overrides by the dataset they are seen in, and everything a dataset holds or shows, one row for each attribute.
OVERRIDES_SQL = """overrides as (
    select view_dataset_id as dataset_id, attr_id, new_value from {scenario_change} join {scenario} using (scenario_id))"""

CELLS_SQL = f"""{OVERRIDES_SQL},
  held as materialized (select dataset_id, attr_id, value as stored, is_calc_redundant, true as is_held from {{value}}),
  cells as materialized (
    select dataset_id, attr_id, stored, is_calc_redundant, coalesce(is_held, false) as is_held, new_value,
           coalesce(new_value, stored) as shown
    from held full join overrides using (dataset_id, attr_id))"""

RESOLVED_SQL = f"""
    with {CELLS_SQL},
    pairs as (
        select own.*, s.scenario_id, base.shown as below
        from cells own left join {{scenario}} s on s.view_dataset_id = own.dataset_id
        left join cells base on base.dataset_id = s.base_dataset_id and base.attr_id = own.attr_id
        where own.is_held)
    select dataset_id, scenario_id, dataset_name as dataset, attr_id, attr_name as attribute, unit as attribute_unit,
           sec_level as attribute_sec_level, is_cost as attribute_is_cost, is_lever as attribute_is_lever,
           is_aggregate as attribute_is_aggregate, is_kpi as attribute_is_kpi,
           is_calculated as attribute_is_calculated, is_calc_redundant as attribute_is_calc_redundant,
           is_non_driver as attribute_is_non_driver, shown as value, coalesce(below, stored) as base_value,
           new_value as override_value
    from pairs join {{attribute}} using (attr_id) join (select dataset_id, dataset_name from {{dataset}}) using (dataset_id)"""

VIEW_SQL = """r.attr_id, r.attribute, r.attribute_unit, r.attribute_sec_level, r.attribute_is_cost,
    r.attribute_is_lever, r.attribute_is_aggregate, r.attribute_is_kpi, r.attribute_is_calculated,
    r.attribute_is_non_driver, r.attribute_is_calc_redundant, r.value, r.base_value, r.override_value"""
