"""Overlay queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.operators import overlay as op
from leverwise.operators.merge import splice
from leverwise.plans.registered.common import (
    CELLS_SQL,
    NOW_SQL,
    OVERRIDES_SQL,
    RESOLVED_SQL,
    VIEW_SQL,
    held_inputs,
    now,
)
from leverwise.plans.what_if import what_if_round
from leverwise.session import held, shared_dir
from leverwise.sources.schemas import BATCHES
from leverwise.sources.sinks import overwrite_groups, read_groups, write_bucketed_groups
from leverwise.sources.tables import as_input, load_tables
from leverwise.streaming.feeds import apply_changes_stream, compact_changes, current_changes, start_change_feed

SEARCH_TEXT = "ring"


def _latest(t) -> DataFrame:
    return op.latest_changes(t.change_feed, ["ts", "event_id"]).select(
        "scenario_id", "attr_id", "new_value", "is_revert", "user_id"
    )


LATEST_SQL = """latest as (
    select scenario_id, attr_id, new_value, is_revert, user_id from (
        select *, row_number() over (partition by scenario_id, attr_id order by ts desc, event_id desc) as rn
        from {change_feed}) f where rn = 1)"""

CHANGED_SQL = f"""with {LATEST_SQL}
    select scenario_id, attr_id, new_value from {{scenario_change}} o
    where not exists (select 1 from latest l where l.scenario_id = o.scenario_id and l.attr_id = o.attr_id)
    union all select scenario_id, attr_id, new_value from latest where not is_revert"""


STREAM_ORDER = ["ts", "event_id"]
STREAM_FILES = 4


def _streamed(t) -> str:
    """The change feed run through the stream in several micro-batches, cut out of time order; its root."""
    spark = t.events.sparkSession
    root = f"{shared_dir(spark)}/change-feed-{uuid.uuid4().hex}"
    files = t.events.withColumn("part", F.col("event_id") % STREAM_FILES).repartition(STREAM_FILES, "part")
    files.write.partitionBy("part").parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    feed = events.select(
        "event_id", "ts", (2 * (F.col("user_id") % 5) + 1000001).alias("scenario_id"),
        (F.col("event_id") % 200).alias("attr_id"), F.col("value").alias("new_value"),
        (F.col("event_type") == "error").alias("is_revert"), "user_id",
    )
    start_change_feed(t, feed, root, STREAM_ORDER)
    apply_changes_stream(lambda: t, feed, root, now(), STREAM_ORDER).awaitTermination()
    return root


def _change_stream(t) -> DataFrame:
    """The outcome, read from compacted deltas."""
    root = _streamed(t)
    compact_changes(t, root, f"{root}/compact", STREAM_ORDER)
    return current_changes(t, f"{root}/compact", STREAM_ORDER)


def _change_stream_log(t) -> DataFrame:
    return t.events.sparkSession.read.parquet(f"{_streamed(t)}/log").drop("batch")


STREAM_LOG_SQL = f"""with ranked as (
        select *, row_number() over (
            partition by event_id % {STREAM_FILES}, scenario_id, attr_id order by ts desc, event_id desc) as rn
        from {{change_feed}})
    select l.scenario_id, l.attr_id, l.user_id, {NOW_SQL} as change_date, v.value as old_value, l.new_value
    from ranked l join {{scenario}} s using (scenario_id)
    join {{value}} v on v.dataset_id = s.view_dataset_id and v.attr_id = l.attr_id
    where rn = 1"""


def _typed_batch(t) -> DataFrame:
    text = t.change_feed.select(
        *[F.col(c).cast("string").alias(c) for c in ("scenario_id", "attr_id", "new_value", "is_revert")]
    )
    return as_input(text, BATCHES["scenario_changes"])


def _copied(t) -> DataFrame:
    copy = op.copy_dataset(t, t.copy_request, now())
    names = copy.dataset.select("dataset_id", "dataset_name", "model_id", "origin")
    scenarios = copy.scenario.select(F.col("view_dataset_id").alias("dataset_id"), "scenario_id", "base_dataset_id")
    return copy.value.join(names, "dataset_id").join(scenarios, "dataset_id").select(
        "dataset_id", "dataset_name", "model_id", "origin", "scenario_id", "base_dataset_id", "attr_id", "value",
        "is_calc_redundant",
    )


def _merged(t) -> DataFrame:
    merged = op.merge_calculated(t, t.calculated, now())
    stamps = merged.dataset.select("dataset_id", "last_update")
    return splice(t.value, merged.value, merged.touched, "dataset_id").join(stamps, "dataset_id")


def _merged_stored(t) -> DataFrame:
    """The same through a bucketed table: only touched folders are read and rewritten, then the whole is read back."""
    spark = t.value.sparkSession
    root = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    path = f"{root}/value"
    write_bucketed_groups(t.value, path, "dataset_id", 16)
    touched = t.calculated.select("dataset_id").distinct()
    merged = op.merge_calculated(t.replace(value=read_groups(spark, path, touched)), t.calculated, now())
    overwrite_groups(merged.value, merged.touched, path)
    stamps = merged.dataset.select("dataset_id", "last_update")
    return load_tables(spark, root, ["value"]).value.join(stamps, "dataset_id")


def _assumption_requests(t) -> DataFrame:
    return t.scenario.select(
        F.col("view_dataset_id").alias("dataset_id"), "scenario_id", F.col("created_by").alias("user_id")
    )


COMPARISON_SQL = f"""with {OVERRIDES_SQL},
        asked as (
            select *, (select base_dataset_id from {{scenario}} s where s.view_dataset_id = q.dataset_id) as base_id
            from {{comparison}} q where dataset_id in (select dataset_id from {{dataset}})),
        numbers as (
            select q.dataset_id, benchmark_id, structure_id, user_id, attr_id,
                   max(value) filter (v.dataset_id = q.dataset_id) as own,
                   max(value) filter (v.dataset_id = base_id) as base,
                   max(value) filter (v.dataset_id = benchmark_id) as target,
                   bool_or(is_calc_redundant) filter (v.dataset_id = q.dataset_id) as is_calc_redundant
            from asked q join {{value}} v on v.dataset_id in (q.dataset_id, base_id, benchmark_id)
            group by all having count(*) filter (v.dataset_id = q.dataset_id) > 0),
        judged as (
            select numbers.*, coalesce(base, own) as actual, coalesce(new_value, own) as whatif, new_value,
                   coalesce((select u.sec_level from {{user}} u where u.user_id = numbers.user_id), -1) as reach
            from numbers left join overrides using (dataset_id, attr_id))
        select dataset_id, benchmark_id, structure_id, user_id, attr_id,
               (select format from {{unit_format}} f where f.unit = a.unit) as value_format,
               (select f.unit from {{unit_format}} f where f.unit = a.unit) as value_unit, is_kpi, is_lever,
               is_calculated, is_non_driver, is_calc_redundant, if(reach >= sec_level, actual, null) as actual,
               if(reach >= sec_level, target, null) as target, (target - actual) / nullif(actual, 0) as target_change,
               (whatif - actual) / nullif(actual, 0) as whatif_change, if(reach >= sec_level, whatif, null) as whatif,
               new_value as override_value, 1 as increase_is_good, vdt_node_id as node_id, name as node_name
        from judged join {{attribute}} a using (attr_id)
        join {{vdt_node}} n on n.attribute_id = judged.attr_id and n.vdt_structure_id = structure_id"""


def _refreshed(t) -> DataFrame:
    """Resolved values kept from before a round of changes and calculated results, brought up to date by these alone."""
    # Each state is read several times below, so it is written once.
    t = held_inputs(t, "value", "scenario_change", "calculated")
    kept = held(op.resolved_values(t))
    changes = _latest(t)
    after = t.replace(scenario_change=held(op.apply_changes(t, changes)))
    written = held(op.with_attr_ids(t, t.calculated).select("dataset_id", "attr_id", "value"))
    merged = op.merge_calculated(after, written, now(), dataset_ids=t.calculated.select("dataset_id"))
    after = after.replace(value=held(splice(t.value, merged.value, merged.touched, "dataset_id")))
    return op.refresh_resolved(after, kept, op.affected_cells(after, changes, written, once=False))


MERGED_SQL = f"""with source as (
            select c.dataset_id, e.attr_id, c.value from {{calculated}} c
            join {{external_attr}} e on e.object_path = c.object_path and e.attr_name = c.attr_name)
        select coalesce(v.dataset_id, s.dataset_id) as dataset_id, coalesce(v.attr_id, s.attr_id) as attr_id,
               coalesce(s.value, v.value) as value, coalesce(v.is_calc_redundant, false) as is_calc_redundant,
               case when d.dataset_id in (select dataset_id from {{calculated}}) then {NOW_SQL}
                    else d.last_update end as last_update
        from {{value}} v full outer join source s on s.dataset_id = v.dataset_id and s.attr_id = v.attr_id
        join {{dataset}} d on d.dataset_id = coalesce(v.dataset_id, s.dataset_id)"""


def _round(t) -> DataFrame:
    """One what-if round with a model that doubles every plain value it is fed."""

    def calculate(inputs: DataFrame) -> DataFrame:
        plain = inputs.where("is_override = 0")
        return plain.select("dataset_id", "object_path", "attr_name", (F.col("value") * 2).alias("value"))

    return what_if_round(held_inputs(t, "value"), _latest(t), calculate, now())[1]


ROUND_VALUES_SQL = f"""
    select v.dataset_id, v.attr_id, v.is_calc_redundant,
           case when a.is_calculated or v.attr_id not in (select attr_id from {{external_attr}}) then v.value
                else 2 * coalesce(c.new_value, v.value) end as value
    from {{value}} v join {{attribute}} a using (attr_id) left join {{scenario}} s on s.view_dataset_id = v.dataset_id
    left join ({CHANGED_SQL}) c on c.scenario_id = s.scenario_id and c.attr_id = v.attr_id"""
ROUND_SQL = RESOLVED_SQL.replace("{scenario_change}", f"({CHANGED_SQL})").replace("from {value}", f"from ({ROUND_VALUES_SQL})")

REFRESHED_SQL = RESOLVED_SQL.replace("{scenario_change}", f"({CHANGED_SQL})").replace(
    "from {value}", f"from (select dataset_id, attr_id, value, is_calc_redundant from ({MERGED_SQL}))"
)

QUERIES = {
    "resolved_values_refreshed": (_refreshed, REFRESHED_SQL),
    "what_if_round": (_round, ROUND_SQL),
    "resolved_values": (lambda t: op.resolved_values(t), RESOLVED_SQL),
    "calc_inputs": (
        lambda t: op.calc_inputs(t),
        """
        with """ + CELLS_SQL + """,
        amounts as (
            select dataset_id, attr_id, shown as amount, 0 as forced from cells
            where is_held and dataset_id in (select dataset_id from {dataset})
            union all select dataset_id, attr_id, new_value, 1 from overrides)
        select dataset_id, object_path, attr_name, amount as value, forced as is_override
        from amounts join {external_attr} using (attr_id)
        where forced = (select cast(is_calculated as int) from {attribute} a where a.attr_id = amounts.attr_id)""",
    ),
    "values_for_attributes": (
        lambda t: op.values_for(t, t.viewer, t.override_attr),
        f"""
        select r.dataset_id, w.user_id, {VIEW_SQL}
        from ({RESOLVED_SQL}) r join {{viewer}} w on w.dataset_id = r.dataset_id
        join {{user}} u on u.user_id = w.user_id and u.sec_level >= r.attribute_sec_level
        where r.attr_id in (select attr_id from {{override_attr}})""",
    ),
    "scenario_assumptions": (
        lambda t: op.assumptions(t, _assumption_requests(t)),
        f"""
        select r.dataset_id, q.scenario_id, q.created_by as user_id, {VIEW_SQL}
        from ({RESOLVED_SQL}) r join {{scenario}} q on q.view_dataset_id = r.dataset_id
        join {{user}} u on u.user_id = q.created_by and u.sec_level >= r.attribute_sec_level
        join {{scenario_change}} x on x.scenario_id = q.scenario_id and x.attr_id = r.attr_id""",
    ),
    "search_attributes": (
        lambda t: op.search_values(t, t.viewer, SEARCH_TEXT),
        f"""
        select distinct r.dataset_id, w.user_id, {VIEW_SQL}
        from ({RESOLVED_SQL}) r join {{viewer}} w on w.dataset_id = r.dataset_id
        join {{user}} u on u.user_id = w.user_id and u.sec_level >= r.attribute_sec_level
        join {{attribute_category}} ac on ac.attr_id = r.attr_id
        join {{category}} c on c.category_id = ac.category_id
        where (c.category_name like '%{SEARCH_TEXT}%' or r.attribute like '%{SEARCH_TEXT}%')
          and not r.attribute_is_kpi and r.attribute_is_lever
        order by r.attribute""",
    ),
    "attribute_export": (
        lambda t: op.export_attributes(t, t.viewer, t.override_attr),
        f"""
        select r.dataset_id, w.user_id, r.attr_id, r.attribute, r.attribute_unit as unit,
               r.attribute_is_cost as is_cost, r.attribute_is_lever as is_lever,
               r.attribute_is_aggregate as is_aggregate, r.attribute_is_kpi as is_kpi,
               r.base_value as baseline_value, r.override_value as scenario_value,
               e.object_path || '[' || r.attribute || ']' as attribute_path
        from ({RESOLVED_SQL}) r join {{viewer}} w on w.dataset_id = r.dataset_id
        join {{user}} u on u.user_id = w.user_id and u.sec_level >= r.attribute_sec_level
        join {{external_attr}} e on e.attr_id = r.attr_id
        where r.attr_id in (select attr_id from {{override_attr}})""",
    ),
    "compare_datasets": (lambda t: op.compare_datasets(t, t.comparison), COMPARISON_SQL),
    "compare_datasets_masked": (
        lambda t: op.compare_datasets(t, t.comparison, mask_changes=True),
        COMPARISON_SQL.replace("(target - actual) /", "if(reach >= sec_level, target - actual, null) /").replace(
            "(whatif - actual) /", "if(reach >= sec_level, whatif - actual, null) /"
        ),
    ),
    "search_attributes_ignoring_case": (
        lambda t: op.search_values(t, t.viewer, SEARCH_TEXT.upper(), ignore_case=True),
        f"""
        select distinct r.dataset_id, w.user_id, {VIEW_SQL}
        from ({RESOLVED_SQL}) r join {{viewer}} w on w.dataset_id = r.dataset_id
        join {{user}} u on u.user_id = w.user_id and u.sec_level >= r.attribute_sec_level
        where r.attribute_is_lever and not r.attribute_is_kpi and r.attr_id in (
            select attr_id from {{attribute_category}} join {{category}} using (category_id)
            join {{attribute}} using (attr_id)
            where category_name ilike '%{SEARCH_TEXT}%' or attr_name ilike '%{SEARCH_TEXT}%')""",
    ),
    "copy_dataset": (
        _copied,
        """with copies as (
            select q.*, d.model_id, (select max(dataset_id) from {dataset})
                     + row_number() over (order by q.base_dataset_id, q.dataset_name, q.user_id) as dataset_id
            from {copy_request} q join {dataset} d on d.dataset_id = q.base_dataset_id)
        select n.dataset_id, n.dataset_name, n.model_id, 'user' as origin,
               (select max(scenario_id) from {scenario})
                 + row_number_of.rn as scenario_id,
               n.base_dataset_id, v.attr_id, coalesce(c.new_value, v.value) as value, false as is_calc_redundant
        from copies n
        join (select dataset_id, row_number() over (order by dataset_id) as rn from copies) row_number_of
          on row_number_of.dataset_id = n.dataset_id
        join {value} v on v.dataset_id = n.base_dataset_id
        left join {scenario} s on s.view_dataset_id = n.base_dataset_id
        left join {scenario_change} c on c.scenario_id = s.scenario_id and c.attr_id = v.attr_id""",
    ),
    "apply_changes": (lambda t: op.apply_changes(t, _latest(t)), CHANGED_SQL),
    "change_log": (
        lambda t: op.change_log(t, _latest(t), now()),
        f"""with {LATEST_SQL}
        select l.scenario_id, l.attr_id, l.user_id, {NOW_SQL} as change_date, v.value as old_value, l.new_value
        from latest l join {{scenario}} s on s.scenario_id = l.scenario_id
        join {{value}} v on v.dataset_id = s.view_dataset_id and v.attr_id = l.attr_id""",
    ),
    "change_stream": (_change_stream, CHANGED_SQL),
    "change_stream_log": (_change_stream_log, STREAM_LOG_SQL),
    "batch_input_check": (_typed_batch, "select scenario_id, attr_id, new_value, is_revert from {change_feed}"),
    "mark_redundant": (
        lambda t: op.mark_redundant(t, t.scenario.select("scenario_id"), t.redundant_mark),
        """
        select v.dataset_id, v.attr_id, v.value, exists (
                 select 1 from {redundant_mark} m where m.scenario_id = s.scenario_id and m.attr_id = v.attr_id)
                 as is_calc_redundant
        from {value} v join {scenario} s on s.view_dataset_id = v.dataset_id""",
    ),
    "overridden_calculated": (
        lambda t: op.overridden_calculated(t, t.scenario.select("scenario_id")),
        """
        select c.scenario_id, c.attr_id from {scenario_change} c
        join {attribute} a on a.attr_id = c.attr_id and a.is_calculated""",
    ),
    "base_datasets": (
        lambda t: op.base_of(t, t.dataset.select(F.col("dataset_id").alias("view_dataset_id"))),
        """
        select s.view_dataset_id, min(s.base_dataset_id) as base_dataset_id
        from {scenario} s join {dataset} d on d.dataset_id = s.view_dataset_id group by s.view_dataset_id""",
    ),
    "merge_calculated": (_merged, MERGED_SQL),
    "merge_calculated_stored": (_merged_stored, MERGED_SQL),
}
