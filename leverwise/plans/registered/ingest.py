"""Model import queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from leverwise.operators import ingest as op
from leverwise.operators.hierarchy import resolve_categories
from leverwise.plans.model_import import Batch, ModelImport, import_model
from leverwise.plans.registered.common import NOW_SQL, now
from leverwise.plans.registered.hierarchy import RESOLVE_SQL

MERGE_SQL = """source as (
    select r.*, coalesce(r.display_unit, '#') as unit, coalesce(r.sec_level, 1) as level,
           substring(r.type, 1, 1) = 'C' as is_cost, substring(r.type, 2, 1) = 'L' as is_lever,
           substring(r.type, 2, 1) = 'C' as is_calculated, substring(r.type, 3, 1) = 'A' as is_aggregate,
           substring(r.type, 4, 1) = 'K' as is_kpi, e.attr_id as known_id
    from {model_row} r left join {external_attr} e
      on e.model_id = r.model_id and e.object_path = r.object_path and e.attr_name = r.attr_name),
  placed as (
    select *, case when known_id is not null then known_id else (select max(attr_id) from {attribute})
             + row_number() over (partition by known_id is null
                                  order by model_id, object_path, attr_name, ext_attr_id) end as attr_id
    from source),
  new_attribute as (
    select a.attr_id, a.attr_name, coalesce(p.unit, a.unit) as unit, coalesce(p.level, a.sec_level) as sec_level,
           coalesce(p.is_cost, a.is_cost) as is_cost, coalesce(p.is_lever, a.is_lever) as is_lever,
           coalesce(p.is_calculated, a.is_calculated) as is_calculated,
           coalesce(p.is_aggregate, a.is_aggregate) as is_aggregate, a.is_non_driver,
           coalesce(p.is_kpi, a.is_kpi) as is_kpi
    from {attribute} a left join placed p on p.known_id = a.attr_id
    union all
    select attr_id, attr_name, unit, level, is_cost, is_lever, is_calculated, is_aggregate, false, is_kpi
    from placed where known_id is null),
  new_external as (
    select model_id, attr_id, object_path, ext_attr_id, attr_name from {external_attr}
    union all
    select model_id, attr_id, object_path, ext_attr_id, attr_name from placed where known_id is null)"""

LOAD_SQL = """named as (
    select model_id, concat('Model Data - ', case when left(filename, 1) = '_' then '_debug' else filename end)
             as dataset_name
    from {model_import}),
  matched as (
    select n.*, (select min(d.dataset_id) from {dataset} d
                 where d.origin = 'model' and d.dataset_name = n.dataset_name) as known_id
    from named n),
  loaded as (
    select *, case when known_id is not null then known_id else (select max(dataset_id) from {dataset})
             + row_number() over (partition by known_id is null order by dataset_name) end as dataset_id
    from matched)"""


def batch(t) -> Batch:
    """The sample delivery for all models."""
    return Batch(t.model_import, t.model_row, t.dependency_row, t.category_row, t.category_link)


def _imported(t) -> ModelImport:
    return import_model(t, batch(t), now())


def _links(t) -> DataFrame:
    grouping, category, id_map = resolve_categories(t, t.category_row)
    return op.replace_attribute_categories(
        t.replace(grouping=grouping, category=category), t.model_row, t.category_link, id_map
    )


def _links_replaced(t) -> DataFrame:
    grouping, category, id_map = resolve_categories(t, t.category_row)
    return op.replace_attribute_categories(
        t.replace(grouping=grouping, category=category), t.model_row, t.category_link, id_map, legacy_full_replace=True
    )


def _import_result(t) -> DataFrame:
    done = _imported(t)
    return (
        done.value.join(done.tables.dataset.select("dataset_id", "dataset_name", "model_id"), "dataset_id")
        .join(done.tables.attribute.select("attr_id", "attr_name", "unit"), "attr_id")
        .select("dataset_id", "dataset_name", "model_id", "attr_id", "attr_name", "unit", "value")
    )


QUERIES = {
    "attribute_flags": (
        lambda t: op.decode_types(t.model_row).select("model_id", "ext_attr_id", "unit", "sec_level", *op.FLAGS),
        """
        select model_id, ext_attr_id, coalesce(display_unit, '#') as unit, coalesce(sec_level, 1) as sec_level,
               substring(type, 1, 1) = 'C' as is_cost, substring(type, 2, 1) = 'L' as is_lever,
               substring(type, 2, 1) = 'C' as is_calculated, substring(type, 3, 1) = 'A' as is_aggregate,
               substring(type, 4, 1) = 'K' as is_kpi
        from {model_row}""",
    ),
    "upsert_attributes": (
        lambda t: op.upsert_attributes(t, t.model_row).attribute,
        f"with {MERGE_SQL} select * from new_attribute",
    ),
    "attribute_id_map": (
        lambda t: op.upsert_attributes(t, t.model_row).actions,
        f"""with {MERGE_SQL}
        select model_id, attr_id, object_path, ext_attr_id, attr_name,
               case when known_id is null then 'INSERT' else 'UPDATE' end as action
        from placed""",
    ),
    "attribute_categories_replaced": (
        _links_replaced,
        f"""with {RESOLVE_SQL}
        select e.attr_id, m.grouping_id, m.category_id from {{category_link}} l
        join {{external_attr}} e using (ext_attr_id)
        join id_map m on m.model_id = l.model_id and m.ext_category_id = l.ext_category_id""",
    ),
    "attribute_categories": (
        _links,
        f"""with {RESOLVE_SQL},
        added as (
            select e.attr_id, m.grouping_id, m.category_id from {{external_attr}} e
            join {{category_link}} l on l.ext_attr_id = e.ext_attr_id
            join id_map m on m.model_id = l.model_id and m.ext_category_id = l.ext_category_id),
        touched as (
            select attr_id from added union all
            select e.attr_id from {{model_row}} r join {{external_attr}} e
              on e.model_id = r.model_id and e.object_path = r.object_path and e.attr_name = r.attr_name)
        select attr_id, grouping_id, category_id from {{attribute_category}}
        where attr_id not in (select attr_id from touched)
        union all select attr_id, grouping_id, category_id from added""",
    ),
    "model_dataset_values": (
        lambda t: op.reload_model_datasets(t, t.model_import, t.model_row, now()).value,
        f"""with {LOAD_SQL}
        select l.dataset_id, e.attr_id, r.value, false as is_calc_redundant
        from {{model_row}} r join loaded l on l.model_id = r.model_id
        join {{external_attr}} e on e.object_path = r.object_path and e.attr_name = r.attr_name""",
    ),
    "model_datasets": (
        lambda t: op.reload_model_datasets(t, t.model_import, t.model_row, now()).dataset,
        f"""with {LOAD_SQL}
        select d.dataset_id, coalesce(l.model_id, d.model_id) as model_id, d.dataset_name, d.origin, d.last_update,
               d.description, d.created, d.category_id, d.model_version, d.deleted
        from {{dataset}} d left join loaded l on l.known_id = d.dataset_id
        union all
        select dataset_id, model_id, dataset_name, 'model', {NOW_SQL}, null, {NOW_SQL},
               (select min(category_id) from {{dataset_category}} where category_name = 'Scenario'), 1, false
        from loaded where known_id is null""",
    ),
    "top_of_tree": (
        lambda t: op.set_top_of_tree(t, t.model_import).select("model_id", "filename", "top_of_tree_attr_id"),
        """
        select m.model_id, case when left(i.filename, 1) = '_' then '_debug' else i.filename end as filename,
               (select min(e.attr_id) from {external_attr} e
                where e.model_id = i.model_id and e.ext_attr_id = i.top_ext_attr_id) as top_of_tree_attr_id
        from {model} m join {model_import} i on i.model_id = m.model_id""",
    ),
    "import_model": (
        _import_result,
        f"""with {MERGE_SQL}, {LOAD_SQL}
        select l.dataset_id, l.dataset_name, l.model_id, e.attr_id, a.attr_name, a.unit, r.value
        from {{model_row}} r join loaded l on l.model_id = r.model_id
        join new_external e on e.object_path = r.object_path and e.attr_name = r.attr_name
        join new_attribute a on a.attr_id = e.attr_id""",
    ),
    "import_model_stamps": (
        lambda t: _imported(t).tables.model.select("model_id", "filename", "top_of_tree_attr_id"),
        f"""with {MERGE_SQL}
        select m.model_id, case when left(i.filename, 1) = '_' then '_debug' else i.filename end as filename,
               (select min(e.attr_id) from new_external e
                where e.model_id = i.model_id and e.ext_attr_id = i.top_ext_attr_id) as top_of_tree_attr_id
        from {{model}} m join {{model_import}} i on i.model_id = m.model_id""",
    ),
    "external_id_map": (
        lambda t: op.external_id_map(t),
        "select object_path || '[' || attr_name || ']' as full_path, attr_id, '' as link from {external_attr}",
    ),
    "attributes_by_path": (
        lambda t: op.attributes_by_path(t, t.path_request, t.model.select("model_id")),
        """
        select concat(e.object_path, '[', e.attr_name, ']') as path, e.model_id, e.attr_id from {external_attr} e
        where concat(e.object_path, '[', e.attr_name, ']') in (select path from {path_request})
          and e.model_id in (select model_id from {model})""",
    ),
}
