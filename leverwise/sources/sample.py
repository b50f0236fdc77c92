"""The star-schema test tables reshaped into model tables and batches.

Each entry is one SQL text that Spark and the checking engine both run unchanged. ``{name}`` stands for a
raw test table or another entry.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leverwise.sources.schemas import AUDIT_CATEGORIES, DATASET_CATEGORIES
from leverwise.sources.tables import Tables

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
WHEN = "cast('2024-01-01 00:00:00' as timestamp_ntz)"


def _numbered(names: list[str], id_column: str, name_column: str) -> str:
    rows = [f"select cast({i} as bigint) as {id_column}, '{n}' as {name_column}" for i, n in enumerate(names, 1)]
    return " union all ".join(rows)


SAMPLE: dict[str, str] = {
    # ---- tables -------------------------------------------------------------------------------------
    "attribute": """
        select p_partkey as attr_id, concat(p_name, ' ', cast(p_partkey as string)) as attr_name, p_type as unit,
               cast(p_size % 5 as int) as sec_level, p_partkey % 2 = 0 as is_cost, p_partkey % 3 = 0 as is_lever,
               p_partkey % 4 = 1 as is_calculated, p_partkey % 5 = 0 as is_aggregate,
               p_partkey % 11 = 0 as is_non_driver, p_partkey % 7 = 0 as is_kpi
        from {part}""",
    "unit_format": """
        select distinct p_type as unit,
               concat(chr(123), '0:', cast(length(p_type) as string), 's', chr(125)) as format
        from {part} where p_type <> 'PROMO'""",
    "model_group": """
        select cast(r_regionkey as bigint) as model_group_id, r_name as name, false as is_offline,
               concat('ident-', cast(r_regionkey as string)) as identifier, cast(r_regionkey + 1 as int) as instances
        from {region}""",
    "model": f"""
        select cast(n.n_nationkey as bigint) as model_id, n.n_name as filename, {WHEN} as file_date,
               n.n_nationkey % 4 <> 3 as is_active, cast(n.n_nationkey % 7 + 1 as int) as version,
               cast(n.n_regionkey as bigint) as model_group_id,
               cast(case when n.n_nationkey % 3 = 0 then n.n_nationkey % 7 end as int) as last_rollback,
               case when n.n_nationkey % 3 = 0 then concat('old ', n.n_name) end as rollback_filename,
               case when n.n_nationkey % 3 = 0 then {WHEN} end as rollback_file_date,
               top.attr_id as top_of_tree_attr_id, n.n_nationkey % 5 <> 4 as upload_complete
        from {{nation}} n
        left join (select s.s_nationkey, min(l.l_partkey) as attr_id from {{lineitem}} l
                   join {{supplier}} s on s.s_suppkey = l.l_suppkey group by s.s_nationkey) top
          on top.s_nationkey = n.n_nationkey""",
    "dataset_category": _numbered(DATASET_CATEGORIES, "category_id", "category_name"),
    "dataset": f"""
        select s_suppkey as dataset_id, cast(s_nationkey as bigint) as model_id,
               case when s_suppkey % 9 = 4 then concat('Model Data - NATION_', cast(s_suppkey % 25 as string), '.xml')
                    else s_name end as dataset_name,
               case when s_suppkey % 9 = 4 then 'model' when s_suppkey % 2 = 1 then 'user' else 'system' end as origin,
               {WHEN} as last_update, concat('Data of ', s_name) as description, {WHEN} as created,
               s_suppkey % 4 + 1 as category_id, cast(s_suppkey % 3 + 1 as int) as model_version,
               s_suppkey % 10 = 8 as deleted
        from {{supplier}}""",
    "user": """
        select c_custkey as user_id, c_name as login,
               cast(case when c_custkey % 17 = 0 then null else c_nationkey % 5 end as int) as sec_level,
               concat('corp-', c_name) as ad_name, c_mktsegment = 'BUILDING' as is_power_user,
               c_mktsegment = 'MACHINERY' as is_admin_user
        from {customer}""",
    "scenario": """
        select s_suppkey + 1000000 as scenario_id, cast(s_nationkey as bigint) as model_id,
               cast(floor(s_suppkey / 2) as bigint) as base_dataset_id, s_suppkey as view_dataset_id,
               case when s_suppkey % 6 = 1 then 'Shared case' else s_name end as scenario_name,
               s_suppkey % 50 as created_by, case when s_suppkey % 3 = 0 then s_suppkey % 20 end as editing_by,
               s_suppkey % 4 = 1 as is_public
        from {supplier} where s_suppkey % 2 = 1""",
    "value": """
        select l_suppkey as dataset_id, l_partkey as attr_id, max(l_extendedprice) as value,
               false as is_calc_redundant
        from {lineitem} group by l_suppkey, l_partkey""",
    "scenario_change": """
        select l_suppkey + 1000000 as scenario_id, l_partkey as attr_id, max(l_quantity) as new_value
        from {lineitem} where l_returnflag = 'R' and l_suppkey % 2 = 1 group by l_suppkey, l_partkey""",
    "grouping": """
        select cast(1 as bigint) as grouping_id, false as is_filter, 'Geo' as grouping_name
        union all
        select distinct 100 + try_cast(substring(p_brand, 7) as bigint),
               try_cast(substring(p_brand, 7) as bigint) % 2 = 0, p_brand from {part}""",
    "category": """
        select cast(1 + r_regionkey as bigint) as category_id, r_name as category_name,
               cast(null as bigint) as parent_category_id, cast(1 as bigint) as grouping_id from {region}
        union all
        select cast(100 + n_nationkey as bigint), n_name, cast(1 + n_regionkey as bigint), cast(1 as bigint)
        from {nation}
        union all
        select 10000 + s_suppkey, s_name, cast(100 + s_nationkey as bigint), cast(1 as bigint) from {supplier}
        union all
        select distinct 5000000000 + try_cast(substring(p_brand, 7) as bigint), p_brand, cast(null as bigint),
               100 + try_cast(substring(p_brand, 7) as bigint) from {part}""",
    "attribute_category": """
        select p_partkey as attr_id, cast(1 as bigint) as grouping_id, 10000 + p_partkey % 10 as category_id
        from {part}
        union all
        select p_partkey, 100 + try_cast(substring(p_brand, 7) as bigint),
               5000000000 + try_cast(substring(p_brand, 7) as bigint) from {part}""",
    "vdt_structure": """
        select cast(1 as bigint) as vdt_id, 'Driver tree' as name
        union all select cast(2 + r_regionkey as bigint), r_name from {region}""",
    "vdt_node": """
        select 2 * p_partkey + 1 as vdt_node_id, p_partkey as node_id, p_partkey as attribute_id, p_name as name,
               cast(1 as bigint) as vdt_structure_id, cast(null as string) as link
        from {part} where p_partkey % 3 <> 2
        union all
        select 2 * p_partkey + 2, p_partkey, p_partkey, concat(p_name, ' detail'), 2 + p_partkey % 5, 'detail'
        from {part} where p_partkey % 6 = 1""",
    "vdt_edge": """
        select 2 * p_partkey as vdt_edge_id, 2 * cast(floor(p_partkey / 2) as bigint) + 1 as parent_id,
               2 * p_partkey + 1 as child_id, cast(1 as bigint) as vdt_structure_id
        from {part} where p_partkey > 0
        union all
        select 2 * p_partkey + 1, 2 * cast(floor(p_partkey / 3) as bigint) + 1, 2 * p_partkey + 1, cast(1 as bigint)
        from {part} where p_partkey > 2 and p_partkey % 5 = 0
        union all
        select 5000000000 + p_partkey,
               2 * (30 * cast(floor(p_partkey / 60) as bigint) + p_partkey % 30) + 2, 2 * p_partkey + 2,
               2 + p_partkey % 5
        from {part} where p_partkey % 6 = 1 and p_partkey >= 30""",
    "attribute_dependency": """
        select p_partkey as attr_id, cast(floor(p_partkey / 2) as bigint) as depends_on_attr_id,
               p_partkey % 25 as model_id
        from {part} where p_partkey > 0""",
    "access_group": """
        select c_custkey as access_group_id, cast(c_nationkey as int) as security_level, c_mktsegment as ad_name,
               c_custkey % 5 as model_group_id
        from {customer} where c_custkey % 5 <> 4""",
    "super_user_group": """
        select c_custkey as super_user_group_id, c_mktsegment as ad_name, c_custkey % 5 as model_group_id
        from {customer} where c_acctbal > 5000""",
    "sensitivity": f"""
        select l_suppkey as sensitivity_id, l_suppkey as dataset_id, cast(0.1 as double) as percent_change,
               min(l_partkey) as target_attr_id, max(l_extendedprice) as target_base_value, {WHEN} as last_update
        from {{lineitem}} group by l_suppkey""",
    "sensitivity_value": """
        select l_suppkey as sensitivity_id, l_partkey as attr_id, max(l_discount) as impact_of_increase,
               min(l_tax) as impact_of_decrease
        from {lineitem} group by l_suppkey, l_partkey""",
    "attribution": f"""
        select s.view_dataset_id as attribution_id, s.view_dataset_id as base_dataset_id,
               s.base_dataset_id as benchmark_dataset_id, s.view_dataset_id % 4 = 3 as is_cumulative,
               n.target_attr_id, n.target_base_value, {WHEN} as last_update
        from {{scenario}} s join {{sensitivity}} n on n.dataset_id = s.view_dataset_id""",
    "attribution_value": """
        select l_suppkey as attribution_id, l_partkey as attr_id, min(l_linenumber) as seq_number,
               max(l_tax) as impact_on_target
        from {lineitem} where l_suppkey % 2 = 1 group by l_suppkey, l_partkey""",
    "audit_category": _numbered(AUDIT_CATEGORIES, "audit_category_id", "name"),
    "audit_entry": """
        select event_id as audit_id, ts as audit_date, event_id % 7 + 1 as category, event_id % 21 + 8 as sub_category,
               user_id
        from {events}""",
    "scenario_change_log": """
        select scenario_id, attr_id, user_id, ts as change_date, new_value as old_value,
               case when is_revert then null else new_value end as new_value
        from {change_feed}""",
    "external_attr": """
        select p_partkey % 25 as model_id, p_partkey as attr_id, concat(p_brand, '.', p_type) as object_path,
               p_partkey + 500000 as ext_attr_id, concat(p_name, ' ', cast(p_partkey as string)) as attr_name
        from {part}""",
    # ---- who asks for what --------------------------------------------------------------------------
    "viewer": "select s_suppkey as dataset_id, s_suppkey % 50 as user_id from {supplier}",
    "override_attr": "select distinct attr_id from {scenario_change}",
    "comparison": """
        select s_suppkey as dataset_id, s_suppkey + 1 as benchmark_id,
               case when s_suppkey % 2 = 0 then 1 else 2 + s_suppkey % 5 end as structure_id, s_suppkey % 50 as user_id
        from {supplier}""",
    "screen_request": """
        select r.r_name as screen, s.s_suppkey as dataset_id, s.s_suppkey % 50 as user_id
        from {supplier} s join {nation} n on n.n_nationkey = s.s_suppkey % 25
        join {region} r on r.r_regionkey = n.n_regionkey""",
    "pair_request": """
        select view_dataset_id as base_dataset_id, base_dataset_id as benchmark_dataset_id,
               view_dataset_id % 50 as user_id
        from {scenario}""",
    "copy_request": """
        select dataset_id as base_dataset_id, concat('Copy of ', dataset_name) as dataset_name,
               concat('Copied from ', dataset_name) as description, dataset_id % 50 as user_id, category_id,
               dataset_id % 2 = 0 as is_public, model_version
        from {dataset}""",
    "name_request": """
        select distinct name from (
            select dataset_name as name from {dataset} union all select scenario_name from {scenario}
            union all select c_name from {customer}) n""",
    "create_request": """
        select view_dataset_id as request_id, scenario_name as dataset_name,
               case when view_dataset_id % 3 = 0 then 'Shared case' else scenario_name end as scenario_name,
               created_by as user_id
        from {scenario}""",
    "group_name": "select distinct ad_name as item from {super_user_group}",
    "path_request": """
        select concat(object_path, '[', attr_name, ']') as path from {external_attr}
        union all select concat(object_path, '[]') from {external_attr}""",
    # ---- batches ------------------------------------------------------------------------------------
    "change_feed": """
        select event_id, ts, 2 * (user_id % 5) + 1000001 as scenario_id, event_id % 200 as attr_id,
               value as new_value, event_type = 'error' as is_revert, user_id
        from {events}""",
    "redundant_mark": """
        select scenario_id, attr_id from {scenario_change} where attr_id % 4 = 1""",
    "calculated": """
        select x.dataset_id, e.object_path, e.attr_name, max(x.quantity) as value
        from (select l_suppkey as dataset_id, l_partkey, l_quantity as quantity from {lineitem}
              where l_returnflag = 'A'
              union all
              select l_suppkey + 1, l_partkey, l_quantity from {lineitem} where l_returnflag = 'N') x
        join {supplier} s on s.s_suppkey = x.dataset_id
        join {external_attr} e on e.attr_id = x.l_partkey
        group by x.dataset_id, e.object_path, e.attr_name""",
    "dataset_patch": """
        select dataset_id, concat('Renamed ', dataset_name) as dataset_name,
               case when dataset_id % 2 = 0 then concat('Note ', dataset_name) end as description,
               dataset_id % 3 + 1 as category_id, dataset_id % 5 = 0 as is_public
        from {dataset} where category_id <> 2""",
    "doomed": "select dataset_id from {dataset} where origin = 'user'",
    "sensitivity_run": """
        select s.dataset_id as run_id, s.dataset_id, cast(0.2 as double) as percent_change,
               case when s.dataset_id % 7 = 6 then 'nowhere' else e.object_path end as target_path,
               e.attr_name as target_attr, s.target_base_value + 1 as target_base_value
        from (select dataset_id, target_base_value,
                     case when dataset_id % 3 = 0 then top_attr_id else target_attr_id end as target_attr_id
              from {sensitivity}
              join (select l_suppkey, max(l_partkey) as top_attr_id from {lineitem} group by l_suppkey) h
                on h.l_suppkey = dataset_id) s
        join {external_attr} e on e.attr_id = s.target_attr_id""",
    "sensitivity_row": """
        select l.l_suppkey as run_id, e.object_path, e.attr_name, max(l.l_tax) as impact_of_increase,
               min(l.l_discount) as impact_of_decrease
        from {lineitem} l join {external_attr} e on e.attr_id = l.l_partkey
        where l.l_returnflag = 'N' group by l.l_suppkey, e.object_path, e.attr_name""",
    "attribution_run": """
        select r.run_id, a.view_dataset_id as base_dataset_id, a.base_dataset_id as benchmark_dataset_id,
               a.view_dataset_id % 4 = 3 as is_cumulative, r.target_path, r.target_attr, r.target_base_value
        from {sensitivity_run} r join {scenario} a on a.view_dataset_id = r.run_id""",
    "attribution_row": """
        select l.l_suppkey as run_id, e.object_path, e.attr_name, max(l.l_linenumber) as seq_number,
               min(l.l_tax) as impact_on_target
        from {lineitem} l join {external_attr} e on e.attr_id = l.l_partkey
        where l.l_returnflag = 'N' and l.l_suppkey % 2 = 1 group by l.l_suppkey, e.object_path, e.attr_name""",
    "new_structure": """
        select r_name as name from {region} union all select concat('Plan ', r_name) from {region}""",
    "new_node": """
        select case when p.p_partkey % 2 = 0 then r.r_name else concat('Plan ', r.r_name) end as structure_name,
               p.p_partkey as node_id, p.p_partkey as attribute_id, p.p_name as name, cast(null as string) as link
        from {part} p join {region} r on r.r_regionkey = p.p_partkey % 5""",
    "new_edge": """
        select structure_name, node_id - 10 as parent_id, node_id as child_id from {new_node} where node_id >= 10""",
    "model_row": """
        select p_partkey % 25 as model_id,
               case when p_partkey % 7 = 3 then p_partkey + 700000 else p_partkey + 500000 end as ext_attr_id,
               concat(p_brand, '.', p_type) as object_path,
               concat(p_name, case when p_partkey % 7 = 3 then ' new ' else ' ' end, cast(p_partkey as string))
                 as attr_name,
               p_retailprice as value,
               concat(case when p_partkey % 2 = 1 then 'C' else 'X' end,
                      case when p_partkey % 3 = 1 then 'L' when p_partkey % 3 = 2 then 'C' else 'X' end,
                      case when p_partkey % 5 = 1 then 'A' else 'X' end,
                      case when p_partkey % 7 = 1 then 'K' else 'X' end) as type,
               case when p_partkey % 4 <> 0 then p_type end as display_unit,
               case when p_partkey % 9 <> 0 then cast(p_size % 5 as int) end as sec_level
        from {part}""",
    "category_row": """
        select cast(s.s_nationkey as bigint) as model_id, s.s_suppkey as ext_category_id, 'Geo' as grouping_name,
               case when s.s_suppkey % 11 = 10 then ''
                    when s.s_suppkey % 2 = 1
                    then concat(r.r_name, '~~', n.n_name, '~~Area ', cast(s.s_suppkey % 3 as string), '~~', s.s_name)
                    when s.s_suppkey % 5 = 0 then concat(r.r_name, '~~', n.n_name, '~~', s.s_name, '~~')
                    else concat(r.r_name, '~~', n.n_name, '~~', s.s_name) end as category_path
        from {supplier} s join {nation} n on n.n_nationkey = s.s_nationkey
        join {region} r on r.r_regionkey = n.n_regionkey
        union all
        select p_partkey % 25, p_partkey + 2000000, concat('Type ', p_type),
               concat(p_brand, '~~', p_name, ' with a name well beyond thirty characters') from {part}""",
    "category_link": """
        select p_partkey % 25 as model_id,
               case when p_partkey % 7 = 3 then p_partkey + 700000 else p_partkey + 500000 end as ext_attr_id,
               p_partkey + 2000000 as ext_category_id
        from {part}""",
    "dependency_row": """
        select p_partkey % 25 as model_id,
               case when p_partkey % 7 = 3 then p_partkey + 700000 else p_partkey + 500000 end as ext_attr_id,
               case when p_partkey % 10 = 0 and p_partkey % 7 <> 3 then p_partkey + 500000
                    when (p_partkey - 25) % 7 = 3 then p_partkey + 699975 else p_partkey + 499975 end
                 as depends_on_ext_attr_id
        from {part} where p_partkey >= 25""",
    "model_import": """
        select cast(n_nationkey as bigint) as model_id,
               case when n_nationkey = 5 then '_trial.xml' else concat(n_name, '.xml') end as filename,
               cast(case when n_nationkey % 7 = 3 then n_nationkey + 700000 else n_nationkey + 500000 end as bigint)
                 as top_ext_attr_id
        from {nation}""",
    "registration": """
        select cast(n_nationkey as bigint) as request_id, concat('Group ', n_name) as model_group_name,
               cast(n_nationkey % 3 + 1 as int) as instances, concat('id-', cast(n_nationkey as string)) as identifier,
               concat(n_name, '_v1.xml') as filename, cast(1 as int) as version,
               cast(case when n_nationkey % 2 = 1 then n_nationkey + 1000 end as bigint) as model_id
        from {nation}""",
    "registration_access": """
        select cast(c_nationkey as bigint) as request_id, cast(c_nationkey % 3 as int) as security_level,
               c_name as ad_name
        from {customer}""",
    "registration_super": """
        select cast(c_nationkey as bigint) as request_id, c_name as ad_name from {customer} where c_acctbal > 5000""",
    "version_update": """
        select model_id, concat(filename, '_new') as filename, cast(version + 1 as int) as version from {model}""",
    "group_version_update": """
        select model_group_id, concat(name, '_up') as filename, cast(9 as int) as version from {model_group}""",
    "access_batch": """
        select c_custkey as access_group_id, cast(c_nationkey + 1 as int) as security_level, c_mktsegment as ad_name,
               c_custkey % 5 as model_group_id
        from {customer} where c_custkey % 3 = 0
        union all
        select c_custkey + 1000000000, cast(c_nationkey as int), concat(c_mktsegment, ' new'), c_custkey % 5
        from {customer} where c_custkey % 50 = 1""",
    "super_batch": """
        select super_user_group_id, concat(ad_name, ' renamed') as ad_name, model_group_id
        from {super_user_group} where super_user_group_id % 2 = 0
        union all
        select c_custkey + 1000000000, c_name, c_custkey % 5 from {customer} where c_custkey % 40 = 7""",
    "scope": "select model_group_id from {model_group} where instances <> 2",
    "user_batch": """
        select case when c_custkey % 10 = 1 then c_custkey + 1000000000 else c_custkey end as user_id,
               case when c_custkey % 10 = 1 then concat('new ', c_name) else 'ignored' end as login,
               cast(c_nationkey % 3 as int) as sec_level, concat('ad-', c_name) as ad_name,
               c_custkey % 2 = 0 as is_power_user, c_custkey % 3 = 0 as is_admin_user
        from {customer} where c_acctbal > 0""",
}


def needs(sql: str) -> list[str]:
    """Names a SQL text stands on."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def standalone_sql(sql: str) -> str:
    """The text with every sample entry it needs put in front as a common table expression."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in needs(text):
            if name not in RAW and name not in order:
                visit(SAMPLE[name])
                order.append(name)

    visit(sql)
    body = re.sub(r"^\s*with\s+(recursive\s+)?", "", sql, flags=re.IGNORECASE)
    own_ctes = body != sql
    parts = [f"s_{name} as ({SAMPLE[name]})" for name in order]
    if own_ctes:
        text = ("with recursive " + ",\n".join([*parts, body])) if parts else sql
    else:
        text = f"with recursive {', '.join(parts)}\n{body}" if parts else body
    text = re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in RAW else f"s_{m[1]}", text)
    return text.replace("timestamp_ntz", "timestamp")


class SampleTables(Tables):
    """Sample tables made on first use from the Parquet files in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__["_frames"]
        if name not in frames:
            spark = self._spark
            if name in RAW:
                frames[name] = spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in SAMPLE:
                sql = SAMPLE[name]
                frames[name] = spark.sql(sql, **{other: getattr(self, other) for other in needs(sql)})
            else:
                raise AttributeError(f"no table {name!r}")
        return frames[name]

    def replace(self, **frames: DataFrame) -> Tables:
        copy = SampleTables(self._spark, self.sf_dir)
        copy._frames.update({**self._frames, **frames})
        return copy
