"""Declared tables: columns, keys, references, defaults, batch inputs and seed rows."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "grouping": "grouping_id bigint not null, is_filter boolean not null, grouping_name string not null",
    "category": "category_id bigint not null, category_name string not null, "
    "parent_category_id bigint, grouping_id bigint not null",
    "attribute_category": "attr_id bigint not null, grouping_id bigint not null, category_id bigint not null",
    "user": "user_id bigint not null, login string not null, sec_level int, ad_name string, "
    "is_power_user boolean not null, is_admin_user boolean not null",
    "model_group": "model_group_id bigint not null, name string not null, is_offline boolean not null, "
    "identifier string not null, instances int not null",
    "access_group": "access_group_id bigint not null, security_level int not null, ad_name string not null, "
    "model_group_id bigint not null",
    "super_user_group": "super_user_group_id bigint not null, ad_name string not null, model_group_id bigint not null",
    "model": "model_id bigint not null, filename string not null, file_date timestamp_ntz not null, "
    "is_active boolean not null, version int not null, model_group_id bigint not null, last_rollback int, "
    "rollback_filename string, rollback_file_date timestamp_ntz, top_of_tree_attr_id bigint, "
    "upload_complete boolean not null",
    "attribute": "attr_id bigint not null, attr_name string not null, unit string not null, sec_level int not null, "
    "is_cost boolean not null, is_lever boolean not null, is_calculated boolean not null, "
    "is_aggregate boolean not null, is_non_driver boolean not null, is_kpi boolean not null",
    "unit_format": "unit string not null, format string not null",
    "dataset_category": "category_id bigint not null, category_name string not null",
    "dataset": "dataset_id bigint not null, model_id bigint not null, dataset_name string not null, "
    "origin string not null, last_update timestamp_ntz not null, description string, created timestamp_ntz not null, "
    "category_id bigint not null, model_version int not null, deleted boolean not null",
    "scenario": "scenario_id bigint not null, model_id bigint not null, base_dataset_id bigint not null, "
    "view_dataset_id bigint not null, scenario_name string not null, created_by bigint not null, "
    "editing_by bigint, is_public boolean not null",
    "scenario_change": "scenario_id bigint not null, attr_id bigint not null, new_value double not null",
    "scenario_change_log": "scenario_id bigint not null, attr_id bigint not null, user_id bigint not null, "
    "change_date timestamp_ntz not null, old_value double not null, new_value double",
    "value": "dataset_id bigint not null, attr_id bigint not null, value double not null, "
    "is_calc_redundant boolean not null",
    "sensitivity": "sensitivity_id bigint not null, dataset_id bigint not null, percent_change double not null, "
    "target_attr_id bigint not null, target_base_value double not null, last_update timestamp_ntz not null",
    "sensitivity_value": "sensitivity_id bigint not null, attr_id bigint not null, "
    "impact_of_increase double not null, impact_of_decrease double not null",
    "attribution": "attribution_id bigint not null, base_dataset_id bigint not null, "
    "benchmark_dataset_id bigint not null, is_cumulative boolean not null, target_attr_id bigint not null, "
    "target_base_value double not null, last_update timestamp_ntz not null",
    "attribution_value": "attribution_id bigint not null, attr_id bigint not null, seq_number int, "
    "impact_on_target double not null",
    "audit_category": "audit_category_id bigint not null, name string not null",
    "audit_entry": "audit_id bigint not null, audit_date timestamp_ntz not null, category bigint not null, "
    "sub_category bigint, user_id bigint not null",
    "attribute_dependency": "attr_id bigint not null, depends_on_attr_id bigint not null, model_id bigint not null",
    "vdt_structure": "vdt_id bigint not null, name string not null",
    "vdt_node": "vdt_node_id bigint not null, node_id bigint not null, attribute_id bigint not null, "
    "name string not null, vdt_structure_id bigint not null, link string",
    "vdt_edge": "vdt_edge_id bigint not null, parent_id bigint not null, child_id bigint not null, "
    "vdt_structure_id bigint not null",
    "external_attr": "model_id bigint not null, attr_id bigint not null, object_path string not null, "
    "ext_attr_id bigint, attr_name string not null",
}

KEYS: dict[str, tuple[str, ...]] = {
    "grouping": ("grouping_id",),
    "category": ("category_id",),
    "attribute_category": ("attr_id", "grouping_id"),
    "user": ("user_id",),
    "model_group": ("model_group_id",),
    "access_group": ("access_group_id",),
    "super_user_group": ("super_user_group_id",),
    "model": ("model_id",),
    "attribute": ("attr_id",),
    "unit_format": ("unit",),
    "dataset_category": ("category_id",),
    "dataset": ("dataset_id",),
    "scenario": ("scenario_id",),
    "scenario_change": ("scenario_id", "attr_id"),
    "value": ("dataset_id", "attr_id"),
    "sensitivity": ("sensitivity_id",),
    "sensitivity_value": ("sensitivity_id", "attr_id"),
    "attribution": ("attribution_id",),
    "attribution_value": ("attribution_id", "attr_id"),
    "audit_category": ("audit_category_id",),
    "audit_entry": ("audit_id",),
    "attribute_dependency": ("attr_id", "depends_on_attr_id", "model_id"),
    "vdt_structure": ("vdt_id",),
    "vdt_node": ("vdt_node_id",),
    "vdt_edge": ("vdt_edge_id",),
}

# Unique columns besides the key. The last one is not enforced by the data model (two scenarios may share a
# view dataset) but it makes overlay rows fan out, so it is reported too.
UNIQUE: list[tuple[str, str]] = [("user", "login"), ("user", "ad_name"), ("scenario", "view_dataset_id")]

# (table, column, referenced table, referenced column)
REFERENCES: list[tuple[str, str, str, str]] = [
    ("category", "parent_category_id", "category", "category_id"),
    ("category", "grouping_id", "grouping", "grouping_id"),
    ("attribute_category", "category_id", "category", "category_id"),
    ("access_group", "model_group_id", "model_group", "model_group_id"),
    ("super_user_group", "model_group_id", "model_group", "model_group_id"),
    ("model", "model_group_id", "model_group", "model_group_id"),
    ("dataset", "model_id", "model", "model_id"),
    ("dataset", "category_id", "dataset_category", "category_id"),
    ("scenario", "model_id", "model", "model_id"),
    ("scenario", "base_dataset_id", "dataset", "dataset_id"),
    ("scenario", "view_dataset_id", "dataset", "dataset_id"),
    ("scenario", "created_by", "user", "user_id"),
    ("scenario", "editing_by", "user", "user_id"),
    ("scenario_change", "scenario_id", "scenario", "scenario_id"),
    ("scenario_change", "attr_id", "attribute", "attr_id"),
    ("scenario_change_log", "scenario_id", "scenario", "scenario_id"),
    ("scenario_change_log", "attr_id", "attribute", "attr_id"),
    ("scenario_change_log", "user_id", "user", "user_id"),
    ("value", "dataset_id", "dataset", "dataset_id"),
    ("value", "attr_id", "attribute", "attr_id"),
    ("sensitivity", "dataset_id", "dataset", "dataset_id"),
    ("sensitivity", "target_attr_id", "attribute", "attr_id"),
    ("sensitivity_value", "sensitivity_id", "sensitivity", "sensitivity_id"),
    ("sensitivity_value", "attr_id", "attribute", "attr_id"),
    ("attribution", "base_dataset_id", "dataset", "dataset_id"),
    ("attribution", "benchmark_dataset_id", "dataset", "dataset_id"),
    ("attribution", "target_attr_id", "attribute", "attr_id"),
    ("attribution_value", "attribution_id", "attribution", "attribution_id"),
    ("attribution_value", "attr_id", "attribute", "attr_id"),
    ("audit_entry", "category", "audit_category", "audit_category_id"),
    ("audit_entry", "sub_category", "audit_category", "audit_category_id"),
    ("attribute_dependency", "attr_id", "attribute", "attr_id"),
    ("attribute_dependency", "depends_on_attr_id", "attribute", "attr_id"),
    ("attribute_dependency", "model_id", "model", "model_id"),
    ("vdt_node", "attribute_id", "attribute", "attr_id"),
    ("vdt_node", "vdt_structure_id", "vdt_structure", "vdt_id"),
    ("vdt_edge", "parent_id", "vdt_node", "vdt_node_id"),
    ("vdt_edge", "child_id", "vdt_node", "vdt_node_id"),
    ("vdt_edge", "vdt_structure_id", "vdt_structure", "vdt_id"),
    ("external_attr", "model_id", "model", "model_id"),
    ("external_attr", "attr_id", "attribute", "attr_id"),
]

# Values a write fills in when the column is not given.
DEFAULTS: dict[str, dict[str, object]] = {
    "model": {"upload_complete": False},
    "attribute": {"is_non_driver": False},
    "unit_format": {"format": "{0:4a}"},
    "dataset": {"model_version": 1, "deleted": False},
    "value": {"is_calc_redundant": False},
    "sensitivity": {"percent_change": 0.1},
}

# Columns a batch must bring, by batch input.
BATCHES: dict[str, str] = {
    "calculated": "dataset_id bigint not null, object_path string not null, attr_name string not null, "
    "value double not null",
    "model_rows": "model_id bigint not null, ext_attr_id bigint, object_path string not null, "
    "attr_name string not null, value double not null, type string not null, display_unit string, sec_level int",
    "categories": "model_id bigint not null, ext_category_id bigint, grouping_name string, category_path string",
    "attribute_categories": "model_id bigint not null, ext_attr_id bigint, ext_category_id bigint",
    "dependencies": "model_id bigint not null, ext_attr_id bigint, depends_on_ext_attr_id bigint",
    "imports": "model_id bigint not null, filename string not null, top_ext_attr_id bigint",
    "sensitivity_runs": "run_id bigint not null, dataset_id bigint not null, percent_change double not null, "
    "target_path string not null, target_attr string not null, target_base_value double not null",
    "sensitivity_rows": "run_id bigint not null, object_path string not null, attr_name string not null, "
    "impact_of_increase double not null, impact_of_decrease double not null",
    "attribution_runs": "run_id bigint not null, base_dataset_id bigint not null, "
    "benchmark_dataset_id bigint not null, is_cumulative boolean not null, target_path string not null, "
    "target_attr string not null, target_base_value double not null",
    "attribution_rows": "run_id bigint not null, object_path string not null, attr_name string not null, "
    "seq_number int not null, impact_on_target double not null",
    "structures": "name string not null",
    "structure_nodes": "structure_name string not null, node_id bigint not null, attribute_id bigint not null, "
    "name string not null, link string",
    "structure_edges": "structure_name string not null, parent_id bigint not null, child_id bigint not null",
    "scenario_changes": "scenario_id bigint, attr_id bigint, new_value double, is_revert boolean",
    "text_filter": "item string",
    "id_filter": "id bigint not null",
    "path_filter": "path string",
    "access_groups": "access_group_id bigint not null, security_level int not null, ad_name string not null, "
    "model_group_id bigint not null",
    "super_user_groups": "super_user_group_id bigint not null, ad_name string not null, "
    "model_group_id bigint not null",
}

# Activity names of the audit log, numbered from 1.
AUDIT_CATEGORIES = [
    "Scenario Management", "Scenario Planning", "Sensitivity Analysis", "Size of Prize Analysis", "System View",
    "Value Driver Tree", "View", "Calculate", "Copy", "Edit", "Delete", "Save as", "Toggle lock", "Load",
    "Import data", "Export to excel", "Login", "Custom Account", "Windows Authentication", "Watch Window",
    "Add Attribute(s)", "Remove Attribute(s)", "Admin Console", "Create Model", "Upload Model", "Update Model",
    "Rollback Model", "Test Connection",
]

# Display format of each unit.
UNIT_FORMATS = {
    "#": "{0:3s}", "$": "{0:2f}", "$/day": "{0:2f}", "$/hr": "{0:4s}", "$/kg": "{0:4s}", "$/L": "{0:4f}",
    "$/m": "{0:4s}", "$/t": "{0:4s}", "%": "{0:3%}", "$M": "{0:4,1000000s}", "A$M": "{0:4,1000000s}",
    "bcm/m": "{0:4s}", "day": "{0:2s}", "hr": "{0:3s}", "kg/t": "{0:3s}", "L": "{0:3s}", "L/hr": "{0:4s}",
    "m": "{0:3s}", "m/hr": "{0:4s}", "m3/bcm": "{0:4s}", "Mt": "{0:4,1000000s}", "Mtpa": "{0:4,1000000s}",
    "t": "{0:2s}", "t/day": "{0:4s}", "t/hr": "{0:4s}", "t:t": "{0:4s}", "$/$": "{0:4s}", "$/service": "{0:4s}",
    "A$M/t": "{0:4s}", "cycles/service": "{0:4s}", "km/cycle": "{0:4s}", "km/t": "{0:4s}", "MWh/service": "{0:4s}",
    "MWh/t": "{0:4s}", "t/m": "{0:4s}",
}

# Kinds of dataset, numbered from 1.
DATASET_CATEGORIES = ["Actuals", "Target", "Scenario", "Benchmark"]
