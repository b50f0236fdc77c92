"""Driver-tree queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.operators import graph as op
from leverwise.operators.overlay import overridden_calculated

IMPORT_SQL = """fresh_structures as (
    select name, (select max(vdt_id) from {vdt_structure}) + row_number() over (order by name) as vdt_id
    from {new_structure} where name not in (select name from {vdt_structure})),
  structures as (select vdt_id, name from {vdt_structure} union all select vdt_id, name from fresh_structures),
  targets as (
    select s.vdt_id, s.name from structures s where s.name in (select name from {new_structure})),
  nodes as (
    select (select max(vdt_node_id) from {vdt_node})
             + row_number() over (order by x.vdt_id, n.node_id, n.attribute_id, n.name) as vdt_node_id,
           n.node_id, n.attribute_id, n.name, x.vdt_id as vdt_structure_id, n.link
    from {new_node} n join targets x on x.name = n.structure_name),
  links as (
    select x.vdt_id as vdt_structure_id, p.vdt_node_id as parent_id, c.vdt_node_id as child_id
    from {new_edge} e join targets x on x.name = e.structure_name
    join nodes p on p.vdt_structure_id = x.vdt_id and p.node_id = e.parent_id
    join nodes c on c.vdt_structure_id = x.vdt_id and c.node_id = e.child_id),
  edges as (
    select (select max(vdt_edge_id) from {vdt_edge})
             + row_number() over (order by vdt_structure_id, parent_id, child_id) as vdt_edge_id,
           parent_id, child_id, vdt_structure_id
    from links)"""


def _import(t) -> op.StructureTables:
    return op.import_structure(t, t.new_structure, t.new_node, t.new_edge)


def _descendants(t) -> DataFrame:
    return op.descendants(t, overridden_calculated(t, t.scenario.select("scenario_id")))


QUERIES = {
    "tree_edges": (
        lambda t: op.tree_edges(t, t.vdt_structure.select(F.col("vdt_id").alias("vdt_structure_id"))),
        "select vdt_structure_id, parent_id, child_id from {vdt_edge}",
    ),
    "tree_structures": (lambda t: op.tree_structures(t), "select vdt_id, name from {vdt_structure}"),
    "import_structure_nodes": (
        lambda t: _import(t).vdt_node,
        f"""with {IMPORT_SQL}
        select vdt_node_id, node_id, attribute_id, name, vdt_structure_id, link from {{vdt_node}}
        where vdt_structure_id not in (select vdt_id from targets)
        union all select vdt_node_id, node_id, attribute_id, name, vdt_structure_id, link from nodes""",
    ),
    "import_structure": (
        lambda t: _import(t).vdt_edge,
        f"""with {IMPORT_SQL}
        select vdt_edge_id, parent_id, child_id, vdt_structure_id from {{vdt_edge}}
        where vdt_structure_id not in (select vdt_id from targets)
        union all select vdt_edge_id, parent_id, child_id, vdt_structure_id from edges""",
    ),
    "descendants": (
        _descendants,
        """with asked as (
            select c.attr_id, c.scenario_id, n.vdt_node_id as root, s.view_dataset_id
            from {scenario_change} c join {attribute} a on a.attr_id = c.attr_id and a.is_calculated
            join {scenario} s on s.scenario_id = c.scenario_id
            join {vdt_node} n on n.attribute_id = c.attr_id),
        below as (
            select distinct root, root as node from asked
            union
            select b.root, e.child_id from below b join {vdt_edge} e on e.parent_id = b.node)
        select distinct q.attr_id, q.scenario_id, n.vdt_node_id, e.child_id, e.parent_id, n.attribute_id, n.name,
               n.vdt_structure_id, v.is_calc_redundant
        from asked q join below b on b.root = q.root
        join {vdt_edge} e on e.parent_id = b.node
        join {vdt_node} n on n.vdt_node_id = e.child_id
        join {attribute} a on a.attr_id = n.attribute_id
        join {value} v on v.attr_id = a.attr_id and v.dataset_id = q.view_dataset_id""",
    ),
    "attribute_dependencies": (
        lambda t: op.dependencies(t, t.model.select("model_id")),
        """
        select d.model_id, d.attr_id, d.depends_on_attr_id from {attribute_dependency} d
        join {attribute} a on a.attr_id = d.depends_on_attr_id
        where d.model_id in (select model_id from {model})""",
    ),
    "replace_dependencies": (
        lambda t: op.replace_dependencies(t, t.model_row, t.dependency_row),
        """with imported as (
            select e.attr_id from {model_row} r join {external_attr} e
              on e.model_id = r.model_id and e.object_path = r.object_path and e.attr_name = r.attr_name)
        select attr_id, depends_on_attr_id, model_id from {attribute_dependency}
        where attr_id not in (select attr_id from imported)
        union all
        select x.attr_id, y.attr_id, d.model_id from {dependency_row} d
        join {external_attr} x on x.model_id = d.model_id and x.ext_attr_id = d.ext_attr_id
        join {external_attr} y on y.model_id = d.model_id and y.ext_attr_id = d.depends_on_ext_attr_id
        where x.attr_id <> y.attr_id""",
    ),
}
