"""Queries over versioned tables: the files they open are those of the asked groups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from leverwise.operators import overlay as op
from leverwise.plans.model_import import CHANGED, import_model, write_import
from leverwise.plans.registered import ingest, overlay
from leverwise.plans.registered.common import held_inputs, now
from leverwise.session import shared_dir
from leverwise.sources.versions import Slice, Store, create_store


def stored(t, *names: str) -> Store:
    """Tables as the first version of a new store in the shared folder."""
    spark = t.value.sparkSession
    return create_store({name: getattr(t, name) for name in names}, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _cut(t, datasets: DataFrame):
    """The tables with values and overrides read from a store, as far as questions about the datasets need them."""
    cut = stored(t, "scenario", "value", "scenario_change").for_datasets(datasets)
    return t.replace(value=cut.value, scenario_change=cut.scenario_change)


def _compared(t) -> DataFrame:
    asked = t.comparison.select("dataset_id").union(t.comparison.select("benchmark_id"))
    return op.compare_datasets(_cut(t, asked), t.comparison)


def _chosen(t) -> DataFrame:
    return op.values_for(_cut(t, t.viewer.select("dataset_id")), t.viewer, t.override_attr)


def _merged(t) -> DataFrame:
    """Calculated results merged in as a new version that rewrites only the touched buckets."""
    t = held_inputs(t, "calculated")
    store = stored(t, "value", "dataset")
    touched = t.calculated.select("dataset_id").distinct()
    held = t.replace(value=store.read("value", touched), dataset=store.read("dataset"))
    merged = op.merge_calculated(held, t.calculated, now())
    store = store.write({"value": Slice(merged.value, merged.touched), **store.changed({"dataset": merged.dataset})})
    return store.read("value").join(store.read("dataset").select("dataset_id", "last_update"), "dataset_id")


def _imported(t) -> DataFrame:
    """A model import written as the next version, and its values read back from there."""
    store = stored(t, *CHANGED)
    done = import_model(t.replace(**{name: store.read(name) for name in CHANGED}), ingest.batch(t), now())
    after = write_import(done, store)
    rows = after.read("value", done.touched)
    return (
        rows.join(after.read("dataset").select("dataset_id", "dataset_name", "model_id"), "dataset_id")
        .join(after.read("attribute").select("attr_id", "attr_name", "unit"), "attr_id")
        .select("dataset_id", "dataset_name", "model_id", "attr_id", "attr_name", "unit", "value")
    )


QUERIES = {
    "compare_datasets_stored": (_compared, overlay.QUERIES["compare_datasets"][1]),
    "values_for_attributes_stored": (_chosen, overlay.QUERIES["values_for_attributes"][1]),
    "merge_calculated_versions": (_merged, overlay.MERGED_SQL),
    "import_model_stored": (_imported, ingest.QUERIES["import_model"][1]),
}
