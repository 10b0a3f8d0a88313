"""Registries on disk: trigger lists as JSON, module files by name."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators.triggers import Registry


def read_triggers(spark: SparkSession, path: str) -> DataFrame:
    """Triggers of a JSON array of {event, pattern, module, func}, numbered
    anew in file order."""
    rows = spark.read.schema("event string, pattern string, module string, func string").option("multiLine", "true").json(path)
    rows = rows.withColumn("ord", (F.monotonically_increasing_id() + 1).cast("int"))  # one file, one partition
    return rows.select(F.concat(F.lit("trigger_"), "ord").alias("id"), "ord", F.upper("event").alias("event"), "pattern", "module", "func")


def save(registry: Registry, folder: str, sources: dict[str, str]) -> None:
    """Module sources as ``<name>.py`` and the triggers."""
    os.makedirs(folder, exist_ok=True)
    for name, text in sources.items():
        with open(os.path.join(folder, f"{name}.py"), "w", encoding="utf-8") as f:
            f.write(text)
    rows = [dict(zip(("event", "pattern", "module", "func"), t[2:])) for t in registry.triggers]
    tmp = os.path.join(folder, ".triggers.json")
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(rows, f)
    os.replace(tmp, os.path.join(folder, "triggers.json"))


def restore(folder: str) -> Registry:
    """Modules first, then triggers; a module that can't be loaded is left out."""
    out = Registry()
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if name.endswith(".py"):
            try:
                out.load_file(name[:-3], os.path.join(folder, name), folder)
            except Exception as e:  # noqa: BLE001  one bad module doesn't stop the others
                import logging

                logging.getLogger(__name__).error("module %s: %s", name, e)
    path = os.path.join(folder, "triggers.json")
    if os.path.exists(path):
        for t in json.load(open(path, encoding="utf-8")):
            out.add_trigger(t["event"], t["pattern"], t["module"], t["func"])
    return out
