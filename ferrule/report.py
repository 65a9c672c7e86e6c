"""Reports of key-value pairs as text, JSON or CSV, and the dashboard."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators.stats import flame_shares


def pairs(row: DataFrame) -> DataFrame:
    """A one-row DataFrame as rows (key, value)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in row.columns])).alias("p")).select("p.*")


def render(title: str, values: dict, form: str = "text", quiet: bool = False) -> str:
    """text unless json or csv is asked for; quiet silences text only."""
    if form.lower() == "json":
        return json.dumps(values, indent=2, default=str)
    if form.lower() == "csv":
        quoted = lambda x: '"' + str(x).replace('"', '""') + '"'
        return "\n".join(['"Key","Value"', *[f'"{k}",{quoted(v)}' for k, v in values.items()]])
    return "" if quiet else "\n".join([title, *[f"{k:<25} : {v}" for k, v in values.items()]])


def write_csv(row: DataFrame, path: str) -> None:
    pairs(row).withColumnsRenamed({"key": "Key", "value": "Value"}).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def _flame_parts(stacks: DataFrame, title: str):
    line = '<div style="width:{:.2f}%" title="{:.2f}%">{} ({})</div>'
    yield f"<html><head><title>{html.escape(title)}</title></head><body>"
    for b in flame_shares(stacks).orderBy(F.desc("count"), "stack").toLocalIterator():
        yield line.format(b.width, b.percent, html.escape(b.stack), b["count"])
    yield "</body></html>"


def flame_html(stacks: DataFrame, title: str = "Flame graph") -> str:
    """A page with one bar a stack, widest first."""
    return "".join(_flame_parts(stacks, title))


def write_flame(stacks: DataFrame, path: str, title: str = "Flame graph") -> None:
    """The page of flame_html as a file of the driver's; folders that are missing are made, and a task's bars are held at a time."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(_flame_parts(stacks, title))


def dashboard(jit: dict | None, gc: dict | None, cached: int, loaders: int = 0) -> str:
    out = ["[ MEMORY ]", f"  Active loaders       : {loaders}", "[ JIT COMPILATION ]"]
    out += [f"  {k:<20} : {v}" for k, v in jit.items()] if jit else ["  (inactive)"]
    out += ["[ GC & SAFEPOINTS ]", *([f"  {k:<20} : {v}" for k, v in gc.items()] if gc else ["  (inactive)"])]
    return "\n".join([*out, "[ RULE CACHE ]", f"  Cached rules         : {cached}"])
