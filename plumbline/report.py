"""Reports of small results: Markdown, and bundles of JSON, Markdown and CSV that are never overwritten."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from .sources.io import new_csv

MAX_ROWS = 1000


def rows_of(df: DataFrame, most: int = MAX_ROWS) -> list[dict]:
    """Rows of a report; a table with more than `most` isn't one."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def cell(x: object) -> str:
    if x is None:
        return "—"
    if isinstance(x, float):
        return f"{x:.6g}"
    text = " ".join(str(x).split()).replace("\\", "\\\\").replace("|", "\\|")
    return text if len(text) <= 240 else text[:239] + "…"


def markdown(title: str, rows: list[dict]) -> str:
    if not rows:
        return f"## {title}\n\nNo rows.\n"
    names = list(rows[0])
    lines = [f"| {' | '.join(cell(r[n]) for n in names)} |" for r in rows]
    return "\n".join([f"## {title}", "", f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *lines, ""])


def write_bundle(folder: str, tables: dict[str, DataFrame]) -> None:
    """report.json, report.md and a CSV folder for each table, in a folder that must not exist."""
    top = Path(folder)
    top.mkdir(parents=True)
    data = {name: rows_of(df) for name, df in tables.items()}
    (top / "report.json").write_text(json.dumps(data, ensure_ascii=False, indent=2, default=str) + "\n")
    (top / "report.md").write_text("\n".join(markdown(name, rows) for name, rows in data.items()))
    for name, df in tables.items():
        flat = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
        new_csv(df.select(*flat).coalesce(1), f"file://{top.resolve()}/{name}")  # at most MAX_ROWS rows
