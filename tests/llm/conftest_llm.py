"""Reading the tables without Spark."""

from __future__ import annotations

import pyarrow.parquet as pq


def documents(folder: str) -> list[tuple[int | None, str | None]]:
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def key_of(row: dict, columns: list[str]) -> tuple:
    return tuple(row[c] for c in columns)
