"""License scans on a table that holds whole licenses, in Spark and in SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from setwise.llm import licenses

#: Where some systems keep the long texts.
FOLDER = Path("/usr/share/common-licenses")
FILES = {
    "Apache-2.0": "Apache-2.0",
    "Artistic-1.0-Perl": "Artistic",
    "CC0-1.0": "CC0-1.0",
    "GFDL-1.2": "GFDL-1.2",
    "GFDL-1.3": "GFDL-1.3",
    "GPL-1.0": "GPL-1",
    "GPL-2.0": "GPL-2",
    "GPL-3.0": "GPL-3",
    "LGPL-2.0": "LGPL-2",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3.0": "LGPL-3",
    "MPL-1.1": "MPL-1.1",
    "MPL-2.0": "MPL-2.0",
}


def texts() -> dict[str, tuple[str | None, str | None]]:
    """name: (license, text)"""
    out = {}
    for k, body in licenses.LICENSES.items():
        out[k] = (k, body)
        out[k + " shouted"] = (k, f"Copyright (c) 2020 Some One\nCopyright 2021, Others. All rights reserved.\n\n{body.upper()}\n")
        out[k + " titled"] = (k, f"{licenses.TITLES[k][-1]}\n\n(c) 1999 X\n" + body.replace(" ", "\n * "))
        out[k + " more"] = (None, body + " And more.")
    one = licenses.LICENSES["MIT"].replace("\n", " ")
    out["one line"] = ("MIT", "Copyright (c) 2020 Some One. All rights reserved. " + one)
    out["one line, no rights"] = ("MIT", "Copyright 2020 Some One " + one)
    out["British"] = ("BSL-1.0", licenses.LICENSES["BSL-1.0"].replace("license", "licence").replace("organization", "organisation"))
    for k, f in FILES.items():
        if (FOLDER / f).exists():
            out[k] = (k, (FOLDER / f).read_text())
    return out | {"null": (None, None), "empty": (None, ""), "long": (None, "license " * 200_000)}


@pytest.fixture(scope="module")
def found(spark):  # noqa: ANN001, ANN201
    docs = spark.createDataFrame([(k, t, 1, "x") for k, (_, t) in enumerate(texts().values())], "doc_id long, text string, digest int, license string")
    return {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}


def test_whole_texts(found) -> None:
    for k, (name, (want, _)) in enumerate(texts().items()):
        assert found[k]["license"] == want, name


def test_as_the_sql(found) -> None:
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, (_, t) in enumerate(texts().values())])
    columns = ["doc_id", "digest", "license", "notices", "n_notices"]
    got = con.execute(licenses.SQL).to_arrow_table().to_pylist()
    assert sorted(tuple(map(str, (r[c] for c in columns))) for r in got) == sorted(tuple(map(str, (r[c] for c in columns))) for r in found.values())


def test_digests_are_distinct() -> None:
    every = [x for v in licenses.DIGESTS.values() for x in v]
    assert len(set(every)) == len(every)
