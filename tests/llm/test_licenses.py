from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tagloom.llm import licenses, queries, sql
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, documents

MIT = licenses.TEXTS[0][1]


@pytest.mark.parametrize(
    "text",
    [
        MIT,
        MIT.upper(),
        "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + MIT.replace(", ", ",\n   "),
        "Copyright 2001-2003 A, B\nAll rights reserved.\n\n" + MIT.replace('"', "“").replace("-", "–"),
        MIT.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "noninfringement") + "\n\n",
        "  Released under the MIT Licence  ",
    ],
)
def test_spellings_of_one_licence(spark, text):
    docs = documents(spark, [text])
    assert licenses.scan(docs, licenses.known(spark), licenses.known(spark, licenses.NOTICES)).first()["license"] == "MIT"


def test_other_texts_have_none(spark):
    docs = documents(spark, ["hello", MIT + " and more", MIT[:-30], "The copyright notice\n" + MIT, "a\nReleased under the MIT License.\nb\nLicensed under the Apache License, Version 2.0."])
    got = {r["doc_id"]: r for r in licenses.scan(docs, licenses.known(spark), licenses.known(spark, licenses.NOTICES)).collect()}
    assert all(r["license"] is None for r in got.values())
    assert got[4]["notices"] == "Apache-2.0,MIT" and got[0]["notices"] == ""


def test_awkward_rows(spark):
    docs = clashing(awkward(spark), "digest", "license", "notices", "th", "id", "line")
    texts = licenses.known(spark, (("B", "Same text, here!"), ("A", "same TEXT here"), ("empty", " \n"), ("null", None)))
    got = licenses.scan(docs, texts, texts)
    found = sorted((r["doc_id"], r["license"], r["notices"]) for r in got.where(F.col("license").isNotNull()).collect())
    assert found == [(5, "A", "A"), (5, "A", "A"), (6, "A", "A")]
    assert got.count() == 9 and licenses.scan(docs.where("doc_id > 99"), texts, texts).count() == 0


def test_query(spark, same_as_sql):
    frame = queries.op9_licenses(spark, SMALL)
    same_as_sql(frame, sql.OP9)
    assert frame.where("notices <> ''").count() > 0


INSTALLED = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not INSTALLED.is_dir(), reason="no licence texts here")
def test_published_texts_are_known(spark, tmp_path):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = [(INSTALLED / file).read_text() for file in names]
    terms = "END OF TERMS AND CONDITIONS"
    texts += [texts[0].partition(terms)[0] + terms, texts[2].replace("\n", "\n  ").upper(), texts[3] + " and more"]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["license"] for r in queries.op9_licenses(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [*names.values(), "Apache-2.0", "GPL-2.0", None]


def test_notices_of_further_licences(spark, tmp_path):
    lines = {
        "This software is licensed under the BSD 3-Clause licence.": "BSD-3-Clause",
        "Released under the ISC License": "ISC",
        "Licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "# SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
        "This project is licensed under the terms of the MIT license.": "MIT",
        "Licensed under the Creative Commons Attribution 4.0 International Licence": "CC-BY-4.0",
        "Licensed under nothing": "",
    }
    documents(spark, [f"a\n{line}\nb" for line in lines]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_licenses(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["notices"] for r in got] == list(lines.values()) and all(r["license"] is None for r in got)
