import re

import pyarrow as pa

from corpusforge.llm import licenses as L

from .oracle import same_rows

SF = "/root/testdata/sf0.001"


def test_against_sql(spark):
    assert same_rows(L.op3_licences(spark, SF), L.ORACLES["op3_licences"], SF) > 3


def test_cut_keeps_rows_apart():
    raw, rows, begin, end, h = L.cut(pa.array(["The MIT", None, "license x", "", "é1"], pa.string()))
    assert [raw[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)] == ["The", "MIT", "license", "x", "é1"]


def test_all_notices_are_found_in_prose(spark):
    rows = [(i, f"Some words before.\n{n.text.title()}. And after it x") for i, n in enumerate(L.NOTICES)]
    got = {(r["doc_id"], r["licence"]) for r in L.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, n.licence) for i, n in enumerate(L.NOTICES)} <= got


def test_bodies_with_words_added_and_missing(spark):
    """Notices as files have them: other lines between, words added or left out."""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation ..."""
    apache = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#     http://www.apache.org/licenses/LICENSE-2.0
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
    rows = [(1, mit), (2, apache), (3, mit.replace("obtaining a copy", "getting one")), (4, apache.replace("You may obtain a copy of the License at", "")), (5, mit.replace("associated", "never " * 9))]
    rows += [(6, apache.replace("AS IS", "as was"))]
    got = {(r["doc_id"], r["licence"]) for r in L.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT-text"), (3, "MIT-text"), *[(i, n) for i in (2, 6) for n in ("Apache-2.0",)], (2, "Apache-2.0-text"), (4, "Apache-2.0")}


def test_phrases_must_stand_together(spark):
    rows = [
        (1, "the gnu general public license is here and much later on comes version 3 of it", 1),
        (2, "GNU General Public License, (at your option) version 3!", 1),
        (3, "the MIT License, and again the mit license", 1),
        (3, "the MIT License, and again the mit license", 1),
        (4, None, 1),
        (5, "", 1),
        (None, "x " * 50_000 + "All rights reserved", 1),
        (7, "the mit licenses; cc by nc 4 01; allrights reserved", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licence int")
    got = sorted((str(r["doc_id"]), r["licence"], r["match_no"], r["matched"]) for r in L.scan_licences(docs).collect())
    assert got == sorted(
        [("2", "GPL-3.0", 1, "GNU General Public License, (at your option) version 3")]
        + [("3", "MIT", 1, "the MIT License"), ("3", "MIT", 2, "the mit license")] * 2
        + [("None", "All-rights-reserved", 1, "All rights reserved")]
    )
    assert L.scan_licences(docs.limit(0)).count() == 0


def test_brute_force_of_every_pattern(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = sum(len(re.findall(r"(?i)\ball\W+rights\W+reserved\b", r["text"])) for r in docs.collect())
    assert L.scan_licences(docs).filter("licence = 'All-rights-reserved'").count() == want
