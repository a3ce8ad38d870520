"""Notices of every known licence, wrapped lines, and the SQL statement of the same rules."""

import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from codelode.llm import license_scan as L
from codelode.llm.queries import _license_sql
from tests.llm.test_operators import APACHE, BSD, GPL, MIT


def counted(rows) -> Counter:
    return Counter((r[0], r[1], r[2], r[3]) for r in rows)


def both(spark, documents, rows):
    got = counted(tuple(r) for r in L.license_statements(documents(rows, extra=True)).collect())
    documents_table = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": pd.array([t for _, t in rows], "string")})
    connection = duckdb.connect()
    connection.register("documents", documents_table)
    said = connection.execute(f"SELECT doc_id, rule, licence, statements FROM ({_license_sql()})").fetchall()
    assert got == counted(said)
    return got


def test_every_sentence_passes_the_first_look():
    assert all(re.search(L.SPEAKS, form) for form in L.KNOWN)
    assert all(" ".join(s.split(" ")[:2]) in L.STARTS for s in L.SENTENCES)
    assert all(s == s.lower() and not re.search(r"[^a-z0-9. ]", s) for s in L.KNOWN)
    leads = [f"this {s} is {v} under the terms of the " for s in L.SUBJECTS for v in L.VERBS]
    assert max(map(len, leads)) <= L.SHORT and all(L.canonical(x) == "under " for x in leads)
    ids = {x for rule, _ in L.RULES for x in rule}
    assert {i for i in L.KNOWN.values() if i.startswith("Ref ")} <= ids


@pytest.mark.parametrize("layout", ["Licensed under the {}.", "This project is released under the terms of the {}!", "SPDX-License-Identifier: {}\nNext line",
                                    "Words\n\nThis Work is\nLicensed under\nThe {}\n\nMore words"])
def test_notices_of_all_names(spark, documents, layout):
    names = [(licence, name) for licence, all_names in L.NAMES.items() for name in all_names]
    rows = [(n, layout.format(name.title())) for n, (_, name) in enumerate(names)]
    got = both(spark, documents, rows)
    assert {(doc, licence) for doc, _, licence, _ in got} == {(n, licence) for n, (licence, _) in enumerate(names)}


def test_sql_and_query_agree_on_wrapped_and_odd_texts(spark, documents):
    rows = [
        (1, MIT), (2, APACHE), (3, BSD), (4, GPL), (5, GPL.replace("\n", "\r\n")), (6, MIT + GPL + MIT + APACHE), (7, re.sub(r"(?<!\n)\n(?!\n)", " ", MIT)),
        (8, "Licensed under the MIT license."), (8, "Licensed under the MIT license."), (None, "Licensed under the MIT licence."), (9, None), (10, ""),
        (11, "Licensed under the Secret License. All rights reserved."), (12, "All\nRights\nReserved"), (13, "ALL RIGHTS RESERVED!\nAll rights reserved.\n\nall rights reserved"),
        (14, "This work is\nLicensed under CC BY-NC 4.0.\nAll rights reserved."), (15, "licensed under the mit license but not really"),
        (16, "Licensed under the Apache License, Version 2.0.\nThe License"), (17, "Licensed under the Apache License, Version 2.0. Words"),
        (18, "See the\nGNU General Public License\nFor more details."), (19, "This\nThis\nThis program is licensed under the GPLv3"), (20, "..." * 1000 + "\x01under"),
        (21, "All rights reserved. " * 300), (22, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"),
    ]
    got = both(spark, documents, rows)
    known = {(doc, licence): times for (doc, _, licence, times), _ in got.items()}
    assert known[8, "MIT"] == 1 and sum(n for k, n in got.items() if k[0] == 8) == 2 and known[None, "MIT"] == 1
    assert known[14, "CC-BY-NC-4.0"] == 1 and known[14, "all-rights-reserved"] == 1 and known[21, "all-rights-reserved"] == 300
    assert known[12, "all-rights-reserved"] == 1 and known[13, "all-rights-reserved"] == 3 and known[22, "MPL-2.0"] == 1
    assert known[15, "unknown"] == 1 and not {(9, "unknown"), (10, "unknown")} & set(known)
    assert known[7, "MIT"] == 1 and known[6, "MIT"] == 2 and known[6, "Apache-2.0"] == 1


def test_no_rows_give_no_statements(spark, documents):
    assert not both(spark, documents, [(1, None)])
    assert L.license_statements(documents([])).count() == 0
