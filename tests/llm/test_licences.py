"""Licence texts with other holders, with parts missing or strange, and SPDX expressions."""

import duckdb
import pytest

from lathe.llm import license_rules

GRANT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
"""
SOURCE = """1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
"""
BINARY = """2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ADVERT = """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
     This product includes software developed by the University of
     Somewhere, Elsewhere and its contributors.
"""
ENDORSE = """{n}. Neither the name of {holder} nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
AS_IS = """THIS SOFTWARE IS PROVIDED BY {holder} ``AS IS'' AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
HOLDERS = ("the copyright holder", "Google Inc.", "the University of California, Berkeley", "Ann B. Cole")


def _found(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.licences, r.n_unmatched) for r in license_rules.scan_licences(rows).orderBy("doc_id").collect()]


@pytest.mark.parametrize("holder", HOLDERS)
def test_bsd_texts_are_told_apart(spark, holder):
    head = f"Copyright (c) 2010, {holder}\nAll rights reserved.\n\n"
    tail = AS_IS.format(holder=holder.upper()).replace("INC. ", "INC ")
    endorse = ENDORSE.format(n=3, holder=holder)
    two, three = head + GRANT + SOURCE + BINARY + tail, head + GRANT + SOURCE + BINARY + endorse + tail
    four = head + GRANT + SOURCE + BINARY + ADVERT + endorse.replace("3.", "4.") + tail
    assert _found(spark, two, three, four) == [("BSD-2-Clause", 0), ("BSD-3-Clause", 0), ("BSD-4-Clause", 0)]


def test_nothing_unknown_stands_inside_a_rule(spark):
    odd = GRANT + SOURCE + BINARY + "4. The software may only be used on Sundays.\n" + AS_IS.format(holder="X")
    inside = GRANT + "You must first send a card.\n" + SOURCE + BINARY
    got = _found(spark, odd, inside, "Our hotel has 20 rooms.\nAll rights reserved.\nBreakfast at nine.", "The MIT License\nsays so.\nCopyright (c) 2001 X\n")
    assert got == [("BSD-2-Clause", 1), (None, 3), (None, 1), ("MIT", 0)]


@pytest.mark.parametrize(
    "line, want",
    [
        ("(MIT OR Apache-2.0)", "MIT, Apache-2.0"), ("Apache-2.0 WITH LLVM-exception", "Apache-2.0 WITH LLVM-exception"), ("GPL-2.0", "GPL-2.0-only"), ("gpl-2.0+", "GPL-2.0-or-later"), ("mit", "MIT"),
        ("(GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause */", "GPL-2.0-only WITH Classpath-exception-2.0, BSD-3-Clause"), ("LicenseRef-own", None), ("", None),
    ],
)
def test_spdx_expressions(spark, line, want):
    assert _found(spark, f"// SPDX-License-Identifier: {line}\nint x;")[0][0] == want


def test_titles_of_full_texts(spark):
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n Everyone is permitted to copy"
    lgpl = "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n"
    cc = "Creative Commons Attribution-ShareAlike 4.0 International Public\nLicense\n\nBy exercising"
    assert [g[0] for g in _found(spark, gpl, lgpl, cc, "Eclipse Public License - v 2.0\n\n  THE")] == ["GPL-3.0-only", "LGPL-2.1-only", "CC-BY-SA-4.0", "EPL-2.0"]


def test_sql_of_the_whole_table(spark):
    """Every sentence of the table in one piece, alone and in the order of every rule, against the SQL."""
    said = {i: s.replace("*", "some holder") for i, s in license_rules.ALL_SENTENCES if "*" not in s}
    texts = [s for _, s in license_rules.ALL_SENTENCES if "*" not in s] + ["\n".join(said[i] for i in seq) for _, seq in license_rules.ALL_RULES if all(i in said for i in seq)]
    texts += ["SPDX-License-Identifier: MIT\nx", "SPDX-License-Identifier: gpl-3.0", None, "", "1. a. b. x y"]
    rows = list(enumerate(texts))
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = license_rules.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(license_rules.scan_sql()).fetchall())
