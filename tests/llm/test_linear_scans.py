"""Scans of odd pages and lines: as the plain patterns find, and linear in their length."""

import random
import re
import time

from wildgrid.llm import language_id, licenses, toxicity

HIDDEN = re.compile(r"<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
PIECES = ["<html ", "lang=", "lang = 'de'", "xlang=fr", "<HTML", ">", "<", "<!--", "-->", "<nav>", "</nav >", "<script", "</SCRIPT>",
          "</nav", "<style a>", "text ", "-", "\n", "<main>", "</main>"]


def test_pages_as_the_patterns_find():
    rng = random.Random(3)
    for _ in range(4000):
        page = "".join(rng.choices(PIECES, k=rng.randrange(0, 14)))
        assert language_id.without_hidden(page) == HIDDEN.sub(" ", page)
        assert language_id.without_tags(page) == re.sub("<[^>]*>", " ", page)
        found = DECLARED.search(page)
        assert language_id.declared_language(page) == (found.group(1).lower() if found else None)


def test_shouting_as_the_pattern_finds():
    rng, plain = random.Random(4), re.compile(r"\b[A-Z]{4,}\b.*!{2,}")
    for _ in range(4000):
        text = "".join(rng.choices(["STOP", "ABC", " ", "!", "!!", "\n", "a", "\r", "9"], k=rng.randrange(0, 12)))
        assert toxicity.shouting(text) == bool(plain.search(text)), text
    assert "shouting" in toxicity.PATTERN_VOTERS
    assert toxicity.matches("please STOP it!!") == ["/shouting"]


def test_two_megabytes_of_openers():
    start = time.monotonic()
    for opener in ("<html ", "<!-- ", "<", "<script ", "<main ", "<nav>", "lang="):
        page = opener * (2_000_000 // len(opener))
        language_id.visible_text(page)
        assert language_id.declared_language(page) is None
    toxicity.matches("SHOUT " * 350_000)
    assert time.monotonic() - start < 60


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NEITHER = """3. Neither the name of {} nor the names of
   its contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GNU = """This {} is free software: you can redistribute it and/or modify
it under the terms of the GNU {} General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.
"""
NOTICES = [
    (BSD, "BSD-2-Clause"),
    (BSD + NEITHER.format("the copyright holder"), "BSD-3-Clause"),
    (BSD + NEITHER.format("Example Corp."), "BSD-3-Clause"),
    (BSD + NEITHER.format("the University of\n   Somewhere, Inc."), "BSD-3-Clause"),
    (GNU.format("library", "Lesser", "2.1"), "LGPL-2.1"),
    (GNU.format("program", "Affero", "3"), "AGPL-3.0"),
    (GNU.format("program", "", "2"), "GPL-2.0"),
    ("// SPDX-License-Identifier: MIT\ncode", "MIT"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
    ("SPDX-License-Identifier: Unheard-1.0", ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not "
     "distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
]


def test_notices(spark):
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.digests(rows).collect()}
    assert got == {k: want for k, (_, want) in enumerate(NOTICES)}
