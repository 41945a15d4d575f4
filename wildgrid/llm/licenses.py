"""License scans by sentence rules.

A text is cut into sentences at line breaks and after full stops, exclamation and question
marks that blanks follow, but not in "v. 2". Sentences in normal form (lower case, runs of
other characters than a-z and 0-9 as one blank) are mapped to identifiers of known licence
sentences. A known sentence may be broken over the lines of a paragraph in any way, and the
longest one counts. The sentence on endorsement has a blank of at most 120 characters for the name
of an organisation. A line may also be a licence tag. The identifiers of a text, in their order, are matched against rules: a
rule is an ordered list of identifiers of one licence. Longer rules are matched first and use
up what they match, so a notice of several sentences is not counted again as a shorter one.
Unknown sentences between known ones do not matter.

All steps are column expressions over one text, without a shuffle. A text without any of
the cue words is not cut: every known sentence holds a cue.

The SQL knows single lines only: it finds a notice of several lines in its usual wrapping,
and takes the GPL's header for version 3.

NULL and empty texts have no sentences and no licences. Repeated rows give equal rows, and
an empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from wildgrid.llm.common import col, whole_text

# Licence sentences by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-required": "Unless required by applicable law or agreed to in writing, software",
    "apache-as-is": 'distributed under the License is distributed on an "AS IS" BASIS,',
    "apache-warranty": "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and",
    "apache-limits": "limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title-plain": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR',
    "gpl-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify",
    "gpl-terms": "it under the terms of the GNU General Public License as published by",
    "gpl-no-warranty": "but WITHOUT ANY WARRANTY; without even the implied warranty of",
    "gpl-details": "GNU General Public License for more details.",
    "gpl-2": "Licensed under the GNU General Public License, version 2.",
    "lgpl-3": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3": "Licensed under the GNU Affero General Public License, version 3.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice,",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its",
    "bsd-2-short": "Licensed under the BSD 2-Clause License.",
    "bsd-3-short": "Licensed under the BSD 3-Clause License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc0": "This work is dedicated to the public domain under the CC0 1.0 license.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2-dist": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved under copyright.",
}

# Ordered rules, each the sentences of one licence notice.
RULES = [
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy", "apache-required", "apache-as-is",
                    "apache-warranty", "apache-see", "apache-limits"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy"]),
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-header"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-title-plain", "mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("GPL-3.0", ["gpl-free", "gpl-terms", "gpl-no-warranty", "gpl-details"]),
    ("GPL-3.0", ["gpl-work"]),
    ("GPL-2.0", ["gpl-2"]),
    ("LGPL-3.0", ["lgpl-3"]),
    ("AGPL-3.0", ["agpl-3"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-2-short"]),
    ("BSD-3-Clause", ["bsd-3-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl-2", "mpl-2-dist"]),
    ("MPL-2.0", ["mpl-2"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense"]),
]

# Whole sentences whose lines are above, with the identifiers they stand for. One
# that ends in a colon or an address may be followed by anything.
WHOLE = [
    ("apache-header apache-comply", 'Licensed under the Apache License, Version 2.0 (the "License"); '
     "you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at:"),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0:"),
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0:"),
    ("apache-required apache-as-is apache-warranty", "Unless required by applicable law or agreed to in writing, software "
     'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
     "either express or implied."),
    ("apache-see apache-limits", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the Software."),
    ("mit-as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
     "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    *[(f"gpl-free gpl-terms gpl-version-{n}", "This program is free software: you can redistribute it and/or modify it under "
       "the terms of the GNU General Public License as published by the Free Software Foundation, " + version)
      for n in (2, 3)
      for version in (f"either version {n} of the License, or (at your option) any later version.", f"version {n} of the License.", f"version {n}.")],
    *[(f"lgpl-version-{n}", f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the "
       "GNU Lesser General Public License as published by the Free Software Foundation, " + version)
      for n in ("2.1", "3") for thing in ("library", "program")
      for version in (f"either version {n} of the License, or (at your option) any later version.", f"version {n} of the License.", f"version {n}.")],
    *[("agpl-version-3", "This program is free software: you can redistribute it and/or modify it under the terms of the "
       "GNU Affero General Public License as published by the Free Software Foundation, " + version)
      for version in ("either version 3 of the License, or (at your option) any later version.", "version 3 of the License.", "version 3.")],
    ("gpl-no-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
     "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-details", "See the GNU General Public License for more details."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
     "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]

# In place of the rule of the GPL's header, which names no version.
_NO_VERSION = ("GPL-3.0", ["gpl-free", "gpl-terms", "gpl-no-warranty", "gpl-details"])
VERSION_RULES = [(f"GPL-{n}.0", ["gpl-free", "gpl-terms", f"gpl-version-{n}", *rest])
                 for n in (2, 3) for rest in (["gpl-no-warranty", "gpl-details"], [])]
VERSION_RULES += [("LGPL-2.1", ["lgpl-version-2.1"]), ("LGPL-3.0", ["lgpl-version-3"]), ("AGPL-3.0", ["agpl-version-3"])]

# The blank of a known sentence, for the name of an organisation.
BLANK = r"neither\s+the\s+names?\s+of\s+[^!?;:]{1,120}?\s+nor\s+the\s+names\s+of\s+(?:its|any|their)(\s)"
FILLED = "neither the name of the copyright holder nor the names of its"

# Every known sentence holds one of these.
CUES = ["licens", "permission", "redistribut", "warrant", "copyright", "public domain", "terms of the gnu", "agreed to in writing", "mozilla"]


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def tags() -> dict[str, str]:
    """Licence by its short tag; tags of the GNU licences also say whether later versions are meant."""
    named = sorted({licence for licence, _ in RULES + VERSION_RULES})
    return {licence + end: licence for licence in named for end in (["", "-only", "-or-later"] if "GPL" in licence else [""])}


def known_sentences() -> dict[str, str]:
    """Identifier by normal form of the sentence."""
    return {normal(s): name for name, s in SENTENCES.items()}


def known_tags() -> dict[str, str]:
    """Identifier by normal form of a line with a tag."""
    return {normal(f"SPDX-License-Identifier: {tag}"): f"spdx-{tag}" for tag in tags()}


def rules() -> list[tuple[str, list[str]]]:
    """The rules, the longest first, in the order given among equals."""
    tagged = [(licence, [f"spdx-{tag}"]) for tag, licence in tags().items()]
    return sorted(RULES + tagged, key=lambda rule: -len(rule[1]))


def whole_rules() -> list[tuple[str, list[str]]]:
    """The rules over whole sentences, the longest first."""
    return sorted([r for r in rules() if r != _NO_VERSION] + VERSION_RULES, key=lambda rule: -len(rule[1]))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = known_sentences() | known_tags() | {normal(s): names for names, s in WHOLE}
    is_open = {normal(s) for _, s in WHOLE if s.endswith(":")}
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    low = F.lower(text)
    filled = F.regexp_replace(low, BLANK, f"{FILLED}$1")
    # In the normal form of the text, S stands for the end of a sentence and L for that of a line.
    ends = F.regexp_replace(filled, r"([!?]|(?<!\bv)\.|\.(?![^a-z0-9]+[0-9]))(?=[ \t\r\n])", " S ")
    form = F.regexp_replace(F.concat(F.lit("\n"), ends, F.lit("\n")), "\n", " L ")
    form = F.trim(F.regexp_replace(form, "[^a-z0-9LS]+", " "))
    one = [f.replace(" ", "(?: L)? ") + ("(?= )" if f in is_open else "(?= [LS])") for f in sorted(known, key=len, reverse=True)]
    # What follows an open sentence directly is the start of another.
    found = F.regexp_extract_all(form, F.lit(rf"(?:(?<=[LS] )|\G )({'|'.join(one)})"), F.lit(1))
    names = F.transform(found, lambda s: F.split(lookup[F.replace(s, F.lit(" L "), F.lit(" "))], " "))
    return F.when(low.rlike("|".join(CUES)), F.flatten(names)).otherwise(F.array().cast("array<string>"))


def matched(ids: Column) -> Column:
    """The licences whose rules match, one entry for each match, in order of place."""
    sequence = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for licence, names in whole_rules():
        sequence = F.replace(sequence, F.lit("".join(f"<{n}>" for n in names)), F.lit(f"{{{licence}}}"))
    return F.regexp_extract_all(sequence, F.lit(r"\{([^}]+)\}"), F.lit(1))


def scan(documents: DataFrame, text: str = "text", ids: str = "sentence_ids", licenses: str = "licenses") -> DataFrame:
    """``documents`` with the identifiers of known sentences and the licences matched."""
    return documents.withColumn(ids, sentence_ids(whole_text(text))).withColumn(licenses, matched(col(ids)))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, numbers of known sentences and of matched rules, their ids and the licences."""
    found = scan(documents.select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.size("licenses").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("licenses")), ",").alias("licenses"),
    )


def oracle() -> str:
    """The same in SQL, of single lines."""
    known = known_sentences() | known_tags()
    pairs = ", ".join(f"('{form}', '{name}')" for form, name in known.items())
    sequence = "seq"
    for licence, names in rules():
        sequence = f"replace({sequence}, '{''.join(f'<{n}>' for n in names)}', '{{{licence}}}')"
    return rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_replace(lower(coalesce(text, '')), '{BLANK}', '{FILLED}\1', 'g') AS low FROM documents
), known AS (
    SELECT * FROM (VALUES {pairs}) AS v(form, name)
), parts AS (
    SELECT rid, string_split(regexp_replace(low, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM docs
), forms AS (
    SELECT rid, pos, trim(regexp_replace(parts[pos], '[^a-z0-9]+', ' ', 'g'), ' ') AS form
    FROM parts, unnest(generate_series(1, len(parts))) AS t(pos)
), ids AS (
    SELECT rid, count(*) AS n, string_agg(name, ' ' ORDER BY pos) AS names,
        string_agg('<' || name || '>', '' ORDER BY pos) AS seq
    FROM forms JOIN known USING (form) GROUP BY rid
), found AS (
    SELECT rid, regexp_extract_all({sequence}, '\{{([^}}]+)\}}', 1) AS licences FROM ids
)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(names, '') AS sentence_ids,
    CAST(coalesce(len(licences), 0) AS BIGINT) AS n_matches,
    coalesce(array_to_string(list_sort(list_distinct(licences)), ','), '') AS licenses
FROM docs LEFT JOIN ids USING (rid) LEFT JOIN found USING (rid)
"""
