"""License scans by sentence rules: a text is cut into sentences, each normalised sentence
is mapped to the identifier of a known licence sentence, and the sequence of identifiers is
matched against ordered licence rules.

A run of text ends at ``. ! ? ; :`` before white space or at an empty line. It is normalised as
a whole (comment signs, line ends, case and punctuation go), and known sentences are looked for
at every word of it, left to right, the longest first and not overlapping, since a notice may be
wrapped anywhere and stand between words without a stop. A rule is met where its identifiers
occur in this order, others between them allowed; a rule whose sequence lies inside that of
another rule met is not reported beside it.

Everything happens inside a row (SQL functions, no join, no shuffle): the catalogue is fixed
and small. Only sentences with one of ``TRIGGERS`` are normalised; every catalogue sentence
has one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.llm.spans import let

# fixed values: words of which every catalogue sentence has one
TRIGGERS = ["licen[sc]e", "copyright", "permission", "permitted", "warrant", "rights reserved", "redistribut", "public domain", "cc by", "cc0", "spdx", "liable", "creative commons", "gnu gpl"]

# fixed values: licence sentences as published, by identifier
SENTENCES = {
    "ref.mit": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License."],
    "ref.apache2": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "This project is licensed under the Apache License, Version 2.0."],
    "ref.gpl3": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License v3.0."],
    "ref.gpl2": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "ref.lgpl3": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3."],
    "ref.agpl3": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3."],
    "ref.bsd2": ["Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License."],
    "ref.bsd3": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
    "ref.mpl2": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ref.isc": ["Released under the ISC License.", "Licensed under the ISC License."],
    "ref.ccby4": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "ref.ccbysa4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "ref.ccbync4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "ref.ccbynd4": ["Licensed under CC BY-ND 4.0.", "This work is licensed under CC BY-ND 4.0."],
    "ref.cc0": ["Released under CC0 1.0.", "Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0."],
    "rights": ["All rights reserved.", "All Rights Reserved"],
    "ref.gpl3+": ["GNU General Public License, version 3 or later", "GNU General Public License, version 3 or any later version", "GNU General Public License, version 3, or (at your option) any later version", "GNU General Public License v3.0 or later", "GNU GPL version 3 or later"],
    "ref.gpl2+": ["GNU General Public License, version 2 or later", "GNU General Public License, version 2 or any later version", "GNU General Public License, version 2, or (at your option) any later version", "GNU General Public License v2.0 or later", "GNU GPL version 2 or later"],
    "ref.lgpl3+": ["GNU Lesser General Public License, version 3 or later", "GNU Lesser General Public License, version 3, or (at your option) any later version"],
    "ref.agpl3+": ["GNU Affero General Public License, version 3 or later", "GNU Affero General Public License, version 3, or (at your option) any later version"],
    "title.mit": ["MIT License", "The MIT License"],
    "title.apache2": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0"],
    "title.bsd2": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "title.bsd3": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "title.isc": ["ISC License"],
    "title.mpl2": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "title.gpl2": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License v2"],
    "title.gpl3": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3"],
    "title.lgpl3": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "title.agpl3": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "bsd.asis": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "mit.grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit.notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "liable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "bsd.grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd.endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "apache.head": ["Licensed under the Apache License, Version 2.0 (the \"License\");"],
    "apache.use": ["you may not use this file except in compliance with the License."],
    "apache.copy": ["You may obtain a copy of the License at"],
    "apache.law": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl.grant2": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."],
    "gpl.grant3": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl.grant3": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl.grant3": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl.nowarranty": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

# fixed values: licence names of SPDX tags, which are sentences of their own
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC0-1.0", "Unlicense"]

# fixed values: (licence, ordered sentence identifiers)
RULES = [
    ("MIT", ["ref.mit"]),
    ("MIT", ["title.mit"]),
    ("MIT", ["mit.grant", "mit.notice", "asis", "liable"]),
    ("MIT", ["mit.grant", "mit.notice"]),
    ("Apache-2.0", ["ref.apache2"]),
    ("Apache-2.0", ["title.apache2"]),
    ("Apache-2.0", ["apache.head"]),
    ("Apache-2.0", ["apache.head", "apache.use", "apache.copy", "apache.law"]),
    ("Apache-2.0", ["apache.head", "apache.use"]),
    ("BSD-2-Clause", ["ref.bsd2"]),
    ("BSD-2-Clause", ["title.bsd2"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("BSD-3-Clause", ["ref.bsd3"]),
    ("BSD-3-Clause", ["title.bsd3"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("ISC", ["ref.isc"]),
    ("ISC", ["title.isc"]),
    ("ISC", ["isc.grant"]),
    ("MPL-2.0", ["ref.mpl2"]),
    ("MPL-2.0", ["title.mpl2"]),
    ("GPL-2.0-only", ["ref.gpl2"]),
    ("GPL-2.0-only", ["title.gpl2"]),
    ("GPL-2.0-or-later", ["ref.gpl2+"]),
    ("GPL-2.0-or-later", ["gpl.grant2"]),
    ("GPL-3.0-only", ["ref.gpl3"]),
    ("GPL-3.0-only", ["title.gpl3"]),
    ("GPL-3.0-or-later", ["ref.gpl3+"]),
    ("GPL-3.0-or-later", ["gpl.grant3"]),
    ("LGPL-3.0-only", ["ref.lgpl3"]),
    ("LGPL-3.0-only", ["title.lgpl3"]),
    ("LGPL-3.0-or-later", ["ref.lgpl3+"]),
    ("LGPL-3.0-or-later", ["lgpl.grant3"]),
    ("AGPL-3.0-only", ["ref.agpl3"]),
    ("AGPL-3.0-only", ["title.agpl3"]),
    ("AGPL-3.0-or-later", ["ref.agpl3+"]),
    ("AGPL-3.0-or-later", ["agpl.grant3"]),
    ("CC-BY-4.0", ["ref.ccby4"]),
    ("CC-BY-SA-4.0", ["ref.ccbysa4"]),
    ("CC-BY-NC-4.0", ["ref.ccbync4"]),
    ("CC-BY-ND-4.0", ["ref.ccbynd4"]),
    ("CC0-1.0", ["ref.cc0"]),
    ("Unlicense", ["unlicense"]),
    ("All-Rights-Reserved", ["copyright", "rights"]),
    ("All-Rights-Reserved", ["rights"]),
]
RULES += [(name, [f"spdx.{name.lower()}"]) for name in SPDX]

_TRIGGER = "|".join(t.replace(" ", "[^a-z0-9]+") for t in TRIGGERS)
_NORMAL = [  # (pattern, replacement) on lower case, in order
    (r"[^a-z0-9.+]+", " "),
    (r"[.]+( |$)", r"\1"),
    (r"^ +| +$", ""),
]


def normalised(sentence: str) -> str:
    s = sentence.lower()
    for pattern, to in _NORMAL:
        s = re.sub(pattern, to, s)
    return s


CATALOGUE = {normalised(t): name for name, texts in SENTENCES.items() for t in texts}
CATALOGUE |= {normalised(f"SPDX-License-Identifier={name}"): f"spdx.{name.lower()}" for name in SPDX}


def _inside(a: list[str], b: list[str]) -> bool:
    at = iter(b)
    return len(a) < len(b) and all(x in at for x in a)


def _normal(sentence: Column) -> Column:
    s = F.lower(sentence)
    for pattern, to in _NORMAL:
        s = F.regexp_replace(s, pattern, to.replace(r"\1", "$1"))
    return s


# a copyright line is known by its first two words
_HOLDER = "copyright (?:c|[0-9][0-9][0-9][0-9])"


def _known_pattern() -> str:
    """Any known sentence between spaces: by first word, the longest first."""
    by_first: dict[str, list[str]] = {}
    for key in sorted(CATALOGUE, key=lambda k: (-len(k.split(" ")), k)):
        by_first.setdefault(key.split(" ")[0], []).append(re.escape(key.partition(" ")[2]))
    tries = [re.escape(w) + " (?:" + "|".join(rest) + ")" for w, rest in by_first.items()]
    return "(?<= )(?:" + "|".join([*tries, _HOLDER]) + ")(?= )"


def _runs(text: Column) -> Column:
    marked = F.regexp_replace(text, r"(?i)spdx-license-identifier:[ \t\r\n\f]*", "SPDX-License-Identifier=")
    marked = F.regexp_replace(marked, r"([ \n,(][vV])\.[ \t\r\n\f#*/-]+([0-9])", "$1 $2")
    marked = F.regexp_replace(F.regexp_replace(marked, r"([.!?;:])[ \t\r\n\f]+", "$1\x01"), r"\n[ \t\r\n\f]*\n", "\x01")
    return F.filter(F.split(marked, "\x01"), lambda s: F.lower(s).rlike(_TRIGGER))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order, each once a run."""
    known = F.create_map(*[F.lit(x) for pair in CATALOGUE.items() for x in pair])

    def ids(run: Column) -> Column:
        met = F.regexp_extract_all(F.concat(F.lit(" "), _normal(run), F.lit(" ")), F.lit(_known_pattern()), F.lit(0))
        return F.array_distinct(F.transform(met, lambda m: F.coalesce(F.element_at(known, m), F.lit("copyright"))))

    none = F.array().cast("array<string>")
    return F.when(F.lower(text).rlike(_TRIGGER), F.flatten(F.transform(_runs(text), ids))).otherwise(none)


def _meets(line: Column, rule: list[str]) -> Column:
    """Whether the identifiers stand in ``line`` (",a,b,") in order; the first place after
    the one before is always the best choice."""
    at = F.lit(1)
    for name in rule:
        at = F.when(at > 0, F.call_function("locate", F.lit(f",{name},"), line, at)).otherwise(F.lit(0))
    return at > 0


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, licenses (names met, ascending, comma-joined),
    sentence_ids (known sentences in order, comma-joined), n_sentences and unmatched (known
    sentences, but no rule met).

    Defined cases: a null or empty text has none; a null doc_id stays null; repeated rows
    give repeated results; an empty table gives no rows; other columns are not looked at."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(F.coalesce(F.col("text"), F.lit(""))).alias("ids"))
    d = d.withColumn("line", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")))
    d = d.select("*", *[F.when(F.size("ids") > 0, _meets(F.col("line"), rule)).otherwise(F.lit(False)).alias(f"r{i}") for i, (_, rule) in enumerate(RULES)])
    names = [F.when(F.col(f"r{i}") & ~_beaten(i), F.lit(name)) for i, (name, _) in enumerate(RULES)]
    met = F.array_sort(F.array_distinct(F.array_compact(F.array(*names))))
    return d.select(
        "doc_id", F.array_join(met, ",").alias("licenses"), F.array_join("ids", ",").alias("sentence_ids"),
        F.size("ids").cast("long").alias("n_sentences"), ((F.size("ids") > 0) & (F.size(met) == 0)).alias("unmatched"),
    )


def _beaten(i: int) -> Column:
    out = F.lit(False)
    for j, (_, rule) in enumerate(RULES):
        if _inside(RULES[i][1], rule):
            out = out | F.col(f"r{j}")
    return out


def oracle() -> str:
    """The same scan as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    normal = "lower(u)"
    for pattern, to in _NORMAL:
        normal = f"regexp_replace({normal}, {quote(pattern)}, {quote(to)}, 'g')"
    catalogue = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in CATALOGUE.items())
    marked = "regexp_replace(coalesce(text, ''), '(?i)spdx-license-identifier:[ \\t\\r\\n\\f]*', 'SPDX-License-Identifier=', 'g')"
    marked = f"regexp_replace({marked}, '([ \\n,(][vV])\\.[ \\t\\r\\n\\f#*/-]+([0-9])', '\\1 \\2', 'g')"
    marked = f"regexp_replace({marked}, '([.!?;:])[ \\t\\r\\n\\f]+', '\\1' || chr(1), 'g')"
    marked = f"regexp_replace({marked}, '\\n[ \\t\\r\\n\\f]*\\n', chr(1), 'g')"
    meets = ["regexp_matches(line, " + quote("," + "(.*,)?".join(re.escape(x) + "," for x in rule)) + f") AS r{i}" for i, (_, rule) in enumerate(RULES)]
    names = []
    for i, (name, rule) in enumerate(RULES):
        above = "".join(f" AND NOT r{j}" for j, (_, other) in enumerate(RULES) if _inside(rule, other))
        names.append(f"CASE WHEN r{i}{above} THEN {quote(name)} END")
    return f"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents
), cut AS (
  SELECT rid, unnest(runs) AS u, generate_subscripts(runs, 1) AS run FROM (
    SELECT rid, list_filter(string_split({marked}, chr(1)), lambda s: regexp_matches(lower(s), {quote(_TRIGGER)})) AS runs FROM texts)
), words AS (SELECT rid, run, string_split({normal}, ' ') AS w FROM cut
), catalogue AS (SELECT string_split(k, ' ') AS k, id FROM (VALUES {catalogue}) c(k, id)
), starts AS (SELECT rid, run, w, unnest(range(1, len(w) + 1)) AS i FROM words
), places AS (
  SELECT rid, run, i, max(len(k)) AS n, max_by(id, len(k)) AS id FROM starts JOIN catalogue ON w[i] = k[1] AND w[i:i + len(k) - 1] = k GROUP BY ALL
  UNION ALL
  SELECT rid, run, i, 2, 'copyright' FROM starts WHERE w[i] = 'copyright' AND (w[i + 1] = 'c' OR regexp_full_match(w[i + 1], '[0-9]{{4}}'))
), taken AS (
  SELECT rid, run, min(i) AS i, min_by(n, i) AS n, min_by(id, i) AS id FROM places GROUP BY rid, run
  UNION ALL
  SELECT t.rid, t.run, min(p.i), min_by(p.n, p.i), min_by(p.id, p.i) FROM taken t JOIN places p ON p.rid = t.rid AND p.run = t.run AND p.i >= t.i + t.n
  GROUP BY t.rid, t.run
), once AS (SELECT rid, run, id, min(i) AS i FROM taken GROUP BY rid, run, id
), per AS (SELECT rid, list(id ORDER BY run, i) AS ids FROM once GROUP BY rid
), ids AS (SELECT rid, doc_id, coalesce(ids, CAST([] AS VARCHAR[])) AS ids FROM texts LEFT JOIN per USING (rid)
), lines AS (SELECT *, ',' || array_to_string(ids, ',') || ',' AS line FROM ids
), met AS (SELECT *, {", ".join(meets)} FROM lines
), named AS (
  SELECT *, list_sort(list_distinct(list_filter([{", ".join(names)}], lambda x: x IS NOT NULL))) AS met FROM met
)
SELECT doc_id, array_to_string(met, ',') AS licenses, array_to_string(ids, ',') AS sentence_ids, len(ids) AS n_sentences,
       len(ids) > 0 AND len(met) = 0 AS unmatched
FROM named
"""
