"""Licence scans by sentence rules, in SQL expressions only.

A text is cut into pieces: at lines without a letter or digit (blank ones, or with comment marks only) and after . ! ? ; : with white space. A piece is
normalised: ASCII lower case, all but a-z and 0-9 to single blanks (so that line ends and comment marks within a sentence are blanks too), then a
few wordings that mean the same to one (``SAME``: leading subjects, "released" or "distributed under the terms of", version numbers, holders'
names). It is looked up in a table of known licence sentences; if it isn't known as a whole, each of its lines is looked up. The
identifiers found, in order, are held against ordered rules: a rule is met where its identifiers stand next to each other in the sequence,
whatever unknown sentences lie between, but not as a part of a longer rule that is met there (BSD-3-Clause isn't BSD-2-Clause too).

``LICENCES`` has the names by which texts refer to a licence, for notices ("licensed under ..."), titles and SPDX lines; ``TEXTS`` the sentences of notices
and full texts that tell a licence. A sentence with other words in it isn't known: recognition is exact after normalising.

All is done within a row: no join, no shuffle, no cap. Null and empty texts have no sentences, so an empty sequence and no
licences. Texts of any length are cut whole. Repeated rows are alike, other columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licences by SPDX name, with the names that texts give them.
LICENCES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License", "Expat License"),
    "MIT-0": ("MIT No Attribution License", "MIT-0 License"),
    "Apache-2.0": ("Apache License 2.0", "Apache 2.0 License", "Apache Software License 2.0"),
    "GPL-2.0": ("GNU General Public License version 2", "GNU GPL version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License version 3", "GNU GPL version 3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License version 2.1", "GNU LGPL version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License version 3", "GNU LGPL version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License version 3", "GNU AGPL version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "MPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "EPL-1.0": ("Eclipse Public License 1.0", "EPL 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "EPL 2.0"),
    "BSL-1.0": ("Boost Software License 1.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "Artistic-2.0": ("Artistic License 2.0",),
}
# Sentences of notices and full texts, as the licences have them, by identifier.
TEXTS: dict[int, str] = {
    10: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    12: 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    13: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    20: "you may not use this file except in compliance with the License",
    21: "You may obtain a copy of the License at",
    22: "http://www.apache.org/licenses/LICENSE-2.0",
    23: "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    30: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    31: "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    32: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    33: "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    34: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    35: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    36: "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    37: "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    38: "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    39: "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    40: "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    41: "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    50: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    51: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    52: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    53: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    54: "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    60: "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    61: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    70: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    71: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    72: "This is free and unencumbered software released into the public domain",
    73: "This software is provided 'as-is', without any express or implied warranty",
    74: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    75: 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    80: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    81: "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
}
# Rules on identifiers of TEXTS, in order.
TEXT_RULES: list[tuple[str, tuple[int, ...]]] = [
    ("0BSD", (71,)),
    ("AGPL-3.0", (36,)),
    ("AGPL-3.0", (41,)),
    ("Apache-2.0", (20, 21, 22)),
    ("Apache-2.0", (23,)),
    ("BSD-2-Clause", (50, 51, 52)),
    ("BSD-3-Clause", (50, 51, 52, 53)),
    ("BSD-4-Clause", (50, 51, 52, 54, 53)),
    ("BSL-1.0", (75,)),
    ("EPL-1.0", (81,)),
    ("EPL-2.0", (80,)),
    ("GPL-2.0", (30,)),
    ("GPL-2.0", (31,)),
    ("GPL-2.0", (37,)),
    ("GPL-3.0", (32,)),
    ("GPL-3.0", (33,)),
    ("GPL-3.0", (38,)),
    ("ISC", (70,)),
    ("LGPL-2.1", (34,)),
    ("LGPL-2.1", (39,)),
    ("LGPL-3.0", (35,)),
    ("LGPL-3.0", (40,)),
    ("MIT", (10, 11)),
    ("MIT-0", (13, 12)),
    ("MPL-2.0", (60, 61)),
    ("Unlicense", (72,)),
    ("Zlib", (73, 74)),
]
#: Wordings made one, in order: patterns on normalised text (understood alike by Java, Python and RE2) and what replaces them. %1 is the first group.
SAME: tuple[tuple[str, str], ...] = (
    (r"\b(l|a|)gplv([0-9])", "%1gpl %2"),
    (r"\b(version|v)( |)([0-9])", "%3"),
    (r" ([0-9]) 0( |$)", " %1%2"),
    (r"\bhttps ", "http "),
    (r"\band or\b", "and"),
    (r"\blicence\b", "license"),
    (r"^all rights reserved ", ""),
    (r"^((this|these|the|our|all|its) ([a-z0-9]+ ){1,5}?(is|are) )?((free|dual|freely|hereby|also|made|and) )*(released|licensed|distributed|available|published|provided|offered) under (the |)(terms of |)(the |)", "licensed under "),
    (r"^(licensed under .*) (the license|or later|or any later version|or at your option any later version)$", "%1"),
    (r"^neither the name of .* nor the names of (its |their |the |)contributors ", "neither the name of holder nor the names of contributors "),
)
#: Where a text is cut, and what stands for the cut.
CUTS: tuple[tuple[str, str], ...] = (
    (r"\r\n?", "\n"),
    (r"(?i)SPDX-License-Identifier:", "SPDX-License-Identifier "),
    (r"\n[^a-zA-Z0-9\n]*\n[^a-zA-Z0-9]*", "\x01"),
    (r"([.!?;:])[ \t\n]+", "%1\x01"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    """The normalised form, as the expressions make it."""
    text = re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip(" ")
    for pattern, instead in SAME:
        text = re.sub(pattern, instead.replace("%", "\\"), text)
    return text


def _sentences() -> tuple[dict[str, int], list[tuple[str, tuple[int, ...]]]]:
    """Known sentences, normalised, with their identifiers, and all rules. A licence's names share an identifier: notices from 1001, titles from 2001, SPDX lines from 3001."""
    known = {normal(text): i for i, text in TEXTS.items()}
    rules = list(TEXT_RULES)
    for k, (name, names) in enumerate(LICENCES.items(), 1):
        for n in names:
            for lead in ("licensed under", "licensed under the"):
                known.setdefault(normal(f"{lead} {n}"), 1000 + k)
            for title in (n, f"the {n}", f"{n} ({name})", f"the {n} ({name})"):
                if "license" in normal(title):  # a short name alone on a line says nothing
                    known.setdefault(normal(title), 2000 + k)
        for suffix in ("", "-only", "-or-later", "+"):
            known.setdefault(normal(f"SPDX-License-Identifier {name}{suffix}"), 3000 + k)
        rules += [(name, (base + k,)) for base in (1000, 2000, 3000) if base + k in known.values()]
    return known, rules


SENTENCES, RULES = _sentences()


def _stems() -> str:
    """A pattern that every known sentence's text has, before normalising too: few words, or pairs of words, of the table, each taken for covering most of what is left."""
    made = set("licensed under version holder contributors and the all rights reserved its their http gpl lgpl agpl this provided universal general".split())
    left = set(SENTENCES)
    found = []
    while left:
        cover: dict[str, set[str]] = {}
        for s in left:
            words = s.split()
            for a, b in zip(words, [*words[1:], ""], strict=True):
                if a not in made and len(a) > 6 and not a.isdigit():
                    cover.setdefault(a, set()).add(s)
                if a not in made and b and b not in made and not (a + b).isdigit() and not a[0].isdigit() and not b[0].isdigit():
                    cover.setdefault(f"{a}[^a-z0-9]+{b}", set()).add(s)
                if s.startswith("licensed under ") and a not in made and 3 <= len(a) <= 4 and not a.isdigit():
                    cover.setdefault(rf"\b{a}\b", set()).add(s)
            if "gpl" in s:
                cover.setdefault("gpl", set()).add(s)
        best = max(cover, key=lambda w: (len(cover[w]), len(w), w))
        found.append(best.replace("license", "licen[cs]e"))
        left -= cover[best]
    return "(?i)" + "|".join(found)


STEMS = _stems()


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for pattern, instead in pairs:
        text = F.regexp_replace(text, pattern, instead.replace("%", "$"))
    return text


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order: array<int>."""
    known = F.create_map(*[F.lit(x) for s, i in SENTENCES.items() for x in (s, i)])

    def identifier(piece: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.translate(piece, _UPPER, _LOWER), "[^a-z0-9]+", " "))
        return F.try_element_at(known, _replaced(plain, SAME))

    def found(piece: Column) -> Column:
        lines = F.filter(F.transform(F.filter(F.split(piece, "\n"), lambda x: x.rlike(STEMS)), identifier), lambda i: i.isNotNull())
        whole = F.element_at(F.transform(F.array(piece), identifier), 1)
        return F.element_at(F.transform(F.array(whole), lambda i: F.when(i.isNotNull(), F.array(i)).when(F.contains(piece, F.lit("\n")), lines).otherwise(F.array().cast("array<int>"))), 1)

    pieces = F.filter(F.split(_replaced(F.coalesce(text, F.lit("")), CUTS), "\x01"), lambda p: p.rlike(STEMS))
    return F.flatten(F.transform(pieces, found))


def _marked(rule: tuple[int, ...]) -> str:
    return "".join(f"<{i}>" for i in rule)


def _longer(rule: tuple[int, ...]) -> list[str]:
    """Rules of which this one is a part."""
    return [_marked(r) for _, r in RULES if len(r) > len(rule) and _marked(rule) in _marked(r)]


def licences_of(ids: Column) -> Column:
    """Names of the rules that a sequence meets, sorted: array<string>."""
    joined = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), "")
    met = []
    for name, rule in RULES:
        left = joined
        for longer in _longer(rule):
            left = F.replace(left, F.lit(longer), F.lit("|"))
        met.append(F.when(F.contains(left, F.lit(_marked(rule))), F.lit(name)))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*met))))


def scan(df: DataFrame, text: str = "text", ids: str = "sentence_ids", licences: str = "licences") -> DataFrame:
    """``df`` with the two arrays. Texts without any of the stems cost one search."""
    known = F.when(F.col(text).rlike(STEMS), sentence_ids(F.col(text))).otherwise(F.array().cast("array<int>"))
    found = df.withColumn(ids, known)
    return found.withColumn(licences, F.when(F.size(ids) > 0, licences_of(F.col(ids))).otherwise(F.array().cast("array<string>")))


def scan_sql(table: str = "documents") -> str:
    """The same in DuckDB."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def replaced(text: str, pairs: tuple[tuple[str, str], ...]) -> str:
        for pattern, instead in pairs:
            made = quoted(instead.replace("%", "\\"))
            text = f"regexp_replace({text}, {quoted(pattern)}, {made.replace(chr(1), "' || chr(1) || '").replace(chr(10), "' || chr(10) || '")}, 'g')"
        return text

    known = "MAP {" + ", ".join(f"{quoted(s)}: {i}" for s, i in SENTENCES.items()) + "}"
    plain = f"trim(regexp_replace(translate(x, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ')"
    met = []
    for name, rule in RULES:
        left = "j"
        for longer in _longer(rule):
            left = f"replace({left}, '{longer}', '|')"
        met.append(f"CASE WHEN contains({left}, '{_marked(rule)}') THEN '{name}' END")
    stems = quoted(STEMS)
    return f"""
        WITH pieces AS (SELECT doc_id, list_filter(string_split({replaced("coalesce(text, '')", CUTS)}, chr(1)), lambda p: regexp_matches(p, {stems})) AS p FROM {table}),
        piece AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM pieces),
        whole AS (SELECT doc_id, k, x, {known}[{replaced(plain, SAME)}] AS i FROM piece),
        line AS (SELECT doc_id, k, unnest(string_split(x, chr(10))) AS x, generate_subscripts(string_split(x, chr(10)), 1) AS m FROM whole WHERE i IS NULL AND contains(x, chr(10))),
        every AS (SELECT doc_id, k, 0 AS m, i FROM whole UNION ALL SELECT doc_id, k, m, {known}[{replaced(plain, SAME)}] AS i FROM line WHERE regexp_matches(x, {stems})),
        found AS (SELECT doc_id, list(i ORDER BY k, m) AS ids FROM every WHERE i IS NOT NULL GROUP BY doc_id),
        seq AS (SELECT d.doc_id, coalesce(f.ids, []) AS ids FROM {table} d LEFT JOIN found f ON d.doc_id = f.doc_id),
        joined AS (SELECT doc_id, len(ids) AS n, array_to_string(ids, ',') AS ids, array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '') AS j FROM seq)
        SELECT doc_id, CAST(n AS INTEGER) AS n_sentences, ids AS sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{", ".join(met)}], lambda x: x IS NOT NULL))), ';') AS licences FROM joined"""
