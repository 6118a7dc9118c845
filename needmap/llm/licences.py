"""Licence recognition by sentences and rules; built-in functions only.

A text is cut into sentences, sentences are normalised (lower case, letters and digits only) and mapped to the identifiers of known
licence sentences. Ordered rules then match sequences of identifiers: a rule that finds its sequence names its licence and takes the
sequence out, so a rule for a whole licence goes before those for single sentences. Identifiers that no rule takes are reported.

Notices come in many wordings ("this code is released under the terms of the MIT License"). What stands before the licence's name is
reduced to "licensed under" or "under", a reference to the licence file after it goes, and a table of names does the rest. SPDX tags
name their identifier.

Sentences end at a full stop, colon, semicolon or mark followed by white space. The text is read twice, with each line feed as an end
and with empty lines as ends, so that notices on a line of their own and notices wrapped over lines are both found; a licence is
named once.
NULL and empty texts have no sentences. All rows and columns stay; repeated rows are read each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

# Names of public licences in notices, normalised, and their SPDX tags, by identifier.
NAMES = {
    "mit": ("mit license", "mit licence", "expat license", "mit"),
    "apache2": ("apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0"),
    "gpl2": ("gnu general public license version 2", "gnu general public license v2 0", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2"),
    "gpl2.later": ("gnu general public license version 2 or later", "gnu general public license v2 0 or later", "gnu gpl version 2 or later", "gpl v2 or later", "gplv2 or later"),
    "gpl3": ("gnu general public license version 3", "gnu general public license v3 0", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3"),
    "gpl3.later": ("gnu general public license version 3 or later", "gnu general public license v3 0 or later", "gnu gpl version 3 or later", "gpl v3 or later", "gplv3 or later"),
    "lgpl21": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgpl version 2 1", "lgpl v2 1", "lgplv2 1"),
    "lgpl3": ("gnu lesser general public license version 3", "gnu lesser general public license v3 0", "gnu lgpl version 3", "lgpl version 3", "lgpl v3", "lgplv3"),
    "agpl3": ("gnu affero general public license version 3", "gnu affero general public license v3 0", "gnu agpl version 3", "gnu agpl v3", "agpl version 3", "agpl v3", "agplv3"),
    "bsd2": ("2 clause bsd license", "bsd 2 clause license", "simplified bsd license", "bsd 2 clause"),
    "bsd3": ("3 clause bsd license", "bsd 3 clause license", "new bsd license", "modified bsd license", "bsd 3 clause"),
    "mpl2": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "epl1": ("eclipse public license v1 0", "eclipse public license version 1 0", "eclipse public license 1 0", "epl 1 0"),
    "epl2": ("eclipse public license v 2 0", "eclipse public license v2 0", "eclipse public license version 2 0", "eclipse public license 2 0", "epl 2 0"),
    "isc": ("isc license", "isc"),
    "zlib": ("zlib license", "zlib libpng license", "zlib"),
    "boost": ("boost software license version 1 0", "boost software license 1 0", "boost software license"),
    "unlicense": ("unlicense",),
    "wtfpl": ("wtfpl", "do what the fuck you want to public license"),
    "cc0": ("cc0 1 0", "cc0 1 0 universal", "cc0 1 0 universal license", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal license", "cc0"),
}
TAGS = {
    "mit": ("MIT",), "apache2": ("Apache-2.0",), "gpl2.only": ("GPL-2.0", "GPL-2.0-only"), "gpl2.later": ("GPL-2.0+", "GPL-2.0-or-later"),
    "gpl3.only": ("GPL-3.0", "GPL-3.0-only"), "gpl3.later": ("GPL-3.0+", "GPL-3.0-or-later"), "lgpl21.only": ("LGPL-2.1", "LGPL-2.1-only"), "lgpl21.later": ("LGPL-2.1+", "LGPL-2.1-or-later"),
    "lgpl3.only": ("LGPL-3.0", "LGPL-3.0-only"), "lgpl3.later": ("LGPL-3.0+", "LGPL-3.0-or-later"), "agpl3.only": ("AGPL-3.0", "AGPL-3.0-only"), "agpl3.later": ("AGPL-3.0+", "AGPL-3.0-or-later"),
    "bsd2": ("BSD-2-Clause",), "bsd3": ("BSD-3-Clause",), "mpl2": ("MPL-2.0",), "epl1": ("EPL-1.0",), "epl2": ("EPL-2.0",), "isc": ("ISC",), "zlib": ("Zlib",), "boost": ("BSL-1.0",),
    "unlicense": ("Unlicense",), "wtfpl": ("WTFPL",), "cc0": ("CC0-1.0",),
}
#: Conditions of the Creative Commons licences: how names and tags say them.
CONDITIONS = {
    "by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial",
    "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives",
}
EDITIONS = {"4.0": "international", "3.0": "unported"}
CREATIVE = {f"cc-{c}{e[0]}": (c, e) for c in CONDITIONS for e in EDITIONS}
# Sentences of public licences, normalised, and what they are.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit.warranty",
    "you may not use this file except in compliance with the license": "apache2.compliance",
    "you may obtain a copy of the license at": "apache2.copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2.warranty",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3.later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2.later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl.warranty",
    "you should have received a copy of the gnu general public license along with this program": "gpl.copy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc.grant",
    "this is free and unencumbered software released into the public domain": "unlicense.notice",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2.notice",
    "mit license": "mit.title",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache2.title",
    "gnu general public license version 2 june 1991": "gpl2.title",
    "gnu general public license version 3 29 june 2007": "gpl3.title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21.title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3.title",
    "gnu affero general public license version 3 19 november 2007": "agpl3.title",
    "mozilla public license version 2 0": "mpl2.title",
    "eclipse public license v 2 0": "epl2.title",
    "boost software license version 1 0 august 17th 2003": "boost.title",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21.later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3.later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3.later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3.later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2.only",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl.warranty",
    "this software is provided as is without any express or implied warranty": "zlib.warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib.grant",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib.altered",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost.grant",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd.short",
}
for _id, _names in NAMES.items():
    for _name in _names:
        SENTENCES[f"licensed under {_name}"] = f"{_id}.notice"
        if "licen" in _name:  # every sentence of the table has one of WORDS
            SENTENCES[f"under {_name}"] = f"{_id}.notice"
for _id, (_c, _e) in CREATIVE.items():
    _plain = f"creative commons {CONDITIONS[_c]} {_e.replace('.', ' ')}"
    _short = f"cc {_c.replace('-', ' ')} {_e.replace('.', ' ')}"
    for _name in (_short, f"{_short} license", f"{_plain} {EDITIONS[_e]} license", f"{_plain} license", _plain):
        SENTENCES[f"licensed under {_name}"] = f"{_id}.notice"
        if "licen" in _name:
            SENTENCES[f"under {_name}"] = f"{_id}.notice"
    TAGS[_id] = (f"CC-{_c.upper()}-{_e}",)
#: A tag of its own line; the sign "+" is read as a word, as normalisation would drop it.
for _id, _tags in TAGS.items():
    for _tag in _tags:
        SENTENCES["spdx license identifier " + _tag.lower().replace("+", " plus").replace("-", " ").replace(".", " ")] = f"{_id}.tag"
#: Ordered: licence, and the identifiers that make it up (fixed values).
RULES = (
    ("MIT", ("mit.grant", "mit.condition", "mit.warranty")),
    ("MIT", ("mit.grant", "mit.condition")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("Apache-2.0", ("apache2.notice", "apache2.compliance", "apache2.copy", "apache2.warranty")),
    ("Apache-2.0", ("apache2.notice", "apache2.compliance")),
    ("GPL-3.0-or-later", ("gpl3.later", "gpl.warranty", "gpl.copy")),
    ("GPL-2.0-or-later", ("gpl2.later", "gpl.warranty", "gpl.copy")),
    ("GPL-3.0-or-later", ("gpl3.later",)),
    ("GPL-2.0-or-later", ("gpl2.later",)),
    ("LGPL-2.1-or-later", ("lgpl21.later", "gpl.warranty")),
    ("LGPL-3.0-or-later", ("lgpl3.later", "gpl.warranty")),
    ("AGPL-3.0-or-later", ("agpl3.later", "gpl.warranty", "gpl.copy")),
    ("LGPL-2.1-or-later", ("lgpl21.later",)),
    ("LGPL-3.0-or-later", ("lgpl3.later",)),
    ("AGPL-3.0-or-later", ("agpl3.later",)),
    ("GPL-2.0-only", ("gpl2.only", "gpl.warranty")),
    ("GPL-2.0-only", ("gpl2.only",)),
    ("Zlib", ("zlib.warranty", "zlib.grant")),
    ("Zlib", ("zlib.grant",)),
    ("BSL-1.0", ("boost.title", "boost.grant")),
    ("BSL-1.0", ("boost.grant",)),
    ("ISC", ("isc.grant",)),
)
#: What a notice, tag or title that no rule took names (fixed values).
ALONE = {
    "mit": "MIT", "apache2": "Apache-2.0", "gpl2": "GPL-2.0", "gpl2.only": "GPL-2.0-only", "gpl2.later": "GPL-2.0-or-later", "gpl3": "GPL-3.0", "gpl3.only": "GPL-3.0-only",
    "gpl3.later": "GPL-3.0-or-later", "lgpl21": "LGPL-2.1", "lgpl21.only": "LGPL-2.1-only", "lgpl21.later": "LGPL-2.1-or-later", "lgpl3": "LGPL-3.0", "lgpl3.only": "LGPL-3.0-only",
    "lgpl3.later": "LGPL-3.0-or-later", "agpl3": "AGPL-3.0", "agpl3.only": "AGPL-3.0-only", "agpl3.later": "AGPL-3.0-or-later", "bsd2": "BSD-2-Clause", "bsd3": "BSD-3-Clause",
    "mpl2": "MPL-2.0", "epl1": "EPL-1.0", "epl2": "EPL-2.0", "isc": "ISC", "zlib": "Zlib", "boost": "BSL-1.0", "unlicense": "Unlicense", "wtfpl": "WTFPL", "cc0": "CC0-1.0",
    **{i: f"CC-{c.upper()}-{e}" for i, (c, e) in CREATIVE.items()},
}
RULES += tuple((ALONE[i.rpartition(".")[0]], (i,)) for i in dict.fromkeys(SENTENCES.values()) if i.endswith((".notice", ".tag", ".title")))
#: Each known sentence has one of these words, so a text without them has no known sentence.
WORDS = ("licen", "software", "redistribution", "copyright", "warranty")
# What may stand before a licence's name in a notice, and after it.
_THING = r"((this|the|our|all) )?((source )?(code|software|files?|program|library|project|package|module|work|works|document|documentation|content|text|material|dataset|data|repository|page|article|font) )?((in this (project|repository|package|file) )?(is|are|was) )?((hereby|made|also|dual) )*"
_TERMS = r" under ((the )?(terms|conditions)( and conditions)? of )?((the|a|an) )?"
LICENSED = f"^{_THING}licen[sc]ed{_TERMS}"
GIVEN = f"^{_THING}(released|distributed|available|published|provided|shared|covered){_TERMS}"
FILE = r" (see|refer to) (the )?(accompanying )?(licen[sc]e|copying|file)( .*)?$"
TAG = r"(?i)spdx-license-identifier:[ \t]*"
#: Ends of sentences without a mark: each line feed, or an empty line.
LINE, EMPTY_LINE = r"\n", r"\n\s*\n"


def sequence(text: Column, line_end: str) -> Column:
    """The identifiers of the known sentences of a text, in order; ``line_end`` is a pattern that ends sentences as well."""
    known = F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))
    sentences = F.split(F.regexp_replace(text, TAG, "spdx-license-identifier-"), r"[.:;!?]+(?=\s|$)|" + line_end)
    plain = F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"\+\s*$", " plus"), "[^a-z0-9]+", " ")))
    plain = F.transform(plain, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, LICENSED, "licensed under "), GIVEN, "under "), FILE, ""))
    return F.filter(F.transform(plain, lambda s: F.try_element_at(known, s)), lambda s: s.isNotNull())


def matched(ids: Column) -> Column:
    """(rest, licences): what is left of a sequence after all rules, and the licences that they named, in the rules' order."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{s}>" for s in parts)).alias("parts")) for name, parts in RULES))
    start = F.struct(F.concat_ws("", F.transform(ids, lambda s: F.concat(F.lit("<"), s, F.lit(">")))).alias("rest"), F.array().cast("array<string>").alias("licences"))
    step = lambda a, r: F.when(
        F.contains(a["rest"], r["parts"]), F.struct(F.replace(a["rest"], r["parts"], F.lit("|")).alias("rest"), F.array_union(a["licences"], F.array(r["name"])).alias("licences"))
    ).otherwise(a)
    return F.when(F.size(ids) > 0, F.aggregate(rules, start, step)).otherwise(start)


def with_licences(df: DataFrame, text: str = "text", licences: str = "licences", sentences: str = "licence_sentences") -> DataFrame:
    """All columns of ``df``, ``licences`` (sorted names) and ``licence_sentences`` (identifiers in order); such columns are replaced."""
    lined, wrapped, of_lines, of_text = fresh(df, "ids_by_line", "ids_by_text", "by_line", "by_text")
    value = text_of(text)
    lower = F.lower(value)
    worth = F.contains(lower, F.lit(WORDS[0]))
    for word in WORDS[1:]:
        worth = worth | F.contains(lower, F.lit(word))
    none = F.array().cast("array<string>")
    rest = [f"`{c}`" for c in df.columns if c.lower() not in (licences.lower(), sentences.lower())]
    read = df.select("*", F.when(worth, sequence(value, LINE)).otherwise(none).alias(lined), F.when(worth, sequence(value, EMPTY_LINE)).otherwise(none).alias(wrapped))
    read = read.select("*", matched(F.col(lined)).alias(of_lines), matched(F.col(wrapped)).alias(of_text))
    named = F.array_sort(F.array_union(F.col(of_lines)["licences"], F.col(of_text)["licences"]))
    longer = F.when(F.size(wrapped) > F.size(lined), F.col(wrapped)).otherwise(F.col(lined))
    return read.select(*rest, named.alias(licences), longer.alias(sentences))


def _sql() -> str:
    """The same result in SQL."""
    known = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items()) + "}"
    def plain(s: str) -> str:
        s = f"trim(regexp_replace(regexp_replace(lower({s}), '\\+\\s*$', ' plus'), '[^a-z0-9]+', ' ', 'g'))"
        for pattern, value in ((LICENSED, "licensed under "), (GIVEN, "under "), (FILE, "")):
            s = f"regexp_replace({s}, '{pattern}', '{value}')"
        return s

    ids = lambda line_end: (
        f"list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, chr(32)), '{TAG}', 'spdx-license-identifier-', 'g'), '[.:;!?]+(?:\\s|$)|{line_end}'), lambda s: {known}[{plain('s')}]), lambda s: s IS NOT NULL)"
    )
    steps, last = [], "read"
    several = [(name, parts) for name, parts in RULES if len(parts) > 1 or not parts[0].endswith((".notice", ".tag", ".title"))]
    for k, (name, parts) in enumerate(several):
        sequence_of = "".join(f"<{p}>" for p in parts)
        columns = ", ".join(
            f"replace(r{side}, '{sequence_of}', '|') AS r{side}, CASE WHEN contains(r{side}, '{sequence_of}') THEN list_append(n{side}, '{name}') ELSE n{side} END AS n{side}"
            for side in "ab"
        )
        steps.append(f"step{k} AS MATERIALIZED (SELECT doc_id, a, b, {columns} FROM {last})")
        last = f"step{k}"
    # Rules of one identifier come last and take nothing from each other.
    alone = "MAP {" + ", ".join(f"'{parts[0]}': '{name}'" for name, parts in RULES if (name, parts) not in several) + "}"
    named = ", ".join(f"list_concat(n{side}, list_filter(list_transform(regexp_extract_all(r{side}, '<([^>]+)>', 1), lambda s: {alone}[s]), lambda s: s IS NOT NULL)) AS n{side}" for side in "ab")
    steps.append(f"named AS (SELECT doc_id, a, b, {named} FROM {last})")
    last = "named"
    return (
        f"WITH ids AS MATERIALIZED (SELECT doc_id, {ids(LINE)} AS a, {ids(EMPTY_LINE)} AS b FROM documents),\n"
        "read AS (SELECT *, list_aggregate(list_transform(a, lambda s: '<' || s || '>'), 'string_agg', '') AS ra, list_aggregate(list_transform(b, lambda s: '<' || s || '>'), 'string_agg', '') AS rb, "
        "CAST([] AS VARCHAR[]) AS na, CAST([] AS VARCHAR[]) AS nb FROM ids),\n" + ",\n".join(steps)
        + f"\nSELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(na, nb))), ',') AS licences, "
        f"array_to_string(CASE WHEN len(b) > len(a) THEN b ELSE a END, ',') AS licence_sentences FROM {last}"
    )


SQL = _sql()
