"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Units are the lines of a text and, where it has several lines, its paragraphs
(parts between blank lines).  Two sets of bigrams with a Dice coefficient of t
have sizes within a factor of (2 - t) / t, so a unit is compared only with
templates in that range.  All of it is a map over rows in DataFrame functions;
templates are a fixed list, a few kilobytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence notices and paragraphs of licence texts.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_OTHER = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.translate(str.maketrans(_UPPER, _LOWER)))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def licence_matches(text: Column, threshold: float = 0.8) -> Column:
    """Array of (license, unit, at, dice) of the units of a text that match a template.

    ``unit`` is line or paragraph and ``at`` its number from 0.  Null where the
    text is null, empty where nothing matches; units of fewer than two words
    have no bigram and never match.
    """
    known = [(name, template_bigrams(t)) for name, t in TEMPLATES]
    templates = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(len(b)).alias("size"), F.array(*map(F.lit, b)).alias("bigrams")) for n, b in known])
    least = min(len(b) for _, b in known) * threshold / (2 - threshold)
    most = max(len(b) for _, b in known) * (2 - threshold) / threshold

    def units(parts: Column, kind: str) -> Column:
        return F.transform(parts, lambda s, at: F.struct(F.lit(kind).alias("unit"), at.alias("at"), F.split(F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), _OTHER, " ")), " ").alias("words")))

    lines = units(F.split(text, "\n"), "line")
    blocks = units(F.when(F.instr(text, "\n") > 0, F.split(text, r"\n[\x20\t\r]*\n")).otherwise(F.array().cast("array<string>")), "paragraph")
    long_enough = F.filter(F.concat(lines, blocks), lambda u: F.size(u["words"]) - 1 >= least)
    # each lambda's variable is computed once for its element
    sets = F.transform(
        long_enough,
        lambda u: F.struct(
            u["unit"].alias("unit"),
            u["at"].alias("at"),
            F.array_distinct(F.zip_with(F.slice(u["words"], 1, F.size(u["words"]) - 1), F.slice(u["words"], 2, F.size(u["words"]) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).alias("bigrams"),
        ),
    )
    near = F.filter(sets, lambda u: F.size(u["bigrams"]).between(F.lit(least), F.lit(most)))

    def compared(u: Column) -> Column:
        size = F.size(u["bigrams"])
        fits = F.filter(templates, lambda t: (size >= t["size"] * threshold / (2 - threshold)) & (size <= t["size"] * (2 - threshold) / threshold))
        return F.transform(fits, lambda t: F.struct(t["license"].alias("license"), u["unit"].alias("unit"), u["at"].alias("at"), F.round(2.0 * F.size(F.array_intersect(u["bigrams"], t["bigrams"])) / (size + t["size"]), 6).alias("dice")))

    return F.filter(F.flatten(F.transform(near, compared)), lambda m: m["dice"] >= threshold)


def scan_licences(docs: DataFrame, text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs with licence_matches; every row stays, an equally named column is replaced, a null text has no matches."""
    none = F.array().cast("array<struct<license:string,unit:string,at:int,dice:double>>")
    return docs.withColumn("licence_matches", F.coalesce(licence_matches(F.col(text_col), threshold), none))


def dice_sql(threshold: float = 0.8) -> str:
    """The same scan in DuckDB SQL, every unit against every template."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(name)}, [{', '.join(map(quote, template_bigrams(t)))}])" for name, t in TEMPLATES)
    words = f"regexp_extract_all(translate(s, '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return rf"""
WITH t(license, tb) AS (VALUES {rows}
), ls AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
), ps AS (SELECT doc_id, string_split_regex(text, '\n[\x20\t\r]*\n') AS parts FROM documents WHERE contains(text, chr(10))
), units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(0, len(parts))) AS pos, unnest(parts) AS s FROM ls
  UNION ALL SELECT doc_id, 'paragraph', unnest(range(0, len(parts))), unnest(parts) FROM ps
), w AS (SELECT doc_id, unit, pos, {words} AS ws FROM units
), g AS (SELECT doc_id, unit, pos, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS ub FROM w WHERE len(ws) > 1
), m AS (SELECT doc_id, unit, pos, license, round(2.0 * len(list_intersect(ub, tb)) / (len(ub) + len(tb)), 6) AS dice FROM g, t WHERE len(ub) <= 1000
), hit AS (SELECT doc_id, count(*) AS n, max(dice) AS best, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM m WHERE dice >= {threshold} GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(best, 0.0) AS best_dice, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN hit USING (doc_id)
"""
