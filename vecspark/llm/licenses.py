"""Licence notices in texts, in built-in expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.registry import documents, query
from vecspark.llm.text import only

#: Notices of common licences as their owners recommend them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "all-rights-reserved": ("All rights reserved.",),
}


def template_bigrams(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """(licence, distinct bigrams) of each notice."""
    out = []
    for name, texts in sorted(templates.items()):
        for t in texts:
            w = re.sub(r"[\W_]+", " ", t.lower()).split()
            out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:])})))
    return out


def _bigrams(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))
    ).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_dice: float = 0.8,
                  templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Lines, and whole texts of several lines, whose word bigrams match a notice.

    Case and everything but letters and digits are normalised away. The coefficient of two bigram sets is
    2 * shared / (a + b); as shared is at most the smaller size, only notices with
    ``a * d / (2 - d) <= b <= a * (2 - d) / d`` are compared at all.

    Returns (doc_id, line, license, dice, n_bigrams): the best notice of each unit that reaches ``min_dice`` (ties:
    the first name). ``line`` counts from 0; -1 is the whole text. Null and empty texts match nothing; repeated rows
    report each; a table without rows gives none. All work stays within the row.
    """
    units = only(docs, id_col, text_col).where("text IS NOT NULL").select(
        "doc_id", F.split(F.col("text"), "\n").alias("lines"), "text")
    units = units.select("doc_id", F.posexplode(F.when(
        F.size("lines") > 1, F.concat(F.array("text"), "lines")).otherwise(F.col("lines"))).alias("k", "unit"),
        (F.size("lines") > 1).alias("many"))
    w = F.array_remove(F.split(F.regexp_replace(F.lower("unit"), r"[^\p{L}\p{N}]+", " "), " "), "")
    units = units.select("doc_id", F.when(F.col("many"), F.col("k") - 1).otherwise(F.col("k")).cast("long").alias("line"),
                         w.alias("w"))
    units = units.select("doc_id", "line", _bigrams(F.col("w")).alias("b"))
    units = units.select("doc_id", "line", "b", F.size("b").cast("long").alias("n_bigrams"))
    grams = template_bigrams(templates)
    # ties go to the first name: the rank counts down
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(-k).alias("rank"), F.lit(len(g)).alias("a"),
                               F.array(*map(F.lit, g)).alias("g")) for k, (name, g) in enumerate(grams)])
    n = F.col("n_bigrams")
    near = F.filter(known, lambda t: (n * (2 - min_dice) >= t["a"] * min_dice) & (n * min_dice <= t["a"] * (2 - min_dice)))
    best = F.array_max(F.transform(near, lambda t: F.struct(
        (F.lit(2.0) * F.size(F.array_intersect(F.col("b"), t["g"])) / (n + t["a"])).alias("dice"),
        t["rank"].alias("rank"), t["license"].alias("license"))))
    # through a generator, so that the condition on the result is not evaluated once more below it
    return (units.select("doc_id", "line", "n_bigrams", F.explode_outer(F.array(best)).alias("m"))
            .where(F.col("m.dice") >= min_dice)
            .select("doc_id", "line", F.col("m.license").alias("license"), F.col("m.dice").alias("dice"), "n_bigrams"))


def _sql() -> str:
    rows = ",\n".join("({}, '{}', [{}])".format(k, name, ", ".join(f"'{g}'" for g in grams))
                      for k, (name, grams) in enumerate(template_bigrams()))
    return f"""
WITH t(k, license, b) AS (VALUES {rows}),
l AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i - 1 AS line, l[i] AS unit FROM l, range(1, (SELECT max(len(l)) FROM l) + 1) r(i) WHERE i <= len(l)
  UNION ALL SELECT doc_id, -1, text FROM l WHERE len(l) > 1),
w AS (SELECT doc_id, line, list_filter(string_split(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '),
  lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM w WHERE len(w) > 1),
m AS (SELECT doc_id, line, k, license, CAST(len(g.b) AS BIGINT) AS n_bigrams,
  2.0::DOUBLE * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice FROM g, t
  WHERE len(g.b) BETWEEN 1 AND 200)
SELECT doc_id, CAST(line AS BIGINT) AS line, license, dice, n_bigrams FROM m WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, k) = 1"""


@query("op6_license_scan", _sql())
def op6(spark, sf):
    return scan_licenses(documents(spark, sf))
