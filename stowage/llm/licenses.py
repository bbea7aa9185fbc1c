"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment confirms.

Everything runs as DataFrame expressions on each row alone; nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.registry import query, table
from stowage.llm.shingles import MARKS, shingles, sql_shingles, words

# Published notices of licenses.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
    "gpl-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version."),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version."),
    "lgpl-3.0-notice": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."),
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
    "cc0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to "
        "this work to the public domain worldwide."),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-sa-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc-by-4.0-line": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0",
}

#: A license is in a document that holds at least this share (tenths) of its distinct shingles.
TENTHS = 8
#: Minima are kept of each block of so many shingles; windows are runs of whole blocks.
BLOCK = 8
#: Bands of one minimum each. A window that holds the required share shares no band with its template with a
#: probability below ``MISS`` (see ``band_count``).
MISS = 1e-6
#: Templates up to this size are looked up by windows of their own size, at every place.
SMALL = 4


def window_blocks(n: int) -> tuple[int, int]:
    """Blocks in a window, and from one window to the next, such that any ``n`` shingles in a row lie in one."""
    step = max(1, n // (2 * BLOCK))
    return -(-(n - 1) // BLOCK) + step, step


def band_count(n: int) -> int:
    """Bands needed for a template of ``n`` shingles; one is enough if the window must hold all of it."""
    inside = -(-n * TENTHS // 10)
    if n <= SMALL:
        return 1
    shared = inside / (window_blocks(n)[0] * BLOCK + n - inside)
    return math.ceil(math.log(MISS) / math.log(1 - shared))


def _mask(band: int) -> int:
    """Each band orders the hashes anew by flipping fixed bits of them."""
    value = band * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def _longs(values) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _block_minima(masks: Column) -> Column:
    """For each band the minimum of each block of column ``sh``."""
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size("sh") - 1) / BLOCK), F.lit(0)).cast("int"))
    return F.transform(masks, lambda mask: F.transform(blocks, lambda j: F.array_min(F.transform(
        F.slice("sh", j * BLOCK + 1, F.lit(BLOCK)), lambda h: h.bitwiseXOR(mask)))))


def _window_keys() -> Column:
    """Band keys of all windows of a shape (``small``, or ``blocks``, ``step`` and ``bands``)."""
    of = lambda name: F.col(f"shape.{name}")
    small = F.transform(F.sequence(F.lit(1), F.greatest(F.size("sh") - (of("small") - 1), F.lit(1))),
                        lambda i: F.array_min(F.slice("sh", i, of("small"))))
    windows = F.flatten(F.transform(F.slice("least", F.lit(1), of("bands")), lambda band: F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(band), F.lit(1)), of("step")), lambda i: F.array_min(F.slice(band, i, of("blocks"))))))
    return F.when(of("small") > 0, small).otherwise(windows)


def shape_of(n: int) -> tuple[int, int, int, int]:
    """(small, blocks, step, bands) of the windows that a template of ``n`` shingles is looked up by."""
    return (n, 0, 1, 1) if n <= SMALL else (0, *window_blocks(n), band_count(n))


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Returns (key, license, n_template, n_found) for each template that is in a document.

    Words are runs of letters and digits. Templates of fewer than five words are not looked for. Null and
    empty texts hold nothing. Rows are judged alone: repeated rows come out repeated, an empty table gives an
    empty one, and other columns are not looked at.
    """
    spark = docs.sparkSession
    listed = spark.createDataFrame(list(templates.items()), "license string, text string")
    cut = listed.select("license", words(F.col("text"), MARKS).alias("w")).where(F.size("w") >= 5)
    # As many rows as there are templates.
    known = [(r["license"], sorted(r["sh"])) for r in cut.select(
        "license", F.array_distinct(shingles("w")).alias("sh")).orderBy("license").collect()]
    shapes = sorted({shape_of(len(sh)) for _, sh in known})
    masks = [_mask(band) for band in range(max((s[3] for s in shapes), default=1))]
    keys = {name: [min(h ^ mask for h in sh) for mask in masks[:shape_of(len(sh))[3]]] for name, sh in known}
    catalogue = spark.createDataFrame(
        [(shapes.index(shape_of(len(sh))), name, len(sh), sh, keys[name]) for name, sh in known],
        "number int, license string, n_template long, of_template array<long>, keys array<long>")

    rows = docs.select(F.col(key).alias("key"), words(F.col(text), MARKS).alias("w")).select(
        "key", shingles("w").alias("sh"))
    # The key of a band is one shingle, so a window can only have it in a text that holds this very shingle: the
    # windows are worked out for those texts alone.
    told = sorted({k ^ mask for own in keys.values() for k, mask in zip(own, masks, strict=False)})
    # By a generator, because a filter would be pushed below the shingles and work them out for each of their places.
    rows = rows.select("key", F.explode(F.filter(F.array("sh"), lambda s: F.arrays_overlap(s, _longs(told or [0])))).alias("sh"))
    by_shape = F.expr("array({})".format(", ".join(
        "named_struct('number', {}, 'small', {}, 'blocks', {}, 'step', {}, 'bands', {})".format(i, *shape)
        for i, shape in enumerate(shapes or [(1, 0, 1, 1)]))))
    looked = rows.withColumn("least", _block_minima(_longs(masks))).withColumn("shape", F.explode(by_shape))
    met = looked.select("key", "sh", F.col("shape.number").alias("number"), _window_keys().alias("of_windows")).join(
        F.broadcast(catalogue), "number").where(F.arrays_overlap("of_windows", "keys"))
    return met.select(F.col("key").alias(key), "license", "n_template", F.size(F.array_intersect("of_template", "sh")).cast(
        "long").alias("n_found")).where(F.col("n_found") * 10 >= F.col("n_template") * TENTHS)


def _oracle() -> str:
    listed = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEMPLATES.items())
    between = r"[\p{L}\p{N}]+"
    return f"""
WITH t(license, text) AS (VALUES {listed}),
d AS ({sql_shingles('documents', 'doc_id', between)}), l AS ({sql_shingles('t', 'license', between)}),
n AS (SELECT license, count(*) AS n_template FROM l GROUP BY license)
SELECT doc_id, license, n_template, count(*) AS n_found FROM d JOIN l USING (s) JOIN n USING (license)
GROUP BY doc_id, license, n_template HAVING count(*) * 10 >= n_template * {TENTHS}
"""


@query("op6_license_scan", _oracle())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
