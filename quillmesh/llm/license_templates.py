"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor folder.

Every line of a file that has a licence word is a notice, alone and in every run of up to three lines around
it, since notices are wrapped; each is compared with the templates. Document frequencies count all notices of the
corpus. Notices are compared once per different text, and only terms that a template has meet it, by an
equality join on the term. If the template names a version, a notice without that version, or with other variant words
(Lesser, ShareAlike) than the template, is no match, however close. A file's own licence is its best
notice. A licence file gives its licence to its folder, and a file without an own licence takes that of the nearest
folder above it that has one, by an equality join on the folders of its path.

Everything is DataFrame functions. The templates are a parameter, a few thousand terms.

Defined results: null and blank texts have no notice; a null path has no folder and inherits nothing; of
equal scores the licence that sorts first wins; repeated rows get one row each with the same result; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

THRESHOLD = 0.6
LICENSE_WORDS = r"licen[sc]|copyright|spdx|warrant|redistribut|public domain|all rights reserved"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|copyright|notice|unlicense)[^/]*$"
#: A term that is a version number, alone or after letters ending in v (v2, gplv3).
VERSION = r"^(?:[a-z]*v)?([0-9](?:\.[0-9]+)*?)(?:\.0)*$"
#: The most lines of a notice.
WINDOW = 3
#: Words that tell variants of one licence apart.
VARIANTS = {
    "affero": "affero",
    "agpl": "affero",
    "cc0": "zero",
    "lesser": "lesser",
    "lgpl": "lesser",
    "nc": "noncommercial",
    "nd": "noderivatives",
    "noncommercial": "noncommercial",
    "noderivatives": "noderivatives",
    "noderivs": "noderivatives",
    "sa": "sharealike",
    "sharealike": "sharealike",
}
#: A term without a version number at its end (lgplv3).
BARE = r"^([a-z]+?[0-9]?)(?:v[0-9.]+)?$"


def _creative_commons(letters: str, words: str) -> tuple[str, ...]:
    return (f"Licensed under CC {letters} 4.0.", f"This work is licensed under a Creative Commons {words} 4.0 International License.", f"SPDX-License-Identifier: CC-{letters}-4.0")


def _gnu(short: str, words: str, version: str) -> tuple[str, ...]:
    return (
        f"This work is licensed under the GNU {words}, version {version}.",
        f"Licensed under the {short} version {version}.",
        f"Licensed under the {short}v{version}.",
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {words} version {version}.",
        f"it under the terms of the GNU {words} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"SPDX-License-Identifier: {short}-{version if '.' in version else version + '.0'}-only",
        f"SPDX-License-Identifier: {short}-{version if '.' in version else version + '.0'}-or-later",
    )


#: Sentences by which licences are named or granted; several per licence.
TEMPLATES: Mapping[str, tuple[str, ...]] = {
    "AGPL-3.0": _gnu("AGPL", "Affero General Public License", "3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "CC-BY-4.0": _creative_commons("BY", "Attribution"),
    "CC-BY-NC-4.0": _creative_commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _creative_commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative_commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _creative_commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _creative_commons("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ("Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "EPL-2.0": ("made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"),
    "GPL-2.0": _gnu("GPL", "General Public License", "2"),
    "GPL-3.0": _gnu("GPL", "General Public License", "3"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "LGPL-2.1": _gnu("LGPL", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("LGPL", "Lesser General Public License", "3"),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction; warranty.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def versions(found: Column) -> Column:
    """The version numbers among terms, 2.0 being 2; years and counts over 9 are none."""
    return F.filter(F.transform(found, lambda t: F.regexp_extract(t, VERSION, 1)), lambda v: v != "")


def variants(found: Column) -> Column:
    """The variant words among terms, under one name each."""
    names = F.create_map(*(F.lit(x) for pair in VARIANTS.items() for x in pair))
    named = F.transform(found, lambda t: F.element_at(names, F.regexp_extract(t, BARE, 1)))
    return F.array_sort(F.array_distinct(F.filter(named, lambda v: v.isNotNull())))


def notices(lines: Column) -> Column:
    """The lines with a licence word, each in every run of up to ``WINDOW`` lines that holds it.

    ``lines`` should be a plain column: an expression would be computed again for each notice.
    """
    marked = F.filter(F.transform(lines, lambda x, i: F.when(F.lower(x).rlike(LICENSE_WORDS), i + 1)), lambda i: i.isNotNull())
    runs = F.transform(marked, lambda i: F.array(*(F.array_join(F.slice(lines, F.greatest(i - back, F.lit(1)), n), " ") for n in range(1, WINDOW + 1) for back in range(n))))
    return F.array_distinct(F.flatten(runs))


def _weights(counted: DataFrame, idf: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, weight) with vectors of length one, from (key, term, tf)."""
    raw = counted.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(*key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def score_lines(lines: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(line_id, license, score) for each different line of (line_id, line) that comes near a template."""
    spark = lines.sparkSession
    different = stored(lines.groupBy("line_id").agg(F.min("line").alias("line"), F.count("*").alias("n")))
    counted = different.select("line_id", "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("line_id", "n", "term").agg(F.count("*").alias("tf"))
    total = different.agg(F.sum("n")).first()[0] or 0
    forms = [(name, f"{name}#{i}", text) for name, texts in templates.items() for i, text in enumerate(texts)]
    forms = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(f, ("license", "form", "text"), strict=True))) for f in forms))))
    known = forms.select("license", "form", F.explode(terms(F.col("text"))).alias("term")).groupBy("license", "form", "term").agg(F.count("*").alias("tf"))
    found = counted.groupBy("term").agg(F.sum("n").alias("df")).unionByName(known.select("term", F.lit(0).cast("long").alias("df")))
    idf = found.groupBy("term").agg((F.log((F.lit(total) + 1.0) / (F.sum("df") + 1.0)) + 1.0).alias("idf"))
    own = _weights(counted.select("line_id", "term", "tf"), idf, ["line_id"])
    theirs = _weights(known, idf, ["license", "form"]).withColumnRenamed("weight", "other")
    scores = own.join(theirs, "term").groupBy("line_id", "license", "form").agg(F.round(F.sum(F.col("weight") * F.col("other")), 6).alias("score"))
    guards = lambda c, p: (versions(terms(F.col(c))).alias(f"{p}_versions"), variants(terms(F.col(c))).alias(f"{p}_variants"))
    scores = scores.where(F.col("score") >= threshold).join(different.select("line_id", *guards("line", "own")), "line_id").join(forms.select("form", *guards("text", "form")), "form")
    same = F.arrays_overlap("own_versions", "form_versions") & (F.col("own_variants") == F.col("form_variants"))
    best = scores.where((F.size("form_versions") == 0) | same).groupBy("line_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("line_id", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def folders(path: Column) -> Column:
    """The folders above a path, the nearest first, the root being empty."""
    parts = F.split(path, "/")
    up = F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1))
    return F.transform(up, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(files: DataFrame, keep: Sequence[str] = (), templates: Mapping[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """From (path, text): the columns to ``keep``, path, own_license, own_score, license, inherited_from; one row per row."""
    text = F.coalesce("text", F.lit(""))
    rows = files.select(F.struct(*keep, F.col("path")).alias("row"), "path", F.xxhash64(text).alias("digest"), F.split(text, "\n").alias("lines"))
    rows = rows.select("row", "path", "digest", notices(F.col("lines")).alias("notices"))
    rows = stored(rows)
    lines = rows.select("path", "digest", F.explode("notices").alias("line")).withColumn("line_id", F.xxhash64("line"))
    scored = score_lines(lines.select("line_id", "line"), templates, threshold)
    pick = F.min(F.struct((-F.col("score")).alias("s"), "license"))
    own = stored(lines.select("path", "digest", "line_id").join(scored, "line_id").groupBy("path", "digest").agg(pick.alias("b")))
    own = own.select(F.col("path").alias("_path"), F.col("digest").alias("_digest"), F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"))
    given = own.where(F.col("_path").rlike(LICENSE_FILE)).select(F.element_at(folders(F.col("_path")), 1).alias("folder"), F.col("own_license").alias("license"), F.col("own_score").alias("score"))
    given = given.groupBy("folder").agg(pick.alias("b")).select("folder", F.col("b.license").alias("given"))
    own_row = F.col("path").eqNullSafe(F.col("_path")) & (F.col("digest") == F.col("_digest"))
    files_ = rows.select("row", "path", "digest").join(own, own_row, "left").select("row", "path", "own_license", "own_score")
    bare = files_.where("own_license IS NULL AND path IS NOT NULL").select("path").distinct()
    near = bare.select("path", F.posexplode(folders(F.col("path"))).alias("up", "folder")).join(given, "folder")
    near = near.groupBy("path").agg(F.min(F.struct("up", "folder", "given")).alias("b")).select(F.col("path").alias("_path"), F.col("b.folder").alias("folder"), F.col("b.given").alias("given"))
    out = files_.join(near, (F.col("path") == F.col("_path")) & F.col("own_license").isNull(), "left")
    return out.select("row.*", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"), F.col("folder").alias("inherited_from"))
