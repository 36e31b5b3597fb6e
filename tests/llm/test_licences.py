"""Cosines against plain code, inheritance from the nearest directory, odd rows; the given statements are all found."""

import math
import re
from collections import Counter

from flowarden.llm import licences as L
from flowarden.llm.queries import QUERIES

TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def slow_best(texts):
    bags = [Counter(TERM.findall(t.lower())) for t in [*texts, *(t for _, t in L.TEMPLATES)]]
    df = Counter(t for b in bags for t in b)
    weigh = [{t: n * (math.log((1 + len(bags)) / (1 + df[t])) + 1) for t, n in b.items()} for b in bags]
    size = [math.sqrt(sum(w * w for w in b.values())) for b in weigh]
    out = {}
    for i, text in enumerate(texts):
        scores = [(-round(sum(w * weigh[j].get(t, 0) for t, w in weigh[i].items()) / (size[i] * size[j] or 1), 9), L.TEMPLATES[j - len(texts)][0]) for j in range(len(texts), len(bags))]
        if texts[i] and -min(scores)[0] >= L.LEAST_COSINE:
            out[text] = (min(scores)[1], -min(scores)[0])
    return out


def test_cosines(spark):
    texts = [t for _, t in L.TEMPLATES] + ["licensed*** under### CC%%% BY-NC 4.0", "a licence to something else", "the GNU General Public License, version 2", "no term: ¡!", "mit license mit"]
    got = {r.bag: (r.licence, r.cosine) for r in L.best_templates(spark.createDataFrame([(t,) for t in texts + texts[:3]], "text string")).collect()}
    want = slow_best(texts)
    assert got.keys() == want.keys()
    assert all(got[t][0] == want[t][0] and abs(got[t][1] - want[t][1]) < 1e-6 for t in want)


FILES = [
    ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", "MIT", "own"),
    ("a/b/c.py", "code", "MIT", "inherited"), ("a/b/own.py", "# SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0", "own"), ("a/b/d/COPYING", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "GPL-3.0", "own"),
    ("a/b/d/e/f.c", None, "GPL-3.0", "inherited"), ("ab/x.py", "code", None, None), ("top.py", "", None, None), (None, "Released under the MIT License.", "MIT", "own"), (None, "code", None, None),
    ("z/long.txt", "word " * 40_000 + "\nLicensed under CC BY-NC 4.0.\n" + "w" * 50_000, "CC-BY-NC-4.0", "own"), ("ab/x.py", "code", None, None), ("z/LICENSE.md", "no known licence here", None, None), ("z/y", "the license of a poet", None, None),
]


def test_inheritance(spark):
    df = spark.createDataFrame([(p, t, "x", 1) for p, t, _, _ in FILES], "path string, text string, licence string, body int")
    got = L.scan(df).collect()
    assert sorted((str(r.path), str(r.text), str(r.licence), str(r.licence_from)) for r in got) == sorted(tuple(map(str, f)) for f in FILES)
    assert set(df.columns) | {"cosine", "licence_from"} == set(L.scan(df).columns)
    assert L.scan(df.limit(0)).count() == 0


def test_documents(spark, sf_dir):
    got = {r.doc_id: r.licence for r in QUERIES["op8_licence_scan"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    marks = {"CC BY-NC 4.0": "CC-BY-NC-4.0", "the MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0", "GNU General Public License, version 3": "GPL-3.0", "All rights reserved": "Proprietary"}
    assert len(got) == len(docs)
    for d in docs:
        assert got[d.doc_id] == next((v for k, v in marks.items() if k in d.text), None)


# usual headers as they stand in files, wrapped and behind comment marks
HEADERS = [
    ("GPL-2.0", """/*
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */
int main;"""),
    ("GPL-3.0", """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

import os"""),
    ("BSD-3-Clause", """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions
// are met:
//   * Redistributions of source code must retain the notice"""),
    ("MPL-2.0", """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""),
    ("MIT", """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish"""),
    ("Apache-2.0", """; Licensed under the Apache License, Version 2.0 (the "License");
; you may not use this file except in compliance with the License.
; You may obtain a copy of the License at"""),
]


def test_wrapped_headers(spark):
    rows = [(f"src/{i}.c", text) for i, (_, text) in enumerate(HEADERS)] * 2
    got = {r.path: r.licence for r in L.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {f"src/{i}.c": name for i, (name, _) in enumerate(HEADERS)}


def test_query_inherits(spark, tmp_path):
    """Licence files among the documents govern what lies below them, the nearest one first."""
    says = {0: "Released under the MIT License.", 1200: "Licensed under CC BY-NC 4.0.", 1240: "All of it.\nSPDX-License-Identifier: Apache-2.0", 1245: "SPDX-License-Identifier: GPL-3.0\ncode"}
    docs = [(i, says.get(i, "plain words"), "en", source, 11) for source, ids in (("src1", (0, 7, 1105, 1200, 1241, 1240, 1245, 1301)), ("src2", (8, 1232)), (None, (9,))) for i in ids]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.licence, r.licence_in_force, r.licence_from) for r in QUERIES["op8_licence_scan"](spark, str(tmp_path)).collect()}
    own = {0: "MIT", 1200: "CC-BY-NC-4.0", 1240: "Apache-2.0", 1245: "GPL-3.0"}
    inherited = {7: "MIT", 1105: "CC-BY-NC-4.0", 1241: "Apache-2.0", 1301: "CC-BY-NC-4.0"}
    assert got == {i: (own.get(i), own.get(i) or inherited.get(i), "own" if i in own else "inherited" if i in inherited else None) for i, *_ in docs}
