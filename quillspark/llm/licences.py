"""Licence scan: a trained paragraph classifier in column expressions alone.

Sparse word n-gram logistic regression (one- and two-word grams, hashed into a fixed number of
weights) gives each paragraph a probability for each licence family and for "none". The model is
fitted on the driver from the statements below, which need no corpus; a temperature and the
least probability of a family are set on statements held out from the fit. A family named by the classifier
is confirmed by comparing two-word grams with that family's statements.

On the executors everything is Spark SQL: weights and statements are literals of fixed size, texts are
never exploded or shuffled, and a paragraph without any of the anchor words is "none" at once.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = 1 << 12
NONE = "none"
UNKNOWN = "unknown"

# Names of licences by family, and well-known sentences of their texts and notices.
NAMES = {
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License"],
    "MIT": ["MIT License", "MIT licence", "MIT", "Expat License", "The MIT License (MIT)"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD 2-Clause License", "BSD-2-Clause", "New BSD License", "Simplified BSD License"],
    "ISC": ["ISC License", "ISC licence", "ISC"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL", "GPL-3.0", "GPLv3", "GPL version 2", "GNU General Public License, version 2", "GPLv2", "GPL-2.0-or-later"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL", "LGPL-2.1", "LGPLv3", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL", "AGPL-3.0", "AGPLv3"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0"],
    "EPL": ["Eclipse Public License", "Eclipse Public License, version 2.0", "EPL-2.0", "EPL 1.0"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "Public domain": ["CC0 1.0", "CC0", "CC0 1.0 Universal public domain dedication", "Unlicense", "public domain"],
}
#: Licences of no family, which teach the class "unknown".
OTHERS = [
    "Artistic License 2.0", "Boost Software License 1.0", "zlib License", "PostgreSQL License", "European Union Public Licence 1.2", "SIL Open Font License 1.1", "Academic Free License 3.0", "Common Development and Distribution License",
    "Ruby License", "PHP License 3.01", "Python Software Foundation License", "Server Side Public License", "Business Source License 1.1", "Elastic License 2.0", "Microsoft Public License", "Microsoft Reciprocal License", "Q Public License",
    "LaTeX Project Public License 1.3c", "Sun Public License", "Netscape Public License", "IBM Public License 1.0", "Common Public License 1.0", "Open Data Commons Open Database License", "CeCILL License 2.1", "Beerware License", "JSON License", "Hippocratic License",
    "Acme Internal License", "Northwind Source License", "Blue River Content License", "Partner License 4.2", "Community Tools License",
]
#: Words of names that tell no licence from another.
GENERIC = frozenset("the a an license licence licenses public general software version free open new of and in 1.0 1.1 2.0 3.0 4.0 0 1 2 3 4 international source".split())
FRAMES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is distributed under the {}.",
    "Distributed under the terms of the {}.", "Available under the {}.", "This project is made available under the {}.", "The content of this site is published under {}.", "License: {}", "SPDX-License-Identifier: {}",
    "You may use this file under the terms of the {}.", "See the {} for details.",
]
SENTENCES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache": [
        "You may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution."],
    "Public domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work has been dedicated to the public domain."],
    "Proprietary": [
        "All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This document is proprietary and confidential.", "Copyright 2021 Example Corporation. All rights reserved.", "Reproduction in whole or in part without written permission is prohibited.", "Proprietary license. All rights reserved.",
    ],
    NONE: [
        "He lost his driving licence in the spring.", "The pub has a licence to sell beer.", "You need a fishing license to fish here.", "She asked for permission to leave the room.", "Permission to land was granted by the tower.", "The copyright office is open on Mondays.",
        "A copyright dispute between two bands ended in court.", "The warranty of the car had expired.", "Our warranty covers parts for two years.", "The licensed therapist works in the city.", "Licensed products were sold at the fair.", "Apache helicopters flew over the valley.", "The Apache people live in the southwest.",
        "The eclipse could be seen by the public.", "Gnu and zebra crossed the river.", "He studied at MIT in Boston.", "Redistribution of wealth is a policy question.", "The general public may attend.", "The Mozilla browser was opened.", "The license plate of the car was dirty.", "The software is provided by the school.", "The road is closed to the public.",
        "Rights of way cross the field.", "Human rights are protected by law.", "They distributed leaflets under the bridge.", "The attribution of the painting is doubtful.", "It was released under pressure.", "The film was released in the summer.", "The work is available at the library.", "See the map for details.", "You may use this door.", "The project is made of wood.",
    ],
}
_COMMON = r"(?i)licen[cs]|copyright|rights\s+reserved|warrant|redistribut|permission|permitted|public\s+domain|creative\s+commons|\bcc0\b|\bcc[\s-]by\b|spdx|\bgnu\b|\b[al]?gpl|apache|mozilla|\bmpl\b|\bbsd\b|proprietary|prohibited|waived"
#: A paragraph with none of these is none of a licence's. Names that the common words miss (MIT, ISC, EPL) count as they are written: in small letters they can be words.
ANCHORS = _COMMON + "|(?-i:" + "|".join(sorted({rf"\b{re.match('[A-Za-z]+', n)[0]}(?:\b|v?[0-9])" for own in NAMES.values() for n in own if not re.search(_COMMON, n)})) + ")"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: What parts paragraphs; and a line break within a sentence, with what marks a comment or quotation on the next line.
UNIT, SOFT = r"\n|(?<=[.!?])\s+", r"(?<![.!?:;\s])[ \t]*\r?\n[ \t]*(?:(?:#+|//+|\*+|;+|--|>+)[ \t]+)?(?=[\"'(A-Za-z])"


def _grams(text: str) -> list[str]:
    w = re.findall(WORD, text.lower())
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))})


def _slot(gram: str) -> int:
    """Spark's xxhash64 of the gram, modulo the number of weights."""
    h = xxhash.xxh64_intdigest(gram.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % WEIGHTS


def statements() -> list[tuple[str, str]]:
    """(family, statement), all that the model is fitted on."""
    out = [(family, frame.format(name)) for family, names in [*NAMES.items(), (UNKNOWN, OTHERS)] for name in names for frame in FRAMES]
    return out + [(family, s) for family, own in SENTENCES.items() for s in own for _ in range(8)]


@lru_cache(maxsize=1)
def model() -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(families, weights by family and slot, biases, least probability): multinomial logistic regression by Adam."""
    rows = statements()
    families = sorted({f for f, _ in rows})
    slots = [sorted({_slot(g) for g in _grams(s)}) for _, s in rows]
    used = sorted({x for own in slots for x in own})
    at = {x: k for k, x in enumerate(used)}
    x = np.zeros((len(rows), len(used)), np.float32)
    for k, own in enumerate(slots):
        x[k, [at[s] for s in own]] = 1 / np.sqrt(len(own))
    y = np.array([families.index(f) for f, _ in rows])
    share = np.bincount(y, minlength=len(families))
    # statements of one frame in seven, or one sentence in seven, are held out for the calibration; of licences of no family, one name in three as a whole
    strange = [k for k, (f, _) in enumerate(rows) if f == UNKNOWN]
    unseen = {k for k in strange if any(name in rows[k][1] for name in OTHERS[::3])}
    held = np.array([k in unseen or (f != UNKNOWN and xxhash.xxh32_intdigest(text) % 7 == 0) for k, (f, text) in enumerate(rows)])

    def fit(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, t = x[keep], np.eye(len(families), dtype=np.float32)[y[keep]]
        pull = (1 / share[y[keep]]).astype(np.float32)[:, None]
        pull /= pull.mean()
        w = [np.zeros((len(used), len(families)), np.float32), np.zeros(len(families), np.float32)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        for step in range(1, 151):
            z = a @ w[0] + w[1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            e = (p / p.sum(axis=1, keepdims=True) - t) * pull / len(a)
            for k, g in enumerate((a.T @ e + 1e-5 * w[0], e.sum(axis=0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                w[k] -= 0.2 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return w[0], w[1]

    w, b = fit(~held)
    z = x[held] @ w + b
    loss = {}
    for heat in np.geomspace(0.2, 5, 25):
        p = z / heat
        p = p - p.max(axis=1, keepdims=True)
        loss[heat] = float((np.log(np.exp(p).sum(axis=1)) - p[np.arange(len(p)), y[held]]).mean())
    heat = min(loss, key=loss.get)
    p = np.exp((z - z.max(axis=1, keepdims=True)) / heat)
    p /= p.sum(axis=1, keepdims=True)
    right = p.argmax(axis=1) == y[held]
    # the least probability: what all but one in fifty right ones reach; but all but one in fifty unseen names stay below it, where they seem of a family
    least = float(np.clip(np.quantile(p.max(axis=1)[right], 0.02), 0.3, 0.7))
    wrong = p.max(axis=1)[(y[held] == families.index(UNKNOWN)) & ~right]
    if len(wrong):
        least = float(min(0.9, max(least, np.quantile(wrong, 0.98))))
    w, b = fit(np.ones(len(rows), bool))
    full = np.zeros((len(families), WEIGHTS))
    full[:, used] = w.T / heat
    return families, full, b / heat, least


def name_templates() -> dict[str, list[list[str]]]:
    """Of each family, the grams of its names without what any licence's name may have."""
    out: dict[str, list[list[str]]] = {}
    for family, names in NAMES.items():
        for name in names:
            own = [g for g in _grams(name) if not set(g.split()) <= GENERIC]
            if own not in out.setdefault(family, []):
                out[family].append(own)
    return out


def templates() -> dict[str, list[list[str]]]:
    """Of each family, the grams of its names and the two-word grams of its sentences."""
    out = name_templates()
    for family, own in SENTENCES.items():
        if family != NONE:
            out.setdefault(family, []).extend([g for g in _grams(x) if " " in g] for x in own)
    return out


def _literal(value: object, kind: str) -> Column:
    """A constant of any size: JSON that the optimizer folds into one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_alike: float = 0.6) -> DataFrame:
    """One row per input row: doc_id, paragraphs (array of paragraph, family, probability, similarity, confirmed, also).

    Paragraphs are sentences and lines, of any length, then sentences that go on over line breaks (joined by spaces, without what
    marks comments); also has other families whose whole names a confirmed paragraph has; only those with an anchor word that aren't classed "none" are
    listed. The family is "unknown" where the model says so, or below the calibrated least probability. similarity
    is the largest share of a template's grams found in the paragraph, over the family's templates (a name without words that
    any licence's name may have, or a sentence); it confirms a known family from least_alike on. Null and empty texts
    list nothing. Repeated rows and null ids are kept as they are, other columns ignored; an empty table gives no rows.
    """
    families, weights, biases, least = model()
    by_family = {family: [sorted(map(_long, own)) for own in found] for family, found in templates().items()}
    # one array of weights per slot, so one access finds a gram's weights for all families
    table = _literal([[round(float(x), 4) for x in col] for col in weights.T], "array<array<float>>")
    known = _literal(by_family, "map<string,array<array<bigint>>>")
    titles = _literal({f: [own for own in found if own] for f, found in {f: [sorted(map(_long, g)) for g in found] for f, found in name_templates().items()}.items()}, "map<string,array<array<bigint>>>")
    names = _literal(families, "array<string>")
    start = _literal([float(x) for x in biases], "array<double>")

    text = F.col(text_col)
    lines = F.split(text, UNIT)
    # sentences that go on over line breaks, besides
    wrapped = F.array_except(F.split(F.regexp_replace(text, SOFT, " "), UNIT), lines)
    marked = F.when(text.rlike(ANCHORS), F.filter(F.concat(lines, F.when(text.rlike(SOFT), wrapped).otherwise(F.array().cast("array<string>"))), lambda p: p.rlike(ANCHORS))).otherwise(F.array().cast("array<string>"))
    words = F.transform(marked, lambda p: F.struct(p.alias("p"), F.regexp_extract_all(F.lower(p), F.lit(WORD), 0).alias("w")))
    pairs = F.transform(words, lambda x: F.struct(x["p"].alias("p"), x["w"].alias("w"), F.array_distinct(F.zip_with(F.slice(x["w"], 1, F.greatest(F.size(x["w"]) - 1, F.lit(0))), F.slice(x["w"], 2, F.greatest(F.size(x["w"]), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))).alias("two")))
    slots = F.transform(pairs, lambda x: F.struct(
        x["p"].alias("p"), F.transform(F.concat(F.array_distinct(x["w"]), x["two"]), lambda g: F.xxhash64(g)).alias("two"),
        F.array_distinct(F.transform(F.concat(F.array_distinct(x["w"]), x["two"]), lambda g: F.pmod(F.xxhash64(g), F.lit(WEIGHTS)).cast("int"))).alias("s"),
    ))
    logits = F.transform(slots, lambda x: F.struct(
        x["p"].alias("p"), x["two"].alias("two"),
        F.aggregate(x["s"], start, lambda z, s: F.zip_with(z, F.get(table, s), lambda a, b: a + b / F.sqrt(F.greatest(F.size(x["s"]), F.lit(1))))).alias("z"),
    ))
    heights = F.transform(logits, lambda x: F.struct(x["p"].alias("p"), x["two"].alias("two"), x["z"].alias("z"), F.array_max(x["z"]).alias("top")))
    named = F.transform(heights, lambda x: F.struct(
        x["p"].alias("p"), x["two"].alias("two"), F.get(names, (F.array_position(x["z"], x["top"]) - 1).cast("int")).alias("f"),
        (1 / F.aggregate(x["z"], F.lit(0.0), lambda a, z: a + F.exp(z - x["top"]))).alias("pr"),
    ))
    alike = F.transform(F.filter(named, lambda x: x["f"] != NONE), lambda x: F.struct(
        x["p"].alias("p"), x["two"].alias("two"), x["f"].alias("f"), x["pr"].alias("pr"),
        F.coalesce(F.array_max(F.transform(F.try_element_at(known, x["f"]), lambda s: F.size(F.array_intersect(s, x["two"])) / F.size(s))), F.lit(0.0)).alias("sim"),
    ))
    found = F.transform(alike, lambda x: F.struct(
        x["p"].alias("paragraph"), F.when(x["pr"] >= least, x["f"]).otherwise(UNKNOWN).alias("family"), x["pr"].alias("probability"),
        x["sim"].alias("similarity"), ((x["f"] != UNKNOWN) & (x["pr"] >= least) & (x["sim"] >= least_alike)).alias("confirmed"), x["two"].alias("two"),
    ))
    # other families of which a whole name stands in a confirmed paragraph: a choice of licences
    whole = lambda x: F.map_keys(F.map_filter(titles, lambda f, own: (f != x["family"]) & F.exists(own, lambda s: F.size(F.array_except(s, x["two"])) == 0)))
    found = F.transform(found, lambda x: F.struct(
        *(x[c].alias(c) for c in ("paragraph", "family", "probability", "similarity", "confirmed")), F.when(x["confirmed"], F.array_sort(whole(x))).otherwise(F.array().cast("array<string>")).alias("also"),
    ))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(found, F.array().cast("array<struct<paragraph:string,family:string,probability:double,similarity:double,confirmed:boolean,also:array<string>>>")).alias("paragraphs"))


def _long(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h
