"""Licence notices by a trained paragraph classifier.

A multinomial logistic regression over sparse word n-grams (one to three words, present or not) tells licence families from
other licences (`unknown`) and from ordinary prose (`none`). It is trained on the notices below and seeded variations of
them; an L1 penalty keeps few n-grams, a temperature fitted on variations left out of training calibrates the
probabilities. A family is reported only with a probability of at least SURE and if a comparison with the family's
notices confirms it: half of the paragraph's word pairs occur in them, or it holds four fifths of one notice's pairs.

Main path, DataFrame functions only: one scan keeps texts with a licence word or the name of a licence; their distinct texts
are split into lines and lines that run on into joined ones; distinct paragraphs into n-grams, which meet the weights (a broadcast of at most MOST_WEIGHTS rows) and are
summed per paragraph. So a notice that a third of all documents repeat is scored once.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagatlas.llm.common import LOWER, UPPER, cut, kept, let

SURE, PAIRS, WHOLE, MOST_WEIGHTS, SCALE, SALTS = 0.6, 0.5, 0.8, 20_000, 1000, 16
#: A paragraph without any of these has no licence notice, as the SQL takes it.
WORDS = r"licen[sc]|copyright|copyleft|rights reserved|creative commons|public domain|spdx|redistribut|\bcc0?[ -]by|\bcc0\b|\bgpl|warranty|permission is hereby|mozilla public"

#: Names of licences that mean nothing else, and those that are other words as well: a paragraph with only the latter is a family or nothing.
NAMES, SHARED_NAMES = r"\b[al]gpl|\bmpl[ -]?v?[12]|\bbsd-[0-9]", r"\bbsd\b|\bapache\b|\bmit\b|\bgnu\b"
#: What scan() looks for: phrases may be broken by a line's end, and by marks of a comment after it.
CLEAR = re.sub(r" (?!-)", r"[\\s*#/]+", WORDS) + "|" + NAMES
SIEVE = CLEAR + "|" + SHARED_NAMES
#: A line's end where a notice may not run on: after a sentence or a colon, or before a line without words.
ENDED = r"""(?<=[.!?:]["')\]]{0,2}\s{0,2})\n|\n(?=[^A-Za-z0-9\n]*(?:\n|\z))"""

# Usual notices of each family.
NOTICES = {
    "agpl-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "all-rights-reserved": ["All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No part of this publication may be reproduced without prior written permission. All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0).", "This work is dedicated to the public domain."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL, version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
_OTHER = ["Licensed under the {} License.", "Licensed under the {} License, Version {}.0.", "Released under the {} Public License, version {}.", "This work is licensed under the {} licence.", "Distributed under the terms of the {} Open License {}.0.", "Use is governed by the {} Software Licence Agreement.", "Copyright 2019 {}. Licensed for internal use only."]
_PROSE = [
    "She renewed her driving licence before the summer.", "The restaurant lost its licence to sell alcohol.", "A fishing license costs twenty dollars a year.", "The warranty on the car ran out in the third version of the contract.",
    "Copyright law is taught in the second year.", "The songs are in the public domain in some countries, the judge said.", "They asked for the right to be heard.", "The council reserved all seats for the guests.", "License plates are made in the prison.",
    "He was licensed as a pilot in May.", "Mining rights were sold under the old law.", "The general public is free to enter the work rooms.", "The software version was released on Monday under great pressure.", "The king gave the monks license to brew beer.",
    "Wealth was redistributed among the poor.", "A poet may take licence with the facts.",
]


def tokens(text: str) -> list[str]:
    return [w for x in re.split(r"[^a-z0-9.]+", text.translate(str.maketrans(UPPER, LOWER))) if (w := x.strip("."))]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}


def _invented(rnd: random.Random) -> str:
    return "".join(rnd.choice(["ka", "lo", "mi", "ter", "vos", "an", "qui", "zel", "bro", "the", "ing", "er", "ou"]) for _ in range(rnd.randint(1, 4)))


def examples(seed: int, each: int = 120) -> list[tuple[list[str], str]]:
    """Seeded variations: words around a notice, words left out, parts of long notices, invented licences, prose."""
    rnd, out = random.Random(seed), []
    prose = lambda n: [_invented(rnd) for _ in range(n)]
    for family, notices in NOTICES.items():
        for k in range(each):
            w = tokens(notices[k % len(notices)])
            if len(w) > 14 and rnd.random() < 0.4:
                a = rnd.randrange(len(w) - 11)
                w = w[a : a + rnd.randint(10, len(w))]
            elif len(w) > 6:
                w = [x for x in w if rnd.random() > 0.04]
            out.append((prose(rnd.choice([0, 0, 1, 4, 12])) + w + prose(rnd.choice([0, 0, 1, 4, 12])), family))
    for k in range(each * 4):
        w = tokens(_OTHER[k % len(_OTHER)].format(_invented(rnd).title() + rnd.choice(["", " " + _invented(rnd)]), rnd.randint(1, 9)))
        out.append((prose(rnd.choice([0, 0, 3])) + w + prose(rnd.choice([0, 0, 3])), "unknown"))
    for k in range(each * 6):
        w = tokens(_PROSE[k % len(_PROSE)])
        out.append((prose(rnd.randint(0, 20)) + (w if rnd.random() < 0.7 else rnd.sample(w, len(w) // 2)) + prose(rnd.randint(0, 20)), "none"))
    return out


@dataclass(frozen=True)
class Model:
    """Weights in thousandths, so that sums are exact in any order; logits are divided by the temperature."""

    classes: tuple[str, ...]
    bias: tuple[int, ...]
    weights: tuple[tuple[str, tuple[int, ...]], ...]
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


@lru_cache(maxsize=4)
def train(seed: int = 3, steps: int = 250, rate: float = 0.5, l1: float = 1e-4) -> Model:
    """Accelerated gradient steps with soft thresholds over a few thousand examples; takes seconds on the driver."""
    rows, later = examples(seed), examples(seed + 1, 40)
    classes = tuple(sorted(NOTICES)) + ("none", "unknown")
    counts: dict[str, int] = {}
    for w, _ in rows:
        for g in grams(w):
            counts[g] = counts.get(g, 0) + 1
    names = sorted(g for g, n in counts.items() if n >= 8)
    at = {g: k for k, g in enumerate(names)}

    def matrix(some):
        x = np.zeros((len(some), len(names)), np.float32)
        for k, (w, _) in enumerate(some):
            x[k, [at[g] for g in grams(w) if g in at]] = 1
        return x, np.array([classes.index(c) for _, c in some])

    (x, y), (x2, y2) = matrix(rows), matrix(later)
    w, b = np.zeros((len(names), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    look, old = w, w
    for k in range(steps):
        e = _softmax(x @ look + b)
        e[np.arange(len(y)), y] -= 1
        e /= len(y)
        new = look - rate * (x.T @ e)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        b = b - rate * e.sum(0)
        look, old = new + k / (k + 3) * (new - old), new
    w = np.round(old * SCALE).astype(int)
    bias = np.round(b * SCALE).astype(int)
    z = (x2 @ w + bias) / SCALE
    loss = {t: -np.log(_softmax(z / t)[np.arange(len(y2)), y2] + 1e-9).mean() for t in np.round(np.arange(0.3, 3.01, 0.1), 1)}
    keep = [k for k in range(len(names)) if w[k].any()]
    if len(keep) > MOST_WEIGHTS:
        raise ValueError("too many weights for a broadcast; raise l1")
    return Model(classes, tuple(bias.tolist()), tuple((names[k], tuple(w[k].tolist())) for k in keep), float(min(loss, key=loss.get)))


def words(text: Column) -> Column:
    """tokens() as a column."""
    split = F.split(F.translate(text, UPPER, LOWER), r"[^a-z0-9.]+")
    return F.filter(F.transform(split, lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")


def _grams(w: Column, n: int) -> Column:
    # by position: a slice inside a lambda copies the whole array each time, which is quadratic for a long paragraph
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - F.lit(n - 1)), lambda i: F.concat_ws(" ", *[F.element_at(w, i + F.lit(k)) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def classify(paragraphs: DataFrame, model: Model) -> DataFrame:
    """(paragraph, label, probability, whole) of distinct, non-null paragraphs; label is a family, unknown or none; whole: it holds one of the family's notices."""
    spark, n = paragraphs.sparkSession, len(model.classes)
    # every paragraph meets the empty gram, so that one without known n-grams stays
    table = spark.createDataFrame([("", [0] * n), *((g, list(w)) for g, w in model.weights)], "gram string, w array<int>")
    pairs_of = {family: [sorted({" ".join(w[k : k + 2]) for k in range(len(w) - 1)}) for w in map(tokens, notices)] for family, notices in NOTICES.items()}
    known = F.array(*map(F.lit, sorted({g for texts in pairs_of.values() for x in texts for g in x})))
    pairs = lambda w: let(F.array_distinct(_grams(w, 2)), lambda p: F.struct(F.size(p).alias("n"), F.array_intersect(p, known).alias("known")))
    of = let(words(F.col("paragraph")), lambda w: F.struct(F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(w, k) for k in (1, 2, 3)])).alias("grams"), pairs(w).alias("pairs")))
    # n-grams travel by a hash and with the notices' pairs only: joined lines may be as long as a text
    key = F.sha2("paragraph", 256)
    met = paragraphs.select(key.alias("key"), of.alias("of")).select("key", "of.pairs", F.explode("of.grams").alias("gram")).join(F.broadcast(table), "gram")
    sums = met.groupBy("key").agg(F.first("pairs").alias("of"), *[F.sum(F.element_at("w", k + 1)).alias(f"z{k}") for k in range(n)])
    sums = sums.select("*", F.col("of.n").alias("n_pairs"), F.col("of.known").alias("pairs")).drop("of")
    z = F.array(*[(F.col(f"z{k}") + F.lit(b)) / F.lit(SCALE * model.temperature) for k, b in enumerate(model.bias)])
    p = let(z, lambda a: F.transform(a, lambda v: F.exp(v - F.array_max(a)) / F.aggregate(a, F.lit(0.0), lambda s, u: s + F.exp(u - F.array_max(a)))))
    best = sums.withColumn("p", p).withColumn("probability", F.array_max("p"))
    best = best.withColumn("first", F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("p", F.col("probability")).cast("int")))
    sure, whole = F.lit(False), F.lit(False)
    for family, texts in pairs_of.items():
        every = F.array(*map(F.lit, sorted({g for x in texts for g in x})))
        here = F.size(F.array_intersect("pairs", every)) >= PAIRS * F.col("n_pairs")
        held = F.lit(False)
        for x in texts:
            held = held | (F.size(F.array_intersect("pairs", F.array(*map(F.lit, x)))) >= WHOLE * len(x))
        here, whole = here | held, whole | ((F.col("first") == family) & held)
        sure = sure | ((F.col("first") == family) & (F.col("n_pairs") > 0) & here)
    # what looks like a licence, but isn't sure or isn't confirmed, is unknown
    licence = F.lit(1.0) - F.element_at("p", model.classes.index("none") + 1)
    label = F.when((F.col("probability") >= SURE) & sure, F.col("first")).when(licence > 0.5, F.lit("unknown")).otherwise(F.lit("none"))
    best = best.select("key", label.alias("label"), "probability", whole.alias("whole"))
    return paragraphs.select("paragraph", key.alias("key")).join(best, "key").drop("key")


def scan(docs: DataFrame, model: Model | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without the text where keep_text is false) with license_families (sorted, comma-joined; empty if none), n_notices and n_unknown (paragraphs).

    Paragraphs are lines, and lines that run on (no sentence ends with them) joined. If joined lines give a family of which no
    line alone holds a notice, they are one notice of it and their lines count only where they hold another family's notice;
    else each line stands for itself, as all unknown ones do. Null and empty texts have none; repeated rows agree; existing
    columns of these names are replaced, all others pass through.

    Texts are searched for licence words once: rows and the lines of those with such a word are kept as a table. Only those rows are
    joined with what their lines say, each distinct text under SALTS numbers, so that copies of one text are no single task.
    """
    model = model or train()
    new, known = ("license_families", "n_notices", "n_unknown"), F.lower(F.col(text)).rlike(SIEVE)
    columns = [c for c in docs.columns if keep_text or c != text] or docs.columns
    seen = docs.select(F.struct(*columns).alias("row"), F.when(known, F.struct(F.sha2(text, 256).alias("key"), F.split(text, ENDED).alias("runs"))).alias("hit"), F.monotonically_increasing_id().alias("at"))
    seen = kept(seen, "licenses")
    texts = seen.where("hit is not null").groupBy("hit.key").agg(F.first("hit.runs").alias("runs"))
    runs = texts.select("key", F.posexplode("runs").alias("run", "lines")).where(F.lower("lines").rlike(SIEVE))
    runs = runs.withColumn("lines", F.filter(F.split("lines", "\n"), lambda x: x.rlike("[A-Za-z0-9]")))
    joined = F.when(F.size("lines") > 1, F.array(F.struct(F.array_join("lines", "\n").alias("paragraph"), F.lit(True).alias("joined"))))
    parts = F.concat(F.transform("lines", lambda x: F.struct(x.alias("paragraph"), F.lit(False).alias("joined"))), F.coalesce(joined, F.array().cast("array<struct<paragraph:string,joined:boolean>>")))
    each = cut(runs.select("key", "run", F.inline(parts)).where(F.lower("paragraph").rlike(SIEVE)))
    labels = cut(classify(each.select("paragraph").distinct(), model)).where(~F.col("label").isin("none", "unknown") | ((F.col("label") == "unknown") & F.lower("paragraph").rlike(CLEAR)))
    family, alone = F.when(F.col("label") != "unknown", F.col("label")), ~F.col("joined")
    of_run = each.join(labels.select("paragraph", "label", "whole"), "paragraph").groupBy("key", "run").agg(
        F.max(F.when(F.col("joined"), family)).alias("one"),
        F.collect_set(F.when(alone, family)).alias("families"),
        F.collect_set(F.when(alone & F.col("whole"), family)).alias("held"),
        F.count(F.when(alone, family)).alias("notices"),
        F.count(F.when(alone & F.col("whole"), family)).alias("n_held"),
        F.count(F.when(alone & (F.col("label") == "unknown"), 1)).alias("unknown"),
    )
    runs_on = F.coalesce(~F.array_contains("held", F.col("one")), F.lit(False))
    of_run = of_run.select(
        "key",
        F.when(runs_on, F.array_union("held", F.array("one"))).otherwise(F.col("families")).alias("families"),
        F.when(runs_on, F.col("n_held") + 1).otherwise(F.col("notices")).alias("notices"),
        F.when(runs_on, F.lit(0).cast("long")).otherwise(F.col("unknown")).alias("unknown"),
    )
    found = of_run.groupBy("key").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("families"),
        F.sum("notices").alias("notices"),
        F.sum("unknown").alias("unknown"),
    )
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = seen.where("hit is not null").select("row", F.col("hit.key").alias("key"), F.pmod("at", F.lit(SALTS)).cast("int").alias("salt")).join(found, ["key", "salt"], "left")
    none = F.lit(0).cast("long")
    got = hit.select("row", F.coalesce("families", F.lit("")).alias(new[0]), F.coalesce("notices", none).alias(new[1]), F.coalesce("unknown", none).alias(new[2]))
    got = got.unionByName(seen.where("hit is null").select("row", F.lit("").alias(new[0]), none.alias(new[1]), none.alias(new[2])))
    return got.select(*[F.col("row").getField(c).alias(c) for c in columns if c not in new], *new)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scan_sql(model: Model | None = None) -> str:
    """scan() of documents as DuckDB SQL: (doc_id, license_families, n_notices, n_unknown); it sieves by WORDS and knows single lines only."""
    model = model or train()
    n = len(model.classes)
    weights = ", ".join(f"({_quoted(g)}, {list(w)})" for g, w in model.weights)
    notices = []
    for family, texts in NOTICES.items():
        for k, w in enumerate(map(tokens, texts)):
            notices.append(f"({_quoted(family)}, {k}, [{', '.join(_quoted(' '.join(w[i : i + 2])) for i in range(len(w) - 1))}])")
    z = ", ".join(f"(coalesce(sum(w[{k + 1}]), 0) + {b}) / {SCALE * model.temperature!r}" for k, b in enumerate(model.bias))
    words_of = "list_filter(list_transform(regexp_split_to_array(translate(paragraph, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.]+'), lambda x: regexp_replace(x, '^\\.+|\\.+$', '', 'g')), lambda x: x <> '')"
    gram = lambda k: f"list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))"
    return f"""
WITH weights(gram, w) AS (VALUES {weights}),
notices(family, k, raw) AS (VALUES {", ".join(notices)}),
pieces AS (SELECT family, k, list_distinct(raw) AS pairs FROM notices),
families AS (SELECT family, list_distinct(flatten(list(pairs))) AS every FROM pieces GROUP BY family),
texts AS (SELECT DISTINCT text FROM documents WHERE regexp_matches(lower(text), {_quoted(WORDS)})),
each AS (SELECT text, paragraph FROM (SELECT text, unnest(string_split(text, chr(10))) AS paragraph FROM texts) WHERE regexp_matches(lower(paragraph), {_quoted(WORDS)})),
rows AS (SELECT DISTINCT paragraph, {words_of} AS w FROM each),
grams AS (SELECT paragraph, list_distinct(flatten([{gram(1)}, {gram(2)}, {gram(3)}])) AS grams, list_distinct({gram(2)}) AS pairs FROM rows),
met AS (SELECT paragraph, pairs, unnest(CASE WHEN len(grams) = 0 THEN [NULL] ELSE grams END) AS gram FROM grams),
z AS (SELECT met.paragraph, any_value(pairs) AS pairs, [{z}] AS z FROM met LEFT JOIN weights USING (gram) GROUP BY met.paragraph),
e AS (SELECT paragraph, pairs, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z),
p AS (SELECT paragraph, pairs, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e),
best AS (SELECT paragraph, pairs, p, list_max(p) AS probability, {list(model.classes)}[list_position(p, list_max(p))] AS first FROM p),
sure AS (
  SELECT b.paragraph, bool_or(len(b.pairs) > 0 AND (len(list_intersect(b.pairs, f.every)) >= {PAIRS} * len(b.pairs) OR len(list_intersect(b.pairs, pieces.pairs)) >= {WHOLE} * len(pieces.pairs))) AS sure
  FROM best b JOIN families f ON b.first = f.family JOIN pieces ON pieces.family = f.family GROUP BY b.paragraph),
labels AS (
  SELECT b.paragraph, CASE WHEN probability >= {SURE} AND coalesce(sure, false) THEN first WHEN 1.0 - p[{model.classes.index("none") + 1}] > 0.5 THEN 'unknown' ELSE 'none' END AS label
  FROM best b LEFT JOIN sure USING (paragraph)),
found AS (
  SELECT text, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label <> 'unknown'), '') AS families, count(*) FILTER (label <> 'unknown') AS notices, count(*) FILTER (label = 'unknown') AS unknown
  FROM each JOIN labels USING (paragraph) WHERE label <> 'none' GROUP BY text)
SELECT doc_id, coalesce(families, '') AS license_families, coalesce(notices, 0)::BIGINT AS n_notices, coalesce(unknown, 0)::BIGINT AS n_unknown
FROM documents LEFT JOIN found USING (text)"""
