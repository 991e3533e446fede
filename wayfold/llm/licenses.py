"""License scans: a trained paragraph classifier, in DataFrame functions only.

Texts are split into paragraphs at lines without letters and digits; a paragraph is judged with its wrapped lines joined,
and each of its lines by itself. Those that could hold a notice are classified by logistic regression over sparse word 1-
and 2-grams into licence families; what no family reaches with calibrated probability is unknown. A prediction is
confirmed if the paragraph holds enough of one of the family's templates, word by word. The model is fitted on the driver from the fixed templates below,
so its size is fixed too, and applied within the row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.quality import settled

UNKNOWN = "unknown"
#: Short public notices of each family.
TEMPLATES = {
    "agpl": ("licensed under the gnu affero general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    "apache": ("licensed under the apache license version 2.0", "you may not use this file except in compliance with the apache license you may obtain a copy of the license at apache.org licenses license-2.0"),
    "bsd": ("released under the bsd license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "licensed under the 3-clause bsd license"),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "cc-by-nc": ("licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    "cc-by-sa": ("licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    "cc0": ("dedicated to the public domain under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "licensed under gpl 2.0 or later"),
    "lgpl": ("licensed under the gnu lesser general public license version 2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "licensed under the mit license"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license version 2.0", "licensed under the mozilla public license 2.0"),
    "reserved": ("all rights reserved", "copyright all rights reserved no part of this publication may be reproduced without permission"),
}
#: The short identifiers of each family.
IDENTIFIERS = {
    "agpl": ("agpl-3.0-only", "agpl-3.0-or-later"), "apache": ("apache-2.0",), "bsd": ("bsd-2-clause", "bsd-3-clause"), "cc-by": ("cc-by-4.0",), "cc-by-nc": ("cc-by-nc-4.0",), "cc-by-sa": ("cc-by-sa-4.0",), "cc0": ("cc0-1.0",),
    "gpl": ("gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later"), "lgpl": ("lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only"), "mit": ("mit",), "mpl": ("mpl-2.0",),
}
TEMPLATES = {c: (*ts, *(f"spdx-license-identifier {i}" for i in IDENTIFIERS.get(c, ()))) for c, ts in TEMPLATES.items()}
#: Sentences about rights that name no licence; they teach the unknown class.
OTHERS = (
    "the license plate of the car was not readable", "drivers need a license to drive in this state", "permission to enter was refused", "ask your doctor for permission first",
    "the software is free to try for thirty days", "he was licensed to practise law in two states", "the right of way belongs to the other driver", "copyright law protects authors of books and films",
    "terms and conditions apply to this offer", "see the license file for details", "the warranty covers parts for two years", "a fishing license costs ten dollars", "this content may be subject to copyright",
    "rights and duties of citizens", "the public domain is a place without fences", "subject to change without notice", "you must accept the license agreement before you continue", "open source software is used by many firms",
)
GATE = r"licen[cs]|copyright|\brights reserved|\bpermission|redistribut|public domain|creative commons|\bcc[ -]?(by|0)|\bgpl|spdx"
#: Between paragraphs: line breaks around lines that are empty or have comment marks only.
BREAK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
BUCKETS = 256
WORDS = r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"


def grams(text: str) -> list[str]:
    words = re.findall(WORDS, text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@lru_cache(maxsize=4)
def fitted(seed: int = 7, copies: int = 15, rounds: int = 25, rate: float = 0.5, decay: float = 1e-4) -> tuple[tuple[str, ...], dict[str, tuple[float, ...]], tuple[float, ...], float]:
    """Classes, weights of each gram, biases and the calibrated temperature.

    Each template is repeated with words left out at random and with ordinary words around it (``copies`` of them, the
    bound of the sample); a third of them is held out to choose the temperature.
    """
    rng = random.Random(seed)
    classes = (*sorted(TEMPLATES), UNKNOWN)
    filler = [w for s in OTHERS for w in s.split()]
    sample = []
    for k, c in enumerate(classes):
        for t in TEMPLATES.get(c, OTHERS):
            for i in range(copies if c != UNKNOWN else copies // 3):
                words = [w for w in t.split() if i == 0 or rng.random() > 0.12] or t.split()
                if i % 3:
                    words = [rng.choice(filler) for _ in range(rng.randint(0, 4))] + words + [rng.choice(filler) for _ in range(rng.randint(0, 4))]
                sample.append((set(grams(" ".join(words))), k))
    rng.shuffle(sample)
    held, train = sample[: len(sample) // 3], sample[len(sample) // 3 :]
    weights: dict[str, list[float]] = {}
    bias = [0.0] * len(classes)

    def scores(x):
        s = list(bias)
        for g in x:
            if w := weights.get(g):
                s = [a + b for a, b in zip(s, w)]
        return s

    def softmax(s, t=1.0):
        top = max(s)
        e = [math.exp((a - top) / t) for a in s]
        return [a / sum(e) for a in e]

    for r in range(rounds):
        step = rate / (1 + r / 10)
        for x, k in train:
            p = softmax(scores(x))
            p[k] -= 1
            bias = [b - step * 0.1 * d for b, d in zip(bias, p)]
            for g in x:
                w = weights.setdefault(g, [0.0] * len(classes))
                weights[g] = [a * (1 - step * decay) - step * d / math.sqrt(len(x)) for a, d in zip(w, p)]
    known = [scores(x) for x, _ in held]
    loss = lambda t: -sum(math.log(max(1e-12, softmax(s, t)[k])) for s, (_, k) in zip(known, held))
    temperature = min((0.25 * 1.25**i for i in range(20)), key=loss)
    return classes, {g: tuple(round(a, 5) for a in w) for g, w in weights.items()}, tuple(round(b, 5) for b in bias), temperature


def predict(text: str, least: float = 0.5, share: float = 0.6) -> tuple[str, bool]:
    """The same decision for one paragraph, in plain Python: family and whether a template confirms it."""
    classes, weights, bias, temperature = fitted()
    s = list(bias)
    for g in dict.fromkeys(grams(text)):
        if g in weights:
            s = [a + b for a, b in zip(s, weights[g])]
    top = max(s)
    p = 1 / sum(math.exp((a - top) / temperature) for a in s)
    family = classes[s.index(top)] if p >= least else UNKNOWN
    words = set(re.findall(WORDS, text.lower()))
    return family, family != UNKNOWN and any(len(words & set(t.split())) >= share * len(set(t.split())) for t in TEMPLATES[family])


def prefixed(words: set[str]) -> str:
    """Pattern of any of the words in which those that begin alike share their beginning: it is tried once at each place."""
    heads: dict[str, set[str]] = {}
    for w in words:
        heads.setdefault(w[:1], set()).add(w[1:])
    parts = []
    for c, rest in sorted(heads.items(), reverse=True):  # an empty rest comes last: longer words first
        while c and len(rest) == 1 and (only := next(iter(rest))):
            c, rest = c + only[0], {only[1:]}
        parts.append(re.escape(c) + (prefixed(rest) if rest != {""} else ""))
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def possible(share: float) -> str:
    """Pattern that every text matches of which some template could be confirmed, and every text that matches the gate.

    Of each template it has so many words, the longest, that the others are too few for ``share``. Blanks of the gate may
    be line breaks, so that wrapped lines need not be joined first.
    """
    words = set()
    for t in (t for ts in TEMPLATES.values() for t in ts):
        own = sorted(set(t.split()), key=lambda w: (-len(w), w))
        words |= set(own[: len(own) - math.ceil(share * len(own) - 1e-9) + 1])
    gate = GATE.replace("[ -]", "[ \\n-]").replace(" ", "[ \\n]").replace("[[ \\n]\\n-]", "[ \\n-]")
    return f"{gate}|(?<![a-z0-9]){prefixed(words)}(?![a-z0-9])"


def license_scan(df: DataFrame, text_col: str = "text", least: float = 0.5, share: float = 0.6) -> DataFrame:
    """``df`` with ``paragraphs`` (line, family, probability, confirmed), ``n_paragraphs, n_unknown, licenses`` added.

    ``licenses`` are the confirmed families, sorted, joined by commas. A paragraph is listed, its lines joined by blanks,
    if it matches the gate or is confirmed; if lines of it are confirmed by themselves, the lines are listed instead, and
    the paragraph beside the confirmed ones only if it adds a family. Null and empty texts have none. Rows are judged one
    by one, repeated ones alike; an empty table stays empty; of very long texts only paragraphs that could hold a notice are classified. Equal
    scores go to the family that comes first. Columns of ``df`` with a result's name are replaced.
    """
    classes, weights, bias, temperature = fitted()
    sql = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    # a map is searched from its beginning, so the weights lie in many small ones, by the checksum of the gram
    dealt: list[dict] = [{} for _ in range(BUCKETS)]
    for g, w in weights.items():
        dealt[zlib.crc32(g.encode()) % BUCKETS][g] = w
    table = F.from_json(F.lit(json.dumps(dealt)), "array<map<string,array<double>>>")
    templates = F.from_json(F.lit(json.dumps({c: [t.split() for t in ts] for c, ts in TEMPLATES.items()})), "map<string,array<array<string>>>")
    names = ("paragraphs", "n_paragraphs", "n_unknown", "licenses")
    a = df.withColumn("_l_text", F.col(f"`{text_col}`").cast("string")).drop(*(c for c in df.columns if c.lower() in names))
    gate, maybe = sql(GATE), sql(possible(share))
    a = a.withColumn("_l_blocks", F.expr(f"CASE WHEN lower(_l_text) rlike '{maybe}' THEN filter(split(_l_text, '{sql(BREAK)}'), b -> lower(b) rlike '{maybe}') ELSE array() END"))
    a = a.withColumn("_l_split", F.expr("transform(_l_blocks, b -> filter(split(b, '\\n'), l -> l rlike '[\\\\p{L}\\\\p{N}]'))"))
    a = a.withColumn("_l_lines", F.expr(f"transform(_l_split, u -> CASE WHEN size(u) = 1 THEN u ELSE concat(filter(u, l -> lower(l) rlike '{maybe}'), array(array_join(u, ' '))) END)"))
    start = "array(" + ", ".join(f"{b}D" for b in bias) + ")"
    zero = "array(" + ", ".join("0D" for _ in bias) + ")"
    a = a.withColumns({"_l_weights": F.when(F.size("_l_lines") > 0, table), "_l_templates": F.when(F.size("_l_lines") > 0, templates)})
    a = a.withColumn("_l_words", F.expr(f"transform(_l_lines, u -> transform(u, l -> named_struct('l', l, 'w', regexp_extract_all(lower(l), '{sql(WORDS)}', 0))))"))
    a = a.withColumn("_l_grams", F.expr("transform(_l_words, u -> transform(u, x -> named_struct('l', x.l, 'w', x.w, 'g', array_distinct(concat(x.w, zip_with(slice(x.w, 1, greatest(size(x.w) - 1, 0)), slice(x.w, 2, greatest(size(x.w) - 1, 0)), (p, q) -> concat(p, ' ', q)))))))"))
    score = f"aggregate(x.g, {start}, (s, g) -> zip_with(s, coalesce(try_element_at(element_at(_l_weights, CAST(crc32(encode(g, 'UTF-8')) % {BUCKETS} AS INT) + 1), g), {zero}), (p, q) -> p + q))"
    a = a.withColumn("_l_scores", F.expr(f"transform(_l_grams, u -> transform(u, x -> named_struct('l', x.l, 'w', x.w, 's', {score})))"))
    family = "element_at(array(" + ", ".join(f"'{c}'" for c in classes) + "), CAST(array_position(x.s, array_max(x.s)) AS INT))"
    a = a.withColumn("_l_named", F.expr(f"transform(_l_scores, u -> transform(u, x -> named_struct('l', x.l, 'w', x.w, 'f', {family}, 'p', 1 / aggregate(x.s, 0D, (t, v) -> t + exp((v - array_max(x.s)) / {temperature}D)))))"))
    a = a.withColumn("_l_judged", F.expr(f"transform(_l_named, u -> transform(u, x -> named_struct('line', x.l, 'family', CASE WHEN x.p >= {least}D THEN x.f ELSE '{UNKNOWN}' END, 'probability', x.p, 'w', x.w)))"))
    confirmed = f"coalesce(exists(try_element_at(_l_templates, x.family), t -> size(array_intersect(t, x.w)) >= {share}D * size(array_distinct(t))), false)"
    a = a.withColumn("_l_confirmed", F.expr(f"transform(_l_judged, u -> transform(u, x -> named_struct('line', x.line, 'family', x.family, 'probability', x.probability, 'confirmed', {confirmed})))"))
    about = f"x -> x.confirmed OR lower(x.line) rlike '{gate}'"
    lines, whole = "slice(u, 1, size(u) - 1)", "element_at(u, -1)"
    listed = f"""CASE WHEN size(u) = 1 OR NOT exists({lines}, x -> x.confirmed) THEN filter(array({whole}), {about})
 WHEN {whole}.confirmed AND NOT exists({lines}, x -> x.confirmed AND x.family = {whole}.family) THEN filter(u, x -> x.confirmed) ELSE filter({lines}, {about}) END"""
    a = a.withColumn("paragraphs", F.expr(f"flatten(transform(_l_confirmed, u -> {listed}))"))
    a = a.withColumns(
        {
            "n_paragraphs": F.size("paragraphs").cast("long"),
            "n_unknown": F.expr(f"CAST(size(filter(paragraphs, x -> x.family = '{UNKNOWN}')) AS BIGINT)"),
            "licenses": F.expr("array_join(sort_array(array_distinct(transform(filter(paragraphs, x -> x.confirmed), x -> x.family))), ',')"),
        }
    )
    return settled(a.drop(*(c for c in a.columns if c.startswith("_l_"))), names)
