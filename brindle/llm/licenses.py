"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are windows of the whole text's words, a template's length over the threshold long. A template's tokens are
ordered by how many documents hold them, rarest first; a block that meets the containment threshold shares one of the
template's first |T| - t + 1 tokens, t being the least overlap. One pass over the texts notes which template words each
holds; texts without such a token, or with fewer than t of the template's, go by that note alone. The others are read
again, and each window of a template's length that begins at one of its tokens is verified. The phrases are looked for
only in texts that hold all their words. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.rows import text_key
from brindle.session import scope, stash

OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{OTHER}]+"
#: Words that a window must hold, and must not, to be of a short template's license.
DISTINCT = {
    "released under the mit license": ("mit", ""),
    "licensed under the apache license version 2 0": ("apache 2", ""),
    "licensed under the bsd 3 clause license": ("bsd 3", ""),
    "licensed under the gnu general public license version 3": ("gnu 3", "lesser affero"),
    "licensed under the gnu general public license version 2": ("gnu 2", "lesser affero"),
    "licensed under the gnu lesser general public license version 3": ("lesser 3", ""),
    "this source code form is subject to the terms of the mozilla public license v 2 0": ("mozilla 2", ""),
    "licensed under cc by nc 4 0": ("cc nc", ""),
    "licensed under cc by sa 4 0": ("cc sa", "nc"),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": ("gnu 3", "lesser affero"),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": ("gnu 2", "lesser affero"),
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": ("lesser 2", ""),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": ("affero 3", ""),
    "boost software license version 1 0": ("boost 1", ""),
    "this work is licensed under a creative commons attribution 4 0 international license": ("attribution", "noncommercial sharealike noderivatives nc sa nd"),
}
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
THRESHOLD = 0.8
#: The least that lines with a license say; distinct words of each are its set.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "licensed under the bsd 3 clause license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost-1", "boost software license version 1 0"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
]


def _phrase(words: str) -> str:
    return rf"(?i)(?<![^{OTHER}])" + f"[{OTHER}]+".join(words.split()) + rf"(?![^{OTHER}])"


def _words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _split(lowered: Column) -> Column:
    return F.filter(F.split(lowered, f"[{OTHER}]+"), lambda w: w != "")


def span(text: str, threshold: float = THRESHOLD) -> int:
    """Words of a window that is compared with a template."""
    return math.ceil(len(text.split()) / threshold)


def prefixes(frequency: dict[str, int], templates=None, threshold: float = THRESHOLD) -> list[tuple[int, str, list[str], int, int]]:
    """(template, label, tokens rarest first, least overlap, prefix length)."""
    out = []
    for k, (label, text) in enumerate(templates or TEMPLATES):
        tokens = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
        least = math.ceil(threshold * len(tokens) - 1e-9)
        out.append((k, label, tokens, least, len(tokens) - least + 1))
    return out


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def _matches(cand: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, tkey, label, share) of the templates that a window of a candidate (doc_id, tkey, text, t) meets."""
    exact = _split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = cand.select("doc_id", "tkey", "ts", exact.alias("words"))
    marks = F.expr("filter(transform(words, (w, i) -> named_struct('p', i, 'w', w)), x -> array_contains(any, x.w))")
    marked = words.withColumn("any", F.expr("array_distinct(flatten(transform(ts, t -> concat(t.tokens, t.bar))))")).select("doc_id", "tkey", "ts", marks.alias("marks"))
    each = marked.select("doc_id", "tkey", "marks", F.explode("ts").alias("t")).select("doc_id", "tkey", "t.*", "marks")
    each = each.withColumn("own", F.expr("filter(marks, x -> array_contains(tokens, x.w) OR array_contains(bar, x.w))"))
    windows = each.withColumn("held", F.expr("transform(own, (x, k) -> transform(filter(slice(own, k + 1, span), y -> y.p < x.p + span), y -> y.w))"))
    most = F.expr(
        "array_max(transform(held, h -> CASE WHEN size(h) >= least AND size(array_except(need, h)) = 0 AND NOT arrays_overlap(bar, h) THEN size(array_intersect(tokens, h)) ELSE 0 END))")
    met = windows.select("doc_id", "tkey", "label", "least", F.size("tokens").alias("size"), most.alias("overlap")).where("overlap >= least")
    return met.select("doc_id", "tkey", "label", (F.col("overlap") / F.col("size")).alias("share"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    score is 1 where a phrase stands, else the largest containment of a template in a window that meets the
    threshold, else 0. Null texts are empty, very long ones are read whole. Rows that repeat an id and a text come
    back as often, and rows without an id as well; labels of rows with one id and other texts stay apart. No rows give
    none. Other columns are not read, whatever their names.
    """
    used = templates or TEMPLATES
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("tkey", text_key("text"))
    vocabulary = sorted({w for _, t in used for w in t.split()} | {w for p in PHRASES.values() for w in p.split()})
    with scope(docs.sparkSession) as sc:
        # lower() also makes a k of the Kelvin sign; so these notes hold a word too many at most, and are not the result.
        tokens = rows.select("doc_id", "tkey", _split(F.lower("text")).alias("words"))
        notes = sc.keep(tokens.select("doc_id", "tkey", F.size("words").cast("long").alias("n_words"), F.array_intersect(_strings(vocabulary), "words").alias("held")))
        frequency = {r["w"]: r["count"] for r in notes.select(F.explode("held").alias("w")).groupBy("w").count().collect()}  # a row a template word

        def lacks(words: list[str], least: int) -> Column:
            return F.size(F.array_intersect("held", _strings(words))) < least

        tests = []
        for k, label, ordered, least, p in prefixes(frequency, templates, threshold):
            need, bar = (x.split() for x in DISTINCT.get(used[k][1], ("", "")))
            one = F.struct(
                F.lit(label).alias("label"), _strings(ordered).alias("tokens"), F.lit(least).alias("least"), F.lit(span(used[k][1], threshold)).alias("span"), _strings(need).alias("need"), _strings(bar).alias("bar"))
            tests.append(F.when(F.arrays_overlap("held", _strings(ordered[:p])) & ~lacks(ordered, least) & ~lacks(need, len(need)), one))
        phrases = [F.when(~lacks(list(set(p.split())), len(set(p.split()))), F.lit(k)) for k, p in PHRASES.items()]
        told = notes.select("doc_id", "tkey", F.array_compact(F.array(*tests)).alias("ts"), F.array_compact(F.array(*phrases)).alias("ps")).where("size(ts) > 0 OR size(ps) > 0")
        told = stash(told.dropDuplicates(["doc_id", "tkey"]).withColumnsRenamed({"doc_id": "c_id", "tkey": "c_key"}))
        cand = stash(rows.join(told, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tkey") == F.col("c_key"))).select("doc_id", "tkey", "text", "ts", "ps").dropDuplicates(["doc_id", "tkey"]))
        more = _matches(cand.where("size(ts) > 0"), threshold).groupBy("doc_id", "tkey").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))

        text = F.col("text")
        count = {f"n_{k}": F.when(F.array_contains("ps", k), F.regexp_count(text, F.lit(_phrase(p)))).otherwise(0).cast("long") for k, p in PHRASES.items()}
        base = cand.where("size(ps) > 0").withColumns(count)
        n_base = sum((F.col(f"`n_{k}`") for k in PHRASES), F.lit(0).cast("long"))
        starts = [F.when(F.col(f"`n_{k}`") > 0, _words_in(F.regexp_extract(text, "(?s)^(.*?)" + _phrase(p), 1))) for k, p in PHRASES.items()]
        ends = [F.when(F.col(f"`n_{k}`") > 0, _words_in(F.regexp_extract(text, "(?s)^(.*)" + _phrase(p), 1))) for k, p in PHRASES.items()]
        own = F.array_compact(F.array(*[F.when(F.col(f"`n_{k}`") > 0, F.lit(k)) for k in PHRASES]))
        base = base.select("doc_id", "tkey", n_base.alias("n_base"), F.least(*starts).alias("first_word"), F.greatest(*ends).alias("last_word"), own.alias("own")).where("n_base > 0")
        both = sc.keep(base.unionByName(more, allowMissingColumns=True).groupBy("doc_id", "tkey").agg(*(F.max(c).alias(c) for c in ("n_base", "first_word", "last_word", "own", "more", "share"))))
    both = both.withColumnsRenamed({"doc_id": "m_id", "tkey": "m_key"})
    joined = notes.join(both, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tkey") == F.col("m_key")), "left")
    none = F.array().cast("array<string>")
    own, more_ = F.coalesce("own", F.lit(none)), F.coalesce("more", F.lit(none))
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, more_)), ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def oracle() -> str:
    """The same in DuckDB's SQL: every window of every text is compared with every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"
    made = ", ".join(
        f"({k}, '{label}', {quoted(sorted(set(t.split())))}, {math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)}, {span(t)}, {quoted(DISTINCT.get(t, ('', ''))[0].split())}, {quoted(DISTINCT.get(t, ('', ''))[1].split())})"
        for k, (label, t) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{k}', {quoted(p.split())})" for k, p in PHRASES.items())
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
t(k, label, tokens, least, span, need, bar) AS (VALUES {made}), p(label, phrase) AS (VALUES {phrases}),
a AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(0, len(words) - 1)) AS i FROM w),
b AS (SELECT w.doc_id, p.label, i FROM a JOIN p ON a.word = p.phrase[1] JOIN w ON w.doc_id = a.doc_id WHERE words[i + 1:i + len(phrase)] = phrase),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS own FROM b GROUP BY doc_id),
o AS (SELECT doc_id, k, i, word, list_contains(tokens, word) AS good FROM a JOIN t ON list_contains(tokens, a.word) OR list_contains(bar, a.word)),
h AS (SELECT x.doc_id, x.k, x.i, list(DISTINCT y.word) AS held, count(DISTINCT y.word) FILTER (WHERE y.good) AS overlap
      FROM o x JOIN t USING (k) JOIN o y ON y.doc_id = x.doc_id AND y.k = x.k AND y.i BETWEEN x.i AND x.i + t.span - 1 GROUP BY ALL),
m AS (SELECT doc_id, label, max(overlap / len(tokens)) AS share FROM h JOIN t USING (k)
      WHERE overlap >= least AND list_has_all(held, need) AND NOT list_has_any(held, bar) GROUP BY doc_id, label),
e AS (SELECT doc_id, list(label) AS more, max(share) AS share FROM m GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(own, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN e USING (doc_id)"""
