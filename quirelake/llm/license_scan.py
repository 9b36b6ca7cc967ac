"""License scans by exact set-similarity join, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import text_of, written

#: Phrases whose every place is counted.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: (label, notice).  No notice may have more than HALF words.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)
#: A block is a window of 2 * HALF words that starts at a multiple of HALF words.
HALF = 32
#: Share of a template's words that a block must hold.
CONTAINED = 0.9

_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _normal(text: str | Column) -> Column:
    """The words of a text, one blank before, between and after them.

    Only A-Z is lower-cased for the comparison: the other characters that
    lower() maps to ASCII (the Kelvin sign) are replaced before.
    """
    t = F.replace(text_of(text), F.lit("K"), F.lit("ĸ"))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), _NOT_WORD, " ")), F.lit(" "))


def _templates(templates) -> list[tuple[int, str, list[str]]]:
    out = []
    for n, (label, notice) in enumerate(templates):
        words = notice.split()
        if not words or len(words) > HALF:
            raise ValueError(f"a template has 1 to {HALF} words, this one {len(words)}: {notice!r}")
        out.append((n, label, list(dict.fromkeys(words))))
    return out


def _needed(n: int, share: float) -> int:
    """The least number of words that makes ``share`` of n, without rounding trouble."""
    return next(k for k in range(n + 1) if k >= share * n - 1e-9)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=None, templates=TEMPLATES, share: float = CONTAINED) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per row of ``df``.

    Base labels come from phrases whose words stand consecutively.  The
    method's labels come from blocks (windows of 64 words, one every 32) that
    hold at least ``share`` of a template's distinct words.  Blocks are joined
    to templates by the words of the prefixes: with all words in one order, the
    globally rarest first, a block and a template that share enough words
    share one of the first n - needed + 1 words of either.  Blocks with too few
    template words (length filter) and matches that come too late in either
    order (positional filter) are left out before the words are counted.
    ``score`` is 1 if a base phrase was found, else the largest share found.

    Global counts cover all rows.  The templates are the small side with a
    fixed size and are broadcast; blocks are never shuffled, only found
    labels are.  Null and empty texts have no words; texts of any length are
    windows of fixed size; repeated rows get equal results; null ids are
    kept; extra columns aren't read; an empty table gives no rows.
    """
    spark = df.sparkSession
    phrases = PHRASES if phrases is None else phrases
    parts = _templates(templates)
    vocabulary = sorted({w for _, _, words in parts for w in words})
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("_key"), _normal(text).alias("_t"))
    words = F.filter(F.split(F.trim("_t"), " "), lambda w: w != "")

    # one number for each word of the templates: in how many documents it stands
    seen = (
        rows.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), words)).alias("w"))
        .groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    )
    times = dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in seen.collect()}
    order = sorted(vocabulary, key=lambda w: (times[w], w))
    place = {w: i for i, w in enumerate(order)}
    prefixes, least = [], min(_needed(len(ws), share) for _, _, ws in parts)
    for n, label, ws in parts:
        ranked, need = sorted(ws, key=place.get), _needed(len(ws), share)
        for at, w in enumerate(ranked[: len(ranked) - need + 1]):
            prefixes.append((w, n, label, at, len(ranked), need, ranked))
    index = spark.createDataFrame(prefixes, "w string, template int, label string, at int, size int, need int, ranked array<string>")

    last = F.greatest(F.lit(0), F.ceil(F.size("_w") / F.lit(HALF)) - 2).cast("int")
    blocks = (
        rows.select("doc_id", "_key", words.alias("_w"))
        .where(F.size("_w") >= least)
        .select("doc_id", "_key", F.explode(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice("_w", b * HALF + 1, 2 * HALF))).alias("_b"))
        # in global order, each once
        .select("doc_id", "_key", F.array_intersect(F.array(*map(F.lit, order)), F.col("_b")).alias("held"))
        .where(F.size("held") >= least)
    )
    probes = blocks.select(
        "doc_id", "_key", "held", F.posexplode(F.slice("held", F.lit(1), F.size("held") - least + 1)).alias("j", "w")
    )
    met = probes.join(F.broadcast(index), "w").where(
        (F.size("held") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("at"), F.size("held") - F.col("j")) - 1 >= F.col("need"))
    )
    common = F.size(F.array_intersect("ranked", "held"))
    found = (
        met.withColumn("common", common)
        .where(F.col("common") >= F.col("need"))
        .groupBy("doc_id", "_key")
        .agg(F.collect_set("label").alias("_found"), F.max(F.col("common") / F.col("size")).alias("_share"))
    )
    found = written(found, "found").withColumnsRenamed({"doc_id": "_doc", "_key": "_k"})

    def spaces(t: Column) -> Column:
        return (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("long")

    t = F.col("_t")
    n_words = F.when(F.length(t) > 2, spaces(t) - 1).otherwise(F.lit(0).cast("long"))
    hits, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in phrases.items():
        own = f" {phrase} "
        here = F.contains(t, F.lit(own))
        # a look-ahead, so that places may share the blank between them
        hits = hits + F.when(here, F.regexp_count(t, F.lit(f"(?={own})")).cast("long")).otherwise(F.lit(0).cast("long"))
        at = F.locate(own, t)
        firsts.append(F.when(here, spaces(F.substring(t, F.lit(1), at)) - 1))
        back = F.locate(own[::-1], F.reverse(t))
        lasts.append(F.when(here, spaces(F.substring(t, F.lit(1), F.length(t) - back - len(own) + 2)) - 1))
        labels.append(F.when(here, F.lit(label)))
    # what nothing was found in carries a null through least and greatest
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    out = rows.select(
        "doc_id", "_key", n_words.alias("n_words"), hits.alias("n_base"),
        F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), base.alias("_base"),
    )
    joined = out.join(found, out["doc_id"].eqNullSafe(found["_doc"]) & (out["_key"] == found["_k"]), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.coalesce("_found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )
