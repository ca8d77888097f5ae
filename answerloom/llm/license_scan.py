"""Licence notices in texts, by Dice coefficient of word bigrams with licence templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices as licences word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met:"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files (the \"Software\"), to deal in the Software without restriction,"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Dice coefficient from which a segment counts as a notice.
MIN_DICE = 0.8
#: Characters at the head of a longer segment that may tell that it has too many bigrams.
HEAD = 1024


def normal_words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), "")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    firsts = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.transform(firsts, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1))))


def may_have(text: Column, most: float) -> Column:
    """False for a text that is sure to have more than `most` distinct bigrams by its first HEAD characters.

    A text has at least as many bigrams as words but one, and the head may end inside a word.
    """
    return (F.length(text) <= HEAD) | (F.size(F.array_distinct(normal_words(F.substring(text, 1, HEAD)))) - 2 <= most)


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for name, text in sorted(templates.items()):
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()
        out[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
    return out


def license_notices(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    min_dice: float = MIN_DICE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Notices of each text: id, n_segments, n_candidates, notices (segment, text, template, dice).

    A segment is a line, a paragraph (what stands between blank lines) or the whole text; equal segments count once.
    A segment and a template have the Dice coefficient 2 * shared / (a + b) of their sets of word bigrams, so only
    segments with between b * d / (2 - d) and b * (2 - d) / d bigrams can reach d: others are dropped by their number
    of words before any comparison (a repeated bigram makes a set smaller, so the upper bound is tested on the set, or
    on the distinct words at the head of a long segment).
    A segment that is close to several templates has the closest one, of equals the first by name.

    Nulls and empty texts have no segment; null ids stay. Repeated rows give equal rows. Extra columns are ignored.
    Any length of text is read whole; an empty table gives an empty result. Everything runs in the scan's stage.
    """
    grams = template_bigrams(TEMPLATES if templates is None else templates)
    sizes = [len(g) for g in grams.values() if g]
    low = min(sizes, default=0) * min_dice / (2 - min_dice)
    high = max(sizes, default=0) * (2 - min_dice) / min_dice
    text = F.coalesce(F.col(text_col), F.lit(""))
    blocks = F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"), F.array(text))
    segments = F.array_distinct(F.filter(blocks, lambda s: s != ""))
    cut = docs.select(F.col(id_col).alias("id"), segments.alias("segments"))
    counted = cut.select(
        "id",
        F.size("segments").alias("n_segments"),
        F.filter(
            F.transform(F.filter("segments", lambda s: may_have(s, high)), lambda s: F.struct(s.alias("text"), normal_words(s).alias("words"))),
            lambda s: F.size(s.words) > low,
        ).alias("candidates"),
    )
    sets = counted.select(
        *("id", "n_segments"),
        F.filter(
            F.transform("candidates", lambda s: F.struct(s.text.alias("text"), bigrams(s.words).alias("grams"))),
            lambda s: (F.size(s.grams) >= low) & (F.size(s.grams) <= high),
        ).alias("candidates"),
    )

    def scored(s: Column) -> Column:
        each = [
            F.struct(
                (F.lit(2.0) * F.size(F.array_intersect(s.grams, F.array(*map(F.lit, g)))) / (F.size(s.grams) + len(g))).alias("dice"),
                F.lit(-i).alias("rank"),
                F.lit(name).alias("template"),
            )
            for i, (name, g) in enumerate(grams.items())
            if g
        ]
        best = F.array_max(F.array(*each))
        return F.struct(s.text.alias("text"), best.template.alias("template"), best.dice.alias("dice"))

    notices = F.filter(F.transform("candidates", scored), lambda s: s.dice >= min_dice) if sizes else F.array()
    return sets.select("id", "n_segments", F.size("candidates").alias("n_candidates"), notices.alias("notices"))


def license_digest(notices: DataFrame) -> DataFrame:
    """One row per document: its licences by name, the number of notices and the best coefficient."""
    names = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n.template)))
    return notices.select(
        F.col("id").alias("doc_id"),
        F.col("n_segments").cast("long").alias("n_segments"),
        F.col("n_candidates").cast("long").alias("n_candidates"),
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(names, ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("notices", lambda n: n.dice)), F.lit(0.0)), 6).alias("best_dice"),
    )


def license_sql(min_dice: float = MIN_DICE) -> str:
    """The digest in DuckDB's SQL."""
    grams = template_bigrams(TEMPLATES)
    sizes = [len(g) for g in grams.values()]
    low, high = min(sizes) * min_dice / (2 - min_dice), max(sizes) * (2 - min_dice) / min_dice
    rows = ", ".join(f"({-i}, '{name}', [{', '.join(repr(x) for x in g)}])" for i, (name, g) in enumerate(grams.items()))
    return f"""
WITH templates(rank, template, grams) AS (VALUES {rows}),
cut AS (SELECT doc_id, list_filter(list_distinct(list_concat(string_split(coalesce(text, ''), chr(10)),
    string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n'), [coalesce(text, '')])), lambda s: s <> '') AS segments FROM documents),
words AS (SELECT doc_id, s, list_filter(string_split(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS words
  FROM (SELECT doc_id, unnest(segments) AS s FROM cut)),
sets AS (SELECT doc_id, s, list_distinct(list_transform(list_zip(words[:-2], words[2:]), lambda p: p[1] || ' ' || p[2])) AS grams
  FROM words WHERE len(words) > {low!r}),
candidates AS (SELECT * FROM sets WHERE len(grams) >= {low!r} AND len(grams) <= {high!r}),
scored AS (SELECT doc_id, s, arg_max(template, (dice, rank)) AS template, max(dice) AS dice FROM (
    SELECT c.doc_id, c.s, t.template, t.rank,
      2.0::DOUBLE * len(list_intersect(c.grams, t.grams)) / (len(c.grams) + len(t.grams)) AS dice
    FROM candidates c CROSS JOIN templates t) GROUP BY doc_id, s),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT template, ',' ORDER BY template) AS names, max(dice) AS best
  FROM scored WHERE dice >= {min_dice!r} GROUP BY doc_id)
SELECT d.doc_id, len(d.segments)::BIGINT AS n_segments,
  (SELECT count(*) FROM candidates c WHERE c.doc_id = d.doc_id) AS n_candidates,
  coalesce(f.n, 0)::BIGINT AS n_notices, coalesce(f.names, '') AS licenses, round(coalesce(f.best, 0.0)::DOUBLE, 6) AS best_dice
FROM cut d LEFT JOIN found f ON f.doc_id = d.doc_id"""
