"""Licence notices by the Dice coefficient over word bigrams; built-in functions only.

Each line of a text, and the text as a whole, is normalised to lower-case words and compared with
every template whose size makes the wanted coefficient possible: with sizes a and b the
coefficient is at most 2 min(a, b) / (a + b), so a must lie between b t / (2 - t) and
b (2 - t) / t. Everything happens inside the row that holds the text, without an exchange.

A notice wrapped over lines, or inside a longer line or a whole licence, is found as a window of the
text's words: any run of bigrams that starts and ends with one of the template's and is at most
(2 - t) / t times as long as the template. Any match needs b t / (2 - t) of the template's bigrams, so
a text is compared with a template, by line or window, only if it has enough of the template's words.
"""

import functools
import math
import operator

from pyspark.sql import DataFrame, functions as F

from driftgate.llm.common import text_or_empty

MIN_DICE = 0.8
# Names and notices of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of "
                   "the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the "
                "terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later "
                "version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."),
)


def _words_of(text):
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()


def _bigrams_of(text):
    """The distinct word bigrams of a template, as the expressions below make them."""
    words = _words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _array_sql(texts):
    return f"array({', '.join(map(_quoted, texts))})"


def _needs(text, min_dice):
    """The bigrams of a template that a match needs, and words of which it has at least one."""
    words, grams = _words_of(text), _bigrams_of(text)
    need = max(1, math.ceil(len(grams) * min_dice / (2 - min_dice) - 1e-9))
    # Without these words, the longest first, too few bigrams are left.
    left, some = grams, []
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < need:
            break
        some.append(word)
        left = [g for g in left if word not in g.split()]
    return need, some


def _any_word(column, templates, min_dice):
    """Whether a text in lower case has, as letters in a row, a word that some template's match needs."""
    some = {w for _, text in templates for w in _needs(text, min_dice)[1]}
    some = sorted(w for w in some if not any(o in w for o in some - {w}))
    return functools.reduce(operator.or_, [F.contains(column, F.lit(w)) for w in some], F.lit(False))


def _windows_sql(templates, min_dice):
    """Templates with what a match needs: `need` bigrams, so one of the words `any` and `least` of all
    words; a window has at most `most` bigrams."""
    rows = []
    for name, text in templates:
        words, grams = _words_of(text), _bigrams_of(text)
        need, some = _needs(text, min_dice)
        least = len(set(words)) - 2 * (len(grams) - need)
        most = math.floor((len(words) - 1) * (2 - min_dice) / min_dice + 1e-9)
        rows.append(f"named_struct('name', {_quoted(name)}, 'n', {len(grams)}, 'need', {need}, "
                    f"'least', {least}, 'most', {most}, 'any', {_array_sql(some)}, "
                    f"'words', {_array_sql(sorted(set(words)))}, 'grams', {_array_sql(grams)})")
    return f"array({', '.join(rows)})"


def _best_window():
    """The best window of template t, of `_pairs`, as (dice, name). p: where t's bigrams are."""
    dice = """transform(filter(slice(p, i + t.need, t.most), e -> e - p[i] < t.most), e ->
        transform(array(slice(_pairs, p[i] + 1, e - p[i] + 1)), w ->
            2.0D * size(array_intersect(w, t.grams)) / (size(array_distinct(w)) + t.n))[0])"""
    places = """filter(transform(_pairs, (g, i) -> if(array_contains(t.grams, g), i, -1)),
        i -> i >= 0)"""
    return f"""transform(array({places}), p -> named_struct('dice', array_max(transform(
        filter(sequence(0, size(p) - t.need), i -> p[i + t.need - 1] - p[i] < t.most),
        i -> array_max({dice}))), 'name', t.name))[0]"""


def scan_licenses(docs: DataFrame, templates=TEMPLATES, min_dice=MIN_DICE,
                  text_col="text") -> DataFrame:
    """Add n_lines, n_matches, license, dice, licenses to every document.

    A line matches when its best template reaches `min_dice`. A name that neither a line nor the whole
    text gives counts as one match more when a window of the text reaches `min_dice`. `license` is
    the best of all matches (ties: the later name), `dice` its coefficient, `licenses` the distinct
    names comma-joined in order. Lines of fewer than two words have no bigrams and match nothing.
    Null texts have no lines. Input columns of these names give way. `templates` is a parameter
    of the call, not a table.
    """
    sizes = [len(_bigrams_of(text)) for _, text in templates]
    least, most = min(sizes), max(sizes)
    low, high = least * min_dice / (2 - min_dice), most * (2 - min_dice) / min_dice
    lines = F.split(text_or_empty(text_col), "\n")
    segments = F.when(F.col(text_col).isNull(), F.array().cast("array<string>")).when(
        F.size(lines) > 1, F.concat(lines, F.array(F.col(text_col)))).otherwise(lines)
    def words(s):
        return F.split(F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " "))), " ")

    # The text's words first: most texts have too few of any template.
    none = F.array().cast("array<array<string>>")
    grams = f"""transform(filter(_words, w -> size(w) - 1 >= {low}), w -> array_distinct(
        zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> a || ' ' || b)))"""
    scores = f"""transform(filter(_grams, g -> size(g) >= {low} and size(g) <= {high}), g ->
        array_max(transform(filter(_templates, t ->
            size(g) >= t.n * {min_dice} / (2 - {min_dice})
            and size(g) <= t.n * (2 - {min_dice}) / {min_dice}), t -> named_struct(
            'dice', 2.0D * size(array_intersect(g, t.grams)) / (size(g) + t.n),
            'name', t.name))))"""
    names = sorted({w for _, text in templates for w in _words_of(text)})
    found = docs.withColumn("_lower", F.lower(F.col(text_col)))
    found = found.withColumn("_whole", F.when(_any_word(F.col("_lower"), templates, min_dice), words(
        F.col(text_col))).otherwise(F.array().cast("array<string>"))).drop("_lower")
    found = found.withColumn("_present", F.expr(f"array_intersect({_array_sql(names)}, _whole)"))
    found = found.withColumn("_templates", F.expr(f"""filter({_windows_sql(templates, min_dice)}, t ->
        arrays_overlap(t.any, _present) and size(array_intersect(t.words, _present)) >= t.least)"""))
    found = found.withColumn("_words", F.when(F.size("_templates") == 0, none).otherwise(
        F.transform(segments, words)))
    found = found.withColumn("_grams", F.expr(grams)).withColumn(
        "_found", F.expr(f"filter({scores}, m -> m.dice >= {min_dice})"))
    found = found.withColumn("_near", F.expr(
        "filter(_templates, t -> not exists(_found, m -> m.name = t.name))"))
    found = found.withColumn("_pairs", F.expr("""if(size(_near) = 0, cast(array() as array<string>),
        zip_with(slice(_whole, 1, size(_whole) - 1), slice(_whole, 2, size(_whole) - 1),
                 (a, b) -> a || ' ' || b))"""))
    # The best window of each name.
    found = found.withColumn("_more", F.expr(f"""filter(transform(filter(_near, t ->
        size(array_intersect(t.grams, _pairs)) >= t.need), t -> {_best_window()}),
        m -> m.dice >= {min_dice})"""))
    found = found.withColumn("_found", F.expr("""concat(_found, array_distinct(filter(_more, m ->
        not exists(_more, o -> o.name = m.name and o.dice > m.dice))))"""))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    return found.withColumns({
        "n_lines": n_lines, "n_matches": F.size("_found").cast("long"),
        "license": F.array_max("_found")["name"], "dice": F.array_max("_found")["dice"],
        "licenses": F.array_join(F.array_sort(F.array_distinct(
            F.transform("_found", lambda m: m["name"]))), ","),
    }).drop("_whole", "_present", "_templates", "_words", "_grams", "_found", "_near", "_pairs", "_more")


def _sql():
    rows = ", ".join(f"({_quoted(name)}, {len(g)}, [{', '.join(map(_quoted, g))}])"
                     for name, text in TEMPLATES for g in [_bigrams_of(text)])
    t = MIN_DICE
    return f"""
WITH templates(name, n, grams) AS (VALUES {rows}),
segments AS (SELECT *, row_number() OVER () AS sid FROM (
  SELECT doc_id, unnest(CASE WHEN text IS NULL THEN [] WHEN strpos(text, chr(10)) > 0
    THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS s FROM documents)),
words AS (SELECT doc_id, sid, string_split(trim(lower(
    regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM segments),
grams AS (SELECT doc_id, sid,
                 list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM words),
scored AS (
  SELECT doc_id, sid, name, 2.0 * len(list_intersect(g, t.grams)) / (len(g) + n) AS dice
  FROM grams, templates t
  WHERE len(g) >= n * {t} / (2 - {t}) AND len(g) <= n * (2 - {t}) / {t}),
best AS (SELECT doc_id, sid, max({{'dice': CAST(dice AS DOUBLE), 'name': name}}) AS m
         FROM scored WHERE dice >= {t} GROUP BY doc_id, sid),
found AS (SELECT doc_id, count(*) AS n_matches, max(m) AS m,
                 array_to_string(list_sort(list(DISTINCT m.name)), ',') AS licenses
          FROM best GROUP BY doc_id),
lines AS (SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END
          AS n_lines FROM documents)
SELECT doc_id, n_lines, coalesce(n_matches, 0) AS n_matches, m.name AS license, m.dice AS dice,
       coalesce(licenses, '') AS licenses
FROM lines LEFT JOIN found USING (doc_id)"""


SQL = _sql()
