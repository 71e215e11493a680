"""Licence scan by sentence identifiers and ordered rules.

A text is cut into sentences, each is normalised and mapped to the identifier
of a known licence sentence, and the sequence of identifiers is matched against
rules: a rule holds when its identifiers occur in its order, with others in
between allowed.  Where one licence is the beginning of another, the sentence at
which they part is joined with the next one, so the shorter rule does not hold
inside the longer text.  A sentence that names a holder is known by its other
words.  Texts are read in several views: with line ends as sentence
ends; with line ends as spaces, for wrapped sentences; and with single line ends
as spaces but blank lines as sentence ends, for notices under headings without a
full stop.  Known sentences with a colon or semicolon inside (the GPL's) are
found where only full stops end a sentence.

Everything happens inside a row, so nothing is shuffled and no group can be
hot.  A text without any of the trigger words (at least one is in each known
sentence) skips the work.  Only DataFrame functions are used.

Nulls and edge cases: a null or empty text has no sentence; repeated rows are
judged alike; very long texts are read whole; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers of known sentences and their normalised words.
SENTENCES = {
    "mit-ref": "released under the mit license",
    "mit-ref-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-upper": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-ref": "licensed under the apache license version 2 0",
    "apache-ref-2": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "gpl3-ref": "this work is licensed under the gnu general public license version 3",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "ccbync-ref": "licensed under cc by nc 4 0",
    "ccby-ref": "licensed under cc by 4 0",
    "ccbysa-ref": "licensed under cc by sa 4 0",
    "ccby-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd-redist": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "reserved": "all rights reserved",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
    "isc-grant": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-or": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc0-dedicate": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "apache-license": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "apache-licensor": "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    "gpl2-intent": "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
    "gpl3-kind": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl3-intent": "by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users",
}

#: Sentences with names of holders in them, by words that they all have.
NAMED = {"bsd-endorse": "endorse or promote products derived from this software"}

#: The GNU licences' names and versions, as their notices have them.
GNU = [
    ("GPL-2.0-or-later", "gnu general public license", "2"),
    ("GPL-3.0-or-later", "gnu general public license", "3"),
    ("LGPL-2.1-or-later", "gnu lesser general public license", "2 1"),
    ("LGPL-3.0-or-later", "gnu lesser general public license", "3"),
    ("AGPL-3.0-or-later", "gnu affero general public license", "3"),
]
for _name, _license, _version in GNU:
    for _what in ("program", "library"):
        SENTENCES[f"free-{_what}-{_name}"] = (
            f"this {_what} is free software you can redistribute it and or modify it under the terms of the {_license} "
            f"as published by the free software foundation either version {_version} of the license or at your option any later version"
        )

#: The same notices for one version only.
ONLY = [
    "the terms of the {license} as published by the free software foundation version {version} of the license",
    "the terms of the {license} as published by the free software foundation version {version}",
    "the terms of the {license} version {version} as published by the free software foundation",
    "the terms of the {license} version {version} only as published by the free software foundation",
    "the terms of version {version} of the {license} as published by the free software foundation",
]
for _name, _license, _version in GNU:
    for _what in ("program", "library"):
        for _k, _terms in enumerate(ONLY):
            SENTENCES[f"only-{_what}-{_k}-{_name}"] = (
                f"this {_what} is free software you can redistribute it and or modify it under " + _terms.format(license=_license, version=_version)
            )

#: Licences and the identifiers that must follow in this order.
RULES = [
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-ref-2"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-ref"]),
    ("Apache-2.0", ["apache-ref-2", "apache-use"]),
    ("Apache-2.0", ["apache-use", "apache-copy"]),
    ("Apache-2.0", ["apache-license", "apache-licensor"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("GPL-3.0", ["gpl3-kind", "gpl3-intent"]),
    ("GPL-2.0", ["gpl2-intent"]),
    ("CC-BY-NC-4.0", ["ccbync-ref"]),
    ("CC-BY-4.0", ["ccby-ref"]),
    ("CC-BY-4.0", ["ccby-long"]),
    ("CC-BY-SA-4.0", ["ccbysa-ref"]),
    ("BSD-2-Clause", ["bsd-redist", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redist", "bsd-source", "bsd-binary+bsd-endorse"]),
    ("all-rights-reserved", ["reserved"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-or"]),
    ("CC0-1.0", ["cc0-dedicate"]),
    ("Unlicense", ["unlicense-free"]),
]
RULES += [(_name, [f"free-{_what}-{_name}"]) for _name, _, _ in GNU for _what in ("program", "library")]
RULES += [(_name.replace("-or-later", "-only"), [f"only-{_what}-{_k}-{_name}"]) for _name, _, _ in GNU for _what in ("program", "library") for _k in range(len(ONLY))]

#: Two identifiers that follow each other directly and then count as one.
JOINED = [("bsd-binary", "bsd-endorse")]

#: A line that names a licence by its short identifier, for every licence of the rules.
for _name in sorted({n for n, _ in RULES if n != "all-rights-reserved"}):
    SENTENCES[f"spdx-{_name}"] = "spdx license identifier " + "".join(c if c.isalnum() else " " for c in _name.lower())
    RULES.append((_name, [f"spdx-{_name}"]))

#: Words of which every known sentence has at least one.
TRIGGERS = ("licen", "permission", "redistribut", "warrant", "reserved", "public domain", "endorse or promote")

SENTENCE_END = r"[.!?;:]+(?:\s+|$)|\n+"

#: The number of a point of a list, where a normalised sentence begins with it.
NUMBER = "^[0-9]{1,2} (?=[a-z]{3})"

#: As ``SENTENCE_END``, but colons and semicolons stay inside a sentence.
FULL_STOP = r"[.!?]+(?:\s+|$)|\n+"

#: A line end and all lines without letters or digits after it (blank, or comment marks).
BLANK_LINES = r"\n(?:[^A-Za-z0-9\n]*\n)+"

#: Blank lines before an indented address belong to the sentence that names it.
BEFORE_ADDRESS = BLANK_LINES + r"([^A-Za-z0-9\n]*https?://)"


def check_tables(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> None:
    """Raise where a sentence has no trigger or a rule names an unknown sentence."""
    for name, words in {**sentences, **NAMED}.items():
        if not any(t in words for t in TRIGGERS):
            raise ValueError(f"sentence {name} has no trigger word")
    for name, ids in rules:
        if not ids or not {part for i in ids for part in i.split("+")} <= {*sentences, *NAMED}:
            raise ValueError(f"rule {name} names unknown sentences")


def _paragraphs(text: Column) -> Column:
    """One line for each paragraph: line feeds are left only where blank lines were."""
    held = F.regexp_replace(F.regexp_replace(text, BEFORE_ADDRESS, " $1"), BLANK_LINES, "\0")
    return F.translate(held, "\n\0", " \n")


def _identifiers(text: Column, sentences: dict[str, str], end: str = SENTENCE_END) -> Column:
    """Identifiers of a text's sentences, in order; the number of a list's point before a sentence is not of it."""
    known = F.create_map(*[F.lit(x) for name, words in sentences.items() for x in (words, name)])
    normal = F.transform(F.split(text, end), lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), NUMBER, ""))
    named = lambda w: [F.when(F.contains(w, F.lit(part)), F.lit(name)) for name, part in NAMED.items()]
    return F.filter(F.transform(normal, lambda w: F.coalesce(F.try_element_at(known, w), *named(w))), lambda x: x.isNotNull())


def rule_pattern(ids: list[str]) -> str:
    return ".*".join(f" {i.replace('+', '[+]').replace('.', '[.]')} " for i in ids)


def scan(
    docs: DataFrame,
    sentences: dict[str, str] = SENTENCES,
    rules: list[tuple[str, list[str]]] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, sentence_ids, licenses`` of every row.

    ``sentence_ids`` are those found with line ends as sentence ends, in order;
    ``licenses`` are the distinct licences of the rules met, sorted.
    """
    check_tables(sentences, rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("maybe", F.col("text").rlike("(?i)" + "|".join(TRIGGERS)))
    none = F.array().cast("array<string>")
    lines, wrapped, paragraphs = F.col("text"), F.translate("text", "\n", " "), _paragraphs(F.col("text"))
    views = [(lines, SENTENCE_END), (wrapped, SENTENCE_END), (paragraphs, SENTENCE_END), (lines, FULL_STOP), (paragraphs, FULL_STOP)]
    ids = [F.when(F.col("maybe"), _identifiers(view, sentences, end)).otherwise(none) for view, end in views]
    names = ["sentence_ids", *(f"view_{k}" for k in range(1, len(views)))]
    rows = rows.select("doc_id", *(c.alias(n) for c, n in zip(ids, names)))
    line = lambda c: F.concat(F.lit(" "), F.array_join(c, "  "), F.lit(" "))
    # One string of all views; a line feed keeps a rule inside one of them.
    rows = rows.select("doc_id", "sentence_ids", F.concat_ws("\n", *(line(n) for n in names)).alias("seen"))
    for one, two in JOINED:
        rows = rows.withColumn("seen", F.replace("seen", F.lit(f" {one}  {two} "), F.lit(f" {one}+{two} ")))
    met = [F.when(F.col("seen").rlike(p), F.lit(name)) for name, p in ((name, rule_pattern(i)) for name, i in rules)]
    licenses = F.array_sort(F.array_distinct(F.array_compact(F.array(*met))))
    return rows.select("doc_id", "sentence_ids", F.when(F.col("seen").rlike(r"\S"), licenses).otherwise(none).alias("licenses"))
