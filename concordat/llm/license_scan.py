"""License scans by an exact set-similarity join of text blocks with license templates.

The blocks are all windows of consecutive words of a text, wherever its lines end, a quarter longer than
the template; a block and a template are sets of words. They are joined if the block holds at least
``threshold`` of the template's words (one may always be missing) and, word by word, the runs that
tell the license from its relatives: CC BY-NC lacks one word of CC BY-SA only, and GPL one of LGPL.

Words are ranked by how few documents of the whole table have them. In that order a template's first
``size - need + 1`` words are its prefix, and a block without any of them cannot reach ``need`` common
words. An index from prefix words to templates gives a text its candidates; the length filter (enough
of the text's words) and the positional filter (enough words of the template from the first common one
on) thin them out. For what is left, the best block is found exactly: every place of a word counts
for a range of blocks, the ranges' ends are sorted, and a running sum over them is the number of
different words in each block. That takes n log n steps however often words repeat.

The join is compiled into expressions over a document's own row, so documents are never shuffled; the
one shuffle is that of word counts, one row for each template word and task.

Phrases (the base) are places where a phrase's words stand consecutively. Words are runs of digits,
letters a-z and characters from U+0080 on, after A-Z are lower-cased.

Defined results: a null text is an empty one: no words, no labels, score 0; ids may be null or
repeat, rows are judged one by one; an empty table gives an empty one; long texts are scanned whole;
further columns are ignored, whatever their names. ``score`` is the largest share of words of any
template that is joined, 1 if a phrase stands in the text, 0 if neither.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.llm.common import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels, fixed by the query.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def plain_words(text: str) -> list[str]:
    """The words of a template, as those of a text are taken."""
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


@dataclass(frozen=True)
class Template:
    """``names`` are runs of words that a block has to hold as they are."""

    label: str
    text: str
    names: tuple[str, ...] = ()

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(sorted(set(plain_words(self.text))))

    def need(self, threshold: float) -> int:
        return max(1, min(len(self.words) - 1, math.ceil(threshold * len(self.words) - 1e-9)))

    def window(self, stretch: float) -> int:
        return math.ceil(stretch * len(plain_words(self.text)))


def _gnu(program: str, name: str, version: str) -> str:
    return f"This {program} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Grants and notices of licenses as their publishers word them, and statements by which works name their
#: license (fixed values).
TEMPLATES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        ("associated documentation files",),
    ),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("associated documentation files",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template(
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("without fee",)),
    Template(
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("commercial applications",),
    ),
    Template("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("accompanying documentation",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    Template(
        "apache-2",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    ),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("lgpl-3", "Licensed under the GNU Lesser General Public License, version 3", ("lesser general public license", "version 3")),
    Template("lgpl-2", "Licensed under the GNU Lesser General Public License, version 2", ("lesser general public license", "version 2")),
    Template("agpl-3", "Licensed under the GNU Affero General Public License, version 3", ("affero general public license", "version 3")),
    Template("gpl-3", _gnu("program", "General Public License", "3"), ("gnu general public license", "version 3")),
    Template("gpl-2", _gnu("program", "General Public License", "2"), ("gnu general public license", "version 2")),
    Template("lgpl-3", _gnu("library", "Lesser General Public License", "3"), ("lesser general public license", "version 3")),
    Template("lgpl-2", _gnu("library", "Lesser General Public License", "2.1"), ("lesser general public license", "version 2")),
    Template("agpl-3", _gnu("program", "Affero General Public License", "3"), ("affero general public license", "version 3")),
    Template("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    Template("epl-2", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license", "2 0")),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", ("public domain",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
    Template("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("attribution noderivatives 4 0",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc0", "dedicated to the public domain under Creative Commons Zero CC0 1.0", ("cc0 1 0",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("neighboring rights",)),
)


@dataclass(frozen=True)
class LicenseConfig:
    phrases: tuple[tuple[str, str], ...] = PHRASES
    templates: tuple[Template, ...] = TEMPLATES
    threshold: float = 0.85
    stretch: float = 1.25
    vocabulary: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "vocabulary", tuple(sorted({w for t in self.templates for w in t.words})))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(low: Column) -> Column:
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _strings(values) -> Column:
    """An array of words as one literal."""
    return F.split(F.lit(" ".join(values)), " ") if values else F.array().cast("array<string>")


def token_order(docs: DataFrame, text_col: str, config: LicenseConfig) -> list[str]:
    """The templates' words, the rarest first, counted over all documents."""
    present = F.array_intersect(F.split(lowered(F.col(text_col)), SEPARATORS), _strings(config.vocabulary))
    counts = {r[0]: r[1] for r in docs.select(F.explode(present).alias("w")).groupBy("w").agg(F.count("*")).collect()}
    return sorted(config.vocabulary, key=lambda w: (counts.get(w, 0), w))


def _stands(words: Column, parts: list[str]):
    return lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == w for k, w in enumerate(parts)])


def _labelled(label: str):
    return lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start"))


def _places(words: Column, config: LicenseConfig) -> Column:
    """``struct(label, start)`` of all phrase places."""
    found = []
    for phrase, label in config.phrases:
        parts = phrase.split()
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), _stands(words, parts))
        found.append(F.transform(F.when(F.size(words) >= len(parts), starts).otherwise(F.array().cast("array<int>")), _labelled(label)))
    return F.flatten(F.array(*found))


#: What a name adds to the running sum; more than any template has words.
NAME = 10_000


def _compiled(order: list[str], config: LicenseConfig) -> tuple[Column, Column, list[str]]:
    """The templates as one literal array, the index from prefix words to their numbers, and its words."""
    rank = {w: k for k, w in enumerate(order)}
    rows, index = [], {}
    for number, t in enumerate(config.templates, 1):
        words, need = sorted(t.words, key=rank.__getitem__), t.need(config.threshold)
        for w in words[: len(words) - need + 1]:
            index.setdefault(w, []).append(number)
        names = [_strings(plain_words(n)) for n in t.names]
        rows.append(
            F.struct(
                F.lit(t.label).alias("label"),
                _strings(words).alias("words"),
                F.lit(len(words)).alias("size"),
                F.lit(need).alias("need"),
                F.lit(t.window(config.stretch)).alias("window"),
                (F.array(*names) if names else F.array().cast("array<array<string>>")).alias("names"),
            )
        )
    prefixes = sorted(index)
    numbers = F.array(*[F.split(F.lit(" ".join(map(str, index[w]))), " ").cast("array<int>") for w in prefixes])
    return F.array(*rows), F.map_from_arrays(_strings(prefixes), numbers), prefixes


def _best_block(words: Column, t: Column) -> Column:
    """The largest sum of a block: one for each of the template's words in it, ``NAME`` for each name."""

    def coded() -> Column:
        single = F.filter(
            F.transform(words, lambda w, i: F.struct(F.array_position(t["words"], w).cast("int").alias("code"), i.alias("at"), F.lit(1).alias("long"))),
            lambda x: x["code"] > 0,
        )

        def runs(name: Column, k: Column) -> Column:
            n = F.size(name)
            found = F.filter(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.slice(words, i + 1, n) == name)
            return F.when(F.size(words) >= n, F.transform(found, lambda i: F.struct((-k - 1).alias("code"), i.alias("at"), n.alias("long"))))

        return F.array_sort(F.concat(single, F.flatten(F.array_compact(F.transform(t["names"], runs)))))

    def ends(places: Column) -> Column:
        """A place counts for the blocks that begin after the place before it of the same word, hold all of
        it and begin no later than it does."""

        def span(x: Column, i: Column) -> Column:
            last = F.get(places, i - 1)
            after = F.when(last["code"] == x["code"], last["at"] + 1).otherwise(F.lit(-(1 << 30)))
            first = F.greatest(after, x["at"] + x["long"] - t["window"])
            worth = F.when(x["code"] < 0, F.lit(NAME)).otherwise(F.lit(1))
            return F.when(first <= x["at"], F.array(F.struct(first.alias("at"), worth.alias("worth")), F.struct((x["at"] + 1).alias("at"), (-worth).alias("worth"))))

        return F.array_sort(F.flatten(F.array_compact(F.transform(places, span))))

    def largest(events: Column) -> Column:
        begin = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best"))

        def step(total: Column, e: Column) -> Column:
            now = total["sum"] + e["worth"]
            return F.struct(now.alias("sum"), F.greatest(total["best"], now).alias("best"))

        return F.aggregate(events, begin, step, lambda total: total["best"])

    return let(let(coded(), ends), largest)


def _hits(words: Column, present: Column, compiled: tuple[Column, Column, list[str]]) -> Column:
    """``struct(label, containment)`` of each template that some block is joined with; ``present`` are the
    templates' words that the text has."""
    templates, index, prefixes = compiled
    numbers = F.array_distinct(F.flatten(F.transform(F.array_intersect(present, _strings(prefixes)), lambda w: F.element_at(index, w))))

    def judged(number: Column) -> Column:
        def held(t: Column) -> Column:
            def counted(common: Column) -> Column:
                rest = t["size"] - F.array_position(t["words"], F.get(common, F.lit(0))) + 1
                joined = let(_best_block(words, t) - NAME * F.size(t["names"]), lambda n: F.when(n >= t["need"], F.struct(t["label"].alias("label"), (n / t["size"]).alias("containment"))))
                return F.when((rest >= t["need"]) & (F.size(common) >= t["need"]), joined)

            return let(F.array_intersect(t["words"], present), counted)

        return let(F.element_at(templates, number), held)

    return F.array_compact(F.transform(numbers, judged))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels`` and ``score``."""
    order = token_order(docs, text_col, config)
    rank = {w: k for k, w in enumerate(order)}
    rare = [min(p.split(), key=lambda w: rank.get(w, -1)) for p, _ in config.phrases]
    no_place = F.array().cast("array<struct<label:string,start:bigint>>")
    compiled = _compiled(order, config)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), lowered(F.col(text_col)).alias("low"))

    def row(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.when(F.arrays_overlap(words, _strings(rare)), _places(words, config)).otherwise(no_place).alias("places"),
            let(F.array_intersect(words, _strings(config.vocabulary)), lambda present: _hits(words, present, compiled)).alias("hits"),
        )

    judged = slim.select("id", let(words_of(F.col("low")), row).alias("x"))
    base = F.array_sort(F.array_distinct(F.transform("x.places", lambda p: p["label"])))
    own = F.transform("x.hits", lambda h: h["label"])
    begins = F.transform("x.places", lambda p: p["start"])
    best = F.coalesce(F.array_max(F.transform("x.hits", lambda h: h["containment"])), F.lit(0.0))
    return judged.select(
        F.col("id").alias(id_col),
        F.col("x.n_words").alias("n_words"),
        F.size("x.places").cast("long").alias("n_base"),
        F.array_min(begins).alias("first_word"),
        F.array_max(begins).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(F.size("x.places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
