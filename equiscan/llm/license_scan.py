"""License scan with a positional index of rare tokens.

Licence notices are word sequences. The words of their mandatory phrases are counted over all documents; of each notice the
few that the fewest documents use go into a positional index of (word, notice, place). A file's indexed words are looked up,
each posting is shifted by its place in the notice, and the postings of a notice are intersected where they meet. There the
mandatory phrases are compared. A notice counts only where all its mandatory phrases stand in place, so each of its
occurrences has all its indexed words in place, and none is lost by the intersection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiscan.llm.columns import text_or_empty, words_of
from equiscan.session import staged


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    mandatory: tuple[str, ...]


#: Wording of public licence notices, and the phrases without which a notice does not count.
NOTICES = [
    Notice("mit", "released under the mit license", ("mit license",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge", "copy of this software")),
    Notice("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Notice("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Notice("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Notice("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Notice("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Notice("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Notice("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "without modification are permitted")),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", ("use copy modify and or distribute",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Notice("cc0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",)),
    Notice(
        "gpl-3.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
        ("gnu general public license as published by the free software foundation", "version 3 of the license"),
    ),
    Notice(
        "gpl-2.0",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        ("gnu general public license as published by the free software foundation", "version 2 of the license"),
    ),
    Notice("gpl-3.0", "gnu general public license v3 0", ("gnu general public license v3",)),
    Notice("gpl-2.0", "gnu general public license v2 0", ("gnu general public license v2",)),
    Notice("lgpl", "gnu library general public license", ("gnu library general public license",)),
    Notice("apache-2.0", "you may not use this file except in compliance with the license", ("not use this file except in compliance with the license",)),
    Notice("bsd", "neither the name of the copyright holder nor the names of its contributors may be used", ("nor the names of its contributors may be used",)),
    Notice("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    Notice("zlib", "altered source versions must be plainly marked as such", ("altered source versions must be plainly marked",)),
    Notice("artistic-2.0", "the artistic license 2 0", ("artistic license 2 0",)),
    Notice("cddl", "common development and distribution license", ("common development and distribution license",)),
    Notice("eupl", "licensed under the european union public licence", ("european union public licence",)),
    Notice("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Notice("cc-by", "creative commons attribution 3 0 unported license", ("creative commons attribution 3 0",)),
    Notice("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Notice("cc-by-sa", "creative commons attribution share alike 3 0 unported license", ("creative commons attribution share alike",)),
    Notice("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Notice("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives",)),
    Notice("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
]
#: Identifiers of the licence tag in source files, and their labels.
SPDX = {
    "MIT": "mit",
    "Apache-2.0": "apache-2.0",
    "GPL-2.0": "gpl-2.0",
    "GPL-3.0": "gpl-3.0",
    "LGPL-2.1": "lgpl",
    "LGPL-3.0": "lgpl",
    "AGPL-3.0": "agpl",
    "MPL-2.0": "mpl-2.0",
    "EPL-2.0": "epl",
    "BSD-2-Clause": "bsd",
    "BSD-3-Clause": "bsd",
    "ISC": "isc",
    "Unlicense": "unlicense",
    "BSL-1.0": "bsl-1.0",
    "Zlib": "zlib",
    "CC0-1.0": "cc0",
    "CC-BY-4.0": "cc-by",
    "CC-BY-SA-4.0": "cc-by-sa",
    "CC-BY-NC-4.0": "cc-by-nc",
}
NOTICES += [Notice(label, tag, (tag,)) for tag, label in ((f"spdx license identifier {' '.join(re.findall('[a-z0-9]+', i.lower()))}", label) for i, label in SPDX.items())]
#: Words of a notice that get postings.
INDEXED = 3
#: The phrases of the base scan and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _offset(text: str, phrase: str) -> int:
    """Words of the text before the phrase."""
    return len(f" {text} ".split(f" {phrase} ", 1)[0].split())


def _starts(words: Column, phrase: str) -> Column:
    """Every place where the words of the phrase stand consecutively; texts without its words are not walked."""
    wanted = phrase.split()
    here = F.lit(True)
    for word in wanted:
        here = here & F.array_contains(words, word)

    def at(i: Column) -> Column:
        same = F.lit(True)
        for j, word in enumerate(wanted):
            same = same & (F.get(words, i + j) == word)
        return same

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), at)
    return F.when(here, places).otherwise(F.array().cast("array<int>"))


def document_frequency(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that use each word of ``vocabulary``; only these words leave the tasks."""
    used = words.select(F.explode(F.array_intersect("words", F.lit(vocabulary))).alias("word"))
    return {r["word"]: r["count"] for r in used.groupBy("word").count().limit(len(vocabulary)).collect()}


def rare_postings(notices: list[Notice], frequency: dict[str, int]) -> list[list[tuple[str, int]]]:
    """For each notice (word, place) of the :data:`INDEXED` words in its mandatory phrases that the fewest documents use,
    the rarest first."""
    out = []
    for notice in notices:
        places = {(w, _offset(notice.text, m) + i) for m in notice.mandatory for i, w in enumerate(m.split())}
        out.append(sorted(places, key=lambda p: (frequency.get(p[0], 0), p))[:INDEXED])
    return out


def scan_licenses(docs: DataFrame, notices: list[Notice] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of ``docs``: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    notices (array of label, first_word and coverage: the notices found, with the share of their words in place).

    Base labels come from phrases in place alone; the method adds the label of every notice whose mandatory phrases stand
    in place, whatever its other words. score is 1 with a base label, else
    the best coverage, 0 without any label.

    Null and empty texts have no words and no labels; first_word and last_word are then null, as without a base phrase.
    Repeated rows and rows without id are scanned each by itself. Columns other than the two named are not read. An empty
    table gives no rows.
    """
    notices = NOTICES if notices is None else notices
    for n in notices:
        if not n.mandatory or any(f" {m} " not in f" {n.text} " for m in n.mandatory):
            raise ValueError(f"a mandatory phrase is not part of the notice {n.label}")
        if re.search(r"[^0-9a-z ]", n.text):
            raise ValueError(f"write the notice {n.label} in lower-case words with single blanks")
    spark = docs.sparkSession
    words = docs.select(F.col(id_col).alias("doc"), words_of(text_or_empty(text_col)).alias("words"))
    frequency = document_frequency(words, sorted({w for n in notices for m in n.mandatory for w in m.split()}))
    postings = rare_postings(notices, frequency)
    leads = F.lit(sorted({terms[0][0] for terms in postings}))
    # Words that a notice can have before and from its rarest word on.
    before = max((terms[0][1] for terms in postings), default=0)
    after = max((len(n.text.split()) - terms[0][1] for n, terms in zip(notices, postings, strict=True)), default=0)
    # Notices all of whose indexed words the text has; postings of other words could not meet.
    term_sets = sorted({tuple(dict.fromkeys(w for w, _ in terms)) for terms in postings})
    present = F.array_intersect("words", F.lit(sorted({w for t in term_sets for w in t})))
    # The words present are used twice, so the planner computes them before, not again for every set of words.
    complete = F.filter(F.lit([list(t) for t in term_sets]), lambda t: F.forall(t, lambda w: F.array_contains("present", w)))
    possible = F.when(F.size("present") > 0, F.array_distinct(F.flatten(complete)))

    def around(i: Column) -> Column:
        low = F.greatest(F.lit(0), i - before)
        word = F.get("words", i)
        near = F.when(F.array_contains(leads, word), F.slice("words", low + 1, F.lit(before + after)))
        return F.struct(i.alias("position"), word.alias("word"), low.alias("low"), near.alias("near"))

    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains("possible", F.get("words", i)))
    scanned = staged(
        words.withColumn("present", present).withColumn("possible", possible).select(
            F.monotonically_increasing_id().alias("row"),
            "doc",
            F.size("words").cast("long").alias("n_words"),
            *(_starts(F.col("words"), phrase).alias(label) for phrase, label in BASE_PHRASES.items()),
            F.when(F.size("possible") > 0, F.transform(places, around)).alias("hits"),
        ),
        "license-words",
    )

    # As many rows as notices have indexed words, and one row a notice.
    index = F.broadcast(
        spark.createDataFrame(
            [(w, place, number, nth == 0, len(terms)) for number, terms in enumerate(postings) for nth, (w, place) in enumerate(terms)],
            "word string, place int, notice int, lead boolean, terms int",
        )
    )
    templates = F.broadcast(
        spark.createDataFrame(
            [(number, n.label, n.text.split(), [(_offset(n.text, m), m.split()) for m in n.mandatory]) for number, n in enumerate(notices)],
            "notice int, label string, template array<string>, mandatory array<struct<at:int,phrase:array<string>>>",
        )
    )
    shifted = scanned.where("hits IS NOT NULL").select("row", F.inline("hits")).join(index, "word").withColumn("base", F.col("position") - F.col("place"))
    met = shifted.groupBy("row", "notice", "base").agg(
        F.count(F.lit(1)).alias("in_place"), F.max("terms").alias("terms"), F.max(F.when(F.col("lead"), F.struct("low", "near"))).alias("_")
    )
    found = met.where("in_place = terms").select("row", "notice", "base", "_.*").join(templates, "notice")
    found = found.withColumn("begin", F.col("base") - F.col("low"))
    in_place = F.forall("mandatory", lambda m: F.when(F.col("begin") + m["at"] >= 0, F.slice("near", F.col("begin") + m["at"] + 1, F.size(m["phrase"]))) == m["phrase"])
    cut = F.greatest(F.lit(0), -F.col("begin"))
    agreeing = F.size(
        F.filter(
            F.zip_with(F.slice("near", F.col("begin") + cut + 1, F.size("template") - cut), F.slice("template", cut + 1, F.size("template")), lambda a, b: a.eqNullSafe(b)),
            lambda same: same,
        )
    )
    verified = found.where(F.coalesce(in_place, F.lit(False))).select(
        "row", F.struct("label", F.col("base").cast("long").alias("first_word"), (agreeing / F.size("template")).alias("coverage")).alias("found")
    )
    by_row = verified.groupBy("row").agg(F.array_sort(F.collect_set("found")).alias("notices"))

    starts = F.concat(*BASE_PHRASES.values())
    base = F.array_compact(F.array(*(F.when(F.size(label) > 0, F.lit(label)) for label in sorted(BASE_PHRASES.values()))))
    none = F.array().cast("array<struct<label:string,first_word:bigint,coverage:double>>")
    return (
        scanned.drop("hits")
        .join(by_row, "row", "left")
        .withColumns({"starts": starts, "base": base, "notices": F.coalesce("notices", none)})
        .select(
            F.col("doc").alias(id_col),
            "n_words",
            F.size("starts").cast("long").alias("n_base"),
            F.array_min("starts").cast("long").alias("first_word"),
            F.array_max("starts").cast("long").alias("last_word"),
            F.array_join("base", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", F.transform("notices", lambda x: x["label"]))), ",").alias("labels"),
            F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda x: x["coverage"])), F.lit(0.0))).alias("score"),
            "notices",
        )
    )
