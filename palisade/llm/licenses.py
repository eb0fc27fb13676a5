"""Licence scan by canonical digests.

A text is brought to a canonical form (lower case, copyright lines dropped, equivalent spellings joined, punctuation
and white space as single spaces), and its digest is joined with a table of digests of known licence texts. Whole
texts are looked up, and each of their lines, so that a licence notice inside a document is found by its whole line.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import small_table

#: Full texts as their publishers give them; the driver reads them, executors don't.
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def _with_titles(license_: str, titles: tuple[str, ...], bodies: tuple[str, ...]) -> Iterator[tuple[str, str, str]]:
    """A full text under each title. A copyright line with a year, which may stand between them, is no part of the canonical form."""
    yield from ((license_, "text", f"{t}\n\n{b}") for t, b in product(titles, bodies))


def _full_texts() -> Iterator[tuple[str, str, str]]:
    mit, isc = (next(t for a, k, t in _SHORT if (a, k) == (x, "text")) for x in ("MIT", "ISC"))
    yield from _with_titles("MIT", ("", "MIT License", "The MIT License", "The MIT License (MIT)"), (mit.removeprefix("MIT License\n\n"),))
    yield from _with_titles("ISC", ("", "ISC License", "The ISC License", "ISC License (ISC)"), (isc,))
    free = TEXTS["Unlicense"]
    yield from _with_titles("Unlicense", ("", "Unlicense", "The Unlicense"), (free, free[: free.index("For more information")]))
    bsd = TEXTS["BSD-3-Clause"]
    bulleted = bsd
    for n in "123":
        bulleted = bulleted.replace(f"\n{n}. ", "\n* ")
    named = ("", "BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License")
    yield from _with_titles("BSD-3-Clause", (*named, *(f"{t}\n\nAll rights reserved." for t in named)), (bsd, bulleted))
    # the two-clause form is the three-clause one without its third clause
    simple = [b[: b.index(third)] + b[b.index("THIS SOFTWARE") :] for b, third in ((bsd, "3. Neither"), (bulleted, "* Neither"))]
    named = ("", "BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License")
    yield from _with_titles("BSD-2-Clause", (*named, *(f"{t}\n\nAll rights reserved." for t in named)), tuple(simple))
    # what follows the terms tells how to apply them and is often left out, or its copyright line is filled in
    for k in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1"):
        text = TEXTS[k]
        end = text.index("END OF TERMS AND CONDITIONS")
        yield from ((k, "text", t) for t in (text, text[:end], text[:end] + "END OF TERMS AND CONDITIONS", text.replace("Copyright [yyyy] [name of copyright owner]", "")))
    for k, after in (("MPL-1.1", "EXHIBIT A"), ("GFDL-1.3", "ADDENDUM: How to use")):
        yield from ((k, "text", t) for t in (TEXTS[k], TEXTS[k][: TEXTS[k].index(after)]))
    yield from ((k, "text", TEXTS[k]) for k in ("MPL-2.0", "LGPL-3.0", "Artistic-1.0-Perl"))
    cc0 = TEXTS["CC0-1.0"]
    yield from (("CC0-1.0", "text", t) for t in (cc0, cc0.replace("Creative Commons Legal Code", "", 1)))


#: Notices and short full texts: (licence, kind, text).
_SHORT = (
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "This project is licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "notice", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "notice", "Licensed under the Mozilla Public License, version 2.0."),
    ("all-rights-reserved", "notice", "All rights reserved."),
    (
        "MIT",
        "text",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to '
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
        "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)
#: Known texts: (licence, kind, text). Add others through the `known` parameter.
KNOWN = (*_SHORT, *_full_texts())
#: Equivalent spellings, applied to lower-case text in this order.
SPELLINGS = (
    (r"licence", "license"),
    (r"non-?\s?commercial", "noncommercial"),
    (r"merchantibility", "merchantability"),
    (r"sub-license", "sublicense"),
    (r"&", " and "),
    (r"https:", "http:"),
    (r"\(c\)|©", "copyright "),
)
_COPYRIGHT = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form; lines stay apart."""
    x = F.lower(text)
    x = F.regexp_replace(x, _COPYRIGHT, "")
    for pattern, to in SPELLINGS:
        x = F.regexp_replace(x, pattern, to)
    return F.regexp_replace(x, r"[^\n\p{L}\p{N}]+", " ")


def _flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def known_digests(spark, known: tuple[tuple[str, str, str], ...] = KNOWN) -> DataFrame:
    """license, kind, chars, digest: one row for each different digest (the first of `known` has it)."""
    rows = small_table(spark, [{"i": i, "license": a, "kind": k, "text": t} for i, (a, k, t) in enumerate(known)], "i int, license string, kind string, text string")
    flat = _flat(canonical(F.col("text")))
    rows = rows.select("i", "license", "kind", F.length(flat).alias("chars"), F.sha2(flat, 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min(F.struct("i", "license", "kind", "chars")).alias("k")).select("digest", "k.license", "k.kind", "k.chars")


def find_licenses(docs: DataFrame, known: tuple[tuple[str, str, str], ...] = KNOWN) -> DataFrame:
    """doc_id, license, unit ("text" or "line"), kind, n (how often) for every known licence of every row.

    A null, empty or blank text has none. A text of a single line is looked up as a text only. Rows with the same
    doc_id count together; rows may repeat and doc_ids be null; an empty table gives an empty result; other columns
    are ignored. The digests to look up are a table of the size of `known`, which is fixed, so it is broadcast.
    """
    digests = known_digests(docs.sparkSession, known)
    lengths = F.array(*[F.lit(n) for n in sorted({r["chars"] for r in digests.select("chars").collect()})])
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda t: F.trim(t))
    # only a text of a known text's length can have its digest
    held = F.filter(lines, lambda t: F.array_contains(lengths, F.length(t)))
    x = x.select("doc_id", _flat(F.col("text")).alias("flat"), held.alias("lines"), F.size(F.filter(lines, lambda t: t != "")).alias("n_lines"))
    units = F.concat(
        F.when(F.array_contains(lengths, F.length("flat")), F.array(F.struct(F.lit("text").alias("unit"), F.col("flat").alias("t")))).otherwise(F.array().cast("array<struct<unit:string,t:string>>")),
        F.when(F.col("n_lines") > 1, F.transform("lines", lambda t: F.struct(F.lit("line").alias("unit"), t.alias("t")))).otherwise(F.array().cast("array<struct<unit:string,t:string>>")),
    )
    looked = x.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", F.sha2("u.t", 256).alias("digest"))
    hits = looked.join(F.broadcast(digests), "digest")
    return hits.groupBy("doc_id", "license", "unit", "kind").agg(F.count(F.lit(1)).alias("n"))
