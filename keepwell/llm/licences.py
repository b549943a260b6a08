"""Licence scan: canonical digests of entire texts, hash-joined to those of known licences. Only DataFrame functions.

A text's canonical form is its lower-cased words without copyright lines and punctuation, in one spelling. A document is
looked up as a whole among the texts of licences. Each of its lines is looked up among these and among notices, which are
mostly a line of their own, but no licence's text: a document that is only a notice has no licence as a whole.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm.common import whole_text
from keepwell.session import materialize

#: Lines that name who holds the copyright, and nothing else.
COPYRIGHT_LINE = (
    r"(?m)^[ \t>*#/;%-]*(?:copyright\b[^\n]*(?:[0-9]{4}|\(c\)|©|<year>|\[year\])[^\n]*|(?:\(c\)|©)[^\n]*"
    r"|all rights reserved\.?[ \t]*$)"
)
#: Spellings that licence matching takes as equal, the second as canonical.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "cancelled": "canceled", "centre": "center", "copyright owner": "copyright holder",
    "emphasised": "emphasized", "favour": "favor", "fulfil": "fulfill", "fulfilment": "fulfillment", "judgment": "judgement",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "licences": "licenses",
    "modelled": "modeled", "modelling": "modeling", "non commercial": "noncommercial", "offence": "offense",
    "organisation": "organization", "per cent": "percent", "practise": "practice", "programme": "program",
    "recognise": "recognize", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while",
}

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted{condition}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
"""

#: For each file of ``licence_texts`` (as Debian's base-files has it) its licence, the first line after the
#: title, and the line at which what isn't terms begins; empty if a text has no such lines.
SHIPPED = (
    ("Apache-2.0", "Apache-2.0", "TERMS AND CONDITIONS FOR USE", "APPENDIX: How to apply"),
    ("Artistic", "Artistic-1.0-Perl", "Preamble", ""),
    ("BSD", "BSD-3-Clause", "", ""),
    ("CC0-1.0", "CC0-1.0", "CREATIVE COMMONS CORPORATION IS NOT", ""),
    ("GFDL-1.2", "GFDL-1.2", "0. PREAMBLE", "ADDENDUM: How to use"),
    ("GFDL-1.3", "GFDL-1.3", "0. PREAMBLE", "ADDENDUM: How to use"),
    ("GPL-1", "GPL-1.0", "Preamble", "Appendix: How to Apply"),
    ("GPL-2", "GPL-2.0", "Preamble", "How to Apply These Terms"),
    ("GPL-3", "GPL-3.0", "Preamble", "How to Apply These Terms"),
    ("LGPL-2", "LGPL-2.0", "Preamble", "How to Apply These Terms"),
    ("LGPL-2.1", "LGPL-2.1", "Preamble", "How to Apply These Terms"),
    ("LGPL-3", "LGPL-3.0", "This version of the GNU Lesser", ""),
    ("MPL-1.1", "MPL-1.1", "1. Definitions.", "EXHIBIT A"),
    ("MPL-2.0", "MPL-2.0", "1. Definitions", "Exhibit A - Source Code"),
)


def variants(text: str, body: str, appendix: str) -> list[str]:
    """A licence's text, with and without its title, its appendix, the line that ends its terms, and the appendix' line for
    one's own name, which is a copyright line once it is filled in."""
    lines = text.split("\n")

    def starting(words: str, otherwise: int) -> int:
        return next(i for i, line in enumerate(lines) if line.strip().startswith(words)) if words else otherwise

    first, last = starting(body, 0), starting(appendix, len(lines))
    terms = last
    while terms and (not lines[terms - 1].strip() or lines[terms - 1].strip() == "END OF TERMS AND CONDITIONS"):
        terms -= 1
    parts = [lines[a:b] for a in (0, first) for b in (len(lines), last, terms)]
    named = [[line for line in part if not line.strip().startswith("Copyright [yyyy]")] for part in parts]
    return list(dict.fromkeys("\n".join(part) for part in parts + named))


def shipped() -> list[tuple[str, str]]:
    folder = Path(__file__).parent / "licence_texts"
    read = [(name, (folder / f"{file}.txt").read_text("utf-8"), *ends) for file, name, *ends in SHIPPED]
    return [(name, variant) for name, text, *ends in read for variant in variants(text, *ends)]


#: Texts of licences. A caller may pass any other list.
TEXTS = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("ISC", _ISC_GRANT.format(condition=", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC_GRANT.format(condition="")),
    ("BSD-2-Clause", _BSD.format(third="")),
    ("BSD-3-Clause", _BSD.format(third=_BSD_THIRD)),
    *shipped(),
)
#: Usual one-line notices, for lines only. A caller may pass any other list.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: What a line can be.
KNOWN = TEXTS + NOTICES


def canonical(text: Column) -> Column:
    """Lower-cased words between single spaces, without copyright lines, in one spelling."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), r"[^\p{L}\p{N}]+", "  ")
    spaced = F.concat(F.lit(" "), F.trim(words), F.lit(" "))  # two spaces between words: each has its own pair

    def one_spelling(so_far: Column, pair: tuple[str, str]) -> Column:
        other, usual = (F.lit(f" {spelling.replace(' ', '  ')} ") for spelling in pair)
        return F.replace(so_far, other, usual)

    return F.trim(F.replace(reduce(one_spelling, SPELLINGS.items(), spaced), F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...]) -> DataFrame:
    """``license_id`` and the ``digest`` of each known text; of several with one digest, the first id in order."""
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    digests = rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licences(
    docs: DataFrame, known: tuple[tuple[str, str], ...] = TEXTS, notices: tuple[tuple[str, str], ...] = NOTICES
) -> DataFrame:
    """``doc_id``, ``digest``, ``license_id`` (of the entire text, if it is in ``known``, or null) and ``line_licenses``
    (ids of its lines that are in ``known`` or ``notices``, in order and without repeats, joined by commas; empty if none).

    Null texts count as empty; an empty text, and one of copyright lines only, has the digest of no words, and is a licence
    only if the list has such a one. Of several licences with one digest the first id in order is named. Every row of
    ``docs`` gives a row, repeated ones each; an empty table gives none; other columns aren't read, whatever their names; texts
    of any length are digested whole. The lists' digests are broadcast: the lists are given by the caller and don't grow
    with the documents. Only lines that are known are shuffled.
    """
    spark = docs.sparkSession
    table = known_digests(spark, known)
    hashed = F.transform(F.array_distinct(F.split(whole_text(), "\n")), lambda line: F.xxhash64(canonical(line)))
    rows = docs.select("doc_id", F.sha2(canonical(whole_text()), 256).alias("digest"), hashed.alias("lines"))
    rows = materialize(rows.withColumn("slot", F.monotonically_increasing_id()), "licence-digests")
    listed = spark.createDataFrame([*known, *notices], "line_license string, text string")
    units = listed.select("line_license", F.xxhash64(canonical(F.col("text"))).alias("line")).distinct()
    found = rows.select("slot", F.explode("lines").alias("line")).join(F.broadcast(units), "line")
    found = found.groupBy("slot").agg(F.array_join(F.sort_array(F.collect_set("line_license")), ",").alias("line_licenses"))
    named = rows.drop("lines").join(F.broadcast(table), "digest", "left").join(found, "slot", "left")
    return named.select("doc_id", "digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))
