"""Licence scan by canonical digest look-up, with DataFrame functions alone.

A text is brought to one canonical form (case, copyright lines, punctuation,
equivalent spellings), and the SHA-256 of the entire form is hash-joined to the
digests of known licences. The same is done for every line, taken as a text of its
own, so notices such as ``Released under the MIT License.`` are found in documents.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence matching treats as equal (variant, canonical).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""

# Known licence texts and one-line notices (name, text).
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("WTFPL", _WTFPL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
)

COPYRIGHT_LINE = "(?m)^[^a-z0-9\\n]*(?:copyright[ \\t]*(?:\\(c\\)|©|[0-9]{4})|\\(c\\)[ \\t]*(?:copyright|[0-9]{4})|©|all rights reserved)[^\\n]*"


#: Words with which the body of a licence ends and its header form begins and ends, where it has them.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the", "limitations under the License."),
    ("GPL-2.0", "This program is free software; you can", "MA 02110-1301 USA."),
    ("GPL-3.0", "This program is free software: you can", "www.gnu.org/licenses/>."),
    ("MPL-2.0", "This Source Code Form is subject to the terms", "mozilla.org/MPL/2.0/."),
)


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of ``licence_texts``: entire texts, these without the appendix, and header forms."""
    whole = {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    out = list(whole.items())
    for name, text in whole.items():
        body, mark, _ = text.partition(END_OF_TERMS)
        if mark:
            out += [(name, body), (name, body + mark)]
    for name, first, last in HEADERS:
        at = whole[name].find(first)
        to = whole[name].find(last, at)
        if min(at, to) >= 0:
            out.append((name, whole[name][at : to + len(last)]))
    return out


def known_licences(spark: SparkSession) -> DataFrame:
    """Notices and texts of this module; ``scan_licences`` takes any table of this form."""
    return spark.createDataFrame([*KNOWN, *full_texts()], "licence string, licence_text string")


def canonical_lines(text: Column) -> Column:
    """Lower case, no copyright lines, other signs as single spaces, one spelling; lines stay."""
    form = F.lower(F.coalesce(text, F.lit("")))
    about = form.contains("copyright") | form.contains("(c)") | form.contains("©") | form.contains("all rights reserved")
    form = F.when(about, F.regexp_replace(form, COPYRIGHT_LINE, "")).otherwise(form)
    form = F.regexp_replace(form, "[^\\p{L}\\p{N}\\n]+", " ")
    form = F.concat(F.lit(" "), F.replace(form, F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    form = F.replace(form, F.lit(" "), F.lit("  "))  # each word has signs of its own around it, so that neighbours are both replaced
    for variant, canonical in SPELLINGS:
        form = F.replace(form, F.lit(f" {variant.replace(' ', '  ')} "), F.lit(f" {canonical.replace(' ', '  ')} "))
    return form


def canonical(text: Column) -> Column:
    """The canonical form of an entire text: words with single spaces between."""
    return F.trim(F.regexp_replace(canonical_lines(text), "[ \\n]+", " "))


def digests(licences: DataFrame) -> DataFrame:
    """licence, digest; texts with the same canonical form keep the first name in order."""
    return licences.where(canonical(F.col("licence_text")) != "").select("licence", F.sha2(canonical(F.col("licence_text")), 256).alias("__known")).groupBy("__known").agg(F.min("licence").alias("__licence"))


#: Leading hexadecimal digits of digests by which lines that may be known are told in their row.
PREFIX = 4


def scan_licences(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text_digest, licence (of the entire text, or null), notice_lines, notices.

    ``notices``: sorted names of licences whose entire text stands on a line, joined by
    commas, empty if none; ``notice_lines`` counts those lines with repeats. Null and
    empty texts, and texts of signs alone, have the digest of the empty form and match
    nothing. Rows that repeat an id stay separate rows. Other columns are ignored.

    A line reaches the join only if its digest begins like a known one: the driver gets
    those beginnings, at most 16 ** PREFIX of 4 signs. The join broadcasts the digests only
    if the planner finds them small enough. Rows are told apart by id and form, and equal
    ones are counted and given back as often.
    """
    known = digests(licences)
    starts = [r[0] for r in known.select(F.substring("__known", 1, PREFIX)).distinct().collect()]
    likely = lambda digest: F.substring(digest, 1, PREFIX).isin(starts) if starts else F.lit(False)
    rows = docs.select(F.col(id_col).alias("__id"), canonical_lines(F.col(text_col)).alias("__form"))
    whole = F.sha2(F.trim(F.regexp_replace("__form", "[ \\n]+", " ")), 256)
    lines = F.transform(F.filter(F.split("__form", "\n"), lambda x: F.trim(x) != ""), lambda x: F.sha2(F.trim(F.regexp_replace(x, " +", " ")), 256))
    rows = rows.select("__id", whole.alias("__whole"), F.xxhash64("__form").alias("__lines_of"), F.filter(lines, likely).alias("__lines"))
    entries = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("__whole").alias("digest"))), F.transform("__lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("digest"))))
    found = rows.select("__id", "__whole", "__lines_of", F.explode(entries).alias("__e")).join(known, F.col("__e.digest") == F.col("__known"), "left")
    line, entire = ~F.col("__e.whole") & F.col("__licence").isNotNull(), F.col("__e.whole")
    out = found.groupBy("__id", "__whole", "__lines_of").agg(F.max(F.when(entire, F.col("__licence"))).alias("licence"), F.sum(line.cast("long")).alias("__n"), F.array_join(F.sort_array(F.collect_set(F.when(line, F.col("__licence")))), ",").alias("notices"), F.sum(entire.cast("long")).alias("__rows"))
    out = out.withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows"))))
    return out.select(F.col("__id").alias(id_col), F.col("__whole").alias("text_digest"), "licence", (F.col("__n") / F.col("__rows")).cast("long").alias("notice_lines"), "notices")
