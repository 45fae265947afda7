"""License scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (lower case, no copyright lines, equivalent spellings joined, punctuation and
white space to single spaces) and its SHA-256 digest is joined to the digests of known licence texts. Whole documents
and their single lines and sentences are texts in this sense. A segment is brought to the canonical form only if it
holds one of a few words, each known text having at least one of them, and takes part only if its canonical length is
one of the known texts'; neither loses anything, as equal digests mean equal words and equal lengths.

Defined results: one row per row of documents, by a key of its own, whatever doc_id it has; a null or empty text has no
licence; a text that is known under two names reports the first by name; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import pick

#: Up to so many known texts are broadcast and sought by length; more are joined by shuffle.
MAX_KNOWN = 2_000
#: Public licence notices and short licences, by SPDX identifier. Longer ones are in license_texts/.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
)
#: Equivalent spellings, applied in this order to lower-case text.
SPELLINGS = (("licence", "license"), ("http://", "https://"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("©", "(c)"), ("per cent", "percent"), ("merchantibility", "merchantability"))


#: Texts of which many copies lack what follows this.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


@lru_cache(maxsize=1)
def known_texts() -> tuple[tuple[str, str], ...]:
    """KNOWN and the whole texts of license_texts/, those with an appendix also without it."""
    out = list(KNOWN)
    for f in sorted(resources.files("quarry.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name, text = f.name.removesuffix(".txt"), f.read_text("utf-8")
        out.append((name, text))
        if END_OF_TERMS in text:
            terms = text[: text.index(END_OF_TERMS)]
            out += [(name, terms), (name, terms + END_OF_TERMS)]
    return tuple(out)


def canonical(text: Column) -> Column:
    """The form whose digest is compared; null stays null. A copyright line starts with the word or sign and holds a
    year, a second sign or a place to fill in."""
    out = F.lower(text)
    out = F.regexp_replace(out, r"(?m)^[ \t*#/;-]*(copyright\b|\(c\)|©)(?=.*(\d{4}|\(c\)|©|[<\[{])).*$|(?m)^[ \t*#/;-]*all rights reserved\.?[ \t]*$", " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def telling_words(texts: list[str]) -> list[str]:
    """Strings of which each canonical text holds one, in every lower-case spelling that becomes them: words that many
    texts hold. Words that a replaced spelling may only partly make up are not used."""
    parts = {w for a, b in SPELLINGS if not (a + b).isalpha() for w in b.replace("/", " ").replace(":", " ").split()} | {"c", "https"}
    open_, out = sorted(set(texts), key=lambda t: (len(t), t)), []
    while open_:
        usable = sorted(set(open_[0].split()) - parts) or open_[0].split()
        out.append(max(usable, key=lambda w: (min(len(w), 5), sum(w in t for t in open_), w)))
        open_ = [t for t in open_ if out[-1] not in t]
    spelled = set(out)
    for a, b in reversed(SPELLINGS):
        spelled |= {w.replace(b, a) for w in spelled if b in w}
    return sorted(spelled)


def known_digests(spark: SparkSession, known) -> DataFrame:
    """digest, license, n, c: one row per known canonical text."""
    rows = spark.createDataFrame(list(known), "license string, text string").withColumn("c", canonical(F.col("text")))
    return rows.where("c <> ''").groupBy("c").agg(F.min("license").alias("license")).select(F.sha2("c", 256).alias("digest"), "license", F.length("c").alias("n"), "c")


def scan_licenses(documents: DataFrame, known=None) -> DataFrame:
    """doc_id, digest (of the whole canonical text), license (of the whole text, else null), licenses (array of all
    found in the text or its segments), n_hits long, for every row. known: pairs of name and text."""
    spark = documents.sparkSession
    known = known_texts() if known is None else known
    digests = known_digests(spark, known).collect() if known else []
    lengths, words = sorted({r.n for r in digests}), telling_words([r.c for r in digests])
    table = spark.createDataFrame([(r.digest, r.license) for r in digests], "digest string, license string")
    few = len(digests) <= MAX_KNOWN

    def tells(lower: Column) -> Column:
        if len(words) > 32:
            return lower.rlike("|".join(words))
        out = F.lit(False)
        for w in words:
            out = out | lower.contains(w)
        return out

    d = pick(documents, doc_id="long", text="string").withColumn("row", F.monotonically_increasing_id())
    d = d.select("row", "doc_id", "text", canonical(F.col("text")).alias("whole"))
    split = F.filter(F.split("text", r"\n|(?<=[.!?])[ \t]+"), lambda x: tells(F.lower(x)))
    parts = F.filter(F.transform(split, canonical), lambda c: (F.length(c).isin(lengths or [-1]) if few else F.length(c) > 0) & (c != F.col("whole")))
    parts = F.when(tells(F.lower("text")), parts)
    one = lambda text, whole: F.struct(text.alias("c"), F.lit(whole).alias("whole"))
    # a text that is itself one segment counts once, as a whole
    none = F.array().cast("array<struct<c:string,whole:boolean>>")
    rows = d.select("row", "doc_id", F.explode(F.concat(F.array(one(F.col("whole"), True)), F.coalesce(F.transform(parts, lambda c: one(c, False)), none))).alias("s"))
    rows = rows.select("row", "doc_id", F.sha2(F.col("s.c"), 256).alias("digest"), "s.whole")
    hits = rows.join(F.broadcast(table) if few else table, "digest", "left")
    return hits.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.min(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_sort(F.collect_set("license")).alias("licenses"),
        F.count("license").alias("n_hits"),
    ).drop("row")
