"""Licence scan by canonical digest.

Method: a text is lower-cased (A-Z), its copyright lines go, equivalent spellings
become one, all punctuation and white space becomes single spaces; SHA-256 of the
rest is looked up, by a hash join, among the digests of known licences that went
the same way. Whole texts are joined to licence texts and notices; single lines
are joined to notices, since a document often has its licence in a line. Short texts
are kept here as such, long ones as digests.

A line can only be a notice if its canonical length is that of one: only such lines
are hashed and joined. Only DataFrame functions are used. The table of known licences is joined without a
hint, so Spark broadcasts it only under its size threshold.

Defined cases: null text counts as empty and has no licence; ties (several names
for one digest) go to the name that sorts first; repeated rows get a row each;
known texts that are empty after normalising never match; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable
from .license_digests import DIGESTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9]|<|\[|\{)|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"
#: What is neither a-z, 0-9 nor beyond ASCII; and dashes, quotes and spaces beyond ASCII.
SEPARATORS = r"[^a-z0-9\x{80}-\x{9F}\x{A1}-\x{200F}\x{2016}\x{2017}\x{2020}-\x{2FFF}\x{3001}-\x{10FFFF}]+"
#: Spellings that count as equal, after punctuation has become spaces.
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("favour", "favor"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("whilst", "while"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("gpl", "gnu general public license"), ("https", "http"),
)

_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Short public licence texts, and one-line notices, by SPDX name.
TEXTS = (
    ("MIT", _PERMIT),
    ("MIT", f"MIT License\n\n{_PERMIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_PERMIT}"),
    ("ISC", f"{_USE}, provided that the above copyright notice and this permission notice appear in all copies.\n{_NO_WARRANTY}"),
    ("0BSD", f"{_USE}.\n{_NO_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD}{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD}{_BSD_NAMES}{_BSD_END}"),
)
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MORE = "For more information, please refer to <https://unlicense.org>"
#: Further short texts: headings and endings that the texts above come with too.
MORE_TEXTS = (
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE}\n\n{_MORE}"),
    ("Unlicense", f"{_UNLICENSE}\n\n{_MORE}/"),
    ("ISC", f"ISC License\n\n{TEXTS[3][1]}"),
    ("ISC", f"The ISC License\n\n{TEXTS[3][1]}"),
    ("0BSD", f"BSD Zero Clause License\n\n{TEXTS[4][1]}"),
    ("0BSD", f"Zero-Clause BSD\n\n{TEXTS[4][1]}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD}{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD}{_BSD_NAMES}{_BSD_END}"),
)
#: What licences are called in notices, by SPDX name.
NAMES = (
    ("MIT", ("MIT License", "MIT")),
    ("ISC", ("ISC License",)),
    ("0BSD", ("Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL v2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL v3")),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL v2.1")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3", "LGPL v3")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL v3")),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0")),
    ("EPL-2.0", ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL 2.0")),
    ("Unlicense", ("Unlicense",)),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License")),
    ("CC-BY-4.0", ("CC BY 4.0", "CC BY 4.0 License", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "CC BY-SA 4.0 License", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "CC BY-NC 4.0 License", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "CC BY-ND 4.0 License", "Creative Commons Attribution-NoDerivatives 4.0 International License")),
    ("CC-BY-NC-SA-4.0", ("CC BY-NC-SA 4.0", "CC BY-NC-SA 4.0 License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License")),
    ("CC-BY-NC-ND-4.0", ("CC BY-NC-ND 4.0", "CC BY-NC-ND 4.0 License", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License")),
)
_SUBJECTS = ("", "This work is ", "This software is ", "This project is ", "This program is ", "This file is ", "This code is ")
_VERBS = ("Licensed under", "Released under", "Distributed under", "Made available under")
MORE_NOTICES = (
    *((name, f"SPDX-License-Identifier: {name}") for name, _ in NAMES),
    *((name, f"SPDX-License-Identifier: {name}-only") for name, _ in NAMES if "GPL" in name),
    *((name, f"{subject}{verb} {the}{called}") for name, calls in NAMES for called in calls for subject in _SUBJECTS for verb in _VERBS for the in ("", "the ", "a ", "the terms of the ")),
)


def _plain(text: Column) -> Column:
    """Lower-cased, without copyright lines, separators as spaces; line ends stay."""
    x = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    may_claim = x.contains("copyright") | x.contains("(c)") | x.contains("©") | x.contains("all rights reserved")
    x = F.when(may_claim, F.regexp_replace(x, COPYRIGHT_LINE, "\n")).otherwise(x)
    return F.regexp_replace(x, SEPARATORS.replace("[^", "[^\\n"), " ")


def _finish(x: Column) -> Column:
    x = F.concat(F.lit(" "), F.btrim(x), F.lit(" "))
    for one, other in EQUIVALENT:
        x = F.replace(x, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.btrim(x)


def _whole(plain: Column) -> Column:
    return _finish(F.regexp_replace(F.replace(plain, F.lit("\n"), F.lit(" ")), "  +", " "))


def canonical(text: Column) -> Column:
    return _whole(_plain(text))


def _digest(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def known(spark: SparkSession, texts=TEXTS + NOTICES) -> DataFrame:
    """(digest, license, n) of known texts, one name for each digest; n: characters of the canonical text."""
    rows = spark.createDataFrame(list(texts), "license string, text string")
    rows = rows.select(canonical(F.col("text")).alias("text"), "license").where("text <> ''").select(_digest(F.col("text")).alias("digest"), "license", F.char_length("text").alias("n"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("n").alias("n"))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license) of the long texts that are kept as digests only."""
    return spark.createDataFrame(list(DIGESTS), "license string, hex string").select(F.unhex("hex").alias("digest"), "license")


def catalogue(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """All known texts and notices, and the notices alone, for scan."""
    notices = known(spark, NOTICES + MORE_NOTICES)
    texts = known(spark, TEXTS + MORE_TEXTS).unionByName(notices).drop("n").unionByName(known_digests(spark))
    return texts.groupBy("digest").agg(F.min("license").alias("license")), notices


def scan(docs: DataFrame, texts: DataFrame, notices: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, text_digest, license, notices): the licence that the whole text is, and the licences of its notice lines.

    texts and notices have columns digest and license; notices also have n, the canonical lengths.
    """
    lengths = sorted(r["n"] for r in notices.select("n").distinct().collect())  # no more than characters of the longest notice
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("th"), _plain(docs[text_col]).alias("plain"))
    lines = F.filter(F.array_distinct(F.transform(F.split("plain", "\n", -1), _finish)), lambda x: F.char_length(x).isin(*lengths))
    # normalised once, and kept: digests of the whole text and of each different line
    digests = durable(rows.select("id", "th", _digest(_whole(F.col("plain"))).alias("digest"), F.transform(lines, _digest).alias("lines")))
    whole = digests.select("id", "th", "digest").join(texts.select("digest", "license"), "digest", "left")
    found = digests.select("id", "th", F.explode("lines").alias("digest")).join(notices.select("digest", "license"), "digest")
    found = found.groupBy("id", "th").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    same = whole["id"].eqNullSafe(found["id"]) & (whole["th"] == found["th"])
    return whole.join(found, same, "left").select(whole["id"].alias(id_col), F.lower(F.hex(whole["digest"])).alias("text_digest"), whole["license"], F.coalesce(found["notices"], F.lit("")).alias("notices"))
