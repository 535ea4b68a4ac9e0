"""Licence scans by canonical digests: a text is brought to one form and its digest looked up.

The form: lower case, no copyright lines, equivalent spellings made one, every run of other characters
than letters and digits one space. The digest of the whole form is joined by hash to those of known licences. A text that
this leaves without a licence is looked up by a second form, which drops only lines of the shape of a copyright
statement, and marks of lists; among the same texts, those with their usual titles, and longer licences of which only digests are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: A year, (c) or a holder's name; not a line of a licence's own words that a wrap lets start with 'copyright'.
STATEMENT = (
    r"(?m)^[ \t]*(?:(?i:(?:copyright|\(c\)|©)(?:[ \t,:]|\(c\)|©|copyright|by\b)*(?:[0-9]{4}|[<\[{])[^\n]*|copyright[ \t]*(?:\(c\)|©|by\b)[^\n]*|©[^\n]*|all rights reserved[. \t\r]*)"
    r"|Copyright[ \t:]+(?!(?i:notices?|holders?|owners?|licen[cs]e|laws?|statements?|and|or|in|the|is)\b)\p{Lu}[^\n]*)$"
)
MARK = r"(?m)^[ \t]*(?:\(?[0-9a-zA-Z]{1,2}[.)]|[*•-])[ \t]+"  #: of a list, at the start of a line
#: Equivalent spellings of whole words, applied in this order after punctuation is gone.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("https", "http"),
)
FEW_LICENCES = 10_000  #: tables of at most so many known licences are broadcast

#: Texts of well-known short licences and notices (fixed values).
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-MIT": "Released under the MIT License.",
    "notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}

#: Titles that files of KNOWN's licences start with.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}

#: Digests of the second form of whole files of longer licences (fixed values), under the name and, where there are several, the variant.
DIGESTS = {
    "Apache-2.0": "5f2deb14a9cf9019b5bf72fee69aeb440c26f6767a918132f10063678880d809",
    "Apache-2.0 terms": "6b57a50e913eadcdb5c6d499584b8af75a5b972abac381cf618c6bb96ad84cd6",
    "Apache-2.0 with end": "c5baaa8b07a2c7d770d53bda83bc0429c6b4c46528cea895ef5d0f9dac355b58",
    "Artistic-1.0-Perl": "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651",
    "CC0-1.0": "d4b3c62906ce8c0436a36f2459b008444883a36158e9bed88a6b926a42067fab",
    "GFDL-1.2": "7bd3a9b625b0b9c72d575e34948a31aa1d9a92600e54323c0abd84a9844ce82d",
    "GFDL-1.3": "3e03599855be6f5154c1bba1c4189768a3518f5863527559438fa78fa2262af5",
    "GPL-1.0": "ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746",
    "GPL-2.0": "2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee",
    "GPL-3.0": "5537b42339f557495a7ef6edda391c721265c572a6e950e552ee50adbb55086b",
    "LGPL-2.0": "da0e4a7fe0b047c78b3d0d3d4f2a7ba30a2ee32b196527f97d3d30a05f3e9b64",
    "LGPL-2.1": "055f4d37605d52b52891d3649b129b56ef5bb6869370235f4c52fc9329159bad",
    "LGPL-3.0": "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",
    "MPL-1.1": "a1ea0c4b634aa7b4256d56525c941092a1facf7d3e96c4ecb68ba71bc6744f7d",
    "MPL-2.0": "d2954ecddd82787482d526252c2595f628a7e2ccd8c32b969382705b61c7ed8d",
}


def canonical(text: str = "text") -> Column:
    return _plain(F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), COPYRIGHT_LINE, ""))


def whole(text: str = "text") -> Column:
    """The second form: all words but copyright statements and the marks of lists."""
    return _plain(F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), STATEMENT, ""), MARK, "")))


def _plain(form: Column) -> Column:
    form = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " ")), " ", "  "), F.lit(" "))  # two spaces a word: none is shared
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new} "))
    return F.trim(F.replace(form, F.lit("  "), F.lit(" ")))


def _sha(form: Column) -> Column:
    return F.sha2(F.encode(form, "UTF-8"), 256)


def digest(text: str = "text") -> Column:
    return _sha(canonical(text))


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN.items()), "license string, text string")


def _titled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, f"{title}\n\n{KNOWN[x]}") for x, titles in TITLES.items() for title in titles], "license string, text string")


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, digest, license (null where the whole text is no known licence).

    licenses: license, text; by default KNOWN, its texts under TITLES, and DIGESTS. Of licences that share a form the first name is given.
    Null, empty and word-free texts have the digest of the empty form and match nothing. Other columns are ignored; rows that repeat a
    doc_id are looked up one by one.
    """
    spark = docs.sparkSession
    titled = licenses if licenses is not None else known(spark).union(_titled(spark))
    table = (known(spark) if licenses is None else licenses).where(canonical() != "").select("license", digest().alias("digest"))
    second = titled.where(whole() != "").select("license", _sha(whole()).alias("_whole"))
    if licenses is None:
        second = second.union(spark.createDataFrame([(name.split(" ")[0], x) for name, x in DIGESTS.items()], "license string, _whole string"))
    table, second = table.groupBy("digest").agg(F.min("license").alias("license")), second.groupBy("_whole").agg(F.min("license").alias("_second"))
    few = max(x.limit(FEW_LICENCES + 1).count() for x in (table, second)) <= FEW_LICENCES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), _sha(whole()).alias("_whole"))
    for x, key in ((table, "digest"), (second, "_whole")):
        rows = rows.join(F.broadcast(x) if few else x, key, "left")
    return rows.select("doc_id", "digest", F.coalesce("license", "_second").alias("license"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _canonical_sql(text: str) -> str:
    form = rf"trim(regexp_replace(regexp_replace(lower(replace(coalesce({text}, ''), 'ẞ', 'ß')), '(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    form = f"' ' || replace({form}, ' ', '  ') || ' '"
    for old, new in SPELLINGS:
        form = f"replace({form}, ' {old.replace(' ', '  ')} ', ' {new} ')"
    return f"trim(replace({form}, '  ', ' '))"


OP8_SQL = f"""
WITH k(license, text) AS (VALUES {", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in item) + ")" for item in KNOWN.items())}),
t AS (SELECT sha256({_canonical_sql('text')}) AS digest, min(license) AS license FROM k GROUP BY 1)
SELECT doc_id, digest, license FROM (SELECT doc_id, sha256({_canonical_sql('text')}) AS digest FROM documents) LEFT JOIN t USING (digest)"""
