"""License scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: case, punctuation and line breaks go,
copyright lines are left out, equivalent spellings become one. The SHA-256 of the whole
form is joined to the digests of known licence texts. The same is done for each
line of a document, each being a whole text of its own, so a notice line in a
larger document is found too. A text with a copyright notice has a second form, in which the rest
of the notice's paragraph is left out as well, as holders' names may stand on lines of their own; it is
that licence if either form is known. Never a prefix: a digest covers its text to the end.

Null text counts as empty, and an empty canonical form matches nothing. Repeated
rows and ids: each row gives a row. Known texts whose forms coincide: the smallest
name wins. An empty table gives none; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that count as equal, each pair (as written, canonical), on canonical words.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"),
    ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorised", "authorized"),
    ("behaviour", "behavior"), ("favour", "favor"), ("judgement", "judgment"), ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"), ("organisation", "organization"), ("per cent", "percent"), ("redistributions", "redistribution"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"), ("ver", "version"),
]

# Notices and licence texts, as published.
PUBLISHED = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "MIT",
        "MIT License\n\nCopyright (c)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nCopyright (c)\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    ("BSD-2-Clause", "BSD 2-Clause License\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "BSD 3-Clause License\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
# Titles that licence texts are found under, or without, each with its usual variants.
TITLES = {
    "MIT License": ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)", "MIT"),
    "ISC License": ("The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "BSD 2-Clause License": ("The BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "The Simplified BSD License", "FreeBSD License"),
    "BSD 3-Clause License": ("The BSD 3-Clause License", "BSD-3-Clause", "BSD License", "The BSD License", "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License"),
}
KNOWN = PUBLISHED + [(name, f"{v}{text[len(t) :]}".strip()) for name, text in PUBLISHED for t, variants in TITLES.items() if text.startswith(t + "\n") for v in ("", *variants)]

#: A line that starts so is a copyright line, if it doesn't go on about copyright as such.
COPYRIGHT = r"^\W*(?:copyright\b|\(c\)\W*(?:\d{4}|copyright\b)|©|all rights reserved)"
ABOUT_COPYRIGHT = r"^\W*copyright\W+(?:notices?|holders?|owners?|ownership|and|or|laws?|licen[cs]\w*|statements?|disclaimers?|interests?|acts?|is|in|of|on|to|as|protect\w*|treat\w*|for)\b"
#: What stands between paragraphs: lines without letters or digits, as in comments.
PARAGRAPH = r"\n[^\p{L}\p{N}\n]*\n"
COPYRIGHT_HINTS = ("copyright", "(c)", "©", "all rights reserved")
#: Words that equivalent spellings may touch; only texts that hold one are rewritten.
_HINTS = sorted({a.split()[0] for a, _ in SPELLINGS})


def _spelled(words: Column) -> Column:
    """Canonical spellings in words that have one space between. Each word gets spaces of its own, so neighbours are both seen."""
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    out, touched = F.replace(padded, F.lit(" "), F.lit("  ")), F.lit(False)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(spaced(a)), F.lit(spaced(b)))
    for h in _HINTS:
        touched = touched | F.contains(padded, F.lit(f" {h} "))
    return F.when(touched, F.trim(F.replace(out, F.lit("  "), F.lit(" ")))).otherwise(words)


def spaced(words: str) -> str:
    """Words with a space of their own on either side."""
    return "".join(f" {w} " for w in words.split())


def _is_copyright(line: Column) -> Column:
    return F.rlike(line, F.lit(COPYRIGHT)) & ~F.rlike(line, F.lit(ABOUT_COPYRIGHT))


def _words_of(lines: Column) -> Column:
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))), lambda x: x != "")


def _holds_copyright(low: Column) -> Column:
    held = F.lit(False)
    for h in COPYRIGHT_HINTS:
        held = held | F.contains(low, F.lit(h))
    return held


def _line_words(text: Column) -> Column:
    """The words of each line, one space between, without copyright lines and empty ones."""
    low = F.lower(text)
    lines = F.split(low, "\n")
    return _words_of(F.when(_holds_copyright(low), F.filter(lines, lambda x: ~_is_copyright(x))).otherwise(lines))


def _without_notices(text: Column) -> Column:
    """The same without what follows a copyright line in its paragraph either: a notice may go on over several lines. Null for a text without any."""
    low = F.lower(text)
    paragraphs = F.transform(F.split(low, PARAGRAPH), lambda p: F.split(p, "\n"))

    def before(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, _is_copyright), True)
        return F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)

    return F.when(_holds_copyright(low), _words_of(F.flatten(F.transform(paragraphs, before))))


def canonical(text: Column) -> Column:
    """The canonical form of a text: its words, one space between."""
    return _spelled(F.array_join(_line_words(text), " "))


def known_digests(known: DataFrame) -> DataFrame:
    """known: license, text -> digest of either canonical form, license, n: the form's length in bytes."""
    forms = F.array_compact(F.array(canonical(F.col("text")), _spelled(F.array_join(_without_notices(F.col("text")), " "))))
    form = known.select("license", F.explode(forms).alias("form")).where("form <> '' and license is not null")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.max(F.octet_length("form")).alias("n"))


def known_licenses(spark) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license string, text string")


def read_licenses(spark, folder: str) -> DataFrame:
    """(license, text) of a folder's texts, each file named by its licence: known texts beyond those here."""
    read = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return read.select(F.regexp_replace("name", r"\.(txt|md)$", "").alias("license"), F.col("value").alias("text"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, digest of the whole canonical form, license (whole text) and notices (names found on lines).

    The digests are exploded beside a row number of the scan and counted per
    (row, licence) before the shuffle, so a row's lines never leave its task singly.
    """
    digests = known_digests(known).cache()
    longest = digests.agg(F.max("n")).first()[0] or 0
    words = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), _line_words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"), _without_notices(F.col(text_col)).alias("bare"))
    # A spelling changes a form's length by less than 2 bytes a word: a line of more than twice the longest known form matches nothing.
    lines = F.transform(F.filter("words", lambda x: F.octet_length(x) <= 2 * longest), _spelled)
    parts = words.select("row_id", "id", F.sha2(_spelled(F.array_join("words", " ")), 256).alias("whole"), F.sha2(_spelled(F.array_join("bare", " ")), 256).alias("bare"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("lines"))
    units = parts.select("row_id", "id", "whole", F.explode(F.concat(F.transform(F.array_compact(F.array("whole", "bare")), lambda d: F.struct(F.lit(True).alias("is_whole"), d.alias("digest"))), F.transform(F.array_distinct("lines"), lambda d: F.struct(F.lit(False).alias("is_whole"), d.alias("digest"))))).alias("u"))
    named = units.select("row_id", "id", "whole", "u.*").join(digests.select("digest", "license"), "digest", "left")
    per = named.groupBy("row_id", "id", "whole", "license").agg(F.max("is_whole").alias("as_whole"), F.count(F.when(~F.col("is_whole"), 1)).alias("as_line"))
    out = per.groupBy("row_id", "id", "whole").agg(
        F.min(F.when(F.col("as_whole"), F.col("license"))).alias("license"),
        F.array_sort(F.collect_list(F.when(F.col("as_line") > 0, F.col("license")))).alias("notices"),
    )
    return out.select("id", F.col("whole").alias("digest"), "license", "notices")
