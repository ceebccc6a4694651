"""Licence scan by canonical digests: whole texts, normalised, are joined with the digests of known licences.

Canonical form: A-Z lower-cased; lines that start with a copyright notice taken out; punctuation and blanks turned to
single blanks; equivalent spellings unified. Its SHA-256 is the text's digest. A text that holds more than a licence
has another digest, and that is meant: this scan finds files that are licences.

The known texts pass through the same expressions, so both sides agree by construction. Known texts are few, and Spark
sends them to all tasks by their size; a hot digest on the documents' side stays where it is. A null text counts as
empty. Two known texts of one digest count as the first by licence id. Repeated rows get repeated results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waygrid.llm.shared import whole_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that is a notice: a year, a sign or a place for one follows. A sentence that is wrapped before "copyright" stays.
COPYRIGHT_LINE = r"(^|\n)[ \t>*#/;-]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|(\(c\)|©)[ \t]*(copyright|[0-9<\[{])|all rights reserved)[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F©“”‘’–—…•·]+"
#: Spellings that count as one.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "sublicence": "sublicense", "acknowledgement": "acknowledgment",
    "analogue": "analog", "authorisation": "authorization", "authorised": "authorized", "merchantibility": "merchantability", "non commercial": "noncommercial", "non infringement": "noninfringement",
    "per cent": "percent", "unlicence": "unlicense", "whilst": "while", "wilful": "willful", "copyright holder": "copyright owner", "copyright holders": "copyright owners", "https": "http",
}

_DISCLAIMER_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_MIT_BODY = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_BODY = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Public licences and the notices by which texts name them.
KNOWN = [
    ("MIT", "MIT License\n\nCopyright (c) year holder\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _DISCLAIMER_BSD),
    ("BSD-2-Clause", _BSD_HEAD + _DISCLAIMER_BSD),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _DISCLAIMER_BSD),
    ("ISC", "ISC License\n\n" + _ISC_BODY + _AS_IS),
    ("ISC", _ISC_BODY + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


#: Digests of the canonical forms of the full texts as their publishers give them.
KNOWN_DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd"),
    ("GFDL-1.3", "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]


#: What stands between words while spellings are replaced: a blank for each of them, so that a word that is replaced takes
#: none from its neighbours.
APART = "  "


def _spellings() -> list[tuple[str, str]]:
    return [tuple(f" {x.replace(' ', APART)} " for x in pair) for pair in EQUIVALENT.items()]


def canonical(text: Column) -> Column:
    t = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "\n")
    t = F.concat(F.lit(" "), F.regexp_replace(t, PUNCTUATION, APART), F.lit(" "))
    for spelling, one in _spellings():
        t = F.replace(t, F.lit(spelling), F.lit(one))
    return F.trim(F.regexp_replace(t, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = KNOWN_DIGESTS) -> DataFrame:
    """(known_digest, license_id) of known texts, and of texts of which the digest alone is known."""
    pair = lambda rows, name: spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias(name)) for i, t in rows])).alias("k")).select("k.*")
    own = pair(known, "license_text").select(digest(F.col("license_text")).alias("known_digest"), "license_id")
    if digests:
        own = own.union(pair(digests, "known_digest").select("known_digest", "license_id"))
    return own.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame, *, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (None: all) in the struct doc, then digest, license_id (null: no known licence) and is_license."""
    rows = docs.select(whole_row(keep), digest(F.col(text)).alias("digest"))
    return rows.join(known, F.col("digest") == F.col("known_digest"), "left").select("doc", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def _sql(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), {quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    t = f"' ' || regexp_replace({t}, {quoted(PUNCTUATION)}, '{APART}', 'g') || ' '"
    for spelling, one in _spellings():
        t = f"replace({t}, '{spelling}', '{one}')"
    return f"sha256(trim(regexp_replace({t}, ' +', ' ', 'g')))"


def oracle_sql(known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = KNOWN_DIGESTS) -> str:
    """The same scan in SQL."""
    values = lambda rows: ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in rows)
    return (
        f"WITH texts AS (SELECT {_sql('license_text')} AS known_digest, license_id FROM (VALUES {values(known)}) AS k(license_id, license_text) UNION ALL SELECT known_digest, license_id FROM (VALUES {values(digests)}) AS k(license_id, known_digest)), "
        "known AS (SELECT known_digest, min(license_id) AS license_id FROM texts GROUP BY known_digest), "
        f"d AS (SELECT doc_id, {_sql('text')} AS digest FROM documents) "
        "SELECT doc_id, digest, license_id, license_id IS NOT NULL AS is_license FROM d LEFT JOIN known ON digest = known_digest"
    )
