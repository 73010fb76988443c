"""License scans by canonical digest lookup. DataFrame functions only."""

from __future__ import annotations

import re
import unicodedata
from hashlib import sha256
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, same

# Spellings that mean the same in licence texts, as (from, to) whole words, after lower-casing. What may break at
# a line's end becomes two words.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sub license"), ("sublicense", "sub license"),
    ("organisation", "organization"), ("organisations", "organizations"), ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"),
    ("programme", "program"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("noninfringement", "non infringement"),
    ("percent", "per cent"), ("whilst", "while"), ("analyse", "analyze"), ("recognise", "recognize"), ("utilisation", "utilization"), ("https", "http"),
)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSDX = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
# Public licence texts and notices, as (licence, text).
LICENSES = (
    ("MIT", "MIT License\nCopyright (c) <year> <holder>\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD1 + _BSD2 + _BSDX),
    ("BSD-3-Clause", _BSD + _BSD1 + _BSD2 + _BSD3 + _BSDX),
    ("ISC", "ISC License\nCopyright (c) <year> <holder>\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_END),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n" + _AS_IS + "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <http://unlicense.org/>"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n" + _AS_IS.replace("PURPOSE AND NONINFRINGEMENT", "PURPOSE, TITLE AND NON-INFRINGEMENT") + "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
)

# Titles that stand, or don't, above the short licences.
TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "ISC": ("", "ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("", "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero-Clause License", "Zero Clause BSD License"),
    "Unlicense": ("", "The Unlicense"),
    "Zlib": ("", "zlib License", "The zlib License", "The zlib/libpng License"),
    "BSL-1.0": ("", "Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
}


def all_texts() -> list[tuple[str, str]]:
    """LICENSES, the short ones under each title and with numbers or bullets, and the files of licenses/: whole, without title, and without what follows the terms."""
    out = list(LICENSES)
    for name, text in LICENSES:
        if name in TITLES and len(text) > 500:
            body = text.split("\n", 2)[2] if name in ("MIT", "ISC") else text
            plain = re.sub(r"(?m)^\d\. ", "", body)  # its items under bullets
            out += [(name, f"{title}\n{x}") for title in TITLES[name] for x in {body, plain}]
    for file in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda x: x.name):
        if file.name.endswith(".txt"):
            text = file.read_text(encoding="utf-8").strip()
            head, mark, _ = text.partition("END OF TERMS AND CONDITIONS")
            for x in {text, head, head + mark}:
                out += [(file.name[:-4], x), (file.name[:-4], re.split(r"\n\s*\n", x, maxsplit=1)[1])]
    return out


#: Lines that are copyright statements: the word with a year or (c), or with a few other words none of which is of the terms.
STATEMENT = r"^(portions )?(c )?copyright( [^ ]+){0,8}? ([0-9]{4}|yyyy|year|c)( |$)|^c ([0-9]{4}|year)( |$)|^all rights reserved$|^(c )?copyright$"
SHORT_STATEMENT = r"^copyright( [^ ]+){1,5}$"
TERMS = r"\b(notices?|holders?|owners?|laws?|licen[sc]ed?|statement|the|and|or|in|on|to|is|this|that|for|all|any|if|as|you|interest|permission|disclaimer|software|works?|protection|infringement|act)\b"
SOME_SPELLING = r"\b(" + "|".join(a for a, _ in SPELLINGS) + r")\b"


def canonical_lines(text: Column) -> Column:
    """Lines of the text as words in lower case, with equivalent spellings made one, without punctuation, empty lines and copyright statements."""
    t = F.regexp_replace(F.regexp_replace(F.replace(F.lower(text), F.lit("©"), F.lit(" c ")), r"\r\n?", "\n"), r"[^\p{L}\p{N}\n]+", " ")
    one = t
    for a, b in SPELLINGS:
        one = F.regexp_replace(one, rf"\b{a}\b", b)
    t = F.when(t.rlike(SOME_SPELLING), one).otherwise(t)
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(STATEMENT) & ~(x.rlike(SHORT_STATEMENT) & ~x.rlike(TERMS)))


def license_table(spark: SparkSession) -> DataFrame:
    """(known_digest, license_id): one row per digest. Its size is that of all_texts(), whatever the input."""
    known = spark.createDataFrame(all_texts(), "license_id string, license_text string")
    digest = F.sha2(F.array_join(canonical_lines(F.col("license_text")), " "), 256)
    return known.select("license_id", digest.alias("known_digest")).groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id, notices) for every row of docs (doc_id, text, ...).

    digest is that of the whole canonical text, license_id the licence whose whole canonical text it is, or null. notices
    counts the document's lines that, taken alone, are a whole known text. licenses (known_digest, license_id) has one row
    per digest; the default is license_table(), of a fixed size and therefore broadcast.

    Defined results: null text is an empty one; texts without words have the digest of the empty string and no licence;
    equal texts have equal rows; repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    known = F.broadcast(license_table(docs.sparkSession)) if licenses is None else licenses
    lines = docs.select(docs["doc_id"], canonical_lines(F.coalesce(docs["text"], F.lit(""))).alias("lines"))
    digests = lines.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), (F.size("lines") > 0).alias("some"), F.transform("lines", lambda x: F.unhex(F.sha2(x, 256))).alias("each"))
    digests = scratch.write(digests, "digests")  # the texts are read and made canonical once
    named = digests.join(known, (digests["digest"] == known["known_digest"]) & digests["some"], "left").select("doc_id", "digest", "license_id")
    one = digests.select("doc_id", "digest", F.posexplode("each").alias("line", "line_digest"))
    found = one.join(known, one["line_digest"] == F.unhex(known["known_digest"])).groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.countDistinct("line").alias("_n"))
    out = named.join(found, same(named, found, {"doc_id": "_id", "digest": "_digest"}), "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("_n", F.lit(0)).cast("long").alias("notices"))


def _plain_digest(text: str) -> str:
    """The digest of a text's canonical form, made without Spark."""
    out = []
    for line in re.split(r"\r\n?|\n", text.lower().replace("©", " c ")):
        line = " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in line).split())
        for a, b in SPELLINGS:
            line = " ".join(f" {line} ".replace(f" {a} ", f" {b} ").replace(f" {a} ", f" {b} ").split())
        words = line.split()
        stated = re.search(STATEMENT, line) or len(words) in range(2, 7) and words[0] == "copyright" and not re.search(TERMS, line)
        if line and not stated:
            out.append(line)
    return sha256(" ".join(out).encode()).hexdigest()


def sql() -> str:
    """The same, for DuckDB: it knows the digests, and makes texts canonical by itself."""
    known: dict[str, str] = {}
    for name, text in all_texts():
        digest = _plain_digest(text)
        known[digest] = min(name, known.get(digest, name))
    rows = ", ".join(f"('{k}', '{v}')" for k, v in sorted(known.items()))
    return _SQL.replace("{rows}", rows)


_SQL = r"""
WITH known(known_digest, license_id) AS (VALUES {rows}),
words AS (SELECT doc_id, regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), '©', ' c '), '\r\n?', chr(10), 'g'), '[^\p{L}\p{N}\n]+', ' ', 'g') AS t FROM documents),
one AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '\blicence(s|d)?\b', 'license\1', 'g'), '\bsublicen[cs]e\b', 'sub license', 'g'), '\borganisation(s?)\b', 'organization\1', 'g'), '\b(fav|hon|behavi)our\b', '\1or', 'g'), '\bprogramme\b', 'program', 'g'),
  '\backnowledgement\b', 'acknowledgment', 'g'), '\bmerchantibility\b', 'merchantability', 'g') AS t FROM words),
two AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '\bnoninfringement\b', 'non infringement', 'g'), '\bpercent\b', 'per cent', 'g'), '\bwhilst\b', 'while', 'g'), '\banalyse\b', 'analyze', 'g'), '\brecognise\b', 'recognize', 'g'), '\butilisation\b', 'utilization', 'g'), '\bhttps\b', 'http', 'g') AS t FROM one),
canon AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''
  AND NOT regexp_matches(x, '^(portions )?(c )?copyright( [^ ]+){0,8}? ([0-9]{4}|yyyy|year|c)( |$)') AND NOT regexp_matches(x, '^c ([0-9]{4}|year)( |$)') AND x NOT IN ('all rights reserved', 'copyright', 'c copyright')
  AND NOT (x LIKE 'copyright %' AND len(string_split(x, ' ')) <= 6 AND NOT regexp_matches(x, '\b(notices?|holders?|owners?|laws?|licen[sc]ed?|statement|the|and|or|in|on|to|is|this|that|for|all|any|if|as|you|interest|permission|disclaimer|software|works?|protection|infringement|act)\b'))) AS lines FROM two),
digests AS (SELECT doc_id, lines, sha256(array_to_string(lines, ' ')) AS digest FROM canon),
found AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(lines) AS line FROM canon) JOIN known ON sha256(line) = known_digest GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license_id, coalesce(f.n, 0)::BIGINT AS notices FROM digests d
LEFT JOIN known k ON d.digest = k.known_digest AND len(d.lines) > 0 LEFT JOIN found f ON d.doc_id = f.doc_id
"""
