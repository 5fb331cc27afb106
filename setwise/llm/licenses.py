"""License scans by canonical digests, in DataFrame functions only.

A text is made canonical: A-Z lower-cased, copyright lines dropped (up to where the rights or the terms start, if that
is on the same line), equivalent spellings made one, every run of punctuation and white space one space. The SHA-256 of
the whole canonical text is joined to the digests of known licenses (a constant table, so it is broadcast), short ones
with and without a title line. Lines that speak of a license are looked up alike among known
one-line notices.

Null texts have no digest, no license and no notice; empty ones the digest of nothing. Rows are independent. Licenses
with the same canonical text don't occur in the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm import common

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole texts, by SPDX identifier, without their copyright lines.
LICENSES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to '
    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall "
    "be included in all copies or substantial portions of the Software.\n" + _WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
    "fee is hereby granted.\n" + _ISC_WARRANTY,
    "BSD-2-Clause": _BSD_TERMS + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_TERMS + "3. Neither the name of the copyright holder nor the names of its "
    "contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_WARRANTY,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
    "any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including "
    "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this "
    "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
    "an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly "
    "marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any "
    "source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
    "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
    "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present "
    "and future rights to this software under copyright law.\n" + _WARRANTY.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS") + "\nFor more information, please refer to <https://unlicense.org>",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and '
    "to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
    "following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and "
    "the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
    "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
    'processor.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
    "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
#: Title lines that may stand before them.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
    "Unlicense": ("The Unlicense",),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
}
#: Canonical digests of long texts, as their publishers give them (fixed values; the test makes them anew from the texts).
DIGESTS = {
    "Apache-2.0": ("1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea",),
    "Artistic-1.0-Perl": ("08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",),
    "GFDL-1.3": ("2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",),
    "GPL-1.0": ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",),
    "GPL-2.0": ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",),
    "GPL-3.0": ("eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",),
    "LGPL-2.0": ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",),
    "MPL-2.0": ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",),
}
#: One-line notices.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
}
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("per cent", "percent"), ("https:", "http:"), ("©", "(c)"), ("&", "and"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A copyright line up to its end, or up to where rights or terms start; and the words on rights at a line's start.
_HOLDERS = r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\([c]\)|[0-9][0-9][0-9][0-9])|\([c]\)[ \t]*[0-9])[^\n]*?(\n|$|all rights reserved|permission |redistribution |licensed )"
_RESERVED = r"(^|\n)[^a-z0-9\n]*all rights reserved"
_GAPS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
SPEAKS = r"(?i)licen[cs]e"


def canonical_sql(text: str, engine: str) -> str:
    """The canonical form of a SQL expression, for 'spark' or 'duckdb'."""

    def lit(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if engine == "spark" else "'" + x.replace("'", "''") + "'"

    def sub(x: str, pattern: str, by: str) -> str:
        pattern = lit(pattern) if engine == "spark" else "'" + pattern + "'"
        return f"regexp_replace({x}, {pattern}, {by}" + (")" if engine == "spark" else ", 'g')")

    out = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    newline = r"'\n'" if engine == "spark" else "chr(10)"
    # each line gets a break of its own at both ends
    out = f"replace({out}, {newline}, concat({newline}, {newline}))"
    out = sub(out, _HOLDERS, r"'\n$4'" if engine == "spark" else r"chr(10) || '\4'")
    out = sub(out, _RESERVED, newline)
    return f"trim({sub(out, _GAPS, repr(' '))})"


def _known(texts: dict[str, str] | dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    return [(k, x) for k, v in texts.items() for x in ((v,) if isinstance(v, str) else v)]


def titled(texts: dict[str, str]) -> dict[str, tuple[str, ...]]:
    """Each text alone and after its titles."""
    return {k: (v, *(f"{t}\n{v}" for t in TITLES.get(k, ()))) for k, v in texts.items()}


def license_scan(docs: DataFrame, licenses: dict[str, str] | None = None, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, digest, license of the whole text or null, notices (sorted identifiers, comma-joined), n_notices of every row."""
    spark = docs.sparkSession
    known = spark.createDataFrame(_known(licenses or titled(LICENSES)), "license string, known string").select("license", F.sha2(F.expr(canonical_sql("known", "spark")), 256).alias("digest"))
    if licenses is None:
        known = known.unionAll(spark.createDataFrame(_known(DIGESTS), "license string, digest string"))
    lines = spark.createDataFrame(_known(notices or NOTICES), "id string, line string").select("id", F.sha2(F.expr(canonical_sql("line", "spark")), 256).alias("d")).collect()  # a constant table
    lookup = F.create_map(*(F.lit(x) for r in lines for x in (r["d"], r["id"])))
    spoken = F.filter(F.split("text", "\n"), lambda x: x.rlike(SPEAKS))
    found = F.expr(f"transform(spoken, x -> sha2({canonical_sql('x', 'spark')}, 256))")
    out = docs.select("doc_id", F.sha2(F.expr(canonical_sql("text", "spark")), 256).alias("digest"), F.when(F.col("text").rlike(SPEAKS), spoken).alias("spoken"))
    out = out.withColumn("found", F.transform(found, lambda x: F.try_element_at(lookup, x)))
    out = out.withColumn("found", F.array_sort(F.array_distinct(F.filter("found", lambda x: x.isNotNull()))))
    out = out.join(F.broadcast(known), "digest", "left")
    return out.select("doc_id", "digest", "license", F.coalesce(F.array_join("found", ","), F.lit("")).alias("notices"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_notices"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents"))


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


SQL = f"""
WITH licenses(license, known) AS (VALUES {_values(_known(titled(LICENSES)))}),
notices(id, line) AS (VALUES {_values(_known(NOTICES))}),
whole AS (SELECT license, sha256({canonical_sql("known", "duckdb")}) AS digest FROM licenses UNION ALL VALUES {_values(_known(DIGESTS))}),
short AS (SELECT id, {canonical_sql("line", "duckdb")} AS c FROM notices),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
told AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS notices, count(DISTINCT id) AS n
  FROM (SELECT doc_id, {canonical_sql("l", "duckdb")} AS c FROM lines WHERE regexp_matches(l, '{SPEAKS}')) JOIN short USING (c) GROUP BY doc_id)
SELECT d.doc_id, sha256({canonical_sql("d.text", "duckdb")}) AS digest, w.license, coalesce(t.notices, '') AS notices, coalesce(t.n, 0)::BIGINT AS n_notices
FROM documents d LEFT JOIN whole w ON w.digest = sha256({canonical_sql("d.text", "duckdb")}) LEFT JOIN told t ON t.doc_id = d.doc_id
"""
