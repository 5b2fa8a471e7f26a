"""Licence scan by canonical digests (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import written
from .common import small

# Words that licence matching treats as the same spelling.
EQUIVALENT = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("modifiable version", "modified version"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("wilful", "willful"),
    ("version 2 0", "version 2"),
    ("version 3 0", "version 3"),
)

# The wording of short licences and of the usual one-line notices.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\n"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_MIT_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n\n"
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
    "License for the specific language governing permissions and limitations under the License."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn "
    "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
    "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    + _MIT_DISCLAIMER.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
    + "\n\nFor more information, please refer to <https://unlicense.org>"
)
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software "
    "Foundation, either version {1} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more "
    "details.\n\nYou should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_MPL_HEADER = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
    "can obtain one at https://mozilla.org/MPL/2.0/."
)
KNOWN = (
    ("MIT", "MIT License\n\n" + _MIT_GRANT + _MIT_NOTICE + _MIT_DISCLAIMER),
    ("MIT", _MIT_GRANT + _MIT_NOTICE + _MIT_DISCLAIMER),
    ("MIT-0", "MIT No Attribution\n\n" + _MIT_GRANT.replace(", subject to the following conditions:", ".") + _MIT_DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_DISCLAIMER),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_DISCLAIMER),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE_HEADER),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("GPL-3.0-or-later", _GNU_HEADER.format("General Public License", 3)),
    ("LGPL-3.0-or-later", _GNU_HEADER.format("Lesser General Public License", 3)),
    ("AGPL-3.0-or-later", _GNU_HEADER.format("Affero General Public License", 3)),
    ("MPL-2.0", _MPL_HEADER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
#: Every known text has one of these; a text without them needs no digest.
ANCHORS = ("licen", "permission", "redistribution")

#: Not before what a licence itself says of copyright, wherever its lines are broken; a colon or a year makes it a notice.
_OWN_WORDS = "(?![\\s*#/]+(?:notice|holder|owner|law|interest)s?\\b(?![ \\t]*[:©]|[^\\n]*\\b(?:19|20)[0-9]{2}\\b))"


def _wide(words: str) -> str:
    return words.replace(" ", "  ")


def canonical(c: Column) -> Column:
    """Lower case, copyright and rights-reserved lines gone, punctuation as one space, one spelling."""
    c = F.regexp_replace(F.lower(c), f"(^|\\n)[ \\t*#/]*(copyright{_OWN_WORDS}|\\(c\\)|©|all rights reserved)[^\\n]*", "\n")
    # Two spaces part the words meanwhile, so that neighbours don't share one.
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, "[^\\p{L}\\p{N}]+", "  ")), F.lit(" "))
    for a, b in EQUIVALENT:
        c = F.replace(c, F.lit(f" {_wide(a)} "), F.lit(f" {_wide(b)} "))
    return F.replace(F.trim(c), F.lit("  "), F.lit(" "))


def digest(c: Column) -> Column:
    return F.sha2(canonical(c), 256)


def license_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(license, known) of a folder of licence texts, one a file that is named as the licence is."""
    name = F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)([.](txt|md))?$", 1)
    return spark.read.text(folder, wholetext=True).select(F.url_decode(name).alias("license"), F.col("value").alias("known"))


def _anchored(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(a) for a in ANCHORS])


def license_scan(docs: DataFrame, known: Sequence[tuple[str, str]] | DataFrame = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_license, notices, n_notices; one row per row of docs.

    text_license is the licence that the entire text is, found by a hash join of its
    canonical digest; notices are the licences, sorted, that entire lines of the text
    name by the same digests, comma-joined; n_notices counts those lines. Null and empty
    texts have none; repeated rows, ties and null ids give rows of their own, and of
    licences with one digest the first by name counts; very long texts get one digest of all
    their characters. An empty table gives no rows;
    other columns, and their names, have no effect. known is a table (license, known),
    as of license_texts, or pairs of them, any number. Only texts with one of ANCHORS
    get a digest, unless a known text has none of them.
    """
    table = known if isinstance(known, DataFrame) else docs.sparkSession.createDataFrame([*known], "license string, known string")
    table = table.filter("license is not null and known is not null")
    by_digest = written(table.groupBy(digest(F.col("known")).alias("digest")).agg(F.min("license").alias("license")), "known")
    every = not table.filter(~_anchored(F.col("known"))).isEmpty()
    able = F.col(text_col).isNotNull() if every else _anchored(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.when(able, F.col(text_col)).alias("text"))
    lines = F.split("text", "\n") if every else F.filter(F.split("text", "\n"), _anchored)
    # Only the texts that may match are looked at again: F.when keeps the others null.
    some = F.col("text").isNotNull()
    kept = rows.select("id", F.when(some, digest(F.col("text"))).alias("digest"), F.when(some, F.transform(lines, digest)).alias("lines"))
    kept = written(kept.withColumn("row", F.monotonically_increasing_id()), "digests")
    named = kept.select("row", F.explode("lines").alias("digest")).join(small(by_digest), "digest")
    named = named.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"), F.count("*").alias("n_notices"))
    found = kept.join(small(by_digest), "digest", "left").join(small(written(named, "notices")), "row", "left")
    return found.select(F.col("id").alias(id_col), F.col("license").alias("text_license"), F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def _sql_canonical(c: str) -> str:
    # What _OWN_WORDS says, without looking ahead: the word is masked before a licence's own words, and unmasked again where those make a notice.
    own = "[\\s\\x0b*#/]+(?:notice|holder|owner|law|interest)s?"
    c = f"regexp_replace(lower({c}), '((?:^|\\n)[ \\t*#/]*)copyright({own})\\b', '\\1copyri' || chr(1) || 'ght\\2', 'g')"
    c = f"regexp_replace({c}, 'copyri\\x01ght({own}(?:[ \\t]*[:©]|\\b[^\\n]*\\b(?:19|20)[0-9]{{2}}\\b))', 'copyright\\1', 'g')"
    c = f"regexp_replace({c}, '(^|\\n)[ \\t*#/]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*', chr(10), 'g')"
    c = f"replace({c}, 'copyri' || chr(1) || 'ght', 'copyright')"
    c = f"' ' || trim(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
    for a, b in EQUIVALENT:
        c = f"replace({c}, ' {_wide(a)} ', ' {_wide(b)} ')"
    return f"replace(trim({c}), '  ', ' ')"


def _values() -> str:
    return ", ".join("('{}', '{}')".format(a, t.replace("'", "''")) for a, t in KNOWN)


SQL = f"""
WITH known(license, t) AS (VALUES {_values()}),
digests AS (SELECT {_sql_canonical("t")} AS canon, min(license) AS license FROM known GROUP BY 1),
whole AS (SELECT doc_id, {_sql_canonical("text")} AS canon FROM documents WHERE regexp_matches(lower(text), '{"|".join(ANCHORS)}')),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE regexp_matches(lower(text), '{"|".join(ANCHORS)}')),
n AS (SELECT l.doc_id, d.license FROM l JOIN digests d ON d.canon = {_sql_canonical("l.x")} WHERE regexp_matches(lower(l.x), '{"|".join(ANCHORS)}')),
g AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM n GROUP BY doc_id),
w AS (SELECT whole.doc_id, d.license FROM whole JOIN digests d ON d.canon = whole.canon)
SELECT s.doc_id, w.license AS text_license, coalesce(g.notices, '') AS notices, coalesce(g.n_notices, 0) AS n_notices
FROM documents s LEFT JOIN g ON s.doc_id = g.doc_id LEFT JOIN w ON s.doc_id = w.doc_id
"""
