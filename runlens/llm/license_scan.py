"""Texts that are a known licence, found by the digest of their canonical form.

The canonical form has lower-case letters and digits with single spaces: copyright
lines are dropped, equivalent spellings are made the same, punctuation becomes
space. The digests of whole texts, and of whole lines for notices within documents, are joined with those of the known licences.
Only DataFrame functions are used.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence guidelines treat as the same.
SPELLINGS = [("acknowledgment", "acknowledgement"), ("authorization", "authorisation"), ("authorized", "authorised"), ("favor", "favour"), ("fulfill", "fulfil"), ("license", "licence"), ("licensed", "licenced"), ("non commercial", "noncommercial"), ("organization", "organisation"), ("per cent", "percent"), ("recognize", "recognise"), ("sub license", "sublicence"), ("sublicense", "sublicence"), ("https", "http")]

# Known licence texts and notices, by their SPDX identifiers.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.\n\nYou should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."

LICENSES = [
    ("MIT", f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT_GRANT}, subject to the following conditions:\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"BSD Zero Clause License\n\n{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_GRANT}\n\n{_BSD_ONE}\n\n{_BSD_TWO}\n\n{_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n\n{_BSD_ONE}\n\n{_BSD_TWO}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_GRANT}\n\n{_BSD_ONE}\n\n{_BSD_TWO}\n\n{_BSD_THREE}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n\n{_BSD_ONE}\n\n{_BSD_TWO}\n\n{_BSD_THREE}\n\n{_BSD_WARRANTY}"),
    ("Zlib", "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0-or-later", _GNU.format(name="General Public License", v=2)),
    ("GPL-3.0-or-later", _GNU.format(name="General Public License", v=3)),
    ("LGPL-2.1-or-later", _GNU.format(name="Lesser General Public License", v="2.1")),
    ("LGPL-3.0-or-later", _GNU.format(name="Lesser General Public License", v=3)),
    ("AGPL-3.0-or-later", _GNU.format(name="Affero General Public License", v=3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("MIT", "Released under the MIT License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
]

# Digests of the canonical forms of long licences' whole texts, as operating systems ship them.
DIGESTS = [
    ("Apache-2.0", "b72841207b909f286adad3e0f99b0eee7eb28eb6ef9ad5440ef09431de039716"),
    ("Artistic-1.0-Perl", "3f72fca8e9edf142b844df45d827a04462cb9a6dd286357a134eb8b2d030d707"),
    ("CC0-1.0", "400db3ed80e146737970d3ff856f201f0206119c2851164504a236a6893f845a"),
    ("GFDL-1.2", "00bc0fc943c6557a551ed32579874c03c01efd181c5e5f3990bf8595a02af33f"),
    ("GFDL-1.3", "069cb5bc99df568e8f093d5b811a45c050b476ca779e06c27f53824e5a2f01fc"),
    ("GPL-1.0", "8e0f81d73b1faf1f8a0333d582879d563350b94d7f1722f07832813be56d0d14"),
    ("GPL-2.0", "1fc5512cd5033f07c0376e93dc984b943d419477f2e6ee97b3ab1f19486cebb6"),
    ("GPL-3.0", "2c2b46f8f109c47a97e47e2cec690ac3dafe2b9b344c6d3311460b6c3dadfd0c"),
    ("LGPL-2.0", "9fad27f8768b724d4343ae8840edd60d469d6925335f351d9e4fa2b7175d6c1a"),
    ("LGPL-2.1", "6d10b75ac8120e4d7a939c3e0de48941cd5e17413f5a8b9b87860b9f65e673a5"),
    ("LGPL-3.0", "7d6e51c6bb80fc7a025c16e64157adf9c280c58dee4c4b2bf73e596166a2a08f"),
    ("MPL-1.1", "1e2f1bca600978c8bd27b0b6cb5ba1067ffea1d93bd3eb7e4090c906cbc68114"),
    ("MPL-2.0", "d4eba72ed883aa90fbf114041e6f1356eba87eefc07f3eadea2cf9d754076630"),
]

#: Known texts at most; their digests go to every task.
KNOWN = 10_000

#: A copyright line: the sign, a year, a name or nothing follows the word, so that wrapped sentences stay.
_COPYRIGHT = r"^[^a-z0-9]*(copyright *(\(c\)|©|[0-9]{4}|[:,<\[{]|$)|\(c\)|©|all rights reserved)"


def _plain(line: Column) -> Column:
    """The canonical form of lower-case text without line ends."""
    plain = F.trim(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "))
    padded = F.concat(F.lit(" "), F.regexp_replace(plain, " ", "  "), F.lit(" "))
    for a, b in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(padded, " +", " "))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\r\n|\r|\n"), lambda x: ~x.rlike(_COPYRIGHT))


def canonical(text: Column) -> Column:
    return _plain(F.array_join(_lines(text), " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license, text, digest): a known text, or the digest of its canonical form alone."""
    return spark.createDataFrame([*((n, t, None) for n, t in LICENSES), *((n, None, d) for n, d in DIGESTS)], "license string, text string, digest string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license, notice) of every row of docs: digest of the canonical
    whole text; license: the known text that has the same, else null; notice: the known text that has
    the digest of one whole line, else null.

    A null or empty text, or one of copyright lines and punctuation only, has the digest of the empty text,
    which is no licence. Of several licences with one canonical text, or several lines that are notices, the
    first by name is given. Repeated rows each get a row, a null doc_id stays null, empty tables
    give no rows or no licences; other columns are not read. known(license, text, and digest where a text is known by it alone) has KNOWN rows at most: a hash join
    with a broadcast for whole texts, a look-up in the same table for lines.
    """
    made = F.when(canonical(F.col("text")) != "", F.sha2(canonical(F.col("text")), 256))
    own = F.coalesce(made, F.col("digest")) if "digest" in known.columns else made
    names = known.select(own.alias("digest"), "license").where("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"))
    rows = names.limit(KNOWN + 1).collect()
    if len(rows) > KNOWN:
        raise ValueError(f"over {KNOWN} known texts")
    table = F.from_json(F.lit(json.dumps({r.digest: r.license for r in rows})), "map<string,string>")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.transform(_lines(text), lambda x: F.try_element_at(table, F.sha2(_plain(x), 256)))
    each = docs.select("doc_id", F.sha2(canonical(text), 256).alias("digest"), F.array_min(found).alias("notice"))
    return each.join(F.broadcast(names), "digest", "left").select("doc_id", "digest", "license", "notice")


def sql(docs: str = "documents") -> str:
    """DuckDB's SQL for scan() with known_licenses()."""
    pattern = _COPYRIGHT.replace("'", "''")

    def lines(text: str) -> str:
        return f"list_filter(regexp_split_to_array(lower({text}), '\\r\\n|\\r|\\n'), lambda x: NOT regexp_matches(x, '{pattern}'))"

    def plain(text: str) -> str:
        padded = f"(' ' || replace(trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '  ') || ' ')"
        for a, b in SPELLINGS:
            padded = f"replace({padded}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({padded}, ' +', ' ', 'g'))"

    def form(text: str) -> str:
        return plain(f"array_to_string({lines(text)}, ' ')")

    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in LICENSES)
    alone = ", ".join(f"('{name}', '{digest}')" for name, digest in DIGESTS)
    return f"""
    WITH known AS MATERIALIZED (SELECT digest, min(license) AS license FROM (SELECT sha256({form("text")}) AS digest, license FROM (VALUES {rows}) v(license, text) WHERE {form("text")} <> '' UNION ALL SELECT digest, license FROM (VALUES {alone}) w(license, digest)) GROUP BY 1),
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {docs}),
    line AS (SELECT r, unnest({lines("text")}) AS x FROM d),
    notices AS (SELECT r, min(license) AS notice FROM (SELECT r, sha256({plain("x")}) AS digest FROM line) JOIN known USING (digest) GROUP BY r),
    whole AS (SELECT r, doc_id, sha256({form("text")}) AS digest FROM d)
    SELECT doc_id, digest, license, notice FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (r)
    """
