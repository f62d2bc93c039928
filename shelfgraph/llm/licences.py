"""Licence scans by canonical digests.

A text is brought to a canonical form: lower case, without the sentences that name a holder, one spelling for words that have several, and single blanks for everything that is
not a letter or digit. The digest of the entire form is joined to the digests of known licences. The units are the whole text and each of its
lines, so a licence that is a document and a notice that is a line are both found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfgraph.llm.common import lower_ascii

#: Known licences up to this number are broadcast (about 100 bytes each).
BROADCAST_KNOWN = 100_000
#: Equivalent signs, and equivalent spellings once signs and blanks are gone, as (found, put), in lower case.
SIGNS = [("http://", "https://"), ("&", " and ")]
SPELLINGS = [("sublicence", "sublicense"), ("licence", "license"), ("copyright holder", "copyright owner"), ("non commercial", "noncommercial"), ("whilst", "while"), ("favour", "favor")]
#: The holder's sentence at a line's start. What the line says of a licence after it stays, and a line that begins with "copyright holders" or the like is a licence's own.
HOLDER = (
    r"(^|\n)[ \t#*/]*(?:copyright[ \t]*+(?=\(c\)|©|[0-9\[<{:,]|[\r\n]|$|(?!holder|owner|notice|law\b|statement|licen[cs]e|and\b|or\b|in\b|to\b)[^\n])|\(c\)|©|all rights reserved)"
    r"(?:[^\n]*?[.;,:)|-][ \t]+(?=(?:it is |this (?:work|file|software|program|code|text) is |(?:re)?(?:leased|distributed|published) under|licen[cs]ed under|permission (?:is hereby|to use)|spdx-license-identifier|(?:the )?mit licen[cs]e|redistribution and use))|[^\n]*)"
)
#: The same by whole lines, as the SQL for a second engine has it; there is no lookahead in that one.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/]*(copyright|\(c\)|©|all rights reserved)[^\n]*"

#: All but a-z, digits and what lies beyond ASCII, save its punctuation and blanks: typographic quotes, dashes, no-break spaces and the like.
NO_WORD = r"[^a-z0-9\x{aa}\x{b5}\x{ba}\x{c0}-\x{1fff}\x{2070}-\x{2fff}\x{3040}-\x{fefe}\x{ff00}-\x{10FFFF}]+"

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Known licences and the usual one-line notices, as (identifier, text).
KNOWN = [
    ("MIT", _PERMISSION),
    ("MIT", "MIT License\n\n" + _PERMISSION),
    ("MIT", "The MIT License (MIT)\n\n" + _PERMISSION),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
#: Digests of the canonical forms of long licences as published, entire and, where they have an appendix, up to "END OF TERMS AND CONDITIONS", as (identifier, digest).
KNOWN_DIGESTS = [
    ("Apache-2.0", "62c23944e22c7e1579b00eab372c8062d04f03e360aaab08b4030b71d5eac153"),
    ("Apache-2.0", "46262ed7a2a06fdac885b37f111be9b18bbde572ab1edbd2f416d673551ab967"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    ("GPL-3.0", "5b004933142ad5f512ad3a3c0537c6a7c13f302a8ac8e4632f720d9b267b20f1"),
    ("GPL-3.0", "22eb3e82400f2536b74963f211af3daaacb548fcde0fe018459b6f2b53a06f8f"),
    ("LGPL-2.1", "bd41c353168fa7258dd575b15107e47406e00e0363f0b975ba9491152352df8a"),
    ("LGPL-2.1", "d07869bf5da5c86d37a7aa8ce3c2604cdd09807d9b2d8d7317e8f845e4d9ec81"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7"),
]


def _folded(text: Column) -> Column:
    """The steps that never reach across a line's end, which they leave in place: case, holders, signs, and one blank for what is no letter or digit."""
    s = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), HOLDER, "$1")
    for a, b in SIGNS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, NO_WORD.replace("[^", r"[^\n", 1), " ")


def _spelled(folded: Column) -> Column:
    """The canonical form of a folded line or text."""
    s = F.trim(F.regexp_replace(folded, "\\s+", " "))
    for a, b in SPELLINGS:
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def canonical(text: Column) -> Column:
    """The canonical form; null is empty."""
    return _spelled(_folded(text))


def _sealed(folded: Column) -> Column:
    return F.coalesce(F.sha2(_spelled(folded), 256), F.lit(""))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = KNOWN_DIGESTS) -> DataFrame:
    """(digest, licence) of the known texts and digests; where texts of two licences have one form, the first by name."""
    texts = spark.createDataFrame(known, "licence string, text string").select(digest(F.col("text")).alias("digest"), "licence")
    ready = spark.createDataFrame(digests, "licence string, digest string").select("digest", "licence")
    return texts.unionByName(ready).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_digest, licence, notices) for each row of ``docs``: the digest of the whole text's canonical form, the licence that it is (null: none known),
    and the licences of its lines, sorted, with commas between (empty: none).

    Null and empty texts have the digest of the empty form and no licence; repeated rows are all returned; null ids need no care. An empty table gives no rows. Other columns are ignored.
    """
    empty = F.sha2(F.lit(""), 256)
    side = known.where(F.col("digest") != empty)
    side = F.broadcast(side) if side.count() <= BROADCAST_KNOWN else side
    # A text is folded once for its own digest and once for its lines, which take their forms from the folded text. A digest that cannot be null and an outer
    # explode spare the filters that the planner would put in front; the text's digest, selected before the explode, is not worked out again for every line
    base = docs.select(F.col(id_col).alias("doc_id"), _folded(F.col(text_col)).alias("folded"))
    whole = base.select("doc_id", _sealed(F.col("folded")).alias("text_digest"))
    texts = base.select("doc_id", _sealed(F.col("folded")).alias("w"), "folded")
    lines = texts.select("doc_id", "w", F.explode_outer(F.split("folded", "\n")).alias("line")).where(F.trim("line") != "")
    found = lines.select("doc_id", "w", _sealed(F.col("line")).alias("digest")).join(side, "digest")
    notices = found.groupBy(F.col("doc_id").alias("n_doc"), F.col("w").alias("n_digest")).agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    out = whole.join(side.select(F.col("digest").alias("text_digest"), "licence"), "text_digest", "left")
    out = out.join(notices, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("text_digest") == F.col("n_digest")), "left")
    return out.select("doc_id", "text_digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))
