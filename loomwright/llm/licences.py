"""Licence scan by canonical digests: whole texts and whole lines, normalised, against known licence texts.

Only built-in expressions run: a text is lower-cased, loses copyright
lines, keeps nothing but letters and digits as words, gets one spelling
for equivalent words, and its SHA-256 is hash-joined with the digests of
the known texts.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import others, stored

#: Whole licence texts (<identifier>.txt) and standard headers (<identifier>.header.txt).
TEXTS = Path(__file__).parent / "licence_texts"

# Public licence texts and notices; the first line of each entry is its identifier.
KNOWN = """
MIT
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

ISC
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.

0BSD
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.

Zlib
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.

MIT
Released under the MIT License.

MIT
Licensed under the MIT License.

Apache-2.0
Licensed under the Apache License, Version 2.0.

Apache-2.0
Released under the Apache License, Version 2.0.

GPL-3.0-only
This work is licensed under the GNU General Public License, version 3.

GPL-3.0-only
This program is licensed under the GNU General Public License, version 3.

CC-BY-NC-4.0
Licensed under CC BY-NC 4.0.

CC-BY-4.0
Licensed under CC BY 4.0.

CC-BY-SA-4.0
Licensed under CC BY-SA 4.0.

BSD-3-Clause
Licensed under the BSD 3-Clause License.

MPL-2.0
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
"""
# Equivalent spellings, replaced wherever they stand in lower-cased text.
SPELLINGS = {
    "licence": "license", "licencing": "licensing", "organis": "organiz", "authoris": "authoriz", "recognis": "recogniz",
    "favour": "favor", "behaviour": "behavior", "acknowledgement": "acknowledgment", "merchantib": "merchantab", "programme": "program",
}
#: A line that says only whose copyright it is; a line that goes on to say more stays.
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[ \t]*((\(c\)|©|[0-9])[^\n]*)?$|^[ \t]*all rights reserved[.]?[ \t]*$"
#: What separates words, but for the end of a line.
BETWEEN = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text: Column) -> Column:
    """The text in lower case without copyright lines, one spelling, words with one space between them; line ends stay."""
    text = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?d)" + COPYRIGHT_LINE, "")
    text = F.regexp_replace(text, BETWEEN, " ")
    for old, new in SPELLINGS.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical(text: Column) -> Column:
    """canonical_lines() as one line."""
    return F.trim(F.regexp_replace(canonical_lines(text), "[ \n]+", " "))


#: Titles that stand above a text that has none of its own.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"], "Zlib": ["zlib License", "The zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License"],
}


def variants(name: str, text: str) -> list[str]:
    """A whole text as it is handed on: with or without title, item numbers, appendix and the appendix's line to fill in; http or https."""
    found = [text]
    if "END OF TERMS AND CONDITIONS" in text:
        terms = text.split("END OF TERMS AND CONDITIONS")[0]
        found += [terms, terms + "END OF TERMS AND CONDITIONS", re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", text)]
    if name.startswith("BSD-"):
        found += [re.sub(r"(?m)^[0-9]\. ", "", text)]
        found += [x.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR") for x in found]
    found += [f"{title}\n\n{x}" for title in TITLES.get(name, []) for x in found]
    found += [re.sub("https?://", scheme, x) for scheme in ("http://", "https://") for x in found if "://" in x]
    return list(dict.fromkeys(found))


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, text) of the built-in notices, whole texts and standard headers; a caller may pass a larger table."""
    entries = [entry.split("\n", 1) for entry in KNOWN.strip().split("\n\n")]
    whole = [(name, text) for name, text in entries if "\n" in text]
    whole += [(path.name.removesuffix(".txt").removesuffix(".header"), path.read_text()) for path in sorted(TEXTS.glob("*.txt"))]
    entries += [(name, x) for name, text in whole for x in variants(name, text)]
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(text).alias("text")) for name, text in entries))))


def known_digests(known: DataFrame, most_broadcast: int = 10_000) -> DataFrame:
    """(digest, licence) of the known texts; broadcast if there are at most `most_broadcast` (they don't grow with the scanned table).

    Texts that become equal count once, the smallest name wins; one without words matches nothing.
    """
    names = known.select("licence", canonical(F.col("text").cast("string")).alias("c")).where("c <> '' and licence is not null")
    digests = names.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("licence").alias("licence"))
    return F.broadcast(digests) if known.limit(most_broadcast + 1).count() <= most_broadcast else digests


#: Known texts up to which a line is looked up in the row that holds it.
MOST_IN_ROW = 10_000


def scan(df: DataFrame, digests: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of df with digest, of the whole canonical text, licence, the known licence that it is, else null,
    and notices: the lines that are a known text, as (line from 0, licence).

    A copyright line counts as an empty line. Null and empty texts have
    the digest of an empty text, no licence and no notices. Every row is
    scanned by itself, whatever its id, so repeated rows give repeated
    results; columns that are not named are dropped, named ones called
    like a result are replaced, an empty table gives an empty one. The text
    is normalised once; whole texts meet the known digests in a hash join.
    """
    columns = others(columns, "digest", "licence", "notices")
    lined = df.select(*columns, canonical_lines(F.col(text_col).cast("string")).alias("__lines"))
    whole = F.sha2(F.trim(F.regexp_replace("__lines", "[ \n]+", " ")), 256)
    if digests.limit(MOST_IN_ROW + 1).count() > MOST_IN_ROW:
        return _scan_large(lined, digests, columns, whole)
    known = {r.digest: r.licence for r in digests.collect()}  # at most MOST_IN_ROW
    lines = F.filter(F.transform(F.split("__lines", "\n"), lambda x, i: F.struct(i.cast("long").alias("line"), F.trim(x).alias("said"))), lambda x: x["said"] != "")
    said = F.filter(F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.sha2(x["said"], 256).alias("said"))), lambda x: x["said"].isin(list(known)))
    names = F.from_json(F.lit(json.dumps(known)), "map<string, string>")
    named = F.transform("__said", lambda x: F.struct(x["line"].alias("line"), F.element_at(names, x["said"]).alias("licence")))
    rows = lined.select(*columns, whole.alias("digest"), said.alias("__said"))
    out = rows.join(digests.select(F.col("digest").alias("__known"), "licence").hint("broadcast"), F.col("digest") == F.col("__known"), "left")
    return out.select(*columns, "digest", "licence", named.alias("notices"))


def _scan_large(lined: DataFrame, digests: DataFrame, columns: list[str], whole: Column) -> DataFrame:
    """scan() against any number of known texts: lines are rows of a shuffled join. Rows get their number in a stored table."""
    lines = F.transform(F.split("__lines", "\n"), lambda x: F.sha2(F.trim(x), 256))
    rows = stored(lined.select(*columns, whole.alias("digest"), lines.alias("__digests")).withColumn("__row", F.monotonically_increasing_id()), "licence-lines")
    known = digests.select(F.col("digest").alias("__known"), "licence")
    said = rows.select("__row", F.posexplode("__digests").alias("line", "__said")).join(known, F.col("__said") == F.col("__known"))
    found = said.groupBy(F.col("__row").alias("__of")).agg(F.array_sort(F.collect_list(F.struct(F.col("line").cast("long").alias("line"), "licence"))).alias("notices"))
    out = rows.join(known, F.col("digest") == F.col("__known"), "left").join(found, F.col("__row") == F.col("__of"), "left")
    none = F.array().cast("array<struct<line: bigint, licence: string>>")
    return out.select(*columns, "digest", "licence", F.coalesce("notices", none).alias("notices"))


def scan_lines(df: DataFrame, digests: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """A row for each line of a text that is a known text as a whole: the named columns, line (from 0) and licence.

    A copyright line counts as an empty line; null and empty texts have no rows.
    """
    lines = F.split(canonical_lines(F.col(text_col).cast("string")), "\n")
    said = df.select(*columns, F.posexplode(F.transform(lines, lambda x: F.trim(x))).alias("line", "said")).where("said <> ''")
    said = said.select(*columns, F.col("line").cast("long").alias("line"), F.sha2("said", 256).alias("digest"))
    return said.join(digests, "digest").select(*columns, "line", "licence")
