"""License scans by canonical digest lookup; DataFrame functions only."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

# Spellings that count as the same word.
EQUIVALENT = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("organisation", "organization"),
    ("modernise", "modernize"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("programme", "program"),
    ("favour", "favor"),
    ("copyright holder", "copyright owner"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

# SPDX identifiers and the names by which notices call the licenses.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL 3.0", "AGPLv3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL 2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL 3.0", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL 3.0", "LGPLv3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
NOTICES = tuple(f"{start} under {the}{{}}." for start in ("Licensed", "Released", "Distributed", "Published", "This work is licensed", "This software is licensed", "This file is licensed") for the in ("the ", "a ", ""))
_FAMILY = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")

#: Texts and notices known by default, (license id, text): each name in each notice, SPDX lines, and short whole texts.
KNOWN = (
    *((i, notice.format(name)) for i, names in NAMES.items() for name in names for notice in NOTICES),
    *((i, f"SPDX-License-Identifier: {i}{end}") for i in NAMES for end in (("", "-only", "-or-later") if i in _FAMILY else ("",))),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
)

PHRASES = tuple((old, new) for old, new in EQUIVALENT if " " in old)

#: Where the text proper ends: what follows are hints for users, which copies often leave out.
_HINTS = re.compile(r"(?im)(?<=END OF TERMS AND CONDITIONS)\s[\s\S]*|^[ \t]*(ADDENDUM: How to use|How to Apply These Terms|Exhibit A ?-)[\s\S]*")
_TITLES = {"BSD-2-Clause": ("", "BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), "BSD-3-Clause": ("", "BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License')}


def _whole_texts() -> tuple[tuple[str, str], ...]:
    """(license id, text) of the entire licenses in ``known``: with and without hints, by http and https, numbered or starred."""
    out = []
    for path in sorted((Path(__file__).parent / "known").glob("*.txt")):
        body = path.read_text("utf-8")
        for form in {body, _HINTS.sub("", body), re.sub(r"(?m)^( *)\d\. ", r"\1* ", body)} if path.stem in _TITLES else {body, _HINTS.sub("", body)}:
            links = {form, form.replace("https://", "http://"), form.replace("http://", "https://")}
            out += [(path.stem, f"{title}\n\n{x}") for title in _TITLES.get(path.stem, ("",)) for x in links]
    return tuple(sorted(out))


#: Entire texts known by default besides ``KNOWN``.
WHOLE = _whole_texts()

#: Copyright lines as the SQL takes them out; ``NOTICE`` takes out these and more, but not what follows a notice.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$"

#: What ends a notice on its line: a sentence, or the text itself, about the license.
_AFTER = (
    r"(?:[.;,|\u2013\u2014-][ \t\"'>)]*[ \t](?i:licen[sc]ed|released|distributed|permission|redistribution|this (?:work|software|program|file)|spdx-)"
    r"|[ \t](?i:permission (?:is hereby granted|to use)|redistribution and use|(?:licen[sc]ed|released|distributed) under|spdx-license-identifier))"
)
#: A copyright notice without the rest of its line: with a year, a sign, a place for a name, or a name.
NOTICE = (
    r"(?m)(?:^[^\p{L}\p{N}\n]*|(?<=(?i:licen[sc]e)[.:]{0,1}[ \t]{1,4}))"
    r"(?:(?i:copyright|\(c\)|©)(?=[^\n]*[0-9]{4})|(?i:copyright)[ \t]*(?i:\(c\)|©|[\[<{])|©|\([cC]\)[ \t]*(?i:copyright)"
    r"|Copyright:?[ \t]+(?:by[ \t]+)?(?!(?i:holder|owner|notice|licen|law|and |or |statement|disclaimer|treat|interest|protection|office|act\b))(?=\p{Lu}))"
    r"(?:(?!" + _AFTER + r")[^\n])*"
    r"(?:\n[^\p{L}\p{N}\n]*(?i:all rights reserved)[^\p{L}\p{N}\n]*$)?"
)


def _equivalent(text: Column, pairs=EQUIVALENT) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical(text: Column) -> Column:
    """Lower case, no copyright notices (nor "all rights reserved" below), words parted by one blank, lines kept."""
    text = F.coalesce(text, F.lit(""))
    out = F.lower(F.when(text.rlike(r"(?i)copyright|\(c\)|©"), F.regexp_replace(text, NOTICE, "")).otherwise(text))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return _equivalent(out)


def whole(canon: Column) -> Column:
    """The lines as one, with the equivalent phrases that a line break had parted."""
    return _equivalent(F.trim(F.regexp_replace(canon, r"[ \n]+", " ")), PHRASES)


def paragraphs(canon: Column) -> Column:
    """Digests of the paragraphs of a canonical text, which blank lines part."""
    some = F.filter(F.split(canon, r"\n *\n[ \n]*"), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" "))) != "")
    return F.transform(some, lambda p: F.struct(digest_of(whole(p)).alias("digest"), F.trim(p).contains("\n").alias("several")))


def digest_of(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def known_table(spark: SparkSession, known=KNOWN + WHOLE) -> DataFrame:
    return spark.createDataFrame(list(known), "license_id string, text string")


def lookup_table(known: DataFrame) -> DataFrame:
    """(part, digest, license_id, variant, kpos, k): what the units of a text are looked up in.

    ``part`` false: the digest of an entire known text. ``part`` true: that of its paragraph
    number ``kpos`` of ``k``; ``variant`` is the digest of all of it.
    """
    texts = known.select("license_id", canonical(F.col("text")).alias("c")).select("license_id", whole(F.col("c")).alias("w"), paragraphs(F.col("c")).alias("ps"))
    texts = texts.where("w <> '' and license_id is not null").select("license_id", digest_of(F.col("w")).alias("variant"), "ps").dropDuplicates(["license_id", "variant", "ps"])
    entire = texts.select(F.lit(False).alias("part"), F.col("variant").alias("digest"), "license_id", "variant", F.lit(0).alias("kpos"), F.lit(0).alias("k")).distinct()
    # one variant may be cut into paragraphs in several ways
    cut = texts.select("license_id", digest_of(F.to_json("ps")).alias("variant"), F.size("ps").alias("k"), F.posexplode("ps").alias("kpos", "p"))
    return entire.union(cut.select(F.lit(True), "p.digest", "license_id", "variant", "kpos", "k"))


def scan_licenses(docs: DataFrame, known: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """Rows (doc_id, scope, license_id, matches) for each license that a document holds.

    The units looked up are the entire text (scope ``text``), each of its lines (scope
    ``line``) and its runs of consecutive paragraphs (scope ``passage``); a unit matches if its
    digest, or those of its paragraphs in turn, equal those of an entire known text. A text
    that is one line counts as ``text`` only, a paragraph of one line as ``line``, and the run
    of all paragraphs as ``text``; passages of one license that begin or end together count once, as the longest.
    Digests of known texts are broadcast up to ``broadcast_rows`` rows, joined by a shuffle
    beyond. Null and empty texts match nothing; known texts that are null or empty after
    normalising are left out; repeated rows of one id add up.
    """
    lookup = lookup_table(known)
    if lookup.limit(broadcast_rows + 1).count() <= broadcast_rows:
        lookup = F.broadcast(lookup)
    texts = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text).cast("string")).alias("c"))
    lines = F.filter(F.transform(F.split("c", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    texts = texts.select("doc_id", F.xxhash64("c").alias("row"), whole(F.col("c")).alias("w"), lines.alias("lines"), paragraphs(F.col("c")).alias("ps"))
    none = F.array().cast("array<struct<scope:string,digest:string,pos:int,several:boolean>>")
    unit = lambda scope, value, pos, several: F.struct(F.lit(scope).alias("scope"), value.alias("digest"), pos.cast("int").alias("pos"), several.alias("several"))
    entire = F.array(unit("text", digest_of(F.col("w")), F.lit(0), F.lit(False)))
    by_line = F.when(F.size("lines") > 1, F.transform("lines", lambda x: unit("line", digest_of(x), F.lit(0), F.lit(False)))).otherwise(none)
    by_paragraph = F.when(F.size("ps") > 1, F.transform("ps", lambda p, i: unit("passage", p.digest, i, p.several))).otherwise(none)
    # explode_outer, as explode would have the array computed once more by a filter on its size
    units = texts.select("doc_id", "row", F.size("ps").alias("n"), F.explode_outer(F.concat(entire, by_line, by_paragraph)).alias("u")).select("doc_id", "row", "n", "u.*")
    space = Workspace(docs.sparkSession)
    hits = units.withColumn("part", F.col("scope") == "passage").join(lookup, ["part", "digest"])
    hits = space.stage(hits.where(~F.col("part") | ((F.col("k") < F.col("n")) & ((F.col("k") > 1) | F.col("several")))).drop("digest"), "hits")
    units = hits.where("not part").groupBy("doc_id", "scope", "license_id").agg(F.count("*").alias("matches"))
    at = hits.where("part").groupBy("doc_id", "row", "license_id", "variant", "k", (F.col("pos") - F.col("kpos")).alias("start")).agg(F.countDistinct("kpos").alias("found"), F.count("*").alias("times"))
    # rows that are alike in id and text stand together: each paragraph comes as often as there are such rows
    full = at.where("found = k").withColumns({"end": F.col("start") + F.col("k"), "times": (F.col("times") / F.col("k")).cast("long")})
    longest = full.groupBy("doc_id", "row", "license_id", "start").agg(F.max("end").alias("end"), F.max("times").alias("times"))
    runs = longest.groupBy("doc_id", "row", "license_id", "end").agg(F.max("times").alias("times"))
    passages = runs.groupBy("doc_id", F.lit("passage").alias("scope"), "license_id").agg(F.sum("times").alias("matches"))
    return units.union(passages)
