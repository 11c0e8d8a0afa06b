"""License scan: TF-IDF cosine to templates, then inheritance along paths.

Lines of a file that speak of a licence make its header. They are compared with
a table of templates by the cosine of sparse TF-IDF vectors, each distinct line
once: wordings of notices by version, identifiers and names in the usual
phrases, and the whole texts of short licences. The versions that a template
names must be in the text. A file that is a licence file by name, or whose whole
text is a licence's, stands for its directory; files without a header of their own inherit from the nearest
directory above that has one, by joins on paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, same, spread_join, stage

#: Wording of notices by SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("ISC", "Licensed under the ISC License. Permission to use, copy, modify, and distribute this software for any purpose is hereby granted."),
    ("CC0-1.0", "Released to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("LicenseRef-Proprietary", "All rights reserved."),
    ("LicenseRef-Proprietary", "Copyright. All rights reserved."),
    ("LicenseRef-Proprietary", "All rights reserved. No part of this work may be reproduced or distributed without prior written permission of the copyright holder."),
)
#: What licences are called, by SPDX identifier.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license"),
    "GPL-2.0-only": ("GNU General Public License version 2", "GNU GPL v2", "GPLv2 license"),
    "GPL-3.0-only": ("GNU General Public License version 3", "GNU GPL v3", "GPLv3 license"),
    "LGPL-2.1-only": ("GNU Lesser General Public License version 2.1", "LGPL v2.1", "LGPLv2.1 license"),
    "LGPL-3.0-only": ("GNU Lesser General Public License version 3", "LGPL v3", "LGPLv3 license"),
    "AGPL-3.0-only": ("GNU Affero General Public License version 3", "AGPL v3", "AGPLv3 license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD license"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0 license"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "European Union Public Licence", "EUPL"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "OFL-1.1": ("SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"),
}
#: Further SPDX identifiers, which stand for themselves.
IDENTIFIERS = ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "Unlicense", "WTFPL", "0BSD", "PostgreSQL")
#: Families whose notices name a version, by name and identifier, with their versions.
VERSIONED = (("GNU General Public License", "GPL", ("1.0", "2.0", "3.0")), ("GNU Lesser General Public License", "LGPL", ("2.1", "3.0")), ("GNU Library General Public License", "LGPL", ("2.0",)), ("GNU Affero General Public License", "AGPL", ("1.0", "3.0")), ("Apache License", "Apache", ("1.0", "1.1", "2.0")), ("Mozilla Public License", "MPL", ("1.0", "1.1", "2.0")))
_GNU = ("{0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version", "This program is free software; you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version", "either version {1} of the License, or (at your option) any later version", "Licensed under the {0}, version {1} or later", "{0} version {1} or any later version")
_ONLY = ("This program is free software; you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation; version {1} of the License", "Licensed under the {0}, version {1}", "Licensed under the {0}, version {1} only")
PHRASES = ("Licensed under the {}", "Distributed under the {}", "Released under the {}", "Available under the terms of the {}", "This project is licensed under the {} see the LICENSE file for details", "License: {}", "{} at your option", "{}")
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Whole texts of short licences.
TEXTS = (
    ("MIT", "MIT License " + _MIT_GRANT + _MIT_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_TERMS + _BSD_THIRD + _BSD_WARRANTY),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
#: The version notices of those families.
VERSIONS = tuple((f"{k}-{v}" + (end if gnu else ""), f.format(name, v.removesuffix(".0") if gnu else v)) for name, k, vs in VERSIONED for gnu in (k.endswith("GPL"),) for v in vs for end, forms in (("-or-later", _GNU if gnu else ()), ("-only", _ONLY)) for f in forms if not (f is _GNU[2] and k != "GPL"))
#: All templates: notices, version notices, whole texts, and each name and identifier in the usual phrases.
TEMPLATES = (*NOTICES, *VERSIONS, *TEXTS, *((k, f.format(x)) for k, names in NAMES.items() for x in names for f in PHRASES), *((k, f.format(k)) for k in (*NAMES, *IDENTIFIERS) for f in ("SPDX-License-Identifier: {}", "Licensed under {}", "License: {}")))

#: What a sentence of a header holds, and the least cosine that counts.
SPEAKS = r"(?i)\b(?:licen[sc]e[ds]?|copyright|spdx|all rights reserved|public domain|creative commons|permission is hereby|redistribution and use)\b"
#: In lower case, what any text that does so contains: searched first, being cheap.
STEMS = ("licen", "copyright", "spdx", "all rights reserved", "public domain", "creative commons", "permission is hereby", "redistribution and use")
#: A sentence; a full stop within a number doesn't end it. It is read once, without going back.
SENTENCE = r"[^\n.!?]++(?:\.(?=\d)[^\n.!?]*+)*+"
LEAST = 0.5
#: A title's line and the version on the next are one.
VERSION_LINE = r"(?i)\s*\n\s*(?=version\s+\d)"
#: A date behind a title's version, which says nothing of the licence.
DATED = r"(?i),?\s+\d{1,2}\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}"
#: A comment's or paragraph's line that goes on in the next, which begins in lower case.
WRAPPED = r"(?<![.!?:\s])[ \t]*\n[ \t]*(?:[#*/;%-]+[ \t]+)?(?=[a-z(])"
#: What says that a licence isn't given.
DENIED = r"(?i)\b(?:not|never|no longer|neither|without being|isn't|aren't|wasn't)\s+(?:\w+\s+){0,3}?(?:licen[sc]ed|released|distributed|available)\b"
#: Where a choice of licences has its next one.
CHOICE = r"\b(?:or|and)\s+(?=(?:under\s+)?(?:the\s+)?[A-Z])"
#: What only counts where nothing else is said.
LAST = "LicenseRef-Proprietary"
#: A file whose header has this share of its words, so many at least, and that as a whole is so like a template, stands for its directory.
MOSTLY, WORDS, WHOLE = 0.5, 60, 0.8
LICENCE_NAME = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[.\-_].*)?$"


def _terms(text: Column) -> Column:
    """Words and version numbers, and pairs of neighbours, which tell BY from BY-NC."""
    none = F.array().cast("array<string>")

    def both(w):
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
        return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(none))

    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|\d+(?:\.\d+)*"), F.lit(0))
    return let(F.transform(words, lambda w: F.regexp_replace(w, r"(?<=\d)(?:\.0)+$", "")), both)  # 2.0 is 2


def headers(files: DataFrame) -> DataFrame:
    """(path, said, whole, named) of the files that speak of a licence.

    said has the distinct sentences that do, as they stand, with wrapped lines
    joined, and their parts that name a choice; and the whole of a file that
    may stand for its directory, whose MD5 is whole. A sentence that denies a
    licence isn't among them.
    """
    text = F.regexp_replace(F.regexp_replace("text", VERSION_LINE, " "), DATED, "")
    sentences = lambda c: F.filter(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), lambda x: x.rlike(SPEAKS) & ~x.rlike(DENIED))
    spoken = F.concat(sentences(text), sentences(F.regexp_replace(text, WRAPPED, " ")))
    choices = let(spoken, lambda xs: F.concat(xs, F.flatten(F.transform(F.filter(xs, lambda x: x.rlike(CHOICE)), lambda x: F.split(x, CHOICE)))))
    said = F.transform(choices, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    words = lambda c: F.regexp_count(c, F.lit(r"\S+"))
    hint = let(F.lower("text"), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in STEMS]))
    speaking = files.where(F.col("text").isNotNull() & hint).where(F.col("text").rlike(SPEAKS)).withColumn("said", F.array_sort(F.array_distinct(F.filter(said, lambda x: x != ""))))
    held = words(F.array_join("said", "\n"))
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_NAME), F.lit(False))
    speaking = speaking.withColumns({"named": named, "mostly": (words(F.col("text")) >= WORDS) & (held >= MOSTLY * words(F.col("text")))}).where((F.size("said") > 0) | F.col("named"))
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    whole = F.when(F.col("named") | F.col("mostly"), flat)
    return speaking.withColumn("whole", whole).select("path", F.when(F.col("whole").isNotNull(), F.array_union("said", F.array("whole"))).otherwise(F.col("said")).alias("said"), F.md5("whole").alias("whole"), "named")


def matched(found: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(key, license, score): the best template of each distinct text said, of the least cosine at least; key is the text's MD5.

    Versions decide: the numbers of a template must all be in the text, and so
    must its `later`; a text that speaks of a later version isn't of one version
    only. Whole licence texts needn't have their numbers. IDF counts all that is said, repeated texts as often as they occur, and the
    templates. Ties go to the identifier first in order.
    """
    spark = found.sparkSession
    said = found.select(F.explode("said").alias("text")).groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    said = stage(said.select("key", "times", F.explode(_terms(F.col("text"))).alias("t")).groupBy("key", "times", "t").agg(F.count(F.lit(1)).alias("tf")))
    whole = {t for _, t in TEXTS}
    fixed = spark.createDataFrame([(i, s, t, t in whole) for i, (s, t) in enumerate(templates)], "i int, license string, template string, long boolean")
    fixed = fixed.withColumn("t", F.explode(_terms(F.col("template")))).groupBy("i", "license", "long", "t").agg(F.count(F.lit(1)).alias("tf"))
    docs = said.select("key", "times").distinct().agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()["n"] + len(templates)
    df = said.select("t", "times").unionByName(fixed.select("t", F.lit(1).cast("long").alias("times"))).groupBy("t").agg(F.sum("times").alias("df"))
    # Only terms of templates can match; the others count for the length alone.
    df = stage(df.select("t", (F.log(F.lit(1.0 + docs) / (1 + F.col("df"))) + 1).alias("idf")))
    weigh = lambda x: x.join(df, "t").withColumn("w", F.col("tf") * F.col("idf"))
    length = lambda x, k: x.groupBy(k).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("length"))
    a = stage(weigh(said).select("key", "t", F.col("w").alias("a")))
    decides = (~F.col("long") & F.col("t").rlike(r"^(?:\d+(?:\.\d+)*|later)$")).cast("int")
    b = stage(weigh(fixed).select("i", "license", "t", "w", decides.alias("decides")))
    per = b.groupBy("i").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("length"), F.sum("decides").alias("needs"))
    b = b.join(F.broadcast(per), "i").select("i", "license", "t", "decides", "needs", (F.col("w") / F.col("length")).alias("b"))
    score = a.join(F.broadcast(b), "t").groupBy("key", "i", "license", "needs").agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum("decides").alias("has"))  # the templates are a fixed table
    later = a.groupBy("key").agg(F.sqrt(F.sum(F.col("a") ** 2)).alias("length"), F.max(F.col("t").isin("later version", "or later").cast("int")).alias("later"))
    score = score.where(F.col("has") == F.col("needs")).join(later, "key").where((F.col("later") == 0) | ~F.col("license").endswith("-only")).select("key", "license", (F.col("dot") / F.col("length")).alias("score"))
    best = score.groupBy("key").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "license")).alias("m"))
    return best.select("key", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score")).where(F.col("score") >= LEAST)


def scan(files: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of files (path, text): the columns of also, path, license, licenses, score, origin, from_dir.

    origin is `header`, `licence file`, `inherited` or `none`. licenses has all
    that a file names, in order; license is that with the best score, ties to
    the identifier first in order, and a reservation of all rights only where
    nothing else is named. A directory has the best of its licence files: those
    with such a name, or whose whole text is a licence's. Null and empty texts
    have no header but may inherit; a null path inherits nothing. Equal paths
    are one file each; very long texts are read whole; an empty table has no
    rows. Columns that aren't in also aren't read, so none of them can clash.
    """
    whole = files.select(*also, "path", "text")
    found = stage(headers(whole).withColumn("header", F.md5(F.array_join("said", "\n"))))
    best = stage(matched(found))
    each = found.select("header", "said").dropDuplicates(["header"]).select("header", F.explode("said").alias("x")).select("header", F.md5("x").alias("key")).join(best, "key")
    order = F.struct((F.col("license") == LAST).alias("last"), (-F.col("score")).alias("s"), "license")
    per_header = each.groupBy("header").agg(F.min(order).alias("m"), F.array_sort(F.collect_set(F.when(F.col("license") != LAST, F.col("license")))).alias("all"))
    per_header = stage(per_header.select("header", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"), F.when(F.size("all") > 0, F.col("all")).otherwise(F.array("m.license")).alias("licenses")))
    like = best.where(F.col("score") >= WHOLE).select(F.col("key").alias("whole"), F.lit(True).alias("like"))
    own = spread_join(found.select("path", "header", "whole", "named"), per_header, ["header"]).join(like, "whole", "left")
    own = stage(own.select("path", "license", "score", "licenses", (F.col("named") | F.col("like").isNotNull()).alias("stands")))
    folder = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, r"/[^/]*$", "")).otherwise("")
    by_dir = own.where("stands AND path IS NOT NULL").groupBy(folder(F.col("path")).alias("dir")).agg(F.min(order).alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("licenses")))).alias("dir_licenses"))
    by_dir = stage(by_dir.select("dir", F.col("m.license").alias("dir_license"), (-F.col("m.s")).alias("dir_score"), "dir_licenses"))
    # Each distinct directory looks up its ancestors, itself first.
    dirs = whole.where("path IS NOT NULL").select(folder(F.col("path")).alias("at")).distinct()
    steps = F.split("at", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    near = dirs.select("at", F.posexplode(ups).alias("depth", "dir")).join(by_dir, "dir").groupBy("at").agg(F.max(F.struct("depth", "dir", "dir_license", "dir_score", "dir_licenses")).alias("m")).select("at", "m.dir", "m.dir_license", "m.dir_score", "m.dir_licenses")
    one = own.groupBy("path").agg(F.min(F.struct((F.col("license") == LAST).alias("last"), (-F.col("score")).alias("s"), "license", "stands", "licenses")).alias("m")).select("path", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"), F.col("m.stands").alias("stands"), F.col("m.licenses").alias("licenses"))
    rows = stage(same(whole.select(*also, "path", folder(F.col("path")).alias("at")), one, ["path"], "left"))
    rows = spread_join(rows, near, ["at"], how="left")
    origin = F.when(F.col("license").isNotNull() & F.col("stands"), "licence file").when(F.col("license").isNotNull(), "header").when(F.col("dir").isNotNull(), "inherited").otherwise("none")
    return rows.select(*also, "path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("licenses", "dir_licenses").alias("licenses"), F.coalesce("score", "dir_score").alias("score"), origin.alias("origin"), F.when(F.col("license").isNull(), F.col("dir")).alias("from_dir"))


def as_files(docs: DataFrame, per_dir: int = 20) -> DataFrame:
    """(doc_id, path, text): documents as files source/lang/group/doc_id, so many of each id range to a directory.

    A document without an id stands alone in a directory named by its text's
    hash, source/lang/none/hash/none.
    """
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    numbered = F.concat_ws("/", F.floor(F.col("doc_id") / per_dir).cast("string"), F.col("doc_id").cast("string"))
    alone = F.concat_ws("/", F.lit("none"), F.md5(F.coalesce("text", F.lit(""))), F.lit("none"))
    return docs.select("doc_id", F.concat_ws("/", unknown("source"), unknown("lang"), F.when(F.col("doc_id").isNull(), alone).otherwise(numbered)).alias("path"), "text")
