"""License scans by canonical digest lookup.

A text is normalised to a canonical form: lower case, equivalent spellings joined, copyright lines dropped, every run of other
characters than letters and digits a space. The digest of the entire canonical text is then hash-joined to those of
known licences. Looked up are each whole document, each of its paragraphs (parted by blank lines), and each of its lines, so a
notice on lines of its own inside a document is found as well as a file that is a licence. Everything runs as built-in
column expressions; the known digests are few, and are sent to every executor while they are at most BROADCAST_ROWS.

Defined results: rows of a null doc_id can't be named and are left out; null and empty texts, and texts of copyright lines
alone, match nothing. One row per doc_id, scope and licence, with the number of matching parts; repeated rows of
a doc_id add up. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000

#: (spelling, canonical spelling), applied in order to text in which only letters, digits and single spaces are left.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"),
    ("copyright holder", "copyright owner"), ("https", "http"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
    ("organisation", "organization"),
)
#: A line that states a copyright, with its mark or year, or reserves all rights; a short one that begins with the word alone, and what
#: such a line of a licence's own text holds and one of names doesn't; what stands between words; the first word; breaks of lines and of paragraphs.
COPYRIGHT = r"^[ #*/;>.-]*(copyright|\(c\)|©).*(\(c\)|©|[0-9][0-9][0-9][0-9])|^[ #*/;>.-]*all rights reserved[. ]*$"
NAMED, NOT_NAMES = r"^[ #*/;>.-]*(?:copyright|\(c\)|©):? +[^ ]+(?: +[^ ]+){0,5} *$", r"(notice|holder|owner|licen[cs]e|statement|interest|treat| rights|material|protect|infring|disclaim| in | of | or | to | is | on | that | this | by | for | as |law)"
MARKS, FIRST, LINES, BLANK = r"[^\p{L}\p{N}]+", r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", r"\r?\n|\r", r"\n[ \t]*\n[ \t\n]*"

_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC = '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n'
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
_NAMES = {"MIT": ("MIT",), "Apache-2.0": ("Apache", "2.0"), "GPL-3.0": ("GNU General Public", "3"), "GPL-2.0": ("GNU General Public", "2"), "LGPL-2.1": ("GNU Lesser General Public", "2.1"), "LGPL-3.0": ("GNU Lesser General Public", "3"), "AGPL-3.0": ("GNU Affero General Public", "3"), "MPL-2.0": ("Mozilla Public", "2.0")}
_CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_CC_WORDS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial"}
#: Titles of licences that _NAMES hasn't.
_TITLES = {"ISC": "ISC License", "0BSD": "Zero-Clause BSD", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Unlicense": "The Unlicense"}
_STARTS = ("Released under", "Licensed under", "This work is licensed under", "Distributed under", "This software is released under")
#: Entire texts, a file each, named by licence.
_TEXTS = Path(__file__).parent / "known_licenses"
#: The end of the terms, behind which stands how to apply them; the line of an unfilled copyright there.
_END, _UNFILLED = r"(?m)^\s*END OF TERMS AND CONDITIONS\s*$", r"(?m)^\s*Copyright \[yyyy\].*\n"


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the licences in ``known_licenses``: as they are, without the copyright line to be filled in, and without what follows the terms."""
    out = []
    for path in sorted(_TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        forms = [text, re.sub(_UNFILLED, "", text)]
        if end := re.search(_END, text):
            forms += [text[: end.start()], text[: end.end()]]
        out += [(path.stem, form) for form in dict.fromkeys(forms)]
    return out


def cc_names(kind: str, version: str) -> list[str]:
    """The names in words of a CC licence."""
    names = []
    for derivatives in ("NoDerivatives", "NoDerivs"):
        name = "Creative Commons " + "-".join((_CC_WORDS | {"ND": derivatives})[x] for x in kind.split("-")) + f" {version}"
        names += [name, name + (" International" if version == "4.0" else " Unported")]
    return list(dict.fromkeys(names))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of full licences and of the usual one-line notices."""
    out = [("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("ISC", _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC)]
    out += [("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"), ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>")]
    out += [("0BSD", _GRANT + "." + _ISC), ("BSD-2-Clause", _BSD + _AS_IS)]
    out.append(("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _AS_IS))
    bare = [(name, text) for name, text in out if name not in ("MIT", "Unlicense")]
    out += [(name, "All rights reserved.\n\n" + text) for name, text in bare]
    out += [(name, f"{_TITLES[name]}\n\n{reserved}{text}") for name, text in bare for reserved in ("", "All rights reserved.\n\n")]
    out += whole_texts()
    for name, title in _TITLES.items():
        out += [(name, title), *((name, f"{start} {the}{title}.") for start in _STARTS for the in ("", "the ")), (name, f"SPDX-License-Identifier: {name}")]
    out += [("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"), *(("CC0-1.0", f"{start} {x}.") for start in _STARTS for x in ("CC0 1.0", "CC0 1.0 Universal"))]
    for name, (title, *version) in _NAMES.items():
        forms = [f"{title} License"]
        for v in [*version, *(f"{x}.0" for x in version if "." not in x)]:
            forms += [f"{title} License, Version {v}", f"{title} License Version {v}", f"{title} License v{v}", f"{title} License {v}"]
        for form in forms[1:] or forms:
            out += [(name, f"{start} {the}{form}.") for start in _STARTS for the in ("", "the ")]
            out.append((name, form))
        out += [(name, f"SPDX-License-Identifier: {name}{which}") for which in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    for kind in _CC:
        for version in ("3.0", "4.0"):
            out += [(f"CC-{kind}-{version}", f"{start} CC {kind} {version}.") for start in ("Released under", "Licensed under", "This work is licensed under", "Distributed under")]
            out.append((f"CC-{kind}-{version}", f"SPDX-License-Identifier: CC-{kind}-{version}"))
            for x in cc_names(kind, version):
                out += [(f"CC-{kind}-{version}", form) for form in (x, f"{x} License", *(f"{start} {the}{x}{end}." for start in _STARTS for the in ("", "a ", "the ") for end in ("", " License", " Public License")))]
    return out


def canonical(text: str) -> str:
    """The canonical form, in Python; ``_canonical`` is the same for a part of a text without its copyright lines."""
    lines = [x for x in re.split(LINES, text.lower()) if not re.search(COPYRIGHT, x) and (not re.search(NAMED, x) or re.search(NOT_NAMES, x))]
    t = " ".join("".join(c if c.isalpha() or c.isnumeric() else " " for c in "\n".join(lines)).split())
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return t


def digest(text: str) -> str:
    return hashlib.md5(canonical(text).encode()).hexdigest()  # noqa: S324 - a lookup key


def spellings_of(word: str) -> set[str]:
    """The first words that a text may have whose canonical form begins with ``word``."""
    found = {word}
    for a, b in reversed(SPELLINGS):
        found |= {w.replace(b, a) for w in found if b in w}
        found |= {a.split()[0] for w in found if " " in a and w.startswith(b)}
    return {w.split()[0] for w in found}


def known(texts: list[tuple[str, str]] | None = None) -> list[tuple[str, str, int, str]]:
    """(digest, licence, size and first word of the canonical form), each digest once; of two licences the first by name."""
    out: dict[str, tuple[str, int, str]] = {}
    for name, text in sorted(known_texts() if texts is None else texts):
        if form := canonical(text):
            out.setdefault(digest(text), (name, len(form), form.split()[0]))
    return [(d, *rest) for d, rest in sorted(out.items())]


def _canonical(part):
    t = F.trim(F.regexp_replace(part, MARKS, " "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def scan(docs: DataFrame, licences: list[tuple[str, str, int, str]] | DataFrame | None = None) -> DataFrame:
    """(doc_id, scope, license, parts); ``licences``: (digest, license, size, first) rows or table, as ``known`` gives.

    Parts that don't begin with the first word of a known text, in any spelling, or have another size than every known
    text can't match, and aren't digested.
    """
    spark = docs.sparkSession
    if isinstance(licences, DataFrame):
        few = licences.count() <= BROADCAST_ROWS
        table = F.broadcast(licences) if few else licences
        sizes, words = ([r[0] for r in licences.select(c).distinct().collect()] for c in ("size", "first")) if few else (None, None)
    else:
        rows = known() if licences is None else licences
        table = F.broadcast(spark.createDataFrame(rows, "digest string, license string, size int, first string"))
        sizes, words = sorted({r[2] for r in rows}), sorted({r[3] for r in rows})
    firsts = None if words is None else sorted(set().union({""}, *(spellings_of(w) for w in words)))
    lines = F.filter(F.split(F.lower(F.col("text")), LINES), lambda x: ~x.rlike(COPYRIGHT) & (~x.rlike(NAMED) | x.rlike(NOT_NAMES)))
    form = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.array_join(lines, "\n").alias("t"))

    def hashes(parts, scope):
        if firsts is None:  # too many are known to tell by these
            fit = F.filter(F.transform(parts, _canonical), lambda p: p != "")
        else:
            fit = F.filter(parts, lambda p: (F.regexp_extract(p, FIRST, 1) != "") & F.regexp_extract(p, FIRST, 1).isin(firsts))
            fit = F.filter(F.transform(fit, _canonical), lambda p: F.length(p).isin(sizes or [-1]))
        return F.transform(fit, lambda p: F.struct(F.lit(scope).alias("scope"), F.md5(p).alias("digest")))

    every = F.concat(hashes(F.array("t"), "document"), hashes(F.split("t", BLANK), "paragraph"), hashes(F.split("t", "\n"), "line"))
    parts = form.select("doc_id", F.explode(every).alias("part")).select("doc_id", "part.scope", "part.digest")
    found = parts.join(table.select("digest", "license"), "digest")
    return found.groupBy("doc_id", "scope", "license").agg(F.count(F.lit(1)).alias("parts"))


def sql(docs: str = "documents") -> str:
    """DuckDB SQL of ``scan`` with the known licences."""
    t = f"trim(regexp_replace(p, '{MARKS}', ' ', 'g'))"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    values = ", ".join(f"('{d}', '{name}')" for d, name, *_ in known())
    return f"""
WITH form AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '{LINES}'), lambda x: NOT regexp_matches(x, '{COPYRIGHT}') AND (NOT regexp_matches(x, '{NAMED}') OR regexp_matches(x, '{NOT_NAMES}'))), chr(10)) AS t
  FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
parts AS (SELECT doc_id, 'document' AS scope, t AS p FROM form
  UNION ALL SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(t, '{BLANK}')) FROM form
  UNION ALL SELECT doc_id, 'line', unnest(string_split(t, chr(10))) FROM form),
canon AS (SELECT doc_id, scope, {t} AS c FROM parts),
known(digest, license) AS (VALUES {values})
SELECT doc_id, scope, license, count(*) AS parts FROM canon JOIN known ON md5(c) = digest WHERE c <> '' GROUP BY ALL
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
