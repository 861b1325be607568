"""Licence scan: canonical forms of whole units of text, hash-joined to the digests of known licences."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.words import bind

# One-line notices and two bodies, by identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)

# Full texts as published, a file for each identifier.
TEXTS = Path(__file__).parent / "license_texts"

# Usual title lines of texts that do not hold one.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
# What may follow the terms of a full text and is often left out.
_APPENDIX = re.compile(r"(?m)^[ \t]*(?:END OF TERMS AND CONDITIONS|APPENDIX: How to apply|How to Apply These Terms)")


def full_texts() -> list[tuple[str, str]]:
    """(license_id, body) of full texts in their usual forms: with a title line, without the appendix, with bullets, under "All rights reserved"."""
    bodies = [(i, t) for i, t in NOTICES if i in ("MIT", "ISC") and len(t) > 300] + [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    out = []
    for name, body in bodies:
        forms = [body] + [body[: m.start()] for m in _APPENDIX.finditer(body)] + [body[: m.end()] for m in _APPENDIX.finditer(body) if m[0].strip().startswith("END")]
        if name == "ISC":
            forms.append(body.replace("modify, and/or distribute", "modify, and distribute"))
        if name.startswith("BSD"):
            forms.append(re.sub(r"(?m)^[1-3]\.", "*", body))
            forms += [f"All rights reserved.\n\n{x}" for x in forms]
        if name.startswith("GPL-3"):
            forms.append(body.replace("/licenses/why-not-lgpl", "/philosophy/why-not-lgpl"))
        out += [(name, x) for form in forms for x in (form, *(f"{title}\n\n{form}" for title in TITLES.get(name, ())))]
    return out


KNOWN_LICENSES = NOTICES + tuple(x for x in full_texts() if x not in NOTICES)

# Words that count as the same, canonical form second.
EQUIVALENT = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("https", "http"),
    ("v", "version"),
    ("ver", "version"),
)

# A line goes only if a sign, a year or a placeholder of one, or a holder follows; wrapped lines of a licence's own text begin with the bare
# word. Without look-ahead a holder is known by "by" or a company's suffix only.
_YEAR = r"[^\p{L}\p{N}\n]*(?:(?:19|20)[0-9][0-9]|[\[<{(](?:yyyy|year|date))"
_COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}©(\n]*(?:©|\(c\)[ \t]*(?:copyright|©)|\(c\)" + _YEAR + r"|(?:copyright|copr\.)(?:[^\p{L}\p{N}\n]*(?:©|\(c\)|&copy;)|" + _YEAR
    + r"|[ \t:]+by[ \t]|[ \t:]+[^\n]*[ ,](?:(?:19|20)[0-9][0-9]|inc|ltd|llc|corp|gmbh)\b))[^\n]*$"
)
_PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical_sql(text: str, replace_all: str) -> str:
    """SQL of the canonical form; ``replace_all`` is a format of text, pattern and replacement."""
    out = replace_all.format(f"lower({text})", _COPYRIGHT_LINE, " ")
    out = "concat(' ', " + replace_all.format(out, _PUNCTUATION, " ") + ", ' ')"
    for old, new in EQUIVALENT:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


def canonical(text: Column) -> Column:
    """Lower case; copyright lines gone; punctuation, white space and line breaks as one blank; equivalent spellings unified."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, _PUNCTUATION, " "), F.lit(" "))
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def known_digests(spark: SparkSession, licenses=KNOWN_LICENSES) -> DataFrame:
    """(license_id, digest) of the known texts, a fixed and small table."""
    rows = spark.createDataFrame(list(licenses), "license_id string, body string")
    return rows.select("license_id", F.sha2(canonical(F.col("body")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def weight(form: Column) -> Column:
    """Words of a canonical form, without those that an equivalent spelling may join to the next."""
    return F.size(F.filter(F.split(form, " "), lambda w: ~w.isin("", "sub", "non")))


def runs(parts: Column, known: DataFrame) -> Column:
    """Runs of two or more consecutive paragraphs, not of all, that begin like a known form (see ``canonical``) and have as many words.

    ``known`` is a fixed table of which the first three words and the numbers of words come to the driver. A paragraph is measured
    only in texts of which a line begins with the first word of a known form.
    """
    rows = known.select("form", weight(F.col("form")).alias("n")).where("form <> ''").collect()
    heads = [r["form"].split(" ")[:3] for r in rows]
    heads = sorted({" ".join(h[:n]) for h in heads for n in (1, 2, 3)})
    sizes = sorted({r["n"] for r in rows})
    first = {h.split(" ")[0] for h in heads}
    first |= {old.split(" ")[0] for old, new in EQUIVALENT if new.split(" ")[0] in first}
    none = F.array().cast("array<struct<kind: string, place: int, unit: string>>")
    if not rows:
        return none
    opens = F.exists(parts, lambda x: F.lower(x).rlike(r"(?m)^[^\p{L}\p{N}\n]*(?:" + "|".join(sorted(first)) + r")(?![\p{L}\p{N}])"))

    def measured(forms: Column) -> Column:
        n = F.size(forms)

        def found(total: Column) -> Column:
            begins = F.filter(F.sequence(F.lit(0), n - 2), lambda i: F.substring_index(F.get(forms, i), " ", 3).isin(heads))

            def of(i: Column) -> Column:
                beside = lambda j: F.exists(F.transform(forms, lambda x, k: (x != "") & ((k < i) | (k > j))), lambda x: x)
                ends = F.filter(F.sequence(i + 1, n - 1), lambda j: (F.get(total, j + 1) - F.get(total, i)).isin(sizes) & (F.get(forms, j) != "") & beside(j))
                return F.transform(ends, lambda j: F.struct(F.lit("run").alias("kind"), i.alias("place"), F.array_join(F.slice(parts, i + 1, j - i + 1), "\n\n").alias("unit")))

            return F.flatten(F.transform(begins, of))

        return bind(F.aggregate(forms, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + weight(x)))), found)

    return F.when((F.size(parts) > 1) & opens, bind(F.transform(parts, canonical), measured)).otherwise(none)


def units(text: Column, known: DataFrame) -> Column:
    """The whole text; its paragraphs (blank lines between) and its lines if there are several, with the line number of each line; runs of paragraphs."""
    text = F.coalesce(text, F.lit(""))

    def numbered(parts: Column, kind: str) -> Column:
        rows = F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), x.alias("unit")))
        return F.when(F.size(parts) > 1, rows).otherwise(F.slice(rows, 1, 0))

    whole = F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("place"), text.alias("unit")))
    paragraphs = F.split(text, "\n[ \t\r]*\n")
    return F.concat(whole, numbered(paragraphs, "paragraph"), numbered(F.split(text, "\n"), "line"), runs(paragraphs, known))


def license_matches(docs: DataFrame, licenses=KNOWN_LICENSES) -> DataFrame:
    """One row per unit that is entirely a known licence text or notice: doc_id, kind (text, paragraph, line, run), place (from 0), license_id.

    A run is two or more consecutive paragraphs but not all; its place is that of its first paragraph.

    Null, empty and unmatched texts give no row; repeated rows give their matches again. Further columns are ignored. The known
    digests are a fixed table of a few kilobytes (a row per text), so the join is a broadcast one without any shuffle of texts.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list(licenses), "license_id string, body string").select(canonical(F.col("body")).alias("form"))
    parts = docs.select("doc_id", F.explode(units(F.col("text"), known)).alias("_u")).select("doc_id", "_u.*")
    parts = parts.select("doc_id", "kind", "place", canonical(F.col("unit")).alias("_form")).where("_form <> ''")
    parts = parts.select("doc_id", "kind", "place", F.sha2("_form", 256).alias("digest"))
    return parts.join(F.broadcast(known_digests(spark, licenses)), "digest").select("doc_id", "kind", "place", "license_id")


def license_scan(docs: DataFrame, licenses=KNOWN_LICENSES) -> DataFrame:
    """One row per document and licence found: doc_id, license_id, whole_text, n_units, first_line.

    whole_text says that the whole document is the licence; n_units counts matching units; first_line is the least line number
    (from 0), null if no single line matched. Rows that repeat a doc_id, or have none, are counted together.
    """
    found = license_matches(docs, licenses)
    return found.groupBy("doc_id", "license_id").agg(
        F.max(F.col("kind") == "text").alias("whole_text"),
        F.count("*").alias("n_units"),
        F.min(F.when(F.col("kind") == "line", F.col("place"))).cast("long").alias("first_line"),
    )
