"""License scans (operator 6), DataFrame functions only: MinHash bands over overlapping windows, shingle containment.

Templates of S shingles are looked for in windows of S + spare(S) shingles, one every S // 4 + 1, so that a whole copy lies in some window, also
one with a line of up to 20 words put in its middle where the template has 40 shingles or more.
Windows and templates whose least hashes agree in all rows of a band meet; then the share of the template's
shingles in the window is counted exactly. With 16 bands of 2 rows a window of Jaccard similarity 0.55 to its template
(0.8 of the shingles in a window a quarter longer) meets it with probability 1 - (1 - 0.55^2)^16 = 0.997, a whole copy (0.8 or more) with 0.9999999, a
copy of similarity 0.44 (0.8 of the shingles in a window longer by half) with 0.97.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS, ROWS, SHINGLE = 16, 2, 5
#: Template shingles that one literal filter may hold; the templates must stay under it.
MAX_TEMPLATE_SHINGLES = 20_000

# Common license notices, headers and whole short licenses.
TEMPLATES = {
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
                   "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                           "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                           "permissions and limitations under the License.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
                  "documentation and/or other materials provided with the distribution.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
                      "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
                      "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
                      "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
                      "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
                      "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                       "software without specific prior written permission.",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                      "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                  "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
                    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
           "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
           "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
           "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
           "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                 "copyright notice and this permission notice appear in all copies.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
                   "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-terms": "Released under the terms of the MIT License.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
                "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
                "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
                "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
                "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
                "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
                "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
                "IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-CC-BY-4.0": "SPDX-License-Identifier: CC-BY-4.0",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
                 "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
            "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
            "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
            "the original software.",
}


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of all five-word shingles of a text, in order; words are lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"), "")
    return F.transform(
        F.array(words), lambda w: F.when(F.size(w) >= SHINGLE, F.transform(
            F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)),
            lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>")))[0]


def spare(shingles: int) -> int:
    """Shingles that a window holds beyond its template's: a quarter, for short templates up to 24 where that is no more than a half."""
    return max(shingles // 4, min(24, shingles // 2))


def _least(hashes: Column, seed: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(F.lit(seed), h)))


def _bands(hashes: Column) -> Column:
    return F.array(*(F.xxhash64(F.lit(b), *(_least(hashes, b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))


def load_templates(spark: SparkSession, templates: dict[str, str] | None = None) -> list[dict]:
    """Shingles and size class of each template, and the shingles that give a least hash. Templates have five words or more."""
    given = TEMPLATES if templates is None else templates
    if not given:
        return []
    t = spark.createDataFrame(sorted(given.items()), "license_id string, text string").select("license_id", F.array_distinct(shingle_hashes(F.col("text"))).alias("hashes"))

    def lead(seed: int) -> Column:
        return F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(F.lit(seed), h).alias("v"), h.alias("h"))))["h"]

    leads = F.array_distinct(F.array(*map(lead, range(BANDS * ROWS))))
    rows = [r.asDict() for r in t.withColumn("leads", F.when(F.size("hashes") > 0, leads)).withColumn("bands", _bands(F.col("hashes"))).collect()]
    if any(not r["hashes"] for r in rows):
        raise ValueError("a license template needs five words or more")
    if sum(len(r["hashes"]) for r in rows) > MAX_TEMPLATE_SHINGLES:
        raise ValueError(f"templates hold over {MAX_TEMPLATE_SHINGLES} shingles: scan with parts of them")
    return rows


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per document and template found: doc_id, license_id, containment, n_shingles (of the template), word_start, word_end.

    ``containment``: the most of a template's shingles in one window, at ``least`` or more; the words are those from the
    first to the last such shingle of the earliest best window. Null and short texts match nothing; rows that repeat a doc_id count as one document; a null doc_id is a
    document of its own; an empty table gives an empty result; other columns are not read.
    Only windows with a shingle that is the least of some template under some hash can share a band, so hashes of other
    windows are not computed: the filter is a literal list bounded by the templates.
    """
    spark = docs.sparkSession
    rows = load_templates(spark, templates)
    out_schema = "doc_id long, license_id string, containment double, n_shingles long, word_start long, word_end long"
    if not rows:
        return spark.createDataFrame([], out_schema)
    lead = sorted({h for r in rows for h in r["leads"]})
    sizes = sorted({len(r["hashes"]) for r in rows})
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(F.col("text")).alias("hs"))
    met = hashed.withColumn("at", F.filter(F.transform("hs", lambda h, i: F.when(h.isin(lead), i)), lambda i: i.isNotNull())).where(F.size("at") > 0)
    # windows (start, shingles) of each size class that hold a hit
    def windows_of(s: int) -> Column:
        step, wide = s // 4 + 1, s + spare(s)
        return F.flatten(F.transform("at", lambda p: F.transform(
            F.sequence(F.greatest(F.lit(0), F.ceil((p - (wide - 1)) / step).cast("int")), F.floor(p / step).cast("int")),
            lambda k: F.struct((k * step).alias("start"), F.lit(wide).alias("wide"), F.lit(s).alias("size")))))

    windows = (met.withColumn("w", F.explode(F.array_distinct(F.concat(*map(windows_of, sizes)))))
               .select("doc_id", "w.start", "w.size", F.slice("hs", F.col("w.start") + 1, F.col("w.wide")).alias("own")))
    keyed = windows.withColumn("band", F.explode(_bands(F.col("own"))))
    known = spark.createDataFrame([(r["license_id"], len(r["hashes"]), b) for r in rows for b in r["bands"]], "license_id string, size int, band long").distinct()
    # at most MAX_TEMPLATE_SHINGLES templates of BANDS bands
    cand = keyed.join(F.broadcast(known), ["size", "band"]).drop("band").dropDuplicates(["doc_id", "start", "size", "license_id", "own"])
    full = spark.createDataFrame([(r["license_id"], r["hashes"]) for r in rows], "license_id string, hashes array<bigint>")
    hits = F.filter(F.transform("own", lambda h, i: F.when(F.array_contains("hashes", h), i)), lambda i: i.isNotNull())
    found = (cand.join(F.broadcast(full), "license_id").withColumn("n", F.size(F.array_intersect("own", "hashes")))
             .withColumn("containment", F.col("n") / F.size("hashes")).where(F.col("containment") >= least).withColumn("hits", hits))
    best = found.groupBy("doc_id", "license_id").agg(F.min(F.struct(
        (-F.col("containment")).alias("c"), "start", F.size("hashes").cast("long").alias("n_shingles"),
        (F.col("start") + F.array_min("hits")).cast("long").alias("word_start"), (F.col("start") + F.array_max("hits") + SHINGLE).cast("long").alias("word_end"))).alias("b"))
    return best.select("doc_id", "license_id", (-F.col("b.c")).alias("containment"), "b.n_shingles", "b.word_start", "b.word_end")


def license_sql(templates: dict[str, str] | None = None, least: float = 0.8) -> str:
    """The DuckDB twin: containment in every window by counting, without bands."""
    given = TEMPLATES if templates is None else templates
    values = ", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in sorted(given.items()))
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT license_id, {words} AS w FROM (VALUES {values}) v(license_id, text)),
ts AS (SELECT DISTINCT license_id, list_slice(w, i, i + 4) AS g FROM t, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
tn AS (SELECT license_id, count(*) AS s FROM ts GROUP BY license_id),
d AS (SELECT doc_id, {words} AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS i, list_slice(w, i, i + 4) AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) WHERE len(w) >= 5),
h AS (SELECT p.doc_id, p.i, p.g, ts.license_id, tn.s, tn.s // 4 + 1 AS step, tn.s + greatest(tn.s // 4, least(24, tn.s // 2)) AS wide FROM p JOIN ts USING (g) JOIN tn USING (license_id)),
w AS (SELECT doc_id, license_id, s, i, g, k * step AS start
      FROM h, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((i - (wide - 1)) / step) AS BIGINT)), i // step + 1)) AS k)),
c AS (SELECT doc_id, license_id, s, start, count(DISTINCT g) / s AS containment, min(i) AS word_start, max(i) + 5 AS word_end FROM w GROUP BY doc_id, license_id, s, start HAVING count(DISTINCT g) / s >= {least}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license_id ORDER BY containment DESC, start) AS k FROM c)
SELECT doc_id, license_id, CAST(containment AS DOUBLE) AS containment, CAST(s AS BIGINT) AS n_shingles, CAST(word_start AS BIGINT) AS word_start, CAST(word_end AS BIGINT) AS word_end
FROM r WHERE k = 1"""
