"""Licence scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

Everything on the main path is a DataFrame expression. Two kinds of units are compared: lines and whole texts, and windows
of as many words as a template has, wherever a text has one of the template's probes, so that notices inside a line or
wrapped over several are found, and full licence texts inside of longer ones. The size bound is used as an equality: for a
threshold d, only texts with between n * d / (2 - d) and n * (2 - d) / d distinct bigrams can reach d against a template of
n bigrams, so each template is listed once for each such size, and lines meet templates in a hash join on their size. Probes
are bigrams of which every text within the threshold has one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.storage import documents, materialize

#: Well-known short licence notices, and the bodies of three short licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "ISC (text)": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT (text)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause (text)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}
THRESHOLD = 0.85
#: Up to so many bytes of templates they are sent to all executors, and texts are tried for their probes first; results are the same beyond.
SMALL = 256 << 10


def normalised(text: Column) -> Column:
    """Lower-case words of letters and digits, joined by one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text; a single word stands for itself, an empty text has none."""
    words = F.split(text, " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(words) == 1, words).otherwise(F.array_distinct(pairs))


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(licence, text) rows."""
    return spark.createDataFrame(list((texts or TEMPLATES).items()), "licence string, text string")


def probes(grams: list[str], threshold: float) -> list[str]:
    """Bigrams of a template of which every text within the threshold has one: as many as such a text may miss, and one more; long ones."""
    n = len(grams)
    least = math.ceil(threshold * (n + math.ceil(n * threshold / (2 - threshold))) / 2 - 1e-9)
    return sorted(grams, key=lambda g: (-len(g), g))[: n - least + 1]


def _grammed(licences: DataFrame, threshold: float) -> DataFrame:
    """(licence, n_words, pairs, t_grams, probes): a template's bigrams in their order, each once, and its probes() as a column."""
    words = F.split("norm", " ")
    t = licences.select("licence", normalised(F.col("text")).alias("norm")).where(F.col("norm") != "").select("licence", F.size(words).alias("n_words"), F.when(F.size(words) > 1, _pairs(words)).alias("pairs"), bigrams(F.col("norm")).alias("t_grams"))
    n = F.size("t_grams")
    least = F.ceil(threshold * (n + F.ceil(n * threshold / (2 - threshold))) / 2 - 1e-9)
    ordered = F.array_sort(F.transform("t_grams", lambda g: F.struct((-F.length(g)).alias("n"), g.alias("g"))))
    return t.withColumn("probes", F.transform(F.slice(ordered, F.lit(1), (n - least + 1).cast("int")), lambda x: x["g"]))


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _tried(licences: DataFrame, threshold: float) -> Column | None:
    """Whether a normalised text (column norm) has a probe of any template; None if the templates are too many to try."""
    if (licences.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0) > SMALL:
        return None
    tried = sorted({p for row in _grammed(licences, threshold).select("probes").collect() for p in row[0]})
    return F.col("norm").rlike(probe_pattern(tried)) if tried else F.lit(False)


def probe_pattern(known: list[str]) -> str:
    """One pattern for whole bigrams in a normalised text, tried at starts of words only. Normalised words have no characters that a pattern reads otherwise."""
    by_first: dict[str, list[str]] = {}
    for p in sorted(known):
        first, _, rest = p.partition(" ")
        by_first.setdefault(first, []).append(f" {rest}" if rest else "")
    return "(?:^| )(?:" + "|".join(f"{w}(?:{'|'.join(rest)})" for w, rest in by_first.items()) + ")(?= |$)"


def match_templates(units: DataFrame, licences: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """All (unit, licence) with a Dice coefficient of threshold or more.

    units: any key columns and text; licences: (licence, text). Returns the key columns with licence and score. Null and
    empty texts match nothing. With up to SMALL bytes of templates, texts that have none of the probes of any are dropped
    before their bigrams are made; no match is lost by that. A template's sizes meet units before its bigrams do.
    """
    keys = [c for c in units.columns if c != "text"]
    t = _grammed(licences, threshold).select("licence", "t_grams")
    n = F.size("t_grams")
    sizes = t.select("licence", F.explode(F.sequence(F.ceil(n * threshold / (2 - threshold)).cast("int"), F.floor(n * (2 - threshold) / threshold).cast("int"))).alias("n_grams"))
    u = units.select(*keys, normalised(F.col("text")).alias("norm"))
    tried = _tried(licences, threshold)
    u = u.where(F.col("norm") != "" if tried is None else tried)
    if tried is not None:
        sizes, t = F.broadcast(sizes), F.broadcast(t)
    u = u.select(*keys, bigrams(F.col("norm")).alias("grams")).withColumn("n_grams", F.size("grams"))
    return u.join(sizes, "n_grams").join(t, "licence").withColumn("score", dice(F.col("grams"), F.col("t_grams"))).where(F.col("score") >= threshold).select(*keys, "licence", "score")


def dice(a: Column, b: Column) -> Column:
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def match_windows(texts: DataFrame, licences: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """texts: (key, norm), normalised, keys once each. (key, licence, start, score) of windows within the threshold: as many words as the template has, such that a probe stands where the template has it.

    Windows that would begin before the text begin with it, and those at its end are cut. Templates of one word have no windows.
    """
    words = F.split("norm", " ")
    t = _grammed(licences, threshold).where("n_words > 1")
    placed = t.select("licence", "n_words", "probes", F.posexplode("pairs").alias("offset", "gram")).where(F.array_contains("probes", F.col("gram"))).drop("probes")
    full = t.select("licence", "t_grams")
    tried = _tried(licences, threshold)
    if tried is not None:
        texts, placed, full = texts.where(tried), F.broadcast(placed), F.broadcast(full)
    hits = texts.where(F.instr("norm", " ") > 0).select("key", F.posexplode(_pairs(words)).alias("at", "gram")).join(placed, "gram")
    found = hits.select("key", "licence", "n_words", F.greatest(F.col("at") - F.col("offset"), F.lit(0)).alias("start")).distinct()
    window = F.array_distinct(_pairs(F.slice("words", F.col("start") + 1, F.col("n_words"))))
    cut = found.join(texts.select("key", words.alias("words")), "key").select("key", "licence", "start", window.alias("grams"))
    return cut.join(full, "licence").withColumn("score", dice(F.col("grams"), F.col("t_grams"))).where(F.col("score") >= threshold).select("key", "licence", "start", "score")


def license_scan(docs: DataFrame, licences: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Licences in each text: in its lines, as a whole, and in windows of words anywhere.

    Returns (id, n_lines, n_windows, licences, best), one row per input row: the lines that match some template (and one
    more if the whole text does), the starts of windows that do, the licences found (sorted, comma-joined) and the highest
    score (null without a match). Null texts, empty texts and empty template tables give no match. Ties between templates
    are all reported; equal texts are scanned once. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("key", F.sha2(F.col("t").cast("binary"), 256))
    lines = rows.select("key", F.posexplode(F.split("t", "\n")).alias("line", "text"))
    whole = rows.where(F.instr("t", "\n") > 0).select("key", F.lit(-1).alias("line"), F.col("t").alias("text"))
    found = match_templates(lines.unionByName(whole), licences, threshold=threshold).select("key", "licence", "score", "line", F.lit(None).cast("int").alias("start"))
    # Texts with a probe meet as one for each key before they are shuffled.
    texts = rows.select("key", normalised(F.col("t")).alias("norm"))
    windows = match_windows(distinct_texts(texts, licences, threshold), licences, threshold=threshold).select("key", "licence", "score", F.lit(None).cast("int").alias("line"), "start")
    by_key = found.unionByName(windows).groupBy("key").agg(F.count_distinct("line").alias("n_lines"), F.count_distinct("start").alias("n_windows"), F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"), F.max("score").alias("best"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("id", "key").join(by_key, "key", "left").select("id", n("n_lines"), n("n_windows"), F.coalesce("licences", F.lit("")).alias("licences"), "best")


def distinct_texts(texts: DataFrame, licences: DataFrame, threshold: float) -> DataFrame:
    """One row a key of texts (key, norm), in the shared folder; of up to SMALL bytes of templates only of texts that have a probe."""
    tried = _tried(licences, threshold)
    texts = texts if tried is None else texts.where(tried)
    return materialize(texts.groupBy("key").agg(F.first("norm").alias("norm")), "licence-texts")


def op10_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in every document; see license_scan() for nulls, ties and repeated rows."""
    found = license_scan(documents(spark, sf_dir), templates(spark))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_windows", "licences", F.round("best", 9).alias("best"))


def _placed_probes() -> list[tuple[str, int, str, int]]:
    """(licence, words, probe, place) of the templates, for the SQL."""
    out = []
    for name, text in TEMPLATES.items():
        w = " ".join(re.findall(r"[^\W_]+", text.lower())).split(" ")
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        out += [(name, len(w), p, k) for p in probes(list(dict.fromkeys(pairs)), THRESHOLD) for k, g in enumerate(pairs) if g == p]
    return out


ORACLE = (
    r"""
WITH l(licence, text) AS (VALUES """
    + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    + r"""), pb(licence, n_words, gram, k) AS (VALUES """
    + ", ".join(f"('{a}', {n}, '{g}', {k})" for a, n, g, k in _placed_probes())
    + r"""), d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), u AS (
  SELECT r, unnest(generate_series(0, len(string_split(t, chr(10))) - 1)) AS line, unnest(string_split(t, chr(10))) AS text FROM d
  UNION ALL SELECT r, -1, t FROM d WHERE contains(t, chr(10))
), n AS (SELECT r, line, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM u
), w AS (SELECT r, line, string_split(norm, ' ') AS w FROM n WHERE norm <> ''
), g AS (SELECT r, line, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w
), tw AS (SELECT licence, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM l
), tg AS (SELECT licence, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS tg FROM tw
), m AS (SELECT r, line, NULL AS start, licence, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS score FROM g JOIN tg ON len(g) >= len(tg) * 0.85 / 1.15 - 1e-6 AND len(g) <= len(tg) * 1.15 / 0.85 + 1e-6
), dw AS (SELECT r, string_split(trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM d
), gr AS (SELECT r, i, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT r, w, unnest(generate_series(1, len(w) - 1)) AS i FROM dw)
), ca AS (SELECT DISTINCT r, licence, n_words, greatest(i - 1 - k, 0) AS start FROM gr JOIN pb USING (gram)
), cw AS (SELECT r, licence, start, w[start + 1:start + n_words] AS w FROM ca JOIN dw USING (r)
), cg AS (SELECT r, licence, start, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM cw
), a AS (SELECT * FROM m UNION ALL SELECT r, NULL, start, licence, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) FROM cg JOIN tg USING (licence)
), f AS (SELECT r, count(DISTINCT line) AS n_lines, count(DISTINCT start) AS n_windows, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, max(score) AS best FROM a WHERE score >= 0.85 GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_windows, 0) AS n_windows, coalesce(licences, '') AS licences, round(best, 9) AS best FROM d LEFT JOIN f USING (r)
"""
)
