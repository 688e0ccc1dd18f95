"""Licence scans: canonical digests of whole texts, and of their lines, hash-joined to those of known licences.

Whole texts have a second digest, of their body: without copyright statements (but with lines of the licence that happen
to start with the word), titles, list marks and holders' names, so that line breaks and headings don't decide.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_text

# Public licence texts and notices.
KNOWN = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        'The MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
}
# Equivalent spellings, replaced as whole words after punctuation has gone.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("copyright owner", "copyright holder"), ("and or", "and"))
COPYRIGHT_LINE = r"(?:^|\n)[ \t*#/;-]*(?:copyright[ \t]|\(c\)[ \t]|©)[^\n]*"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, every run of ASCII punctuation and white space one space, one spelling; trimmed.

    The slower replacements run only where a text holds what they look for.
    """
    out = F.lower(text)
    out = F.when(out.contains("copyright") | out.contains("(c)") | out.contains("©"), F.regexp_replace(out, COPYRIGHT_LINE, "\n")).otherwise(out)
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    found = F.rlike(out, F.lit(" (?:" + "|".join(one for one, _ in SPELLINGS) + ") "))
    respelt = out
    for one, other in SPELLINGS:
        respelt = F.replace(respelt, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(F.when(found, respelt).otherwise(out))


MARKS = r"[ \t*#/;!%-]*"
#: Real copyright statements: a sign, a year or a holder's name follows; not 'copyright notice' or 'copyright holders'.
SIGNED = r"(?:(?i:(?:portions[ \t]+)?copyright[ \t:]*(?:\(c\)|©|\d|[<\[{]))|(?i:\(c\)[ \t]*(?:copyright|\d|[<\[{]))|©)"
NAMED, RESERVED = r"(?:Copyright|COPYRIGHT)[ \t]+", r"(?i:all rights reserved)[ \t.\r]*"
NO_HOLDER = (
    r"(?i:notices?|holders?|owners?|licen[cs]es?|laws?|and|or|in|is|as|to|of|by|statements?|interests?|rights?|protection|disclaimers?|treaty|acts?|ownership|permissions?|status"
    r"|materials?|works?|information|infringement|with|for|on|that|which|shall|will|may|can|under|related)\b"
)
STATEMENT = rf"(?:^|\n){MARKS}(?:{SIGNED}|{NAMED}(?!{NO_HOLDER})[A-Z])[^\n]*|(?:^|\n){MARKS}{RESERVED}(?=\n|$)"
#: Titles in front of a body, in its canonical form.
TITLES = r"^ (?:(?:the )?(?:(?:mit|expat|mit expat|isc|zlib|zlib libpng|unlicense|(?:new |modified |simplified |revised )?bsd(?: [23] clause)?(?: new| revised| simplified| new or revised)?) license(?: (?:mit|expat|isc|zlib|bsd [23] clause|freebsd))?) )+"
# What differs between the usual forms of one text.
FORMS = (
    (r" neither the names? of .{1,200}? nor the names? of (?:its |any |their |other )*contributors ", " neither name nor contributors "),
    (r" (?:[1-4]|[abc]|i{1,3}) (redistributions? (?:of source|in binary)|neither name nor) ", " $1 "),
    (r" the (?:copyright holders?|regents|authors?) (and|or) contributors ", " the copyright holder $1 contributors "),
    (r" [1-3] (the origin|altered source|this notice) ", " $1 "),
    (" acknowledgement ", " acknowledgment "),
    (r" https(?= )", " http"),
    (" including the next paragraph ", " "),
    (r" (?:59 temple place|51 franklin st(?:reet)?|675 mass ave)[a-z0-9 ]{0,60}? usa ", " "),
)
TEXTS = Path(__file__).with_name("licence_texts")
TERMS_END = "END OF TERMS AND CONDITIONS"


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files in licence_texts; those with an appendix after their terms also without it."""
    found = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    return found + [(name, text[: text.index(TERMS_END) + len(TERMS_END)]) for name, text in found if TERMS_END in text]


def body(text: Column) -> Column:
    """The canonical text without what differs between copies of one licence: statements, titles, list marks, names."""
    out = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.regexp_replace(text, STATEMENT, "\n")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    for pattern, other in FORMS:
        out = F.regexp_replace(out, pattern, other)
    return F.trim(F.regexp_replace(F.regexp_replace(out, " +", " "), TITLES, " "))


def possible(low: Column, forms: list[str], words: int = 3) -> Column:
    """Whether a lower-cased text may have one of these canonical forms, or a line that has: it holds, for one of them,
    its longest words. Words that a replacement may have written count in their other spelling too, or not at all."""
    spelt = {other: one.split()[0] for one, other in SPELLINGS if " " not in other}
    written = {w for _, other in (*SPELLINGS, *FORMS) if other not in spelt for w in other.split()}
    picked = {tuple(sorted({w for w in form.split() if w not in written and w.isascii()}, key=lambda w: (-len(w), w))[:words]) for form in forms if form}
    found = F.lit(False)
    for chosen in sorted(picked):
        here = F.lit(True)
        for w in chosen:
            here = here & (low.contains(w) | low.contains(spelt[w]) if w in spelt else low.contains(w))
        found = found | here
    return found


def scan_licences(docs: DataFrame, known: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, digest (SHA-256 of the canonical text), licence (whose whole text it is, else null), line_licences.

    licence goes by the digest, else by that of the body, among the known texts and (without ``known``) ``full_texts``.
    line_licences: the sorted, comma-joined licences whose known text is one whole line ('' if none). Null texts are
    empty and match nothing; rows repeated as wholes come out once; extra columns are ignored; empty tables give no
    rows. The known licences, a table whose size the caller fixes, are all that is broadcast; their canonical forms are
    read by the driver. Bodies and lines are made only of texts that hold the words of a known one (see ``possible``).
    """
    spark = docs.sparkSession
    short = [(name, text) for name, texts in (KNOWN if known is None else known).items() for text in texts]
    entries = [(n, t, True) for n, t in short] + [(n, t, False) for n, t in (full_texts() if known is None else [])]
    forms = spark.createDataFrame(entries, "name string, text string, short boolean").select("name", "short", canonical(F.col("text")).alias("whole"), body(F.col("text")).alias("body")).collect()
    listed = spark.createDataFrame([(r.name, r.whole) for r in forms if r.short], "licence string, form string").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("licence").alias("licence"))
    bodies = spark.createDataFrame([(r.name, r.body) for r in forms if r.body], "by_body string, form string").groupBy(F.sha2("form", 256).alias("body")).agg(F.min("by_body").alias("by_body"))
    told = possible(F.col("low"), [r.whole for r in forms if r.short] + [r.body for r in forms])
    texts = ids_and_text(docs).select("doc_id", "text", F.lower("text").alias("low"))
    texts = texts.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("whole"), F.when(told, F.col("text")).alias("text"))
    lines = texts.select("doc_id", "whole", "text", F.sha2(body(F.col("text")), 256).alias("body")).join(F.broadcast(bodies), "body", "left")
    lines = lines.select("doc_id", "whole", "by_body", F.explode_outer(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", "whole", "by_body", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(F.broadcast(listed), "digest", "left")
    found = lines.groupBy("doc_id", "whole").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("line_licences"), F.min("by_body").alias("by_body"))
    found = found.withColumnRenamed("whole", "digest").join(F.broadcast(listed), "digest", "left")
    return found.select("doc_id", "digest", F.coalesce("licence", "by_body").alias("licence"), "line_licences")


def oracle_sql() -> str:
    """The same over the view documents, in DuckDB's SQL. Its patterns have no lookahead, so statements are told line by line."""
    split = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'"

    def respelt(x: str) -> str:
        for one, other in SPELLINGS:
            x = f"replace({x}, ' {one} ', ' {other} ')"
        return x

    def canon(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE.replace(chr(92) + 'n', chr(10)).replace(chr(92) + 't', chr(9))}', chr(10), 'g')"
        return "sha256(trim({}))".format(respelt(f"(' ' || regexp_replace({out}, {split}) || ' ')"))

    def bare(x: str) -> str:
        stated = f"regexp_matches(l, '^{MARKS}(?:{SIGNED}|{RESERVED}$)') OR (regexp_matches(l, '^{MARKS}{NAMED}[A-Z]') AND NOT regexp_matches(l, '^{MARKS}{NAMED}{NO_HOLDER}'))"
        kept = f"array_to_string([CASE WHEN {stated} THEN '' ELSE l END FOR l IN string_split({x}, chr(10))], chr(10))"
        out = respelt(f"(' ' || regexp_replace(lower({kept}), {split}) || ' ')")
        for pattern, other in FORMS:
            if pattern.endswith("(?= )"):  # twice, as neighbours share a space
                out = "replace(replace({0}, '{1} ', '{2} '), '{1} ', '{2} ')".format(out, pattern.removesuffix("(?= )"), other)
            else:
                out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern, other.replace("$", chr(92)))
        return f"trim(regexp_replace(regexp_replace({out}, ' +', ' ', 'g'), '{TITLES}', ' '))"

    def values(rows: list[tuple[str, str]]) -> str:
        return ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in rows)

    short = [(name, text) for name, texts in KNOWN.items() for text in texts]
    return f"""WITH listed AS (SELECT {canon('t')} AS digest, min(l) AS licence FROM (VALUES {values(short)}) AS k(l, t) GROUP BY 1),
    bodies AS (SELECT body, min(name) AS by_body FROM (SELECT name, {bare('t')} AS body FROM (VALUES {values(short + full_texts())}) AS k(name, t)) WHERE body <> '' GROUP BY 1),
    texts AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
    whole AS (SELECT doc_id, text, {canon('text')} AS digest, {bare('text')} AS body FROM texts),
    found AS (SELECT w.doc_id, w.digest, min(b.by_body) AS by_body FROM whole w LEFT JOIN bodies b USING (body) GROUP BY 1, 2),
    lines AS (SELECT doc_id, whole, {canon('line')} AS digest FROM (SELECT doc_id, digest AS whole, unnest(string_split(text, chr(10))) AS line FROM whole)),
    named AS (SELECT doc_id, whole, string_agg(licence, ',' ORDER BY licence) AS line_licences FROM (SELECT DISTINCT doc_id, whole, licence FROM lines JOIN listed USING (digest)) GROUP BY 1, 2)
    SELECT f.doc_id, f.digest, coalesce(l.licence, f.by_body) AS licence, coalesce(n.line_licences, '') AS line_licences
    FROM found f LEFT JOIN listed l USING (digest) LEFT JOIN named n ON n.doc_id IS NOT DISTINCT FROM f.doc_id AND n.whole = f.digest"""
