"""Quality rules: a table of thresholds compiled into one projection of built-in expressions over each whole text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D. Symbols that prose seldom has. Fixed values.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Common words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "au avec dans de des du elle en est et la le les par pas pour que qui sur un une "
    "auf das dem den der des die ein eine ist mit nicht sich und von zu "
    "como con del el es las los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures in percent, and the bounds it must keep; a ratio to nothing keeps any bound."""

    name: str
    part: str
    whole: str
    at_least: int | None = None
    at_most: int | None = None

    def broken(self) -> str:
        """The rule as a condition in SQL, on whole numbers only, so that no rounding decides."""
        sides = [f"100 * {self.part} < {self.at_least} * {self.whole}"] * (self.at_least is not None)
        sides += [f"100 * {self.part} > {self.at_most} * {self.whole}"] * (self.at_most is not None)
        return "(" + " or ".join(sides or ["false"]) + ")"


#: Rules by which a text fails at once, in every table. ``one`` is the number 1: bounds on a plain count.
BASE = (Rule("short", "n_words", "one", at_least=5000), Rule("repeats_itself", "n_repeat_words", "n_words", at_most=50))
#: The rest of the table; each bound lies outside what the texts labelled good on sf0.1 hold (README).
RULES = (
    Rule("word_length", "word_chars", "n_words", at_least=300, at_most=1000),
    Rule("symbols", "n_symbols", "n_words", at_most=10),
    Rule("stop_words", "n_stop_words", "n_words", at_least=6),
    Rule("repeated_lines", "n_dup_lines", "n_lines", at_most=40),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often, and inside whatever loop, the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def _spellings(words: Sequence[str]) -> list[str]:
    return sorted({s for w in words for s in (w, w.capitalize(), w.upper())})


def repeated_words(words: Column, n: Column, width: int = 3) -> Column:
    """How many words stand in a window of ``width`` words that the text holds twice or more.

    Windows are sorted with their places, equal neighbours found, and the places' gaps (``width`` at most) added up.
    """
    windows = F.transform(
        F.sequence(F.lit(0), n - width),
        lambda i: F.struct(F.concat_ws(" ", *(F.get(words, i + k) for k in range(width))).alias("window"), i.alias("at")),
    )
    twice = lambda s: F.transform(
        F.filter(s, lambda x, j: (x["window"] == F.get(s, j - 1)["window"]) | (x["window"] == F.get(s, j + 1)["window"])), lambda x: x["at"]
    )
    covered = lambda at: F.aggregate(
        F.transform(at, lambda a, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - a, F.lit(width)))), F.lit(0), lambda total, x: total + x
    )
    return F.when(n < width, 0).otherwise(let(F.sort_array(windows), lambda s: let(F.sort_array(twice(s)), covered)))


def measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """A struct of MEASURES of a text, null counting as empty: words, their code points, symbols, words of the stop list
    (in lower case, capitalised or in capitals), lines with a word, such lines equal to an earlier one, and words in
    windows of three that the text repeats."""
    text = F.coalesce(text, F.lit(""))
    kept = lambda text, out: F.char_length(F.translate(text, out, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: kept(x, SPACE) > 0)
    lists = F.struct(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("words"), lines.alias("lines"))

    def measured(x: Column) -> Column:
        words, found = x["words"], x["lines"]
        n = F.size(words)
        values = (
            n, kept(text, SPACE), F.char_length(text) - kept(text, SYMBOLS), F.size(F.filter(words, lambda w: w.isin(_spellings(stop_words)))),
            F.size(found), F.size(found) - F.size(F.array_distinct(found)), repeated_words(words, n),
        )
        return F.struct(*(v.cast("long").alias(m) for v, m in zip(values, MEASURES, strict=True)))

    return let(lists, measured)


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """doc_id, the MEASURES, base_failed, failed (names of the broken rules, base first) and kept (none is broken).

    One projection and no shuffle. Null and empty texts are short texts; a text of any length is read whole; rows with
    a null or repeated doc_id come out as they came in; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measures(F.col("text"), stop_words).alias("m"))
    measured = rows.select("doc_id", "m.*", F.lit(1).alias("one"))
    broken = lambda table: F.filter(F.array(*(F.when(F.expr(r.broken()), F.lit(r.name)) for r in table)), lambda x: x.isNotNull())
    at_once = F.size(broken(base)) > 0 if base else F.lit(False)
    failed = broken([*base, *rules]) if base or rules else F.array().cast("array<string>")
    return measured.select("doc_id", *MEASURES, at_once.alias("base_failed"), failed.alias("failed")).withColumn("kept", F.size("failed") == 0)


def oracle_sql() -> str:
    """The query over documents as DuckDB SQL; rules become the same conditions."""
    names = ", ".join(f"'{w}'" for w in _spellings(STOP_WORDS))
    gone = "replace(" * len(SPACE) + "{}" + "".join(f", chr({ord(c)}), '')" for c in SPACE)
    plain = "replace(" * len(SYMBOLS) + "t" + "".join(f", '{c}', '')" for c in SYMBOLS)
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, {words} AS w, list_filter(string_split(t, chr(10)), lambda x: length({gone.format("x")}) > 0) AS l FROM d),
    one AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
    win AS (SELECT r, i, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS g FROM one WINDOW s AS (PARTITION BY r ORDER BY i)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
    m AS (
        SELECT doc_id, len(w) AS n_words, length({gone.format("t")}) AS word_chars, length(t) - length({plain}) AS n_symbols,
            len(list_filter(w, lambda x: x IN ({names}))) AS n_stop_words, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
            coalesce(n, 0) AS n_repeat_words, 1 AS one
        FROM w LEFT JOIN rep USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(r.broken() for r in BASE)} AS base_failed,
        concat_ws(',', {", ".join(f"CASE WHEN {r.broken()} THEN '{r.name}' END" for r in (*BASE, *RULES))}) AS failed,
        NOT ({" OR ".join(r.broken() for r in (*BASE, *RULES))}) AS kept
    FROM m"""
