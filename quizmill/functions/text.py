"""Column functions on strings and lists. All are built-in expressions; none runs Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What counts as white space at the ends of a text. Fixed values of the format.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def or_empty(c: Column, kind: str = "string") -> Column:
    """A null array as the empty one."""
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def ids_of(items: Column) -> Column:
    return or_empty(items["id"])


def repeated(c: Column) -> Column:
    """Whether an element occurs twice."""
    return F.size(F.array_distinct(c)) < F.size(c)


def repeats(c: Column) -> Column:
    """Each element after its first occurrence, in order. Only lists that do repeat something are gone through."""
    return F.when(~repeated(c), F.slice(c, 1, 0)).otherwise(F.filter(c, lambda x, i: F.array_position(F.slice(c, 1, i), x) > 0))


def unknown(refs: Column, known: Column) -> Column:
    """References that name nothing known, in order, repeats kept. Only lists that hold such are gone through."""
    return F.when(F.size(F.array_except(refs, known)) == 0, F.slice(refs, 1, 0)).otherwise(F.filter(refs, lambda r: ~F.array_contains(known, r)))


def some_unknown(refs: Column, known: Column) -> Column:
    """Whether ``unknown`` lists any."""
    return (F.size(F.array_except(refs, known)) > 0) & F.exists(refs, lambda r: ~F.array_contains(known, r))


def same_list(a: Column, b: Column) -> Column:
    """Equal as multisets."""
    return F.sort_array(a) == F.sort_array(b)


def same_selection(a: Column, b: Column) -> Column:
    """Equally long, and every element of a in b (so repeats in a count more than once)."""
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: F.array_contains(b, x))


def answer_letters(raw: Column) -> Column:
    """Option letters of an answer key, lower-cased, each once: those that stand alone, else a text of letters only."""
    # Fixed patterns of the format.
    alone = F.regexp_extract_all(F.upper(raw), F.lit(r"(?U)\b([A-H])\b"), F.lit(1))
    compact = F.regexp_replace(F.upper(raw), r"(?U)[\s,;/&+.-]", "")
    letters = F.when(F.size(alone) > 0, alone).when(compact.rlike("^[A-H]+$"), F.split(compact, "")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(letters, F.lower))


def plain_text(blocks: Column) -> Column:
    """Blocks as one text: images by id in brackets, table cells tab-separated."""
    def one(b: Column) -> Column:
        rows = F.array_join(F.transform(b["rows"], lambda r: F.array_join(r, "\t")), "\n")
        return F.when(b["kind"] == "image", F.concat(F.lit("[image "), b["asset_id"], F.lit("]"))).when(b["kind"] == "table", rows).otherwise(b["text"])

    return F.array_join(F.transform(blocks, one), "\n")
