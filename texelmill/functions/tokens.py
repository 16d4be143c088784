"""List-valued text columns, fixed-width strings and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(csv: Column) -> Column:
    """Comma list to array: trimmed, empty entries dropped, null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda t: t != "")


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, ", ")


def last_segment(entry: Column) -> Column:
    return F.substring_index(F.replace(entry, F.lit("/"), F.lit("\\")), "\\", -1)


def sibling_entry(entry: Column, new_last: Column) -> Column:
    """Same parent, new last segment, back-slashes throughout."""
    parts = F.split(F.replace(entry, F.lit("/"), F.lit("\\")), r"\\")
    return F.array_join(F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(new_last)), "\\")


def replace_tokens(tokens: Column, targets: Column, new: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(F.array_contains(targets, t), new).otherwise(t))


def replace_entries(entries: Column, targets: Column, new_last: Column) -> Column:
    hit = lambda t: F.array_contains(targets, last_segment(t))
    return F.transform(entries, lambda t: F.when(hit(t), sibling_entry(t, new_last)).otherwise(t))


def prepend_entries(entries: Column, targets: Column, new_last: Column) -> Column:
    """Insert the new sibling before each match, unless the entry before the match already is that sibling."""

    def grow(t: Column, i: Column) -> Column:
        made = sibling_entry(t, new_last)
        before = F.when(i > 0, F.element_at(entries, F.greatest(i, F.lit(1))))
        wanted = F.array_contains(targets, last_segment(t)) & ~F.coalesce(before == made, F.lit(False))
        return F.when(wanted, F.array(made, t)).otherwise(F.array(t))

    return F.flatten(F.transform(entries, grow))


def parse_sizes(csv: Column, lowest: int = 1, highest: int = 16384) -> Column:
    """``1024;2048, x`` to a sorted array of distinct sizes in range."""
    tokens = F.transform(F.split(F.replace(F.coalesce(csv, F.lit("")), F.lit(";"), F.lit(",")), ","), lambda t: F.trim(t))
    digits = F.filter(tokens, lambda t: t.rlike("^[0-9]{1,18}$"))
    numbers = F.transform(digits, lambda t: t.cast("bigint"))
    kept = F.filter(numbers, lambda n: n.between(lowest, highest))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda n: n.cast("int"))))


def parse_terms(raw: Column, default: Column | None = None) -> Column:
    """Comma or newline list, trimmed, ordered and distinct; ``default`` when nothing is left."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), "[,\r\n]+"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    terms = F.array_distinct(F.filter(parts, lambda t: t != ""))
    if default is None:
        return terms
    return F.when(F.size(terms) > 0, terms).otherwise(F.filter(F.array(default), lambda t: t != ""))


def replace_terms(text: Column, terms: Column, new: Column) -> Column:
    """Apply the terms in order; each works on the result of the one before."""
    return F.aggregate(terms, text, lambda acc, t: F.replace(acc, t, new))


def fits_and_changes(old: Column, new: Column, size: Column) -> Column:
    return (new != old) & (F.octet_length(new) <= size)


def nul_padded(text: Column, size: Column) -> Column:
    """UTF-8 bytes of ``text`` filled with NUL up to ``size`` bytes."""
    return F.rpad(F.encode(text, "UTF-8"), size, F.unhex(F.lit("00")))


def range_text(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
