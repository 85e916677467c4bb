"""Text functions as column expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_tokens(text: Column) -> Column:
    """Four characters to a token; null and empty text have none."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dot_leaders(text: Column) -> Column:
    """Leaders of a printed table of contents become a colon."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def physical_index(tag: Column) -> Column:
    """The number in <physical_index_N>, physical_index_N or N; null for anything else."""
    return F.coalesce(F.regexp_extract(tag, r"^<?physical_index_.*?(\d+)\s*>*$", 1).try_cast("int"), tag.try_cast("int"))


def first_tag(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"<start_index_(\d+)>", 1).try_cast("int"), F.lit(-1))


def last_tag(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"<start_index_(\d+)>"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("int"), F.lit(-1))


def without_first_section(text: Column) -> Column:
    """The text without its first tagged page section."""
    hit = F.regexp_extract(text, r"(?s)<start_index_\d+>.*?<end_index_\d+>", 0)
    at = F.call_function("instr", text, hit)
    return F.when(hit == "", text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(hit), F.length(text))))


def unfence(text: Column) -> Column:
    """What stands in a JSON fence, or the text itself."""
    body = F.regexp_extract(text, r"(?s)```json(.*)```", 1)
    return strip(F.when(F.contains(text, F.lit("```json")), body).otherwise(text))


def repaired_json(text: Column) -> Column:
    """Tolerant JSON: without fence, None as null, on one line, without trailing commas."""
    flat = collapse(F.regexp_replace(F.replace(unfence(text), F.lit("None"), F.lit("null")), r"[\r\n]+", " "))
    return F.regexp_replace(flat, r",\s*([\]}])", "$1")


def object_slice(text: Column) -> Column:
    """From the first brace to the last."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def shortened(text: Column, n: int, marker: str = "...") -> Column:
    """The first n characters and a marker, if there are more."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(marker))).otherwise(text)


def padded(number: Column, width: int = 4) -> Column:
    """Zero-padded without cutting longer numbers."""
    digits = number.cast("string")
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(name: Column, by: str = "-") -> Column:
    return F.replace(name, F.lit("/"), F.lit(by))


def normalised(text: Column) -> Column:
    """Lower case without white space, for fuzzy title matching."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def paragraphs(text: Column) -> Column:
    """Split at blank lines, trimmed, without empties; single newlines if that leaves one at most."""

    def pieces(by: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), by), lambda p: strip(p)), lambda p: p != "")

    blank = pieces("\n\n")
    return F.when(F.size(blank) > 1, blank).otherwise(pieces("\n"))


def indexed_paragraphs(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda p, i: F.concat(F.lit("[Paragraph "), i.cast("string"), F.lit("]\n"), p, F.lit("\n"))), "\n")


def ordered_join(order: Column, text: Column, sep: str) -> Column:
    """Aggregate: texts joined in the order of a column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), sep)


def vertical_place(y_min: Column, y_max: Column) -> Column:
    """top, middle or bottom by the centre of a box in percent of the page; middle without a box."""
    centre = (y_min + y_max) / 2
    return F.when(centre < 33, "top").when(centre > 67, "bottom").otherwise("middle")


def crop(percent: Column, size: Column) -> Column:
    return F.floor(percent * size / 100).cast("int")


def sentences(text: Column, n: int = 2) -> Column:
    """The first n sentences."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.trim(F.array_join(F.slice(found, 1, n), ""))
