"""Scalar text and vector expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


NFC_ROWS = 256


@F.arrow_udf(T.StringType())
def nfc_texts(text: pa.Array) -> pa.Array:
    """Unicode NFC. Of a batch only ``NFC_ROWS`` texts at a time are Python objects, the rest stays in Arrow."""

    def normal(part: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in part.to_pylist()], part.type)

    return pa.concat_arrays([normal(text.slice(at, NFC_ROWS)) for at in range(0, max(len(text), 1), NFC_ROWS)])


def nfc(text: Column) -> Column:
    """Unicode NFC; Spark has no built-in for it. Texts of characters below U+0300 are in that form and do not go to Python."""
    return F.coalesce(nfc_texts(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    """The first balanced ``{...}`` of a text, quotes respected; the text itself when there is none."""

    def cut(t: str | None) -> str | None:
        start = -1 if t is None else t.find("{")
        if start < 0:
            return t
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(t)):
            ch = t[i]
            if quoted:
                escaped, quoted = (ch == "\\" and not escaped), not (ch == '"' and not escaped)
            elif ch == '"':
                quoted = True
            elif ch == "{":
                depth += 1
            elif ch == "}":
                depth -= 1
                if depth == 0:
                    return t[start : i + 1]
        return t[start:]

    return text.map(cut)


def strip(text: Column) -> Column:
    """Trim all white space, line breaks included."""
    return F.btrim(text, F.lit(" \t\n\u000b\f\r"))


def json_from_text(text: Column) -> Column:
    """JSON object in free text: a fenced block, else the outermost braces, else the whole text."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(first_json_object(text))


def json_array_from_text(text: Column) -> Column:
    """Outermost ``[...]`` of a text, null when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))


def title_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_slug(name: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(without_extension(name)), "[^a-z0-9-]", "-")
    return F.regexp_replace(F.regexp_replace(cleaned, "-{2,}", "-"), "^-+|-+$", "")


def vector_key(name: Column) -> Column:
    """File name as a vector key: keeps spaces, hyphens, parentheses and brackets."""
    cleaned = F.regexp_replace(F.lower(without_extension(name)), r"[^a-zA-Z0-9\s\-()\[\]]", "-")
    return strip(F.regexp_replace(cleaned, r"\s+", " "))


def clean_title(title: Column, limit: int = 200) -> Column:
    return F.left(strip(F.regexp_replace(nfc(title), r"\s+", " ")), F.lit(limit))


def clean_body(body: Column) -> Column:
    """NFC, drop lone page numbers, collapse blank lines and blanks, trim."""
    text = F.regexp_replace(nfc(body), r"(?md)^\s*\d{1,4}\s*$", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def parent_folder(path: Column) -> Column:
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return F.when(folder == "", "root").otherwise(folder)


def file_stem(path: Column) -> Column:
    return without_extension(F.regexp_extract(path, r"[^/]*$", 0))


def chunk_id(folder: Column, stem: Column, index: Column) -> Column:
    return F.format_string("%s/%s__chunk_%05d", folder, stem, index.cast("int"))


def section_id(base: Column, index: Column) -> Column:
    return F.format_string("%s-s%04d", base, index.cast("int"))


def iso_timestamp(moment: Column) -> Column:
    """ISO text; fractions of a second only where there are any."""
    return F.when(
        F.date_trunc("second", moment) == moment, F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def without_thoughts(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?s)<think>.*?</think>", ""))


def html_text(html: Column) -> Column:
    """Page text: scripts, styles and comments out, headings as Markdown lines, other tags as blanks."""
    text = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, "(?i)<h[1-6][^>]*>", "\n# ")
    text = F.regexp_replace(text, "(?i)</h[1-6]>|</p>|<br[^>]*>|</li>", "\n")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(text, "[ \t]+", " "))


def relative_time(minutes: Column) -> Column:
    whole = F.floor(minutes)
    return (
        F.when(whole < 60, F.format_string("%dm ago", whole))
        .when(whole < 1440, F.format_string("%dh ago", F.floor(whole / 60)))
        .otherwise(F.format_string("%dd ago", F.floor(whole / 1440)))
    )


def duration_text(minutes: Column) -> Column:
    hours, rest = F.floor(minutes / 60), minutes % 60
    return (
        F.when(minutes < 60, F.format_string("%dm", minutes))
        .when(rest > 0, F.format_string("%dh %dm", hours, rest))
        .otherwise(F.format_string("%dh", hours))
    )


def percent_text(value: Column, decimals: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{decimals}f", F.round(value, decimals)), F.lit("%"))


def thousands_text(value: Column, decimals: int = 0) -> Column:
    """A number with commas between thousands; null stays null."""
    return F.format_number(F.round(value, decimals), decimals)


def rounded_or_same(value: Column, decimals: int = 3) -> Column:
    """Text of a number rounded to ``decimals``; what is no number, or not a finite one, passes through unchanged."""
    number = value.cast("string").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(finite, F.round(number, decimals).cast("string")).otherwise(value.cast("string"))


def quantise(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.round(x * 127).cast("tinyint"))


def widen(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("float"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def distance_to_similarity(distance: Column) -> Column:
    """``1 - d``; its own inverse."""
    return 1 - distance
