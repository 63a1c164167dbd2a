"""Text, name and identifier expressions. All are column functions; Python runs only where Unicode folding needs it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the two polarities.
POSITIVE = ("positive", "pos", "+", "p", "positiveionmode", "esi+", "es+")
NEGATIVE = ("negative", "neg", "-", "n", "negativeionmode", "esi-", "es-")
#: Dashes and full-width signs that are unified before tokenizing.
TYPOGRAPHY = ("−–—／＋", "---/+")
#: Tokens of scientific text - bracketed ions, m/z, hyphenated or decimal numbers, words.
SCIENTIFIC_TOKEN = r"(?U)\[[^\]\r\n]{1,40}\][+-]?|\bm\s*/\s*z\b|\d+(?:\.\d+)?(?:-[a-z0-9]+)+|\d+(?:\.\d+)?|[a-z]+(?:[-'][a-z0-9]+)*"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: within a lambda, other expressions are evaluated at each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def nonempty(c: Column) -> Column:
    """Null instead of the empty string."""
    return F.nullif(c, F.lit(""))


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*[nonempty(v) for v in values], F.lit(""))


def normalize_space(c: Column) -> Column:
    """White space runs become one blank, outer ones go; null is empty."""
    return F.coalesce(F.btrim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def clean_text(c: Column) -> Column:
    """normalize_space, and the words nan, none and null are empty."""
    text = normalize_space(c.cast("string"))
    return F.when(F.lower(text).isin("nan", "none", "null"), F.lit("")).otherwise(text)


def evidence_text(c: Column) -> Column:
    """The evidence records' cleaning: zero and false are empty, the word nan stays."""
    return F.when(c.cast("string").isin("0", "0.0", "false"), F.lit("")).otherwise(normalize_space(c.cast("string")))


def safe_float(c: Column, finite: bool = False) -> Column:
    """A double or null. With ``finite`` infinities and NaN are null."""
    x = clean_text(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) if finite else x


def float_from_text(c: Column) -> Column:
    """The first signed decimal number within a text."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")


def header_key(c: Column) -> Column:
    """A header's letters and digits, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def header_key_of(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", (text or "").casefold())


def canonical_feature_id(c: Column) -> Column:
    """Trimmed, unquoted; ``12.0`` is ``12``."""
    text = F.regexp_replace(F.btrim(F.coalesce(c.cast("string"), F.lit(""))), '^"+|"+$', "")
    return F.when(text.rlike(r"^[+-]?\d+\.0+$"), F.substring_index(text, ".", 1)).otherwise(text)


def normalize_ion_mode(c: Column) -> Column:
    key = F.regexp_replace(F.lower(F.btrim(F.coalesce(c.cast("string"), F.lit("")))), " ", "")
    return F.when(key.isin(*POSITIVE), "positive").when(key.isin(*NEGATIVE), "negative").otherwise("")


def ion_mode_from_adduct(c: Column) -> Column:
    """The polarity an adduct ends with or closes its bracket with; positive is tested first."""
    text = F.regexp_replace(F.btrim(F.coalesce(c, F.lit(""))), " ", "")
    return F.when(text.rlike(r"\+$|\[[^\]]+\]\+"), "positive").when(text.rlike(r"-$|\[[^\]]+\]-"), "negative").otherwise("")


def ion_mode_from_charge(c: Column) -> Column:
    text = F.btrim(F.coalesce(c, F.lit("")))
    return F.when(text.endswith("+"), "positive").when(text.endswith("-"), "negative").otherwise("")


def clean_library_name(c: Column) -> Column:
    """What stands before the first bar."""
    return F.btrim(F.substring_index(F.btrim(F.coalesce(c, F.lit(""))), "|", 1))


def split_values(c: Column, separators: str = ";|") -> Column:
    """A JSON list of texts, else the parts between separators; trimmed, empty ones left out."""
    text = F.btrim(F.coalesce(c, F.lit("")))
    parts = F.split(text, f"[{separators}]")
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.filter(F.transform(F.coalesce(listed, parts), lambda x: F.btrim(x)), lambda x: x != "")


def join_unique(values: Column, separator: str = ";") -> Column:
    """Distinct values by lower case in order, the first spelling kept."""
    cleaned = F.filter(F.transform(values, clean_text), lambda x: x != "")
    first = F.filter(cleaned, lambda x, i: F.array_position(F.transform(cleaned, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return F.array_join(first, separator)


def format_number(c: Column, digits: int) -> Column:
    """Fixed decimals without trailing zeros; ``-0`` is ``0``, null is empty."""
    text = F.regexp_replace(F.format_string(f"%.{digits}f", c.cast("double")), r"\.?0+$", "") if digits else F.format_string("%.0f", c.cast("double"))
    return F.when(c.isNull(), F.lit("")).when(text == "-0", F.lit("0")).otherwise(text)


def stable_id(prefix: str, *parts: Column, width: int = 16) -> Column:
    """``prefix_`` and the first hex digits of SHA-1 over the lower-cased parts, joined by bars."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws("|", *[F.lower(clean_text(p)) for p in parts])), 1, width))


def stable_json_id(prefix: str, payload: Column, width: int = 16) -> Column:
    """``prefix_`` and SHA-1 of a struct's JSON; its fields must be declared in sorted order."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.to_json(payload)), 1, width))


def chunk_id(source_file: Column, page: Column, sheet: Column, row_index: Column, number: Column) -> Column:
    """``chunk_`` and 20 hex digits of SHA-256 over a chunk's place; a missing part prints as None."""

    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))

    place = F.concat(source_file, F.lit("|p="), shown(page), F.lit("|s="), shown(sheet), F.lit("|r="), shown(row_index), F.lit("|c="), shown(number))
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(place, 256), 1, 20))


def normalize_symbols(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), *TYPOGRAPHY)


def scientific_tokens(c: Column) -> Column:
    """Tokens of a scientific text in order; white space within a token goes."""
    found = F.regexp_extract_all(normalize_symbols(c), F.lit(SCIENTIFIC_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(t, r"(?U)\s+", ""))


def traceability_text(c: Column) -> Column:
    """Lower case, dashes unified, single blanks."""
    return normalize_space(F.translate(F.lower(F.coalesce(c, F.lit(""))), "−–—", "---"))


def compact_text(c: Column) -> Column:
    """Lower case, dashes unified, no white space at all."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "−–—‐", "----"), r"(?U)\s+", "")


#: The tokens by which a quote is looked for.
QUOTE_TOKEN = r"(?U)[A-Za-z]+(?:[-'][A-Za-z0-9]+)*|\d+(?:\.\d+)?"


def word_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(QUOTE_TOKEN), F.lit(0)), lambda t: F.lower(t))


def semantic_text(c: Column) -> Column:
    return normalize_space(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}]+", " "))


def preview(c: Column, limit: int = 360) -> Column:
    text = normalize_space(c)
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def parse_confidence(c: Column) -> Column:
    """A number clamped to 0 and 1; anything else is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))))


def serialize_cell(c: Column, kind: str) -> Column:
    """A cell of a rule table: null is empty, lists and structs are JSON, booleans upper case, text trimmed."""
    if kind.startswith(("array", "struct", "map")):
        return F.coalesce(F.to_json(c), F.lit(""))
    if kind == "boolean":
        return F.coalesce(F.upper(c.cast("string")), F.lit(""))
    return F.coalesce(F.btrim(c.cast("string")), F.lit(""))


def fold_name(value: str | None) -> str:
    """NFKC, case folded, single blanks: the comparison form of a name."""
    return " ".join(unicodedata.normalize("NFKC", value or "").casefold().split())


def registry_name(c: Column) -> Column:
    """fold_name of a column. Names of ASCII letters never leave the JVM."""

    @F.pandas_udf("string")
    def folded(names: pd.Series) -> pd.Series:
        return names.map(fold_name)

    simple = F.lower(normalize_space(c))
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^[\x00-\x7F]*$"), simple).otherwise(folded(c))


def registry_name_keys(c: Column) -> Column:
    """Keys of a name: the whole; of ``outer (inner)`` with three letters inside also both parts and the inner pieces."""
    whole = registry_name(c)
    found = F.regexp_extract(whole, r"^(.*\S)\s*\((.*)\)$", 1)
    inner = F.regexp_extract(whole, r"^(.*\S)\s*\((.*)\)$", 2)
    lettered = F.length(F.regexp_replace(inner, r"(?U)[^\p{L}]", "")) >= 3
    pieces = F.filter(F.transform(F.split(inner, "[/;]"), lambda x: F.btrim(x)), lambda x: x != "")
    return F.when(lettered & (found != ""), F.array_distinct(F.concat(F.array(whole, found, inner), pieces))).otherwise(F.array(whole))


def mixed_script(c: Column) -> Column:
    """Whether a name mixes Latin with Cyrillic letters."""
    return c.rlike(r"\p{IsLatin}") & c.rlike(r"\p{IsCyrillic}")
