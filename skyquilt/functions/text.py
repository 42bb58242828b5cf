"""Text, name and file-list functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns that name an instrument, in order of precedence.
INSTRUMENTS = (("OHRC", r"(?i)ohrc|orbiter high resolution camera|_ohr_"), ("TMC2", r"(?i)tmc|terrain mapping camera|_tmc_"), ("IIRS", r"(?i)iirs|imaging infrared spectrometer|_iir_"))
SOURCE_SUFFIXES = (".py",)
WEIGHT_SUFFIXES = (".pth", ".pt", ".ckpt", ".safetensors", ".onnx", ".h5", ".bin")
REQUIREMENT_NAMES = ("requirements.txt", "environment.yml", "setup.py", "pyproject.toml")


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind; blank gives null."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def first_text(*columns: Column) -> Column:
    """First of the columns that is neither null, blank nor the text nan."""
    return F.coalesce(*[F.when(F.lower(strip(c)) != "nan", strip(c)) for c in columns])


def to_double(text: Column) -> Column:
    """Number of a text, null where it is none or not a number."""
    value = strip(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def to_long(text: Column) -> Column:
    """Whole number nearest to a text's value, halves to even."""
    return F.bround(to_double(text)).cast("long")


def instrument(*texts: Column) -> Column:
    """First instrument whose pattern a text matches; earlier texts win over later ones."""
    def of(text: Column) -> Column:
        return reduce(lambda e, i: e.when(text.rlike(i[1]), i[0]), INSTRUMENTS[1:], F.when(text.rlike(INSTRUMENTS[0][1]), INSTRUMENTS[0][0]))

    return F.coalesce(*map(of, texts))


def view_variant(name: Column) -> Column:
    """aft, fore or nadir from the letter after ``_nc`` in a product id."""
    letter = F.lower(F.regexp_extract(name, r"(?i)_nc([a-z])_", 1))
    return F.when(letter == "a", "aft").when(letter == "f", "fore").when(letter == "n", "nadir")


def header(name: Column) -> Column:
    """Column header in lower case, blanks and hyphens as underscores, without parentheses."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[- ]", "_"), r"[()]", "")


def header_text(name: str) -> str:
    """The same for a driver-side header."""
    return name.strip().lstrip("﻿").lower().replace("-", "_").replace(" ", "_").replace("(", "").replace(")", "")


def file_classes(files: Column) -> Column:
    """Struct ``has_source, has_requirements, has_weights`` of an array of paths."""
    def any_ends(suffixes: tuple[str, ...]) -> Column:
        return F.exists(files, lambda f: reduce(lambda a, b: a | b, [F.lower(f).endswith(s) for s in suffixes]))

    def any_named(names: tuple[str, ...]) -> Column:
        return F.exists(files, lambda f: F.lower(F.element_at(F.split(f, "/"), -1)).isin(*names))

    return F.struct(any_ends(SOURCE_SUFFIXES).alias("has_source"), any_named(REQUIREMENT_NAMES).alias("has_requirements"), any_ends(WEIGHT_SUFFIXES).alias("has_weights"))


def file_verdict(classes: Column) -> Column:
    return F.when(classes["has_source"] & classes["has_requirements"] & classes["has_weights"], "usable").when(classes["has_source"], "code only").otherwise("no code")


def pair_id(a: Column, b: Column) -> Column:
    return F.concat_ws("__x__", a, b)


def elapsed(seconds: Column) -> Column:
    return F.when(seconds < 1, F.format_string("%.0f ms", seconds * 1000)).otherwise(F.format_string("%.2f s", seconds))


def links(html: Column, base: Column) -> Column:
    """Absolute targets of href attributes in order of first occurrence; mail addresses go."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.concat(root, F.regexp_extract(F.regexp_replace(F.substr(base, F.length(root) + 1), r"[?#].*$", ""), r"^(.*/)", 1))
    folder = F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder)

    def absolute(h: Column) -> Column:
        return F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(root, h)).when(h.startswith("#") | h.startswith("?"), F.concat(base, h)).otherwise(F.concat(folder, h))

    found = F.regexp_extract_all(html, F.lit(r"""href=["']([^"']+)["']"""), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda h: ~F.lower(h).startswith("mailto:")), absolute))
