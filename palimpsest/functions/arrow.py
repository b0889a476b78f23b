"""The text functions as Arrow UDFs, for columns; ``register`` makes them SQL functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import changes, dates, markup

TEXT, TEXTS, LONG = T.StringType(), T.ArrayType(T.StringType()), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DIFF = _struct(inserted=TEXTS, removed=TEXTS, first_offset=LONG, old_blocks=TEXTS, new_blocks=TEXTS)
CHANGE = _struct(prose=TEXT, sections=TEXTS, section_chars=T.ArrayType(LONG), kinds=TEXTS, inserted_chars=LONG, removed_chars=LONG)
LINES = _struct(added=TEXTS, gone=TEXTS)
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _text(x):
    return x if isinstance(x, str) else None


@F.pandas_udf(TEXT)
def plain_text(text: pd.Series) -> pd.Series:
    return text.map(lambda x: markup.plain_text(_text(x)))


@F.pandas_udf(TEXTS)
def prose(text: pd.Series) -> pd.Series:
    return text.map(lambda x: markup.prose(_text(x)))


@F.pandas_udf(TEXT)
def lead(text: pd.Series) -> pd.Series:
    return text.map(lambda x: markup.lead(_text(x)))


@F.pandas_udf(DIFF)
def word_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([changes.word_diff(_text(a), _text(b)) for a, b in zip(old, new)], columns=DIFF.names)
    return out.astype({"first_offset": "Int64"})


@F.pandas_udf(LINES)
def line_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([changes.line_diff(_text(a), _text(b)) for a, b in zip(old, new)], columns=LINES.names)


@F.pandas_udf(CHANGE)
def day_change(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([changes.day_change(_text(a), _text(b)) for a, b in zip(old, new)], columns=CHANGE.names)


SPAN_SECTIONS = T.ArrayType(_struct(span=TEXT, sections=TEXTS))
SPANS = _struct(spans=TEXTS, inserted_chars=LONG, removed_chars=LONG)
CONTEXT = _struct(section=TEXT, context=TEXT)


@F.pandas_udf(SPAN_SECTIONS)
def span_sections(old: pd.Series, new: pd.Series) -> pd.Series:
    """The new spans of a text with the sections each goes into."""

    def one(a, b):
        outline = markup.Outline(b or "")
        return [{"span": s, "sections": changes.span_sections(outline, at, s)} for at, s in changes.new_spans(a, b)[0]]

    return pd.Series([one(_text(a), _text(b)) for a, b in zip(old, new)], dtype=object)


@F.pandas_udf(SPANS)
def new_spans(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    found = [changes.new_spans(_text(a), _text(b)) for a, b in zip(old, new)]
    return pd.DataFrame([([s for _, s in spans], came, gone) for spans, came, gone in found], columns=SPANS.names)


@F.pandas_udf(CONTEXT)
def edit_context(text: pd.Series, offset: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([changes.edit_context(_text(t), int(o)) for t, o in zip(text, offset)], columns=CONTEXT.names)


@F.pandas_udf(TEXT)
def mark_dates(text: pd.Series, day: pd.Series) -> pd.Series:
    return pd.Series([dates.mark(_text(t), d) if d is not None else _text(t) for t, d in zip(text, day)], dtype=object)


@F.pandas_udf(TEXTS)
def dated_lines(text: pd.Series, day: pd.Series) -> pd.Series:
    return pd.Series([dates.dated_lines(_text(t), d) if d is not None else [] for t, d in zip(text, day)], dtype=object)


@F.pandas_udf(TEXT)
def fix_weekdays(text: pd.Series, day: pd.Series) -> pd.Series:
    return pd.Series([dates.fix_weekdays(_text(t), d) if d is not None else _text(t) for t, d in zip(text, day)], dtype=object)


@F.pandas_udf(TEXT)
def snippet(text: pd.Series) -> pd.Series:
    """The longest piece of prose, shortened."""
    return text.map(lambda x: changes.snippet([_text(x) or ""]))


@F.pandas_udf(TEXTS)
def kinds_of(span: pd.Series) -> pd.Series:
    """The kinds of change a span makes to an empty page."""
    return span.map(lambda x: [k for k in changes.KINDS if k in changes.kinds_of(_text(x) or "", set())])


@F.pandas_udf(TEXT)
def sha1_base36(digest: pd.Series) -> pd.Series:
    """A hexadecimal SHA-1 in base 36, 31 digits; null and what isn't hexadecimal is null."""

    def convert(x) -> str | None:
        try:
            n, out = int(x, 16), ""
        except (TypeError, ValueError):
            return None
        while n:
            n, digit = divmod(n, 36)
            out = DIGITS[digit] + out
        return out.rjust(31, "0")

    return digest.map(convert)


def register(spark: SparkSession) -> None:
    for name in ("plain_text", "prose", "lead", "word_diff", "line_diff", "day_change", "mark_dates", "dated_lines", "fix_weekdays", "snippet", "kinds_of", "sha1_base36", "span_sections", "new_spans", "edit_context"):
        spark.udf.register(name, globals()[name])
