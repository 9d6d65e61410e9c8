"""Unicode normalization for matching: NFC, one space per white-space run, plain hyphens, case folding.

Spark has neither NFC nor full case folding.  Most texts need neither: over plain
characters both equal ``lower`` and every character stands for itself.  Only the other texts go
through Python, in Arrow batches.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as p

# Characters that normalize one by one, as ``lower`` does: Latin without the micro sign, sharp s,
# dotted I, apostrophe n and long s; Vietnamese; basic Cyrillic; general punctuation, currency,
# drawing signs; CJK; Hangul syllables; full-width forms; pictographs.
_SINGLE = (
    r"\x00-\xb4\xb6-\xde\xe0-\u012f\u0131-\u0148\u014a-\u017e\u0410-\u044f\u1ea0-\u1ef9"
    r"\u2010-\u2027\u202f-\u205f\u20a0-\u20bf\u2212\u2500-\u27bf\u3000-\u3029\u4e00-\u9fff"
    r"\uac00-\ud7a3\uff01-\uff5e"
)
_NOT_PLAIN = f"[^{_SINGLE}\\x{{1f300}}-\\x{{1faff}}]"
_NOT_PLAIN_WORDS = f"[^{_SINGLE}\\x{{1f300}}-\\x{{1faff}}\\xdf\\u1e9e]"
_NOT_NORMAL = f"[{p.SPACE}]{{2}}|[{p.SPACE}&&[^ ]]|[{p.HYPHENS}]"

ALIGNED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
    ]
)

# One visible unit: a Hangul syllable spelled in jamo, or any character, with its combining marks.
_CLUSTER = regex.compile(
    r"(?s)(?:[\u1100-\u115f\ua960-\ua97c][\u1160-\u11a7\ud7b0-\ud7c6][\u11a8-\u11ff\ud7cb-\ud7fb]?|.)"
    r"\P{Canonical_Combining_Class=0}*"
)
_TO_HYPHEN = {ord(c): "-" for c in p.HYPHENS}


# A stretch without white space whose characters stand for themselves; its last one must not carry
# a mark of the next.
_STRETCH = regex.compile(rf"(?:[{_SINGLE}--[\s]](?!\P{{Canonical_Combining_Class=0}}))+", regex.V1)


def align(text: str, fold: bool) -> tuple[str, list[int], list[int]]:
    """Normalize one text; for each output character give the source span it stands for."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    while at < len(text):
        if m := _STRETCH.match(text, at):
            value, at = m.group().translate(_TO_HYPHEN), m.end()
            out.append(value.casefold() if fold else value)
            starts.extend(range(m.start(), at))
            ends.extend(range(m.start() + 1, at + 1))
            continue
        m = _CLUSTER.match(text, at)
        at = m.end()
        value = unicodedata.normalize("NFC", m.group())
        if value.isspace():
            if out and out[-1] == " ":
                ends[-1] = at
                continue
            if not out:
                continue
            value = " "
        value = value.translate(_TO_HYPHEN)
        value = value.casefold() if fold else value
        out.append(value)
        starts.extend([m.start()] * len(value))
        ends.extend([at] * len(value))
    if out and out[-1] == " ":
        out.pop(), starts.pop(), ends.pop()
    return "".join(out), starts, ends


def _align_batch(texts: pd.Series, fold: bool) -> pd.DataFrame:
    out = np.full((len(texts), 3), None, object)
    # Most rows are null.
    for i in np.flatnonzero(texts.notna()):
        value, starts, ends = align(texts.iat[i], fold)
        out[i, 0], out[i, 1], out[i, 2] = value, np.asarray(starts, np.int32), np.asarray(ends, np.int32)
    return pd.DataFrame(dict(zip(("text", "starts", "ends"), out.T)), index=texts.index)


@F.pandas_udf(ALIGNED)
def align_folded(texts: pd.Series) -> pd.DataFrame:
    """Folded normalization with alignment; null in, null out."""
    return _align_batch(texts, True)


@F.pandas_udf(ALIGNED)
def align_cased(texts: pd.Series) -> pd.DataFrame:
    """Case-keeping normalization with alignment; null in, null out."""
    return _align_batch(texts, False)


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else align(t, True)[0])


@F.pandas_udf(T.StringType())
def _cased(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else align(t, False)[0])


def is_plain(c: Column, words: bool = False) -> Column:
    """True for texts made of characters that normalize one by one, as ``lower`` does.

    With ``words`` sharp s is allowed too: it folds to two letters, so it stays inside its word but
    moves what follows.
    """
    ascii = F.octet_length(c) == F.length(c)
    return ascii | ~c.rlike(_NOT_PLAIN_WORDS if words else _NOT_PLAIN)


def is_normal(c: Column) -> Column:
    """True when ``plain_normalize`` would change nothing."""
    return ~c.rlike(_NOT_NORMAL)


def plain_lower(c: Column) -> Column:
    """Case folding of a plain text."""
    low = F.lower(c)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.replace(low, F.lit("ß"), F.lit("ss")))


def plain_normalize(c: Column) -> Column:
    """Case-keeping normalization of a plain text, without trimming its ends."""
    spaced = F.regexp_replace(c, f"[{p.SPACE}]{{2,}}|[{p.SPACE}&&[^ ]]", " ")
    return F.regexp_replace(spaced, f"[{p.HYPHENS}]", "-")


def normalize_plain(c: Column | str, fold: bool = True) -> Column:
    """``normalize`` for texts known to be plain."""
    native = F.trim(plain_normalize(F.col(c) if isinstance(c, str) else c))
    return plain_lower(native) if fold else native


def normalize(c: Column | str, fold: bool = True) -> Column:
    """Normalized text; native for plain rows, Python for the rest."""
    c = F.col(c) if isinstance(c, str) else c
    plain = is_plain(c, words=True)
    python = (_folded if fold else _cased)(F.when(~plain, c))
    return F.when(plain, normalize_plain(c, fold)).otherwise(python)


def looks_code_like(c: Column | str) -> Column:
    """A digit, mixed case, or at most eight letters all in upper case."""
    c = F.col(c) if isinstance(c, str) else c
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    return (
        c.rlike(r"\p{Nd}|[\xb2\xb3\xb9\u2070\u2074-\u2079\u2080-\u2089]")
        | (letters.rlike(r"\p{Lu}") & letters.rlike(r"\p{Ll}"))
        | letters.rlike(r"^\p{Lu}{1,8}\z")
    )


def needs_boundaries(form: Column | str, lang: Column | str) -> Column:
    """Whether both neighbours of a match must be non-word characters."""
    form = F.col(form) if isinstance(form, str) else form
    lang = F.col(lang) if isinstance(lang, str) else lang
    return (lang != "zh") & ~((lang == "ko") & ~form.rlike("[A-Za-z0-9]"))
