"""Text functions for Hebrew and mixed-direction disclosures. All are built-in expressions, but ``nfc``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers of the disclosure forms.
START_MARKER = "שעת שידור"
FOOTERS = ("פרטי החותמים המורשים לחתום בשם התאגיד:", "הסבר: לפי תקנה 5 לתקנות", "מספרי אסמכתאות של מסמכים קודמים בנושא")
SECTION_PATTERNS = {"directors": r"(?:דוח|הסברי)\s+הדירקטוריון", "financials": r"דוחות?\s+כספיים"}
FORM_SYMBOL = r"(ת|א|ד)\d{3}"
BULLETS = "•·●▪️✓✔▶►❖"

_BLANK = r"[\s\x1c-\x1f]"
_LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, for which SQL has no function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def held(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row: Spark writes an expression out wherever it is used, and within a lambda
    computes it again for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(t: Column) -> Column:
    """Without white space (Unicode's, and the separators U+001C..1F) at both ends."""
    return F.regexp_replace(t, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def split_lines(t: Column) -> Column:
    return F.split(t, _LINE_END)


def clean_lines(t: Column) -> Column:
    """Lines stripped, empty ones dropped."""
    return F.array_join(F.filter(F.transform(split_lines(t), strip), lambda x: x != ""), "\n")


def strip_points(t: Column, compose: bool = True) -> Column:
    """NFC, then without U+0591..U+05C7, then single blanks (STR1)."""
    t = F.coalesce(nfc(F.when(t.rlike(r"[^\x00-\x{2ff}]"), t)), t) if compose else t  # signs below U+0300 are composed
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[֑-ׇ]", ""), rf"(?U){_BLANK}+", " "))


def trim_report(t: Column, start: str = START_MARKER, footers: tuple[str, ...] = FOOTERS) -> Column:
    """From the start marker on; up to the first footer of the list that occurs; clean lines (STR2)."""
    at = F.instr(t, start)
    body = F.when(at > 0, F.substring(t, at, F.length(t))).otherwise(t)
    ends = [F.when(F.instr(body, f) > 0, F.instr(body, f)) for f in footers]
    end = F.coalesce(*ends)
    return clean_lines(F.when(end.isNotNull(), F.substring(body, F.lit(1), end - 1)).otherwise(body))


def before_marker(t: Column, marker: str = FOOTERS[0]) -> Column:
    """What stands before the marker, stripped; the text as it is without one (STR3)."""
    at = F.instr(t, marker)
    return F.when(at > 0, strip(F.substring(t, F.lit(1), at - 1))).otherwise(t)


def normalise_hebrew(t: Column, join_table_lines: bool = False) -> Column:
    """The eight-step normaliser (STR4); ``join_table_lines`` adds the step of the PDF variant.

    The reference's step that makes three and more blanks between signs a ``|`` finds none: blanks are single after the
    second step, and the third makes at most two of a blank and a line end. Runs of blanks are looked at from their start
    only, so that a text of signs that become blanks takes no time with the square of its length."""
    steps = [
        ("\r\n|\r", "\n"), (r"[ \t]+", " "), (r"(?U)\n(?<=[^.!?:]\n)(?=[^\n\Wא-תa-zA-Z])", " "), (r"\n{2,}", "\n"),
        *([(r"(?U)\n(?=\S+ [|] \S+)", " ")] if join_table_lines else []),
        (rf"(?md)^[{BULLETS}-]+[ \t]+", "- "), ("(?U)[^\\x00-\\x7F֐-׿\\d.,\\-:;|!?()\"'\n ]", " "), (r"(?<![ \t])[ \t]++\n", "\n"),
    ]
    # of white space ASCII's is left
    return F.btrim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, t), F.lit(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"))


def clean_extracted(t: Column, ends: Callable[[Column], Column] = strip) -> Column:
    """The five-step variant that keeps line ends after . ! ? only (STR5); ``ends`` takes off what stands at both ends, with
    ``F.trim`` blanks alone, so that a last line of other signs leaves the line end before it."""
    steps = [(r"[ \t]+", " "), (r"\n{2,}", "\n"), (r"(?<![.!?])\n(?!\n)", " "), ("[^\\x00-\\x7F֐-׿]+", " ")]
    return ends(reduce(lambda c, s: F.regexp_replace(c, *s), steps, t))


def matches_either_way(t: Column, pattern: str) -> Column:
    """The pattern in the text or in its reverse: visual-order extraction turns lines round (STR6)."""
    return t.rlike(pattern) | F.reverse(t).rlike(pattern)


def form_symbol(t: Column, window: int = 200) -> Column:
    """First form symbol in the first ``window`` characters, else null (STR8)."""
    return F.nullif(F.regexp_extract(F.substring(t, 1, window), FORM_SYMBOL, 0), F.lit(""))


def first_line(t: Column) -> Column:
    """First line that is not blank, stripped; '' without one (STR9)."""
    return F.coalesce(F.get(F.filter(F.transform(split_lines(t), strip), lambda x: x != ""), 0), F.lit(""))


def sheet_name(t: Column) -> Column:
    return F.substring(F.regexp_replace(t, "[^A-Za-z0-9_]+", "_"), 1, 31)


def file_safe(t: Column, most: int = 60) -> Column:
    """A name for files: other signs to _, cut, no _ or . at the ends (STR10)."""
    return F.regexp_replace(F.substring(F.regexp_replace(t, r"(?U)[^\w.\-]+", "_"), 1, most), r"^[_.]+|[_.]+$", "")


def model_dir(t: Column) -> Column:
    return F.regexp_replace(t, r"[^A-Za-z0-9._\-]+", "_")


def key_base(t: Column, prefix: str = "") -> Column:
    """Object key to base name: prefix dropped, / to _, last extension dropped (STR10b)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, f"^\\Q{prefix}\\E", ""), "/", "_"), r"\.[^.]*$", "")


def strip_fence(t: Column) -> Column:
    """Without code fences and a stray json label (STR11)."""
    for pattern in (r"(?i)^```json\s*", r"^```", r"(?i)^json\s*", r"\s*```$"):
        t = F.regexp_replace(strip(t) if pattern.startswith("(?i)^`") else t, pattern, "")
    return strip(t)


def escape_inner_quotes(t: Column) -> Column:
    """A quotation mark between Hebrew letters gets a backslash (STR12)."""
    return F.regexp_replace(t, '(?<=[֐-׿])"(?=[֐-׿])', '\\\\"')


def excerpt(t: Column, most: int = 500) -> Column:
    """First characters on one line, stripped after the cut; null to '' (STR13)."""
    return F.coalesce(strip(F.translate(F.substring(t, 1, most), "\n", " ")), F.lit(""))


def token_estimate(t: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(t, F.lit(""))) / 4)).cast("long")


def csv_of(values: Column) -> Column:
    return F.coalesce(F.array_join(values, ","), F.lit(""))


def ints_of(t: Column, strings_when_bad: bool = False) -> Column:
    """'1, 2' to numbers (STR20): null for blank and, if any part is no number, strings or an empty list."""
    parts = F.transform(F.split(t, ","), lambda x: F.trim(x))
    numbers = F.transform(parts, lambda x: x.try_cast("long"))
    bad = F.exists(numbers, lambda x: x.isNull())
    blank = F.coalesce(F.trim(t), F.lit("")) == ""
    if strings_when_bad:
        return F.when(~blank, F.when(bad, parts).otherwise(F.transform(numbers, lambda x: x.cast("string"))))
    return F.when(blank | bad, F.array().cast("array<bigint>")).otherwise(numbers)


def short_number(x: Column, digits: int = 3) -> Column:
    """Fixed digits without trailing zeros and point (STR21)."""
    text = F.format_string(f"%.{digits}f", x)
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def rtl_wrapped(t: Column) -> Column:
    """Byte-order mark and right-to-left embedding around a text (SNK15)."""
    return F.concat(F.lit("﻿‫"), t, F.lit("‬"))


def template(pattern: str, **values: Column) -> Column:
    """``pattern`` with {name} slots filled; unknown slots stay (STR22)."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), values.items(), F.lit(pattern))


def language_of(t: Column, share: float = 0.3) -> Column:
    """'he' when Hebrew letters are a share of all letters, else 'en'; short texts are 'en' (LNG1)."""
    hebrew, letters = F.length(F.regexp_replace(t, "[^א-ת]", "")), F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return F.when((F.length(strip(t)) >= 20) & (letters > 0) & (hebrew >= share * letters), "he").otherwise("en")


def file_type(url: Column) -> Column:
    """pdf, txt, html or unknown by the extension of a URL's path (SRC22)."""
    path = F.lower(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", ""))
    ext = F.regexp_extract(path, r"[^/]\.([a-z0-9]+)$", 1)
    return F.when(ext.isin("pdf", "txt"), ext).when(ext.isin("htm", "html"), "html").otherwise("unknown")


def mime_type(name: Column, header: Column | None = None) -> Column:
    """Header, else by extension, else octet-stream (SRC21)."""
    guess = F.when(file_type(name) == "pdf", "application/pdf").when(file_type(name) == "html", "text/html").when(file_type(name) == "txt", "text/plain")
    return F.coalesce(*([header] if header is not None else []), guess, F.lit("application/octet-stream"))


def url_file_name(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)$", 1)


def charset_of(raw: Column) -> Column:
    """utf-8, windows-1255, iso-8859-8 or windows-1252, by how bytes stand (SRC16).

    Valid UTF-8 is that. Hebrew letters are the bytes E0 to FA in both Hebrew charsets and stand in runs, while the accented
    letters that these bytes are in windows-1252 stand alone: it is Hebrew if at least half of them stand in runs of two and
    more, or if there is no letter of ASCII, which no Western text lacks. Marks at 80 to 9F and points at C0 to D8 are of
    windows-1255 only. A null stays null.
    """
    one = F.decode(raw, "ISO-8859-1")  # a character a byte
    letters = F.length(F.regexp_replace(one, "[^\u00e0-\u00fa]", ""))
    in_runs = F.length(F.regexp_replace(one, "[^\u00e0-\u00fa]|(?<![\u00e0-\u00fa])[\u00e0-\u00fa](?![\u00e0-\u00fa])", ""))
    hebrew = F.when(one.rlike("[\u0080-\u009f\u00c0-\u00d8]"), "windows-1255").otherwise("iso-8859-8")
    return F.when(raw.isNull(), None).when(F.is_valid_utf8(raw.cast("string")), "utf-8").when(((letters > 0) & (2 * in_runs >= letters)) | ~one.rlike("[A-Za-z]"), hebrew).otherwise("windows-1252")


@F.pandas_udf(T.StringType())
def _decoded_as(raw: pd.Series, charset: pd.Series) -> pd.Series:
    """Spark's own decode knows no charset of these."""
    return pd.Series([None if b is None else bytes(b).decode(c, "replace") for b, c in zip(raw, charset)])


def decoded(raw: Column) -> Column:
    """Bytes to text by ``charset_of``; bytes that the charset does not have become U+FFFD (SRC16)."""
    charset = charset_of(raw)
    return F.coalesce(F.when(charset == "utf-8", raw.cast("string")), _decoded_as(F.when(charset != "utf-8", raw), F.coalesce(charset, F.lit("utf-8"))))


def date_path(d: Column) -> Column:
    """year/month/day without padding (DAT1)."""
    return F.format_string("%d/%d/%d", F.year(d), F.month(d), F.dayofmonth(d))
