"""HTML to text and fields. Text extraction is a chain of built-in expressions; fields need a parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import clean_lines, strip

# Element ids of the disclosure form's header.
HEADER_IDS = {"company_name_he": "HeaderEntityNameEB", "company_name_en": "HeaderEntityNameEn", "registration_number": "HeaderSingNumberD", "form_type": "HeaderFormNumber", "submission_date": "HeaderSendDate", "subject": "HeaderFormSubject", "proof_id": "HeaderProofValue"}
BOILERPLATE = ("script", "style", "head", "footer", "nav")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@F.pandas_udf(T.StringType())
def _decoded(text: pd.Series) -> pd.Series:
    """Named and numeric entities decoded, a no-break space as a blank; SQL has no function for it."""
    return text.map(lambda t: t if t is None or "&" not in t else unescape(t).replace("\xa0", " "))


_ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


@F.pandas_udf(T.StringType())
def _decoded_ended(text: pd.Series) -> pd.Series:
    """As ``_decoded``, but a reference that no semicolon ends, as where a text was cut, stays as it is."""
    one = lambda m: unescape(m[0]) if not m[1] or m[1] + ";" in html5 else m[0]
    return text.map(lambda t: t if t is None or "&" not in t else _ENDED.sub(one, t).replace("\xa0", " "))


def html_text(h: Column, separator: str = "\n", drop: tuple[str, ...] = (), ended: bool = False) -> Column:
    """Text of all nodes, entities decoded (HTML1); with ``drop``, without those elements (HTML2); with ``ended``, only
    entities that a semicolon ends are decoded."""
    h = F.regexp_replace(h, "(?s)<!--.*?-->|<![^>]*>", "")
    for tag in drop:
        h = F.regexp_replace(h, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    return strip((_decoded_ended if ended else _decoded)(F.regexp_replace(h, r"(?s)<[^>]*>", separator)))


def html_body(h: Column, ended: bool = False) -> Column:
    """Text without scripts, styles, head, footer and navigation, clean lines (HTML2)."""
    return clean_lines(html_text(h, "\n", BOILERPLATE, ended))


def combined(*parts: Column) -> Column:
    """Parts that are not empty, with a blank line between (HTML7)."""
    return F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts])


def narrative(h: Column, least: int = 80, share: float = 0.5) -> Column:
    """Main content by text density: blocks with much text and few links (HTML6, approximate)."""
    blocks = F.split(F.regexp_replace(h, r"(?is)<(script|style|head|footer|nav)\b.*?</\1\s*>", ""), r"(?i)</?(?:p|div|article|section|td|li|h[1-6]|br)\b[^>]*>")

    def dense(b: Column) -> Column:
        linked = F.length(F.array_join(F.regexp_extract_all(b, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), ""))
        n = F.length(strip(F.regexp_replace(b, r"(?s)<[^>]*>", "")))
        return (n >= least) & (linked <= share * n)

    return _decoded(F.array_join(F.transform(F.filter(blocks, dense), lambda b: strip(F.regexp_replace(b, r"(?s)<[^>]*>", " "))), "\n"))


class _Form(HTMLParser):
    """Collects header elements by id, body elements and table rows of a form."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.header: dict[str, str] = {}
        self.body: list[tuple[int, str]] = []
        self.rows: list[list[str]] = []
        self.seen = 0

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        wanted = dict(attrs).get("id")
        node = {"tag": tag, "id": wanted, "text": [], "order": self.seen, "hidden": wanted in HEADER_IDS.values() and wanted not in self.header}
        self.seen += 1
        if node["hidden"]:
            self.header[wanted] = ""
        if tag == "tr":
            node["cells"] = []
        self.stack.append(node)

    def handle_data(self, data):
        for node in self.stack:
            node["text"].append((data, any(n["hidden"] for n in self.stack)))

    def handle_endtag(self, tag):
        if not any(n["tag"] == tag for n in self.stack):
            return
        while self.stack:
            node = self.stack.pop()
            self._done(node)
            if node["tag"] == tag:
                break

    def close(self):
        super().close()
        while self.stack:
            self._done(self.stack.pop())

    def _done(self, node):
        everything = "".join(x.strip() for x, _ in node["text"])
        if node["hidden"]:
            self.header[node["id"]] = everything
        if node["tag"] in ("th", "td"):
            row = next((n for n in reversed(self.stack) if n["tag"] == "tr"), None)
            if row is not None:
                row["cells"].append(everything)
        if node["tag"] == "tr":
            self.rows.append(node["cells"])
        if node["tag"] in ("textarea", "span") and not any(n["hidden"] for n in [*self.stack, node]):
            shown = "".join(x.strip() for x, hidden in node["text"] if not hidden)
            if len(shown) > 2 and not shown.startswith("__"):
                self.body.append((node["order"], shown))


def _parsed(h: str) -> _Form:
    form = _Form()
    form.feed(h)
    form.close()
    return form


_FIELDS = T.StructType([T.StructField(k, T.StringType()) for k in (*HEADER_IDS, "body", "table_text")])


@F.pandas_udf(_FIELDS)
def form_fields(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Seven header fields (missing: null), body of textarea and span elements, table rows as 'k: v; k: v' (HTML3-5)."""
    for series in pages:
        rows = []
        for h in series:
            if h is None:
                rows.append([None] * (len(HEADER_IDS) + 2))
                continue
            f = _parsed(h)
            pairs = ["; ".join(f"{c[i]}: {c[i + 1]}" for i in range(0, len(c) - 1, 2)) for c in f.rows if len(c) >= 2]
            rows.append([*(f.header.get(i) for i in HEADER_IDS.values()), "\n".join(x for _, x in sorted(f.body)), "\n".join(pairs)])
        yield pd.DataFrame(rows, columns=[*HEADER_IDS, "body", "table_text"])
