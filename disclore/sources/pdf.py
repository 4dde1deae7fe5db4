"""PDF pages, words and tables as rows, where a PDF library is installed; the rest works on rows alone."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _library():
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pdfplumber") from e
    return pdfplumber


def pages(files: DataFrame) -> DataFrame:
    """path, page (from 0), text of binaryFile rows (SRC17)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lib = _library()
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                with lib.open(io.BytesIO(content)) as pdf:
                    yield pd.DataFrame([(path, i, p.extract_text() or "") for i, p in enumerate(pdf.pages)], columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


def words(files: DataFrame) -> DataFrame:
    """path, page, x0, x1, top, text, page_width, page_height (SRC18)."""
    def run(frames):
        lib = _library()
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                with lib.open(io.BytesIO(content)) as pdf:
                    rows = [(path, i, w["x0"], w["x1"], w["top"], w["text"], p.width, p.height) for i, p in enumerate(pdf.pages) for w in p.extract_words()]
                    yield pd.DataFrame(rows, columns=["path", "page", "x0", "x1", "top", "text", "page_width", "page_height"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, x0 double, x1 double, top double, text string, page_width double, page_height double")


def document_text(page_rows: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One text a document, pages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return page_rows.groupBy("path").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), separator).alias("text"))


def lines(word_rows: DataFrame, left: float = 0.275, right: float = 0.700) -> DataFrame:
    """Words to lines by page and height (AGG14): relative bounds to 3 digits, text by x0, whether centred."""
    g = word_rows.groupBy("path", "page", F.round("top", 1).alias("y")).agg(
        F.min("x0").alias("a"), F.max("x1").alias("b"), F.max("page_width").alias("w"), F.max("page_height").alias("h"), F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("t"))
    return g.select(
        "path", "page", F.round(F.col("a") / F.col("w"), 3).alias("rel_x0"), F.round(F.col("b") / F.col("w"), 3).alias("rel_x1"), F.round(F.col("y") / F.col("h"), 3).alias("rel_y"),
        ((F.col("a") / F.col("w") > left) & (F.col("b") / F.col("w") < right)).alias("centered"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
