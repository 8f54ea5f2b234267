"""Cleaning of text documents and overlapping word chunks, as expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabularium.functions.text import FLAGS, SPACE, col, let, strip, words

# Limits that must equal the reference's.
MIN_LINES, EDGE_LINES, SHORT_LINE, TINY_LINE = 5, 2, 20, 5
CHUNK_WORDS, OVERLAP_WORDS, MIN_CHUNK_CHARS = 512, 50, 50


def remove_headers_footers(text: Column | str) -> Column:
    """Drop page-like or tiny lines among the first and last two lines of longer texts."""
    def without_edges(lines: Column) -> Column:
        def keep(n: Column) -> Callable[[Column, Column], Column]:
            def test(line: Column, i: Column) -> Column:
                bare = strip(line)
                at_edge = (i < EDGE_LINES) | (i >= n - EDGE_LINES)
                page_like = bare.startswith("Page ") | bare.rlike(r"^\p{Nd}+$") | (F.length(bare) < TINY_LINE)
                return ~(at_edge & (F.length(bare) < SHORT_LINE) & page_like)

            return test

        return let(F.size(lines), lambda n: F.array_join(F.filter(lines, keep(n)), "\n"))

    trimmed = let(F.split(col(text), "\n", -1), without_edges)
    newlines = F.length(col(text)) - F.length(F.replace(col(text), F.lit("\n"), F.lit("")))
    return F.when(newlines >= MIN_LINES, trimmed).otherwise(col(text))


def remove_page_numbers(text: Column | str) -> Column:
    """Drop lines that hold only a number, ``Page n`` or ``n / m``."""
    result = col(text)
    for pattern in (rf"\n{SPACE}*\d+{SPACE}*\n", rf"(?i)\n{SPACE}*Page{SPACE}+\d+{SPACE}*\n",
                    rf"\n{SPACE}*\d+{SPACE}*/{SPACE}*\d+{SPACE}*\n"):
        result = F.regexp_replace(result, FLAGS + pattern, "\n")
    return result


def normalize_whitespace(text: Column | str, preserve_layout: bool = True) -> Column:
    if not preserve_layout:
        # A lone blank is already what it should become, so only other runs are matched.
        return strip(F.regexp_replace(col(text), f"{FLAGS}{SPACE}{{2,}}|[\\s\\x1c-\\x1f&&[^ ]]", " "))
    result = col(text)
    for pattern, replacement in (
        ("[ \t]{2,}|\t", " "), ("\n[ \t]+", "\n"), ("[ \t]+\n", "\n"), ("\n{3,}", "\n\n"),
    ):
        result = F.regexp_replace(result, pattern, replacement)
    return result


def clean_text(text: Column | str, preserve_layout: bool = True) -> Column:
    return normalize_whitespace(remove_page_numbers(remove_headers_footers(text)), preserve_layout)


def word_chunks(
    text: Column | str, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, min_chars: int = MIN_CHUNK_CHARS
) -> Column:
    """Overlapping windows of ``size`` words; short texts stay whole.

    Window i starts at word i * (size - overlap), so the array is built in closed form.
    """
    text = col(text)
    stride = max(size - overlap, 1)

    def pieces(tokens: Column) -> Column:
        windows = F.when(F.size(tokens) <= size, 1).otherwise(1 + F.ceil((F.size(tokens) - size) / F.lit(stride)))
        return F.transform(
            F.sequence(F.lit(0), windows.cast("int") - 1),
            lambda i: F.array_join(F.slice(tokens, i * stride + 1, size), " "),
        )

    kept = F.filter(let(words(text), pieces), lambda p: F.length(p) >= min_chars)
    nothing = F.array().cast("array<string>")
    short = F.when(strip(text) != "", F.array(text)).otherwise(nothing)
    whole = F.when(strip(text) != "", F.array(strip(text))).otherwise(nothing)
    long = let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(whole))
    return F.when(F.length(text) < min_chars, short).otherwise(long)


@dataclass
class CleanDocuments:
    """Documents with ``cleaned``; ``chunks`` explodes them; ``stats`` has one row per document."""

    table: DataFrame
    key: str

    def chunks(self, **sizes) -> DataFrame:
        return chunk_table(self.table, self.key, "cleaned", **sizes)

    def stats(self, original: str) -> DataFrame:
        counted = self.table.withColumn("__chunks", word_chunks("cleaned"))
        return counted.select(
            self.key, F.length(original).alias("original_length"), F.length("cleaned").alias("final_length"),
            F.size("__chunks").alias("chunks_created"),
        )


def clean_documents(df: DataFrame, key: str, text: str, preserve_layout: bool = True) -> CleanDocuments:
    return CleanDocuments(df.withColumn("cleaned", clean_text(text, preserve_layout)), key)


def chunk_table(df: DataFrame, key: str, text: str, **sizes) -> DataFrame:
    """One row per chunk: resource, index, id, text and estimated token count."""
    return df.select(key, F.posexplode(word_chunks(text, **sizes)).alias("chunk_index", "chunk")).select(
        key, "chunk_index", F.concat(F.col(key).cast("string"), F.lit("_chunk_"), "chunk_index").alias("chunk_id"),
        "chunk", F.floor(F.length("chunk") / 4).alias("token_count"),
    )
