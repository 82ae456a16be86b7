"""Greedy segmentation of texts into chunks of speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip

# Shortest chunk, longest chunk, and how far a chunk may look for a space.
MIN_CHARS, MAX_CHARS, WINDOW = 160, 220, 320

#: The next chunk, by preference: all that is left if it fits; up to the last sentence end, else the last clause end, between
#: MIN_CHARS and MAX_CHARS; up to the first space after MAX_CHARS in the window, else the last one before; MAX_CHARS characters.
_CHUNK = "|".join([
    rf"\S(?:.{{0,{MAX_CHARS - 2}}}\S)?(?=\s*+\z)",
    rf".{{{MIN_CHARS},{MAX_CHARS - 1}}}[.!?]",
    rf".{{{MIN_CHARS},{MAX_CHARS - 1}}}[,;]",
    rf".{{{MAX_CHARS},{WINDOW - 1}}}?(?= )",
    rf".{{{MIN_CHARS},{MAX_CHARS - 1}}}(?= )",
    rf".{{{MAX_CHARS}}}",
])


def newline_pauses(text: Column) -> Column:
    """Line ends as pauses: a wrapped line is rejoined, a line end is a comma, a paragraph end a full stop."""
    low = r"(?=[\"'(]?\p{IsLowercase})"
    t = F.regexp_replace(text, rf"-\n(?!\n){low}", "\u0003")  # a hyphen at a wrap, marked until all line ends are read
    t = F.regexp_replace(t, rf"(?<=[^ \n])\n(?!\n){low}", " ")
    t = F.regexp_replace(t, rf"(?<=^| )\n(?!\n){low}", "")
    t = F.regexp_replace(t, r"^\n+", " ")
    t = F.regexp_replace(t, r"(?<![.!?,;:\n])\n{2,}", ". ")
    t = F.regexp_replace(t, r"(?<![.!?,;:\n])\n(?!\n)", ", ")
    return strip(F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("\u0003"), F.lit("")), r"\n+", " "), " +", " "))


def segment(text: Column, newlines: bool = True) -> Column:
    """array<string> of the chunks of a text, one empty chunk for an empty text.

    One pass of one pattern: each chunk starts where the one before ended, so time follows the length of the text.
    """
    t = newline_pauses(text) if newlines else strip(text)
    chunks = F.transform(F.regexp_extract_all(t, F.lit(rf"(?sU)\s*+({_CHUNK})"), F.lit(1)), strip)
    return F.when(t == "", F.array(t)).otherwise(F.filter(chunks, lambda c: c != ""))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", newlines: bool = True) -> DataFrame:
    """(doc_id, chunk_index, text): one row per chunk."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(segment(F.col(text_col), newlines)).alias("chunk_index", "text"))
