"""Tokens of lines of text, in three modes.

``corpus_en``: lower case, letters and ``'`` alone; a piece of which nothing is left keeps its place and breaks chains.
``syllable``: lower case only, so punctuation stays on the piece.
``history``: NFC, curly quotes made straight, lower case without a final-sigma rule, letters and ``'``; empty pieces are
dropped first, so their neighbours join.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("corpus_en", "syllable", "history")
_SPACE = r"\p{IsWhite_Space}+"
_NOT_WORD = r"[^\p{IsAlphabetic}']"


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    def one(s):
        if s is None or s.isascii():
            return s
        s = unicodedata.normalize("NFC", s)
        # one character at a time, so that a last capital sigma is like any other
        return "".join(c.lower() for c in s) if "Σ" in s else s

    return text.map(one, na_action="ignore")


def pieces(line: Column) -> Column:
    """The runs without white space."""
    return F.array_remove(F.split(line, _SPACE), "")


def normalize(piece: Column, mode: str = "corpus_en") -> Column:
    if mode == "syllable":
        return F.lower(piece)
    if mode == "corpus_en":
        return F.regexp_replace(F.lower(piece), _NOT_WORD, "")
    if mode == "history":
        return F.regexp_replace(F.lower(F.translate(piece, "’‘", "''")), _NOT_WORD, "")
    raise ValueError(f"mode is one of {MODES}")


def piece_tokens(text: Column, mode: str = "corpus_en") -> Column:
    """The token of each piece, ``corpus_en`` or ``syllable``; a regular expression over the text is far cheaper than one for each piece."""
    if mode == "syllable":
        return pieces(F.lower(text))
    own = F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}'\p{IsWhite_Space}]+", "\u0001")
    return F.transform(pieces(own), lambda p: F.translate(p, "\u0001", ""))


def lines(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each line; a line is the scope of a chain.  A carriage return at its end is not part of it."""
    out = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return out.withColumn("line", F.regexp_replace("line", "\r$", ""))


def token_lines(df: DataFrame, mode: str = "corpus_en", text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, line_no, tokens): the tokens of each line in order.  In mode ``history`` the whole text is one line."""
    if mode == "history":
        base = df.select(*keys, F.lit(0).alias("line_no"), _composed(F.col(text)).alias("line"))
        return base.select(*keys, "line_no", F.filter(F.transform(pieces(F.col("line")), lambda p: normalize(p, mode)), lambda x: x != "").alias("tokens"))
    return lines(df, text, keys).select(*keys, "line_no", piece_tokens(F.col("line"), mode).alias("tokens"))


def tokens(df: DataFrame, mode: str = "corpus_en", text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, line_no, pos, token)."""
    return token_lines(df, mode, text, keys).select(*keys, "line_no", F.posexplode("tokens").alias("pos", "token"))
