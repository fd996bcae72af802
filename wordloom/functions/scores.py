"""Packed lexicon values, log-quantized weights, and scores that decay with age."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U16, U32 = 65535, 4294967295
DAY = 86_400.0
WORD_HALF_LIFE, EDGE_HALF_LIFE = 14 * DAY, 7 * DAY


def pack(prob: Column, flags: Column, word_id: Column) -> Column:
    """Probability in bits 0-7, flags in 8-15, id from 16."""
    return prob.cast("long").bitwiseOR(F.shiftleft(flags.cast("long"), 8)).bitwiseOR(F.shiftleft(word_id.cast("long"), 16))


def unpack(value: Column) -> dict[str, Column]:
    return {
        "prob": value.bitwiseAND(F.lit(0xFF)).cast("int"),
        "flags": F.shiftright(value, 8).bitwiseAND(F.lit(0xFF)).cast("int"),
        "word_id": F.shiftright(value, 16).bitwiseAND(F.lit(U32)),
    }


@F.pandas_udf(T.IntegerType())
def _weight(count: pd.Series, most: pd.Series) -> pd.Series:
    both = np.concatenate([count.to_numpy(np.float64), most.to_numpy(np.float64)])
    own, at = np.unique(both, return_inverse=True)
    ln = np.array([math.log(x) if x > 0 else 0.0 for x in own.tolist()])[at]
    share = np.clip(ln[: len(count)] / np.maximum(ln[len(count) :], 1.0), 0.0, 1.0)
    return pd.Series(np.floor(share * U16).astype(np.int32))


def quantize(count: Column, most: Column) -> Column:
    """ln(count) over ln(most), in 16 bits; a count of 1 has weight 0.

    Powers of one number have shares that are whole weights (3 of 243 is 13107), where the last bit of a logarithm decides.
    It is the C library's, which other engines use; the JVM's differs from it in one number of a hundred.
    """
    return F.when((count > 0) & (most > 0), _weight(count.cast("double"), most.cast("double"))).otherwise(F.lit(0))


def confidence(weight: Column) -> Column:
    """A weight as a whole percentage."""
    return F.floor(weight / F.lit(float(U16)) * 100).cast("int")


def decay(age: Column, half_life: float) -> Column:
    """2 ** (-age / half life) of seconds of age, which is 0 at least; 0 if there is no half life."""
    return F.pow(F.lit(2.0), -F.greatest(age, F.lit(0)) / F.lit(half_life)) if half_life > 0 else F.lit(0.0)


def _clamped(x: Column) -> Column:
    return F.floor(F.least(F.lit(float(U16)), F.greatest(F.lit(0.0), x))).cast("int")


def word_score(freq: Column, accept: Column, last_used: Column, now: int) -> Column:
    return _clamped(F.log1p(freq * decay(F.lit(now) - last_used, WORD_HALF_LIFE)) * 10_000 + accept * 3_000)


def edge_score(count: Column, last_used: Column, now: int) -> Column:
    return _clamped(F.log1p(count * decay(F.lit(now) - last_used, EDGE_HALF_LIFE)) * 10_000)
