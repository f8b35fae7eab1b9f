"""Row types shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# Stand-in for "impossible" log densities; kept finite so max/exp chains stay NaN-free.
NEG_INF = -1.0e300
POS_INF = 1.0e300

VECTOR = T.ArrayType(T.DoubleType(), containsNull=False)

SAMPLE = T.StructType(
    [
        T.StructField("data", VECTOR, False),
        T.StructField("id", T.IntegerType(), False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("calculated", T.BooleanType(), False),
    ]
)

STORED = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        T.StructField("bin", T.IntegerType(), False),
        T.StructField("id", T.LongType(), False),
        T.StructField("data", VECTOR, False),
        T.StructField("weight", T.DoubleType(), False),
    ]
)

CHAIN_DRAW = T.StructType(
    [
        T.StructField("chain", T.LongType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("iter", T.LongType(), False),
        T.StructField("data", VECTOR, False),
        T.StructField("weight", T.DoubleType(), False),
        T.StructField("ee_jumps", T.LongType(), False),
        T.StructField("mh_jumps", T.LongType(), False),
    ]
)

PANEL = T.StructType(
    [
        T.StructField("dt", T.DoubleType(), False),
        T.StructField("var", T.StringType(), False),
        T.StructField("value", T.DoubleType(), False),
    ]
)

CONFIG = T.StructType(
    [
        T.StructField("file", T.StringType(), False),
        T.StructField("section", T.StringType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("value", T.DoubleType(), False),
    ]
)
