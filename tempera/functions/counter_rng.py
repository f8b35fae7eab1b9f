"""Counter-based pseudo-random numbers: the Threefry cipher on two 32-bit lanes.

The key is the 64-bit id of a row or chain; the block holds a 48-bit counter, the top 4 bits of which are the purpose, and
a 16-bit seed. The
cipher maps blocks of a key one to one, so no two (seed, counter) of a key give the same block, and
keys are not offsets into a common cycle. A draw never depends on partitioning: a task that
is run again after an executor loss repeats exactly the same numbers. The Column and the NumPy form agree bit for bit.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published cipher: lane mask, key parity, rotations; 13 rounds is its crush-resistant form.
MASK = 0xFFFFFFFF
PARITY = 0x1BD11BDA
ROTATIONS = (13, 15, 26, 6, 17, 29, 16, 24)
ROUNDS = 13

MAX_SEED = 1 << 16
MAX_COUNTER = 1 << 48
PURPOSE_BITS = 44


def _checked(seed: int) -> int:
    if not 0 <= seed < MAX_SEED:
        raise ValueError(f"a seed lies between 0 and {MAX_SEED - 1}")
    return seed


def purpose(number: int) -> int:
    """What to add to the counters (below 2**44) of a purpose of its own under one seed, such as acceptance beside proposals.

    The purpose is part of the block, so neither purposes of one seed nor neighbouring seeds share a number.
    """
    if not 0 <= number < MAX_COUNTER >> PURPOSE_BITS:
        raise ValueError(f"a purpose lies between 0 and {(MAX_COUNTER >> PURPOSE_BITS) - 1}")
    return number << PURPOSE_BITS


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK).cast("long"))


def uniform_column(key: Column, counter: Column | int, seed: int) -> Column:
    """A uniform on (0, 1) with 52 random bits; counters must stay below 2**48.

    The rounds are a fold over their constants, so the expression stays small
    wherever the optimizer copies it to.
    """
    key, counter = key.cast("long"), (F.lit(counter) if isinstance(counter, int) else counter).cast("long")
    k0, k1 = _low(key), _low(F.shiftright(key, 32))
    ks = (k0, k1, k0.bitwiseXOR(k1).bitwiseXOR(F.lit(PARITY).cast("long")))
    zero = F.lit(0).cast("long")
    rounds = []
    for i in range(ROUNDS):
        j = i // 4 + 1
        added = (ks[j % 3], ks[(j + 1) % 3] + F.lit(j)) if i % 4 == 3 else (zero, zero)
        rounds.append(F.struct(F.lit(ROTATIONS[i % 8]).alias("r"), added[0].alias("a"), added[1].alias("b")))
    high = _low(F.shiftright(counter, 32)) * F.lit(MAX_SEED) + F.lit(_checked(seed))
    start = F.struct(_low(_low(counter) + k0).alias("x"), _low(high + k1).alias("y"))

    def turn(block: Column, step: Column) -> Column:
        x, y = _low(block["x"] + block["y"]), block["y"]
        left = _low(F.call_function("shiftleft", y, step["r"]))
        y = left.bitwiseOR(F.call_function("shiftright", y, F.lit(32) - step["r"])).bitwiseXOR(x)
        return F.struct(_low(x + step["a"]).alias("x"), _low(y + step["b"]).alias("y"))

    def scaled(block: Column) -> Column:
        bits = block["x"] * F.lit(1 << 20) + F.shiftright(block["y"], 12)
        return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))

    return F.aggregate(F.array(*rounds), start, turn, scaled)


def with_uniforms(df: DataFrame, key: Column, counters: dict[str, Column | int], seed: int) -> DataFrame:
    """Add uniforms, one per named counter."""
    return df.withColumns({n: uniform_column(key, c, seed) for n, c in counters.items()})


def box_muller(u: Column, v: Column) -> tuple[Column, Column]:
    """Two standard normals from two uniforms."""
    radius, angle = F.sqrt(F.lit(-2.0) * F.log(u)), F.lit(2.0 * math.pi) * v
    return radius * F.cos(angle), radius * F.sin(angle)


def cipher(k0, k1, c0, c1, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The two lanes of encrypted blocks; all arguments are 32-bit lanes."""
    k0, k1, x, y = np.broadcast_arrays(*(np.asarray(v, dtype=np.uint32) for v in (k0, k1, c0, c1)))
    ks = (k0, k1, k0 ^ k1 ^ np.uint32(PARITY))
    with np.errstate(over="ignore"):
        x, y = x + ks[0], y + ks[1]
        for i in range(rounds):
            r = ROTATIONS[i % 8]
            x = x + y
            y = (y << np.uint32(r) | y >> np.uint32(32 - r)) ^ x
            if i % 4 == 3:
                j = i // 4 + 1
                x, y = x + ks[j % 3], y + ks[(j + 1) % 3] + np.uint32(j)
    return x, y


def uniform(keys: np.ndarray, counter, seed: int) -> np.ndarray:
    keys, counter = np.asarray(keys, dtype=np.int64), np.asarray(counter, dtype=np.int64)
    high = (counter >> 32 & MASK) * MAX_SEED + _checked(seed)
    x, y = cipher(*((v & MASK).astype(np.uint32) for v in (keys, keys >> 32, counter, high)))
    return ((x.astype(np.int64) << 20 | y.astype(np.int64) >> 12) + 0.5) / float(1 << 52)


def normal(keys: np.ndarray, counter, seed: int) -> np.ndarray:
    counter = np.asarray(counter, dtype=np.int64)
    radius = np.sqrt(-2.0 * np.log(uniform(keys, 2 * counter, seed)))
    return radius * np.cos(2.0 * math.pi * uniform(keys, 2 * counter + 1, seed))
