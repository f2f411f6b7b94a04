"""Counter-based randomness: a 32-bit integer mix, as a column and in NumPy.

A draw depends only on its seed and its own identity (row and column id, or draw
number), never on partitioning, batch shape or task retries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# Multipliers of the public-domain MurmurHash3 32-bit finaliser.
MIX_A = 2246822507
MIX_B = 3266489909
# Odd 32-bit constants that keep rows, columns and streams apart.
ROW_STREAM = 2654435769
COL_STREAM = 2246822519
MASK = 0xFFFFFFFF


def mix_int(x: int) -> int:
    x &= MASK
    x = ((x ^ (x >> 16)) * MIX_A) & MASK
    x = ((x ^ (x >> 13)) * MIX_B) & MASK
    return x ^ (x >> 16)


def mix_array(x: np.ndarray) -> np.ndarray:
    """In-place mix of a ``uint32`` array (arithmetic wraps modulo 2**32)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(MIX_A)
    x ^= x >> np.uint32(13)
    x *= np.uint32(MIX_B)
    x ^= x >> np.uint32(16)
    return x


def stream_key(seed: int, *parts: int) -> int:
    """Fold a seed and counters (iteration, direction) into one 32-bit key."""
    key = mix_int(seed)
    for part in parts:
        key = mix_int(key + part + 1)
    return key


def id_keys(ids: np.ndarray, stream: int, key: int) -> np.ndarray:
    u = ids.astype(np.uint64)
    folded = ((u ^ (u >> np.uint64(32))) & np.uint64(MASK)).astype(np.uint32)
    return mix_array(folded ^ np.uint32(mix_int(stream ^ key)))


def keep_mask(row_keys: np.ndarray, col_keys: np.ndarray, keep: float) -> np.ndarray:
    """Boolean matrix: does the (row, column) cell survive with probability ``keep``."""
    cells = mix_array(row_keys[:, None] ^ col_keys[None, :])
    return cells < np.uint32(min(MASK, int(keep * 2.0**32)))


def _mul32(x: str, c: int) -> str:
    # 32x32-bit product modulo 2**32 without overflowing a signed 64-bit BIGINT
    high = f"shiftleft(({x} * {c >> 16}L) & 65535L, 16)"
    return f"(({high} + {x} * {c & 0xFFFF}L) & {MASK}L)"


def mix_sql(x: str) -> str:
    """The same mix as a SQL expression over a BIGINT below 2**32."""
    for shift, factor in ((16, MIX_A), (13, MIX_B)):
        # each round is bound to a name so that it is computed once
        product = _mul32("y", factor)
        mixed = f"x ^ shiftright(x, {shift})"
        x = (
            f"transform(transform(array({x}), x -> {mixed}), y -> {product})[0]"
        )
    return f"transform(array({x}), x -> x ^ shiftright(x, 16))[0]"


def uniform_column(counter: str, key: int) -> Column:
    """A double in [0, 1) with 53 random bits for each counter below 2**32."""
    high = mix_sql(f"({counter} ^ {mix_int(ROW_STREAM ^ key)}L)")
    low = mix_sql(f"({counter} ^ {mix_int(COL_STREAM ^ key)}L)")
    return F.expr(
        f"double({high} * 2097152L + shiftright({low}, 11)) / 9007199254740992D"
    )
