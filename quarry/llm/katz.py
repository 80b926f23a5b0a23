"""What the language model shares: which texts are kept from learning, and Katz's discounts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counts up to this one are discounted.
TOP = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; rows without an id are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def discounts(seen: np.ndarray) -> np.ndarray:
    """Katz's d(1) to d(TOP) from the numbers of pairs seen once to TOP + 1 times.

    Where these are too few for Good-Turing (a factor outside 0 to 1), (r - 1/2) / r stands in.
    """
    d = np.array([(r - 0.5) / r for r in range(1, TOP + 1)])
    if seen[0] > 0:
        common = (TOP + 1) * seen[TOP] / seen[0]
        for r in range(1, TOP + 1):
            if seen[r - 1] > 0 and common < 1:
                value = ((r + 1) * seen[r] / seen[r - 1] / r - common) / (1 - common)
                if 0 < value < 1:
                    d[r - 1] = value
    return d
