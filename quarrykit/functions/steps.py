"""Parts of an Arrow batch that are worked on one after another, so that a task's memory is bounded by a part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most most; a larger row is a range of its own."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield begin, end
        begin = end
