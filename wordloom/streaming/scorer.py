"""Live novelty of events against a fitted vocabulary.

A count-based frame is not supported on a stream, so each key keeps its last w - 1 values as state; every
new value completes one window, whose word is looked up in the broadcast vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.symbols import breakpoints, paa_weights

OUT = "series long, t long, word string, cnt long, novelty double"


def encode(window: np.ndarray, word_len: int, alphabet: int, flat_std: float) -> str:
    sd = window.std()
    if sd < flat_std:
        return "<flat>"
    z = (window - window.mean()) / sd
    levels = [sum(z[i] * w for i, w in share) for share in paa_weights(len(z), word_len)]
    return "".join(chr(97 + sum(v >= e for e in breakpoints(alphabet))) for v in levels)


def score_stream(points: DataFrame, vocab: list[tuple[str, int]], window: int = 12, word_len: int = 4, alphabet: int = 4, flat_std: float = 1e-3) -> DataFrame:
    """(series, t, word, cnt, novelty) of each completed window of a stream of (series, t, value), in arrival order within a micro-batch sorted by t.

    ``vocab`` is a fitted dictionary of (word, count) and is bounded by alphabet ** word_len.
    """
    counts = dict(vocab)
    denom = sum(counts.values()) + len(counts) + 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = list(state.get[0]) if state.exists else []
        n = state.get[1] if state.exists else 0
        new = pd.concat(list(batches)).sort_values("t", ignore_index=True)
        values, rows = np.array(before + new["value"].tolist()), []
        for i in range(len(before), len(values)):
            if i + 1 >= window:
                word = encode(values[i + 1 - window : i + 1], word_len, alphabet, flat_std)
                c = counts.get(word, 0)
                rows.append((key[0], n + i - len(before) - window + 1, word, c, -math.log((c + 1) / denom)))
        state.update((values[-(window - 1) :].tolist(), n + len(new)))
        yield pd.DataFrame(rows, columns=["series", "t", "word", "cnt", "novelty"])

    return points.groupBy("series").applyInPandasWithState(step, OUT, "tail array<double>, n long", "append", GroupStateTimeout.NoTimeout)
