"""The older two-sided step, which sees its own changes: interior bases from left to right, in Arrow batches against the broadcast spectrum.

`mutations.interior_fixes` judges every place on the read as it stands, by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import bases as B
from kmerloom.operators.lookup import Spectrum, digits_of, keys_of, schema_of, shared_spectrum

_BASES = np.array([1, 2, 3, 4])


def _rescued(d: np.ndarray, places: np.ndarray, k: int, spectrum: Spectrum) -> np.ndarray:
    """For each place and base, whether the k-mer that ends there and the one that starts there are trusted with it."""
    out = np.zeros((len(places), 4), bool)
    if not len(places):
        return out
    around = d[places[:, None] + np.arange(-(k - 1), k)]
    for i, base in enumerate(_BASES):
        around[:, k - 1] = base
        out[:, i] = (spectrum.many(keys_of(around[:, :k])) > 0) & (spectrum.many(keys_of(around[:, k - 1 :])) > 0)
    out[d[places][:, None] == _BASES] = False
    return out


def fixes_in_order(seq: str | None, k: int, spectrum: Spectrum) -> list[tuple[int, str]]:
    """(place, base) of the changes to one read. A place is changed if no trusted k-mer of the read covers it and exactly one base rescues both of its k-mers."""
    if seq is None or len(seq) < 2 * k - 1:
        return []
    d = digits_of(seq)
    hit = spectrum.many(keys_of(np.lib.stride_tricks.sliding_window_view(d, k))) > 0
    total = np.r_[0, np.cumsum(hit)]
    at = np.arange(k - 1, len(d) - k + 1)
    at = at[total[at + 1] == total[at - (k - 1)]]
    rescued, made = _rescued(d, at, k, spectrum), []
    for i, place in enumerate(at.tolist()):
        if rescued[i].sum() == 1:
            d[place] = _BASES[rescued[i].argmax()]
            made.append((place, B.LETTERS[d[place] - 1]))
            end = int(np.searchsorted(at, place + k))
            rescued[i + 1 : end] = _rescued(d, at[i + 1 : end], k, spectrum)
    return made


def interior_in_order(reads: DataFrame, trusted: DataFrame, k: int = B.K) -> DataFrame:
    """(read_id, pos, base): the changes of the older two-sided step. Null and short reads have none; `trusted` must be small enough to be sent to the tasks."""
    shared = shared_spectrum(trusted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(*shared.value, in_order=True)
        for batch in batches:
            made = [fixes_in_order(s, k, spectrum) for s in batch.column(1).to_pylist()]
            row = pa.array([i for i, m in enumerate(made) for _ in m], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([p for m in made for p, _ in m], pa.int32()), pa.array([b for m in made for _, b in m], pa.string())], names=["read_id", "pos", "base"])

    return reads.select("read_id", "seq").where(F.length("seq") >= 2 * k - 1).mapInArrow(run, f"{schema_of(reads, ['read_id'])}, pos INT, base STRING")
