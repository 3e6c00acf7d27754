"""Arrow batches of a sorted partition, cut into runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

ROWS_OUT = 10_000


def runs_of(batches: Iterator[pd.DataFrame], keys: list[str], least: int = 1) -> Iterator[dict[str, list]]:
    """The columns of each run of rows with equal ``keys``, if it has ``least`` rows; it may go on over batches."""
    held: dict[str, list] = {}
    for batch in batches:
        if not len(batch):
            continue
        columns = {name: batch[name].tolist() for name in batch.columns}
        new = np.zeros(len(batch), bool)
        for key in keys:
            values = batch[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(batch))
        first = int(starts[0]) if len(starts) else len(batch)
        if held and any(held[key][-1] != columns[key][0] for key in keys):
            if len(held[keys[0]]) >= least:
                yield held
            held = {}
        for name, values in columns.items():
            held.setdefault(name, []).extend(values[:first])
        if not len(starts):
            continue
        if len(held[keys[0]]) >= least:
            yield held
        inner = ends[:-1] - starts[:-1] >= least
        for a, b in zip(starts[:-1][inner].tolist(), ends[:-1][inner].tolist()):
            yield {name: values[a:b] for name, values in columns.items()}
        last = int(starts[-1])
        held = {name: values[last:] for name, values in columns.items()}
    if held and len(held[keys[0]]) >= least:
        yield held


def in_frames(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)
