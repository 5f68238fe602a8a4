"""Functions that run in Python workers.

They are sent by value, so executors need pandas but not this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value


def similar(text: str, kept: list[SequenceMatcher], threshold: float) -> bool:
    """Is ``text`` a near copy of a kept text? Cheap upper bounds come first."""
    text = text.lower()
    for matcher in kept:
        matcher.set_seq1(text)
        if (
            matcher.real_quick_ratio() >= threshold
            and matcher.quick_ratio() >= threshold
            and matcher.ratio() >= threshold
        ):
            return True
    return False


def _matcher(kept_text: str) -> SequenceMatcher:
    return SequenceMatcher(None, "", kept_text.lower())


def pick_front(threshold: float, front: int):
    """Greedy choice among the first ``front`` rows of one theme."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        more = len(rows) > front
        rows = rows.iloc[:front]
        need = int(rows["need"].iloc[0])
        kept, chosen = [], []
        for at, body in enumerate(rows["text"]):
            if similar(body, kept, threshold):
                continue
            kept.append(_matcher(body))
            chosen.append(at)
            if len(chosen) == need:
                break
        out = rows.iloc[chosen].drop(columns=["rank"])
        start = int(rows["taken"].iloc[0])
        return out.assign(
            seq=range(start + 1, start + 1 + len(out)),
            more=more,
            last_distance=rows["distance"].iloc[-1],
            last_id=rows["id"].iloc[-1],
        ).drop(columns=["need", "taken"])

    return pick


def drop_similar(threshold: float):
    """Drop rows that are near copies of a text kept for their theme."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[tuple[str, ...], list[SequenceMatcher]] = {}
        for frame in frames:
            keep = []
            for body, kept in zip(frame["text"], frame["kept"]):
                key = tuple(kept)
                if key not in cache:
                    if len(cache) > 256:
                        cache.clear()
                    cache[key] = [_matcher(k) for k in key]
                keep.append(not similar(body, cache[key], threshold))
            yield frame[pd.Series(keep, index=frame.index, dtype=bool)].drop(columns=["kept"])

    return run


register_pickle_by_value(sys.modules[__name__])
