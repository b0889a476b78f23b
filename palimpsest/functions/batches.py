"""Ordered folds over small groups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def length_batches(lengths: Iterable[int], most_rows: int, most_padded: int) -> list[list[int]]:
    """Places of ``lengths``, shortest first, in batches of up to ``most_rows`` whose padded size stays within ``most_padded``."""
    out: list[list[int]] = []
    for size, place in sorted((n, i) for i, n in enumerate(lengths)):
        fits = out and len(out[-1]) < most_rows and (len(out[-1]) + 1) * size <= most_padded
        if fits:
            out[-1].append(place)
        else:
            out.append([place])
    return out


def _unlike(texts: Iterable[str | None], most: float) -> Iterator[bool]:
    """Whether each text is unlike every one kept before; only kept ones that share a word are compared."""
    kept: list[int] = []  # numbers of words
    holders: dict[str, list[int]] = {}
    empty = False
    for text in texts:
        own = set((text or "").lower().split())
        shared: Counter = Counter()
        for word in own:
            shared.update(holders.get(word, ()))
        new = not empty if not own else all(n / (len(own) + kept[i] - n) < most for i, n in shared.items())
        yield new
        if new and own:
            for word in own:
                holders.setdefault(word, []).append(len(kept))
            kept.append(len(own))
        empty = empty or not own


def without_repeats(rows: DataFrame, most: float = 0.8) -> DataFrame:
    """Of each group of (grp, n, text) in the order of n the texts unlike every one kept before: adds ``kept``. Texts without words are alike.

    Whether a text is kept depends on those before it, so a group is read in order by one task, which holds the words of what it
    keeps: it is for the statements of a day. Rows stream by; a null group is a group.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, judge, queue = object(), None, []
        for pdf in batches:
            kept = []
            for grp, text in zip(pdf["grp"], pdf["text"]):
                if grp != of:
                    of, queue = grp, []
                    judge = _unlike(iter(queue.pop, None), most)
                queue.append(text if text is not None else "")
                kept.append(next(judge))
            yield pdf.assign(kept=kept)

    ordered = rows.select("grp", "n", "text").repartition("grp").sortWithinPartitions("grp", "n")
    return ordered.mapInPandas(fold, "grp string, n bigint, text string, kept boolean")
