"""Mixtures of sources at target shares, as a min-cost flow from groups of documents to quotas."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.tokens import BYTE_BPE, token_sizes
from palimpsest.operators.selection import select_ranks
from palimpsest.shared import write_shared

#: Bits of the seeded hash that orders documents.
HASH_BITS = 60

Pattern = tuple[str, ...]
Targets = dict[str, tuple[float, int]]


class Flow:
    """Tokens sent from patterns (the sets of sources that documents have in common) to those sources.

    The graph is source of flow -> pattern -> source of documents -> sink. A pattern's tokens can be used ``limit`` times over
    all its sources, and the r-th use costs 2r - 1 a token. The cost lies on the arcs into patterns alone, so an augmenting
    path never takes flow back from a pattern and costs what its first arc costs: the cheapest paths are those of the lowest
    use that still has room. Filling the uses one after the other, each with a plain maximum flow, therefore gives a maximum
    flow of least cost.

    Flow is held for each pair of a pattern and one of its sources. Paths run over sources: more flow for one lets patterns that
    it shares with another send theirs there. All patterns between two sources move at once, so the number of paths depends on
    the sources, not on the patterns.
    """

    def __init__(self, patterns: dict[Pattern, int], targets: Targets) -> None:
        self.patterns = list(patterns)
        self.sources = sorted({s for p in self.patterns for s in p})
        place = {s: i for i, s in enumerate(self.sources)}
        self.tokens = np.array([patterns[p] for p in self.patterns], np.int64)
        self.limit = np.array([min(targets[s][1] for s in p) for p in self.patterns], np.int64)
        self.pattern_of = np.array([i for i, p in enumerate(self.patterns) for _ in p], np.int64)
        self.source_of = np.array([place[s] for p in self.patterns for s in p], np.int64)
        self.pairs = [np.flatnonzero(self.source_of == i) for i in range(len(self.sources))]
        self.flow = np.zeros(len(self.pattern_of), np.int64)

    def used(self) -> np.ndarray:
        return np.add.reduceat(self.flow, np.flatnonzero(np.diff(self.pattern_of, prepend=-1))) if len(self.flow) else np.zeros(0, np.int64)

    def run(self, quotas: dict[str, int]) -> int:
        """Send up to each quota at least cost, and return what was sent."""
        self.flow[:] = 0
        need = np.array([quotas[s] for s in self.sources], np.int64)
        for r in range(1, int(self.limit.max(initial=0)) + 1):
            self._fill(np.minimum(self.limit, r) * self.tokens - self.used(), need)
            if not need.any():
                break
        return int(self.flow.sum())

    def reaches(self, quotas: dict[str, int]) -> bool:
        self.flow[:] = 0
        need = np.array([quotas[s] for s in self.sources], np.int64)
        self._fill(self.limit * self.tokens, need)
        return not need.any()

    def _fill(self, room: np.ndarray, need: np.ndarray) -> None:
        while (path := self._path(room, need)) is not None:
            first = self.pairs[path[0]]
            hops = [self._shared(a, b) for a, b in zip(path, path[1:])]
            most = min([int(need[path[-1]]), int(room[self.pattern_of[first]].sum()), *(int(self.flow[out].sum()) for out, _ in hops)])
            taken = _split(room[self.pattern_of[first]], most)
            room[self.pattern_of[first]] -= taken
            for out, into in hops:
                moved = _split(self.flow[out], most)
                self.flow[out] -= moved
                self.flow[into] += moved
            self.flow[first] += taken
            need[path[-1]] -= most

    def _shared(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of source ``a`` and of source ``b`` of the patterns that have both."""
        _, i, j = np.intersect1d(self.pattern_of[self.pairs[a]], self.pattern_of[self.pairs[b]], assume_unique=True, return_indices=True)
        return self.pairs[a][i], self.pairs[b][j]

    def _path(self, room: np.ndarray, need: np.ndarray) -> list[int] | None:
        """The shortest way to a source that needs tokens, over sources."""
        came: dict[int, int | None] = {s: None for s, own in enumerate(self.pairs) if (room[self.pattern_of[own]] > 0).any()}
        level = list(came)
        while level:
            for s in level:
                if need[s] > 0:
                    path = [s]
                    while came[path[-1]] is not None:
                        path.append(came[path[-1]])
                    return path[::-1]
            after = []
            for a in level:
                sends = np.zeros(len(self.patterns), bool)
                sends[self.pattern_of[self.pairs[a][self.flow[self.pairs[a]] > 0]]] = True
                for b in np.unique(self.source_of[sends[self.pattern_of]]).tolist():
                    if b not in came:
                        came[b] = a
                        after.append(b)
            level = after
        return None


def _split(rooms: np.ndarray, total: int) -> np.ndarray:
    """``total`` taken from ``rooms`` in their order."""
    before = np.cumsum(rooms) - rooms
    return np.clip(total - before, 0, rooms)


def _quotas(targets: Targets, total: int) -> dict[str, int]:
    return {s: int(share * total) for s, (share, _) in targets.items()}


def route(patterns: dict[Pattern, int], targets: Targets, total: int) -> tuple[int, dict[tuple[Pattern, str], int]]:
    """The tokens reached of ``total`` and those of each (pattern, source), at the least number of repetitions."""
    flow = Flow(patterns, targets)
    reached = flow.run(_quotas(targets, total)) if patterns else 0
    return reached, {(flow.patterns[p], flow.sources[s]): n for p, s, n in zip(flow.pattern_of.tolist(), flow.source_of.tolist(), flow.flow.tolist())}


def largest_total(patterns: dict[Pattern, int], targets: Targets) -> int:
    """The largest total at which every source that has tokens reaches its share of it."""
    flow = Flow(patterns, targets)
    live = [s for s in flow.sources if targets[s][0] > 0]
    if not live:
        return 0
    own = np.bincount(flow.source_of, (flow.limit * flow.tokens)[flow.pattern_of].astype(float), len(flow.sources))
    low, high = 0, int(min((own[flow.sources.index(s)] + 1) / targets[s][0] for s in live)) + 1
    while low < high:
        middle = (low + high + 1) // 2
        if flow.reaches(_quotas(targets, middle)):
            low = middle
        else:
            high = middle - 1
    return low


def _uses(tokens: int, parts: list[tuple[str, int]]) -> tuple[list[int], list[list[tuple[str, int]]]]:
    """Where a pattern's line of documents is cut, and how often each piece is used for which source.

    The parts follow each other along the line, which starts again at its end: so no document is used more than once more than
    another, however the parts are shared out.
    """
    ends = np.cumsum([n for _, n in parts]).tolist()
    cuts = sorted({e % tokens for e in ends} - {0})
    pieces = []
    for begin in [0, *cuts]:
        counts: dict[str, int] = {}
        for lap in range(math.ceil((ends[-1] - begin) / tokens) if ends else 0):
            source = next(s for (s, _), e in zip(parts, ends) if begin + lap * tokens < e)
            counts[source] = counts.get(source, 0) + 1
        pieces.append(sorted(counts.items()))
    return cuts, pieces


def mix_sources(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """The documents of the mix: doc_id, source it is drawn for, n_tokens, repeats.

    ``sizes``: doc_id bigint, sources array<string>, n_tokens bigint, and ``ids`` map<string, bigint> if a document has another
    id in each source. ``targets``: source, target_share, max_repeats; shares are of the whole mix. ``total`` tokens; by default
    the largest total at which every source with documents reaches its share. A source without documents stays at 0, and one
    that can't reach its share gives all it has.

    A document of several sources is one document: it is used for all of them together no more often than the lowest
    ``max_repeats`` of its sources, and the flow decides which of them it serves. Documents without doc_id, tokens or a targeted
    source are never drawn; target rows without source, share or limit are left out.

    Of documents only one row for each combination of sources that occurs comes to the driver, at most 2**n - 1 of n targeted
    sources. Within a combination documents stand in the order of a seeded hash; the hashes at which the parts of its sources
    end are found by histograms of tokens, not by sorting. A part misses its size by half a document at each end.
    """
    spark = sizes.sparkSession
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.dropna(subset=["source", "target_share", "max_repeats"]).collect()}
    wanted = {s: t for s, t in wanted.items() if t[0] > 0 and t[1] > 0}
    pattern = F.array_sort(F.array_distinct(F.array_intersect("sources", F.array(*[F.lit(s) for s in sorted(wanted)]).cast("array<string>"))))
    ids = [F.col("ids")] if "ids" in sizes.columns else []
    own = sizes.select("doc_id", "n_tokens", *ids, pattern.alias("pattern")).filter((F.col("n_tokens") > 0) & F.col("doc_id").isNotNull() & (F.size("pattern") > 0))
    patterns = {tuple(r["pattern"]): r["n"] for r in own.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()}
    _, flows = route(patterns, wanted, largest_total(patterns, wanted) if total is None else total)
    names = sorted(patterns)
    lines = [_uses(patterns[p], [(s, flows[p, s]) for s in p if flows[p, s]]) for p in names]
    numbers = F.broadcast(spark.createDataFrame([(i, list(p)) for i, p in enumerate(names)], "line bigint, pattern array<string>"))
    place = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("u")
    drawn = own.join(numbers, "pattern").select("doc_id", "n_tokens", *ids, "line", place)
    found = select_ranks(drawn, "line", "u", [(i, c) for i, (cuts, _) in enumerate(lines) for c in cuts], 0, (1 << HASH_BITS) - 1, weight="n_tokens")
    ends: dict[int, list[int]] = {i: [] for i in range(len(lines))}
    for (i, cut), (u, below, to) in sorted(found.items()):
        ends[i].append(u if to - cut <= cut - below else u - 1)  # the document across a cut goes where most of it lies
    plan = F.broadcast(spark.createDataFrame([(i, ends[i], pieces) for i, (_, pieces) in enumerate(lines)], "line bigint, ends array<bigint>, pieces array<array<struct<source: string, repeats: int>>>"))
    piece = F.col("pieces")[F.size(F.filter("ends", lambda e: e < F.col("u")))]
    rows = drawn.join(plan, "line").select("doc_id", "n_tokens", *ids, F.explode(piece).alias("use")).select("doc_id", "n_tokens", *ids, "use.source", "use.repeats")
    shown = F.coalesce(F.col("ids")[F.col("source")], F.col("doc_id")) if ids else F.col("doc_id")
    return rows.select(shown.alias("doc_id"), "source", "n_tokens", "repeats")


def document_sizes(documents: DataFrame, targets: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """Every text of a targeted source once, with the sources that hold it: doc_id, sources, n_tokens, ids.

    Copies of a text under several ids are one document; ``ids`` has the lowest id of it in each source, ``doc_id`` the lowest of
    all. Copies are first merged within a source, map-side, so that a text that makes up much of the corpus is no hot key.
    """
    wanted = targets.select("source").dropna().distinct()
    own = documents.filter(F.col("doc_id").isNotNull()).join(F.broadcast(wanted), "source", "left_semi")  # a row for each target
    sized = token_sizes(own.select("doc_id", "source", F.unhex(F.sha2("text", 256)).alias("hash"), "text"), tokenizer).filter("n_tokens > 0")
    each = sized.groupBy("hash", "source").agg(F.min("doc_id").alias("id"), F.min("n_tokens").alias("n_tokens"))
    units = each.groupBy("hash").agg(F.min("id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("source", "id"))).alias("held"), F.min("n_tokens").alias("n_tokens"))
    return write_shared(units.select("doc_id", F.col("held.source").alias("sources"), "n_tokens", F.map_from_entries("held").alias("ids")), "sizes")


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Of every target source: target_share, tokens and reached_share of the mix, documents drawn and most_repeats."""
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    both = targets.select("source", "target_share", "max_repeats").join(used, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0)).cast("bigint")
    share = F.coalesce(F.try_divide(tokens.cast("double"), F.sum("tokens").over(W.partitionBy())), F.lit(0.0))  # a row for each target
    return both.select("source", "target_share", "max_repeats", tokens.alias("tokens"), share.alias("reached_share"), F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
