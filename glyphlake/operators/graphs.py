"""Weighted graphs (transducers) as rows: composition, trimming, pruning and best paths.

A row holds one graph: ``arcs`` (src, dst, isym, osym, cost) and ``finals`` (state, cost). State 0 starts, symbol 0 is
epsilon, costs are -ln p and must not form a cycle of negative cost. Graphs are small (one utterance, or a model
that is broadcast), so each is worked on whole inside its row; rows are independent of each other.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARCS = "array<struct<src:int,dst:int,isym:int,osym:int,cost:double>>"
FINALS = "array<struct<state:int,cost:double>>"


@dataclass
class Graph:
    arcs: list[tuple[int, int, int, int, float]]
    finals: dict[int, float] = field(default_factory=dict)

    def _distances(self, ends: dict[int, float], back: bool) -> dict[int, float]:
        out = defaultdict(list)
        for a, b, _, _, w in self.arcs:
            out[b if back else a].append((a if back else b, w))
        best, todo = dict(ends), deque(ends)
        while todo:
            s = todo.popleft()
            for t, w in out[s]:
                if best[s] + w < best.get(t, np.inf) - 1e-12:
                    best[t] = best[s] + w
                    todo.append(t)
        return best

    def forward(self) -> dict[int, float]:
        """Cheapest cost from the start, of every state that can be reached."""
        return self._distances({0: 0.0}, False)

    def backward(self) -> dict[int, float]:
        """Cheapest cost to an end, of every state that comes to one."""
        return self._distances(self.finals, True)

    def prune(self, beam: float = np.inf) -> Graph:
        """Without what no path from the start to an end, or none within ``beam`` of the best, goes through."""
        a, b = self.forward(), self.backward()
        limit = b.get(0, np.inf) + beam + 1e-9
        arcs = [x for x in self.arcs if a.get(x[0], np.inf) + x[4] + b.get(x[1], np.inf) <= limit and np.isfinite(a.get(x[0], np.inf) + b.get(x[1], np.inf))]
        return Graph(arcs, {s: w for s, w in self.finals.items() if a.get(s, np.inf) + w <= limit and s in a})

    def compose(self, other: Graph) -> Graph:
        """Paths whose outputs here are inputs there. Moves without output come before moves without input, so no pair of paths is made twice."""
        mine, theirs = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for x in self.arcs:
            mine[x[0]].append(x)
        for x in other.arcs:
            theirs[x[0]][x[2]].append(x)
        number, todo, arcs, finals = {(0, 0, 0): 0}, [(0, 0, 0)], [], {}

        def to(state: tuple[int, int, int]) -> int:
            if state not in number:
                number[state] = len(number)
                todo.append(state)
            return number[state]

        while todo:
            at = todo.pop()
            p, q, waits = at
            if p in self.finals and q in other.finals:
                finals[number[at]] = self.finals[p] + other.finals[q]
            for _, d, i, o, w in mine[p]:
                if o:
                    arcs += [(number[at], to((d, e, 0)), i, out, w + v) for _, e, _, out, v in theirs[q][o]]
                elif not waits:
                    arcs.append((number[at], to((d, q, 0)), i, 0, w))
            arcs += [(number[at], to((p, e, 1)), 0, out, v) for _, e, _, out, v in theirs[q][0]]
        return Graph(arcs, finals).prune()

    def best(self, n: int = 1, beam: float = np.inf) -> list[tuple[list[int], float]]:
        """The ``n`` cheapest distinct outputs within ``beam`` of the best, each with its cheapest cost; ties by the output."""
        g = self.prune(beam)
        rest, out = g.backward(), defaultdict(list)
        if 0 not in rest:
            return []
        for a, b, _, o, w in g.arcs:
            out[a].append((b, o, w))
        heap: list[tuple[float, tuple[int, ...], int, float, bool]] = [(rest[0], (), 0, 0.0, False)]
        found: dict[tuple[int, ...], float] = {}
        gone: dict[tuple[int, tuple[int, ...]], float] = {}
        while heap and len(found) < n:
            total, said, s, cost, ended = heapq.heappop(heap)
            if total > rest[0] + beam + 1e-9:
                break
            if ended:
                found.setdefault(said, cost)
                continue
            if gone.get((s, said), np.inf) <= cost:
                continue
            gone[(s, said)] = cost
            if s in g.finals:
                heapq.heappush(heap, (cost + g.finals[s], said, s, cost + g.finals[s], True))
            for t, o, w in out[s]:
                heapq.heappush(heap, (cost + w + rest[t], (*said, o) if o else said, t, cost + w, False))
        return [(list(said), cost) for said, cost in found.items()]


def chain(symbols: list[int]) -> Graph:
    """The acceptor of one sequence."""
    return Graph([(k, k + 1, s, s, 0.0) for k, s in enumerate(symbols)], {len(symbols): 0.0})


def _read(arcs, finals) -> Graph:
    return Graph([(int(x["src"]), int(x["dst"]), int(x["isym"]), int(x["osym"]), float(x["cost"])) for x in arcs], {int(x["state"]): float(x["cost"]) for x in finals})


def changed(graphs: DataFrame, change: Callable[[Graph], Graph], key: str = "utt_id") -> DataFrame:
    """(key, arcs, finals) after ``change`` of each graph; one without a path keeps empty arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, arcs, finals in zip(b[key], b["arcs"], b["finals"]):
                g = change(_read(arcs, finals))
                rows.append((k, [dict(zip(("src", "dst", "isym", "osym", "cost"), x)) for x in g.arcs], [{"state": s, "cost": w} for s, w in g.finals.items()]))
            yield pd.DataFrame(rows, columns=[key, "arcs", "finals"])

    return graphs.select(key, "arcs", "finals").mapInPandas(run, f"{key} {dict(graphs.dtypes)[key]}, arcs {ARCS}, finals {FINALS}")


def pruned(graphs: DataFrame, beam: float = 4.0, key: str = "utt_id") -> DataFrame:
    return changed(graphs, lambda g: g.prune(beam), key)


def composed(graphs: DataFrame, model: Graph, *more: Graph, key: str = "utt_id") -> DataFrame:
    """Each graph with a model, then with further ones; the models are sent to the workers with the function."""

    def all_of(g: Graph) -> Graph:
        for m in (model, *more):
            g = g.compose(m)
        return g

    return changed(graphs, all_of, key)


def best_paths(graphs: DataFrame, n: int = 1, beam: float = np.inf, key: str = "utt_id", keep_empty: bool = False) -> DataFrame:
    """(key, rank, tokens, cost) of the ``n`` best distinct outputs; a graph without a path gives no row, or with ``keep_empty`` one without tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, arcs, finals in zip(b[key], b["arcs"], b["finals"]):
                found = _read(arcs, finals).best(n, beam)
                rows += [(k, r, tokens, cost) for r, (tokens, cost) in enumerate(found)] or ([(k, 0, [], None)] if keep_empty else [])
            yield pd.DataFrame(rows, columns=[key, "rank", "tokens", "cost"])

    return graphs.select(key, "arcs", "finals").mapInPandas(run, f"{key} {dict(graphs.dtypes)[key]}, rank int, tokens array<int>, cost double")


def sausage(slots: Column) -> Column:
    """Arcs of a confusion network: ``slots`` is an array of arrays of (sym, cost), in order."""
    return F.flatten(F.transform(slots, lambda alts, k: F.transform(alts, lambda x: F.struct(k.alias("src"), (k + 1).alias("dst"), x["sym"].alias("isym"), x["sym"].alias("osym"), x["cost"].alias("cost")))))


def without_silent_slots(slots: Column) -> Column:
    """Slots whose only alternative is epsilon go."""
    return F.filter(slots, lambda alts: ~((F.size(alts) == 1) & (F.get(alts, F.lit(0))["sym"] == 0)))


def scaled(lm: Column, acoustic: Column, lm_scale: float = 1.0, acoustic_scale: float = 0.1) -> Column:
    return lm * lm_scale + acoustic * acoustic_scale


def distinct_outputs(hypotheses: DataFrame, key: list[str], output: str, cost: str = "cost") -> DataFrame:
    """Hypotheses with one output are one, at its cheapest cost."""
    return hypotheses.groupBy(*key, output).agg(F.min(cost).alias(cost))


def trie(words: list[tuple[list[int], float]], silence: int = 1) -> Graph:
    """Letters to word numbers: one branch for each prefix, back at the root after the silence that ends a word; -ln p of the word is spread as early as prefixes allow."""
    mass: dict[tuple[int, ...], float] = defaultdict(float)
    for letters, p in words:
        for k in range(len(letters) + 1):
            mass[tuple(letters[:k])] += p
    state = {prefix: k for k, prefix in enumerate(sorted(mass, key=lambda x: (len(x), x)))}
    arcs = [(state[x[:-1]], state[x], x[-1], 0, float(np.log(mass[x[:-1]] / mass[x]))) for x in state if x]
    arcs += [(state[tuple(letters)], 0, silence, k, float(np.log(mass[tuple(letters)] / p))) for k, (letters, p) in enumerate(words, 1)]
    return Graph(arcs, {0: 0.0})
