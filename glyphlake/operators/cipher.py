"""Noisy substitution cipher: expectation-maximisation and best-path decoding.

A hidden text from a letter language model is matched, shortened (a source symbol without a letter)
and lengthened (a letter without a source symbol) by the alignment model, and its letters are written as source
symbols by the lexical model. Insertions in a row are bounded, so the moves at one position are a chain of
fixed depth and only the position is sequential. The E-step runs in executors over all restarts at once and emits sparse counts; the
parameters, bounded by the alphabets, are broadcast and updated on the driver. Equal sequences are computed once and count as
often as they occur. Where a letter model has one context after a silence (order 2), what follows a silence doesn't depend on what was
before it, so sequences are cut there and distinct words are computed once, with the same results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.operators.graphs import trie
from glyphlake.operators.models import alignment

EPS, SIL = 0, 1


@dataclass
class LetterModel:
    """Arcs (context, symbol, next context, p) of an n-gram model; context 0 is the start. Symbols: 1 silence, 2.. letters."""

    src: np.ndarray
    sym: np.ndarray
    dst: np.ndarray
    p: np.ndarray
    n: int

    @classmethod
    def from_probs(cls, table: dict[tuple[tuple[int, ...], int], float], order: int) -> LetterModel:
        """From p(sym | last symbols); contexts are closed under their arcs, each arc goes to the longest known one."""
        known = {c for c, _ in table} | {()}
        number = {c: k for k, c in enumerate(sorted(known, key=lambda c: (len(c), c)))}

        def after(c: tuple[int, ...], s: int) -> int:
            full = (*c, s)[-(order - 1) :] if order > 1 else ()
            while full not in number:
                full = full[1:]
            return number[full]

        arcs = [(number[c], s, after(c, s), p) for (c, s), p in sorted(table.items()) if p > 0]
        a = np.array(arcs)
        return cls(a[:, 0].astype(np.int64), a[:, 1].astype(np.int64), a[:, 2].astype(np.int64), a[:, 3].astype(float), len(number))


@dataclass
class Parameters:
    """lex[src, tgt] (the last column: deletion), arcs[(from, to, kind)] = p."""

    lex: np.ndarray
    arcs: dict[tuple[int, int, str], float] = field(default_factory=lambda: {(a, b, k): p for a, b, k, p in alignment(0)})

    @property
    def states(self) -> int:
        return 1 + max(max(a, b) for a, b, _ in self.arcs)


class Lattice:
    """Forward, backward and best path of one sequence."""

    def __init__(self, p: Parameters, lm: LetterModel):
        self.p, self.lm = p, lm
        by = lambda kind: [(a, b, w) for (a, b, k), w in p.arcs.items() if k == kind and w > 0]
        self.match, self.insert, self.delete, self.start = by("match"), sorted(by("insert")), by("delete"), by("start")
        self.read_sil, self.put_sil = by("read_silence"), by("insert_silence")
        sil = lm.sym == SIL
        self.sil, self.let = np.flatnonzero(sil), np.flatnonzero(~sil)

    def _go(self, v: np.ndarray, arcs: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.lm.dst[arcs], v[self.lm.src[arcs]] * w, self.lm.n)

    def _back(self, v: np.ndarray, arcs: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.lm.src[arcs], v[self.lm.dst[arcs]] * w, self.lm.n)

    def _mixed(self, a: np.ndarray, moves: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        """Moves into one state share a pass over the arcs: (state, weighted sum of where they come from)."""
        for t in dict.fromkeys(t for _, t, _ in moves):
            yield t, sum(w * a[x] for x, y, w in moves if y == t)

    def _close(self, a: np.ndarray) -> np.ndarray:
        """Moves that read nothing, in the order in which they can follow each other."""
        a, lm = a.copy(), self.lm
        for s, t, w in self.insert:
            a[t] += w * self._go(a[s], self.let, lm.p[self.let])
        for t, mix in self._mixed(a, self.put_sil):
            a[t] += self._go(mix, self.sil, lm.p[self.sil])
        for s, t, w in self.start:
            a[t] += w * a[s]
        return a

    def _close_back(self, b: np.ndarray) -> np.ndarray:
        b, lm = b.copy(), self.lm
        for s, t, w in self.start:
            b[s] += w * b[t]
        back = {t: self._back(b[t], self.sil, lm.p[self.sil]) for t in dict.fromkeys(t for _, t, _ in self.put_sil)}
        for s, t, w in self.put_sil:
            b[s] += w * back[t]
        for s, t, w in reversed(self.insert):
            b[s] += w * self._back(b[t], self.let, lm.p[self.let])
        return b

    def _read(self, a: np.ndarray, s: int) -> np.ndarray:
        out, lm, lex = np.zeros_like(a), self.lm, self.p.lex
        if s == SIL:
            for t, mix in self._mixed(a, self.read_sil):
                out[t] += self._go(mix, self.sil, lm.p[self.sil])
            return out
        e = lm.p[self.let] * lex[s, lm.sym[self.let]]
        for t, mix in self._mixed(a, self.match):
            out[t] += self._go(mix, self.let, e)
        for x, t, w in self.delete:
            out[t] += w * lex[s, -1] * a[x]
        return out

    def _read_back(self, b: np.ndarray, s: int) -> np.ndarray:
        out, lm, lex = np.zeros_like(b), self.lm, self.p.lex
        if s == SIL:
            for x, t, w in self.read_sil:
                out[x] += w * self._back(b[t], self.sil, lm.p[self.sil])
            return out
        e = lm.p[self.let] * lex[s, lm.sym[self.let]]
        back = {t: self._back(b[t], self.let, e) for t in dict.fromkeys(t for _, t, _ in self.match)}
        for x, t, w in self.match:
            out[x] += w * back[t]
        for x, t, w in self.delete:
            out[x] += w * lex[s, -1] * b[t]
        return out

    def forward(self, seq: list[int]) -> tuple[list[np.ndarray], float]:
        """Closed forward vectors, each scaled to sum 1 after reading, and the log likelihood (-inf: no path)."""
        a = np.zeros((self.p.states, self.lm.n))
        a[0, 0] = 1
        out, ll = [self._close(a)], 0.0
        for s in seq:
            a = self._read(out[-1], s)
            z = a.sum()
            if not z > 0:
                return out, -np.inf
            ll += np.log(z)
            out.append(self._close(a / z))
        return out, ll + np.log(out[-1].sum())

    def expect(self, seq: list[int], lex: np.ndarray, ops: dict[tuple[int, int, str], float]) -> float:
        """Adds expected counts to ``lex`` and ``ops``; returns the log likelihood."""
        alpha, ll = self.forward(seq)
        if not np.isfinite(ll):
            return ll
        lm = self.lm
        e0 = lm.p[self.let]

        def arcs_count(a, b, arcs, w):
            return a[lm.src[arcs]] * w * b[lm.dst[arcs]]

        beta = self._close_back(np.ones_like(alpha[0]))
        after = np.ones_like(beta)
        for t in range(len(seq), -1, -1):
            # ``after``: what follows the moves that read; ``beta``: with moves that read nothing.
            a = alpha[t]
            scale = 1.0 / float((a * after).sum())
            for s, d, w in self.insert:
                ops[(s, d, "insert")] = ops.get((s, d, "insert"), 0.0) + scale * float(arcs_count(a[s], beta[d], self.let, w * e0).sum())
            for d in dict.fromkeys(d for _, d, _ in self.put_sil):
                back = self._back(beta[d], self.sil, lm.p[self.sil])
                for s, y, w in self.put_sil:
                    if y == d:
                        ops[(s, d, "insert_silence")] = ops.get((s, d, "insert_silence"), 0.0) + scale * w * float(a[s] @ back)
            if t == 0:
                break
            s = seq[t - 1]
            a = alpha[t - 1]
            read = self._read_back(beta, s)
            scale = 1.0 / float((a * read).sum())
            if s == SIL:
                for x, d, w in self.read_sil:
                    ops[(x, d, "read_silence")] = ops.get((x, d, "read_silence"), 0.0) + scale * float(arcs_count(a[x], beta[d], self.sil, w * lm.p[self.sil]).sum())
            else:
                e = e0 * self.p.lex[s, lm.sym[self.let]]
                for d, mix in self._mixed(a, self.match):
                    lex[s] += np.bincount(lm.sym[self.let], scale * arcs_count(mix, beta[d], self.let, e), lex.shape[1])
                    back = self._back(beta[d], self.let, e)
                    for x, y, w in self.match:
                        if y == d:
                            ops[(x, d, "match")] = ops.get((x, d, "match"), 0.0) + scale * w * float(a[x] @ back)
                for x, d, w in self.delete:
                    c = scale * float((a[x] * w * self.p.lex[s, -1] * beta[d]).sum())
                    lex[s, -1] += c
                    ops[(x, d, "delete")] = ops.get((x, d, "delete"), 0.0) + c
            after = read / read.max()
            beta = self._close_back(after)
        return ll

    def best(self, seq: list[int], beam: float = np.inf) -> tuple[list[int], float]:
        """Letters of the cheapest path and its cost; states beyond the best of their position plus ``beam`` are dropped."""
        lm, n = self.lm, self.lm.n
        cost = np.full((self.p.states, n), np.inf)
        cost[0, 0] = 0
        trail: list[tuple] = []
        link = np.full((self.p.states, n), -1)

        def relax(new, back, source, links, s, t, w, arcs, weights):
            """Arc by arc; ties go to the earlier arc."""
            with np.errstate(divide="ignore"):
                c = source[s][lm.src[arcs]] - np.log(w * weights)
            order = np.lexsort((np.arange(len(c)), c))
            d, first = np.unique(lm.dst[arcs][order], return_index=True)
            k = order[first]
            better = c[k] < new[t, d] - 1e-12
            for dd, kk in zip(d[better], k[better]):
                new[t, dd] = c[kk]
                trail.append((links[s, lm.src[arcs][kk]], int(lm.sym[arcs][kk])))
                back[t, dd] = len(trail) - 1

        def close(c, b):
            for s, t, w in self.insert:
                relax(c, b, c, b, s, t, w, self.let, lm.p[self.let])
            for s, t, w in self.put_sil:
                relax(c, b, c, b, s, t, w, self.sil, lm.p[self.sil])
            for s, t, w in self.start:
                on = c[s] < c[t]
                c[t][on], b[t][on] = c[s][on], b[s][on]

        close(cost, link)
        for s in seq:
            new, back = np.full_like(cost, np.inf), np.full_like(link, -1)
            if s == SIL:
                for x, t, w in self.read_sil:
                    relax(new, back, cost, link, x, t, w, self.sil, lm.p[self.sil])
            else:
                for x, t, w in self.match:
                    relax(new, back, cost, link, x, t, w, self.let, lm.p[self.let] * self.p.lex[s, lm.sym[self.let]])
                for x, t, w in self.delete:
                    with np.errstate(divide="ignore"):
                        c = cost[x] - np.log(w * self.p.lex[s, -1])
                    on = c < new[t]
                    new[t][on], back[t][on] = c[on], link[x][on]
            if not np.isfinite(new.min()):
                return [], np.inf
            new[new > new.min() + beam] = np.inf
            close(new, back)
            cost, link = new, back
        at = np.unravel_index(np.argmin(cost), cost.shape)
        out, k = [], link[at]
        while k >= 0:
            k, sym = trail[k]
            out.append(sym)
        return out[::-1], float(cost[at])


class BatchLattice:
    """``Lattice.expect`` for many sequences at once; counts are added to ``lex`` and ``ops``. Letter models whose arcs fall into blocks only.

    Contexts that can't be reached from the start are left out. Arcs of contexts that share a next one form a block, a small dense
    matrix. Forward vectors are kept at every ``k``-th position, k about the root of the length, and made again from there.
    """

    ROOM, MOST = 1 << 26, 128

    def __init__(self, p: Parameters, lm: LetterModel):
        own = Lattice(p, lm)
        self.own, self.S, self.lex = own, p.states, p.lex.copy()
        self.lex[SIL] = 0
        reached, new = {0}, [0]
        after: dict[int, set[int]] = {}
        for a, b in zip(lm.src.tolist(), lm.dst.tolist()):
            after.setdefault(a, set()).add(b)
        while new:
            new = [b for b in set().union(*(after.get(a, set()) for a in new)) if b not in reached]
            reached.update(new)
        on = np.isin(lm.src, list(reached))
        # Blocks: contexts are joined by the arcs' next contexts.
        top = {g: g for g in reached}

        def find(g: int) -> int:
            while top[g] != g:
                top[g] = top[top[g]]
                g = top[g]
            return g

        first: dict[int, int] = {}
        for a, b in zip(lm.src[on].tolist(), lm.dst[on].tolist()):
            top[find(a)] = find(first.setdefault(b, a))
        order = sorted(reached, key=lambda g: (find(g), g))
        at = {g: k for k, g in enumerate(order)}
        self.n, self.start = len(order), at[0]
        blocks: dict[int, list[int]] = {}
        for g in order:
            blocks.setdefault(find(g), []).append(at[g])
        self.spans: list[tuple[int, int]] = []
        for x in blocks.values():  # small ones together
            if self.spans and x[-1] + 1 - self.spans[-1][0] <= 48:
                self.spans[-1] = self.spans[-1][0], x[-1] + 1
            else:
                self.spans.append((x[0], x[-1] + 1))
        src, dst = (np.array([at[g] for g in x[on].tolist()], np.int64) for x in (lm.src, lm.dst))
        sym, w = lm.sym[on], lm.p[on]
        self.last = np.zeros(self.n, np.int64)
        self.last[dst] = sym
        #: A context has one last symbol here, so counts by context are counts by letter.
        self.single = bool((self.last[dst] == sym).all())
        self.let, self.sil = ([self._block(span, src[k], dst[k], w[k]) for span in self.spans] for k in (sym != SIL, sym == SIL))
        self.size = sum(m.size for _, _, m in self.let)
        self.by_letter = (self.last[None, :] == np.arange(p.lex.shape[1])[:, None]).astype(float)
        self.by_letter[SIL] = 0
        self.e = np.ascontiguousarray(self.lex.T[self.last])
        after_silence = {(t, d) for _, t, _ in own.read_sil for d in dst[sym == SIL].tolist()}
        #: The one (state, context) after a silence was read, if there is one only.
        self.cut = next(iter(after_silence)) if len(after_silence) == 1 else None
        #: [state, kind]: the weights of the moves match, read_silence and insert_silence, each into one state.
        self.w = np.zeros((self.S, 3))
        for k, moves in enumerate((own.match, own.read_sil, own.put_sil)):
            for x, _, w in moves:
                self.w[x, k] += w
        self.gone = [t for _, t, _ in own.delete]
        into, own_state = [t for _, t, _ in own.insert], lambda moves, t: {y for _, y, _ in moves} <= {t}
        plain = own_state(own.match, 2) and own_state(own.read_sil, 1) and own_state(own.put_sil, 1) and {(x, y) for x, y, _ in own.start} <= {(0, 1)}
        chains = len({0, 1, 2, *into, *self.gone}) == 3 + len(into) + len(self.gone) and self.w[1, 1] == self.w[1, 2] == 0 and not {0, 1} & {x for x, _, _ in (*own.insert, *own.delete)}
        self.usable = self.single and plain and chains and len(self.spans) <= 256 and self.size <= 1 << 22

    @staticmethod
    def _block(span: tuple[int, int], src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[slice, np.ndarray, np.ndarray]:
        a, b = span
        k = (src >= a) & (src < b)
        to, row = np.unique(dst[k], return_inverse=True)
        m = np.zeros((len(to), b - a))
        np.add.at(m, (row, src[k] - a), w[k])
        return slice(a, b), to, m

    @staticmethod
    def _go(blocks, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for span, to, m in blocks:
            if len(to):
                out[to] = m @ v[span]
        return out

    @staticmethod
    def _back(blocks, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for span, to, m in blocks:
            if len(to):
                np.matmul(m.T, v[to], out=out[span])
        return out

    def _close(self, a: np.ndarray) -> np.ndarray:
        """In place; what stands in the insertions' states is replaced."""
        for s, t, w in self.own.insert:
            np.multiply(self._go(self.let, a[s]), w, out=a[t])
        a[1] += self._go(self.sil, (self.w[:, 2] @ a.reshape(self.S, -1)).reshape(a.shape[1:]))
        return a

    def _step(self, a: np.ndarray, s: np.ndarray, z: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Reads a symbol of each sequence: closed vectors divided by ``z``, and ``z``, their sum before moves that read nothing if not given."""
        if a.shape[2] != len(s):
            a = np.ascontiguousarray(a[:, :, : len(s)])
        out, silent = np.empty_like(a), s == SIL
        mixed = (self.w[:, :2].T @ a.reshape(self.S, -1)).reshape(2, *a.shape[1:])
        out[0] = 0
        np.multiply(self._go(self.let, mixed[0]), self.e[:, s], out=out[2])
        out[1] = self._go(self.sil, mixed[1]) * silent if silent.any() else 0
        gone = self.lex[s, -1]
        for x, t, w in self.own.delete:
            np.multiply(a[x], w * gone, out=out[t])
        for _, t, _ in self.own.insert:
            out[t] = 0
        read = (1, 2, *self.gone)
        z = sum(out[k].sum(axis=0) for k in read) if z is None else z
        for k in read:
            out[k] *= 1 / np.where(z > 0, z, 1)
        return self._close(out), z

    def expect(self, seqs: list[np.ndarray], weights: np.ndarray, lex: np.ndarray, ops: dict[tuple[int, int, str], float], opens: bool = True, ends: bool = True) -> np.ndarray:
        """The log likelihoods (-inf: no path). ``opens``: the sequences begin at the start, else after a silence was read; ``ends``: they are
        whole up to their end, else they end in a silence after which another one begins. Those without a path add no counts."""
        out, order, at = np.zeros(len(seqs)), sorted(range(len(seqs)), key=lambda k: -len(seqs[k])), 0
        while at < len(order):
            keep = 2 * (int(len(seqs[order[at]]) ** 0.5) + 2) * self.S * self.n * 8
            some = order[at : at + max(1, min(max(self.MOST, 16_000 // self.n), self.ROOM // keep))]
            out[some] = self._group([seqs[k] for k in some], weights[some], lex, ops, opens, ends)
            at += len(some)
        return out

    def _group(self, seqs, weights, lex, ops, opens, ends) -> np.ndarray:
        S, n, own = self.S, self.n, self.own
        lengths = np.array([len(s) for s in seqs])
        T = int(lengths[0])
        syms = np.full((T + 1, len(seqs)), SIL)
        for k, s in enumerate(seqs):
            syms[1 : len(s) + 1, k] = s
        live = [int((lengths >= t).sum()) for t in range(T + 1)] + [0]
        every = max(1, int(T**0.5))
        a = np.zeros((S, n, len(seqs)))
        if opens:
            a[0, self.start] = 1
            a[1, self.start] = sum(w for _, _, w in own.start)
        else:
            a[self.cut] = 1
        a = self._close(a)
        kept, z, ll = {0: a}, [np.ones(len(seqs))], np.zeros(len(seqs))
        with np.errstate(divide="ignore"):
            for t in range(T + 1):
                if t:
                    a, total = self._step(a, syms[t, : live[t]])
                    z.append(total)
                    ll[: live[t]] += np.log(total)
                    if t % every == 0:
                        kept[t] = a
                if ends:
                    ll[live[t + 1] : live[t]] += np.log(a[:, :, live[t + 1] : live[t]].sum(axis=(0, 1)))
        good = np.where(np.isfinite(ll), weights, 0.0)
        add = lambda x, d, kind, c: ops.__setitem__((x, d, kind), ops.get((x, d, kind), 0.0) + float(c))
        moves, inserted = np.zeros((S, 3)), np.zeros(len(own.insert))
        beta, segment = None, {}
        for t in range(T, -1, -1):
            if t not in segment:
                low = t - t % every
                segment = {low: kept.pop(low)}
                for k in range(low + 1, t + 1):
                    segment[k], _ = self._step(segment[k - 1], syms[k, : live[k]], z[k])
            a, j, m = segment.pop(t), live[t + 1], live[t]
            # The moves that read the next symbol, then those that read nothing; sequences that end here have 1 after them. A sequence's
            # vectors are divided by their largest entry; ``scale`` makes counts of products with the forward vectors.
            backs = np.zeros((3, n, m))
            if j:
                s, following = syms[t + 1, :j], beta
                silent = s == SIL
                own_back = [self._back(self.let, following[2] * self.e[:, s])]
                if silent.any():
                    own_back.append(self._back(self.sil, following[1] * silent))
                gone = self.lex[s, -1]
                most = np.max([x.max(axis=0) for x in own_back], axis=0)
                most = np.where(most > 0, most, 1)
                for k, x in enumerate(own_back):
                    np.multiply(x, 1 / most, out=backs[k, :, :j])
                scale = scale * most / np.where(z[t + 1] > 0, z[t + 1], 1)
            else:
                scale = np.zeros(0)
            closing = scale
            if j < m:
                total = a[:, :, j:m].sum(axis=(0, 1)) if ends else np.ones(m - j)
                fresh = good[j:m] / np.where(total > 0, total, 1)
                scale = np.concatenate([scale, fresh])
                closing = scale if ends else np.concatenate([closing, np.zeros(m - j)])
            first = self.w[1, 0] * backs[0]
            first[:, j:] += 1
            backs[2] = self._back(self.sil, first)
            beta = (self.w @ backs.reshape(3, -1)).reshape(S, n, m)
            beta[:, :, j:] += 1
            if j:
                for x, d, w in own.delete:
                    beta[x][:, :j] += following[d] * (w * gone / most)
            for k in range(len(own.insert) - 1, -1, -1):
                x, d, w = own.insert[k]
                back = self._back(self.let, beta[d])
                beta[x] += w * back
                back *= closing
                inserted[k] += w * (a[x].ravel() @ back.ravel())
            if not ends:
                beta[:, :, j:] = 1
            backs[:2] *= scale
            backs[2] *= closing
            moves += self.w * (a.reshape(S, -1) @ backs.reshape(3, -1).T)
            if t:
                s = syms[t, :m]
                lex += (((self.by_letter @ (a[2] * beta[2])) * scale) @ np.eye(len(lex))[s]).T
                for x, d, _ in own.delete:
                    c = np.einsum("nb,nb->b", a[d], beta[d]) * scale
                    lex[:, -1] += np.bincount(s, c, len(lex))
                    add(x, d, "delete", c.sum())
        for k, (x, d, _) in enumerate(own.insert):
            add(x, d, "insert", inserted[k])
        for k, (kind, d) in enumerate((("match", 2), ("read_silence", 1), ("insert_silence", 1))):
            for x in np.flatnonzero(self.w[:, k]):
                add(int(x), d, kind, moves[x, k])
        return ll


class BatchDecoder:
    """The paths of ``Lattice.best`` for many whole sequences at once; all positions' links are kept, bounded by ``ROOM`` bytes or one sequence."""

    ROOM, MOST = 1 << 26, 128

    def __init__(self, p: Parameters, lm: LetterModel, beam: float = np.inf):
        own = Lattice(p, lm)
        self.own, self.lm, self.beam, self.S, self.A = own, lm, beam, p.states, len(lm.src)
        self.kind = np.int16 if 2 * self.S * (self.A + 1) < 1 << 15 else np.int32
        with np.errstate(divide="ignore"):
            self.lex, cost = -np.log(p.lex), -np.log(lm.p)
        self.let, self.sil = self._table(own.let), self._table(own.sil)
        self.put = {id(t): np.where(t < self.A, np.append(cost, np.inf)[t], np.inf) for t in (self.let, self.sil)}
        sym = np.append(lm.sym, 0)
        # By source symbol: an arc's cost with its letter written as that symbol.
        self.match = np.stack([self.put[id(self.let)] + self.lex[s][sym[self.let]] for s in range(len(p.lex))])
        self.src = np.append(lm.src, 0)
        after_silence = {(t, d) for _, t, _ in own.read_sil for d in lm.dst[own.sil].tolist()}
        #: The one (state, context) after a silence was read, if there is one only.
        self.cut = next(iter(after_silence)) if len(after_silence) == 1 else None

    def _table(self, arcs: np.ndarray) -> np.ndarray:
        """[context, k]: the arcs into a context, filled up with the number after the last arc."""
        into = [arcs[self.lm.dst[arcs] == g] for g in range(self.lm.n)]
        out = np.full((self.lm.n, max(1, *map(len, into))), self.A)
        for g, x in enumerate(into):
            out[g, : len(x)] = x
        return out

    def _relax(self, new, back, rows, cost, moves, table, weights, reads: int) -> None:
        """Moves along arcs, those into one state together; ties go to the earlier arc, then to the earlier move."""
        for t in dict.fromkeys(t for _, t, _ in moves):
            mine = [(x, -np.log(w)) for x, y, w in moves if y == t]
            each = np.stack([cost[:, x] + w for x, w in mine])
            pick = each.argmin(axis=0)
            c = np.take_along_axis(each, pick[None], 0)[0][:, self.src[table]] + weights
            k = c.argmin(axis=2)
            c = np.take_along_axis(c, k[:, :, None], 2)[:, :, 0]
            arc = table[np.arange(len(table)), k]
            state = np.array([x for x, _ in mine])[np.take_along_axis(pick, self.src[arc], 1)]
            old = new[rows, t]
            on = c < old - 1e-12
            new[rows, t] = np.where(on, c, old)
            back[rows, t] = np.where(on, (reads * self.S + state) * (self.A + 1) + arc, back[rows, t])

    def _close(self, c, b) -> None:
        every = slice(None)
        for m in self.own.insert:
            self._relax(c, b, every, c, [m], self.let, self.put[id(self.let)], 0)
        self._relax(c, b, every, c, self.own.put_sil, self.sil, self.put[id(self.sil)], 0)
        for s, t, w in self.own.start:
            on = c[:, s] < c[:, t]
            c[:, t][on], b[:, t][on] = c[:, s][on], s * (self.A + 1) + self.A

    def decode(self, seqs: list[list[int]], opens: bool = True, ends: bool = True) -> list[tuple[list[int], float]]:
        """``opens`` and ``ends`` as in ``BatchLattice.expect``."""
        out: list = [None] * len(seqs)
        order, at = sorted(range(len(seqs)), key=lambda k: -len(seqs[k])), 0
        while at < len(order):
            one = (len(seqs[order[at]]) + 1) * self.S * self.lm.n * np.dtype(self.kind).itemsize
            group = order[at : at + max(1, min(self.MOST, self.ROOM // one))]
            for k, found in zip(group, self._group([seqs[k] for k in group], opens, ends)):
                out[k] = found
            at += len(group)
        return out

    def _group(self, seqs: list[list[int]], opens: bool, ends: bool) -> list[tuple[list[int], float]]:
        """Sequences from the longest to the shortest; those that have ended are left out of later positions."""
        lengths = np.array([len(s) for s in seqs])
        syms = np.zeros((len(seqs), int(lengths.max())), np.int64)
        for k, s in enumerate(seqs):
            syms[k, : len(s)] = s
        cost, last = np.full((len(seqs), self.S, self.lm.n), np.inf), [None] * len(seqs)
        cost[(slice(None), *((0, 0) if opens else self.cut))] = 0
        links = []
        for t in range(syms.shape[1] + 1):
            if t:
                live = int((lengths >= t).sum())
                new, back = np.full((live, self.S, self.lm.n), np.inf), np.full((live, self.S, self.lm.n), -1, self.kind)
                s, cost = syms[:live, t - 1], cost[:live]
                rows = np.flatnonzero(s == SIL)
                if len(rows):
                    self._relax(new, back, rows, cost[rows], self.own.read_sil, self.sil, self.put[id(self.sil)], 1)
                rows = np.flatnonzero(s != SIL)
                if len(rows):
                    self._relax(new, back, rows, cost[rows], self.own.match, self.let, self.match[s[rows]], 1)
                    for x, y, w in self.own.delete:
                        c, old = cost[rows, x] - np.log(w) + self.lex[s[rows], -1][:, None], new[rows, y]
                        on = c < old
                        new[rows, y] = np.where(on, c, old)
                        back[rows, y] = np.where(on, (self.S + x) * (self.A + 1) + self.A, back[rows, y])
                least = new.min(axis=(1, 2), keepdims=True)
                new[new > least + self.beam] = np.inf
            else:
                new, back = cost, np.full(cost.shape, -1, self.kind)
            self._close(new, back)
            links.append(back)
            cost = new
            for k in np.flatnonzero(lengths[: len(cost)] == t):
                at = np.unravel_index(np.argmin(cost[k]), cost[k].shape) if ends else self.cut
                last[k] = at, float(cost[k][at])
        return [self._trace(links, k, int(n), *end) for k, (n, end) in enumerate(zip(lengths, last))]

    def _trace(self, links: list[np.ndarray], k: int, t: int, at: tuple, cost: float) -> tuple[list[int], float]:
        if not np.isfinite(cost):
            return [], np.inf
        (s, g), out = at, []
        while (code := int(links[t][k, s, g])) >= 0:
            move, arc = divmod(code, self.A + 1)
            reads, s = divmod(move, self.S)
            t -= reads
            if arc < self.A:
                out.append(int(self.lm.sym[arc]))
                g = self.lm.src[arc]
        return out[::-1], cost


def counted(obs: DataFrame) -> DataFrame:
    """(seq, opens, ends, n) of (syms): each distinct sequence and how often it occurs; ``opens`` and ``ends`` as in ``BatchLattice.expect``."""
    each = obs.groupBy("syms").agg(F.count("*").alias("n")).select(F.col("syms").alias("seq"), F.lit(True).alias("opens"), F.lit(True).alias("ends"), "n")
    # By length, as sequences of like length are computed together; many parts, the longest first, as those are more work.
    cores = obs.sparkSession.sparkContext.defaultParallelism
    return each.repartitionByRange(max(4 * cores, min(obs.count() // 48, 64 * cores)), F.size("seq").desc())


def cut_at_silences(seq) -> list[tuple[bytes, bool, bool]]:
    """(32-bit symbols, opens, ends): the pieces up to each silence, and what comes after the last."""
    x = np.asarray(seq, np.int32)
    at = [0, *(np.flatnonzero(x == SIL) + 1).tolist(), len(x)]
    last = len(at) - 2
    return [(x[a:b].tobytes(), k == 0, k == last) for k, (a, b) in enumerate(zip(at, at[1:]))]


def words_of(sequences: DataFrame) -> DataFrame:
    """``counted`` for whole sequences to the same for their pieces between silences, counted in each batch first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for seq, n in zip(b["seq"], b["n"]):
                for piece in cut_at_silences(seq):
                    found[piece] += int(n)
            yield pd.DataFrame([(x, o, e, n) for (x, o, e), n in found.items()], columns=["key", "opens", "ends", "n"])

    pieces = sequences.mapInPandas(run, "key binary, opens boolean, ends boolean, n long").groupBy("key", "opens", "ends").agg(F.sum("n").alias("n"))

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"seq": [np.frombuffer(x, np.int32) for x in b["key"]], "opens": b["opens"], "ends": b["ends"], "n": b["n"]})

    return pieces.repartition(4 * sequences.sparkSession.sparkContext.defaultParallelism).mapInPandas(back, "seq array<int>, opens boolean, ends boolean, n long")


def expectations(sequences: DataFrame, params: list[Parameters], lm: LetterModel) -> DataFrame:
    """(restart, kind, src, dst, c) over (seq, opens, ends, n): 'lex' counts, alignment kinds, 'cost' and 'failed'. Summed over partitions."""
    shared = sequences.sparkSession.sparkContext.broadcast((params, lm))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        params, lm = shared.value
        lattices = [BatchLattice(p, lm) for p in params]
        lex = [np.zeros_like(p.lex) for p in params]
        ops: list[dict] = [{} for _ in params]
        cost, failed, seen = np.zeros(len(params)), np.zeros(len(params)), False
        for b in batches:
            for (opens, ends), g in b.groupby(["opens", "ends"]):
                seen = True
                seqs, n = [np.asarray(x, np.int64) for x in g["seq"]], g["n"].to_numpy(float)
                for r, lattice in enumerate(lattices):
                    if lattice.usable:
                        ll = lattice.expect(seqs, n, lex[r], ops[r], opens, ends)
                    else:
                        ll = np.array([_one(lattice.own, seq.tolist(), k, lex[r], ops[r]) for seq, k in zip(seqs, n)])
                    good = np.isfinite(ll)
                    cost[r] -= (ll[good] * n[good]).sum()
                    failed[r] += n[~good].sum()
        if not seen:
            return
        rows = []
        for r in range(len(params)):
            s, t = np.nonzero(lex[r])
            rows += [(r, "lex", int(i), int(j), float(lex[r][i, j])) for i, j in zip(s, t)]
            rows += [(r, k, a, b, c) for (a, b, k), c in ops[r].items()]
            rows += [(r, "cost", 0, 0, float(cost[r])), (r, "failed", 0, 0, float(failed[r]))]
        yield pd.DataFrame(rows, columns=["restart", "kind", "src", "dst", "c"])

    return sequences.mapInPandas(run, "restart int, kind string, src int, dst int, c double").groupBy("restart", "kind", "src", "dst").agg(F.sum("c").alias("c"))


def _one(lattice: Lattice, seq: list[int], n: float, lex: np.ndarray, ops: dict[tuple[int, int, str], float]) -> float:
    """``Lattice.expect`` with a weight."""
    own, moves = np.zeros_like(lex), {}
    ll = lattice.expect(seq, own, moves)
    lex += n * own
    for k, c in moves.items():
        ops[k] = ops.get(k, 0.0) + n * c
    return ll


def maximise(counts: pd.DataFrame, params: list[Parameters], train_lex: bool, train_ali: bool, floor: float = 0.0) -> list[Parameters]:
    """Lexical columns sum to 1; an alignment state's moves keep their mass. A group without counts keeps its weights.

    ``floor`` is added to the count of every letter that the model had for a symbol, so that none of them goes for good.
    """
    out = []
    for r, p in enumerate(params):
        mine = counts[counts.restart == r]
        lex, arcs = p.lex.copy(), dict(p.arcs)
        if train_lex:
            x = mine[mine.kind == "lex"]
            c = np.zeros_like(lex)
            c[x.src.to_numpy(), x.dst.to_numpy()] = x.c.to_numpy()
            c += np.where((lex > 0) & (c.sum(axis=0) > 0), floor, 0)
            total = c.sum(axis=0)
            lex[:, total > 0] = (c / np.where(total > 0, total, 1))[:, total > 0]
        if train_ali:
            x = mine[mine.kind.isin(["match", "insert", "delete"])]
            total = x.groupby("src").c.sum()
            for a, b, k, c in x[["src", "dst", "kind", "c"]].itertuples(index=False):
                if total[a] > 0:
                    arcs[(a, b, k)] = c / total[a]
        out.append(Parameters(lex, arcs))
    return out


def train(obs: DataFrame, params: list[Parameters], lm: LetterModel, iterations: int = 20, train_lex: bool = True, train_ali: bool = False, floor: float = 0.0) -> tuple[list[Parameters], pd.DataFrame]:
    """EM over all restarts on all sequences of ``obs`` (syms) or of ``counted``; the log has (restart, iter, cost, n_failed) before each update."""
    whole = obs if "seq" in obs.columns else counted(obs)
    kernels = [BatchLattice(p, lm) for p in params]
    words = words_of(whole).persist() if all(k.usable and k.cut for k in kernels) else None
    # Read in every iteration.
    sequences = words if words is not None else whole.persist()
    log = []
    for it in range(iterations):
        counts = expectations(sequences, params, lm).toPandas()
        if words is not None and counts[counts.kind == "failed"].c.sum():
            counts = expectations(whole, params, lm).toPandas()  # a sequence with a word that has no path counts nowhere
        for r in range(len(params)):
            mine = counts[counts.restart == r]
            log.append((r, it, float(mine[mine.kind == "cost"].c.sum()), int(mine[mine.kind == "failed"].c.sum())))
        params = maximise(counts, params, train_lex, train_ali, floor)
    if words is not None:
        words.unpersist()
    return params, pd.DataFrame(log, columns=["restart", "iter", "cost", "n_failed"])


def select_restart(log: pd.DataFrame) -> int:
    """The restart with the smallest cost in the last iteration; those with failed sequences come last."""
    last = log[log["iter"] == log["iter"].max()].sort_values(["n_failed", "cost", "restart"])
    return int(last.restart.iloc[0])


def curriculum(obs: DataFrame, starts: list[Parameters], models: list[LetterModel], iterations: int | list[int] = 20, keep_top: int = 20) -> tuple[Parameters, pd.DataFrame]:
    """Restarts on the first model; the best one, pruned, goes on through the others with the alignment trained too. ``iterations``: for all models or for each."""
    steps = [iterations] * len(models) if isinstance(iterations, int) else iterations
    obs = counted(obs).persist()  # distinct sequences, for all models
    params, log = train(obs, starts, models[0], steps[0])
    best = params[select_restart(log)]
    best = Parameters(prune_matrix(best.lex, keep_top), best.arcs)
    for lm, n in zip(models[1:], steps[1:]):
        (best,), _ = train(obs, [best], lm, n, train_ali=True)
    return best, log


def word_model(words: list[tuple[list[int], float]]) -> LetterModel:
    """A letter model that allows the words (letters, p) only, each between silences: contexts are a trie's nodes, and a
    node's arcs have the share of its mass that goes on there. It begins in a silence or in a word."""
    g = trie(words, SIL)
    p = [(a, s, b, float(np.exp(-w))) for a, b, s, _, w in g.arcs]
    root = [x for x in p if x[0] == 0]
    # Words follow a silence; before the first there may be one more.
    again = 1 + max(max(x[0], x[2]) for x in p)
    arcs = [(again if a == 0 else a, s, again if b == 0 else b, q) for a, s, b, q in p] + [(0, SIL, again, 0.5)] + [(0, s, b, 0.5 * q) for _, s, b, q in root]
    x = np.array(arcs)
    return LetterModel(x[:, 0].astype(np.int64), x[:, 1].astype(np.int64), x[:, 2].astype(np.int64), x[:, 3].astype(float), again + 1)


def word_stage(obs: DataFrame, params: Parameters, words: list[tuple[list[int], float]], iterations: int = 20, floor: float = 1e-300) -> Parameters:
    """Training on whole words: the smoothed lexical model, then EM with both models trained and no letter dropped; smoothed again for decoding."""
    start = Parameters(smooth_matrix(params.lex), params.arcs)
    (best,), _ = train(obs, [start], word_model(words), iterations, train_ali=True, floor=floor)
    return Parameters(smooth_matrix(best.lex), best.arcs)


def prune_matrix(lex: np.ndarray, k: int) -> np.ndarray:
    body = lex[2:, 2:]
    kth = lambda m, axis: np.sort(m, axis=axis).take(-min(k, m.shape[axis]), axis=axis)
    keep = (body >= kth(body, 1)[:, None]) | (body >= kth(body, 0)[None, :])
    keep[:, -1] = True
    out = np.zeros_like(lex)
    out[2:, 2:] = np.where(keep, body, 0)
    total = out.sum(axis=0)
    return out / np.where(total > 0, total, 1)


def smooth_matrix(lex: np.ndarray, alpha: float = 0.9) -> np.ndarray:
    out = np.zeros_like(lex)
    out[2:, 2:] = (1 - alpha) / (lex.shape[0] - 1) + alpha * lex[2:, 2:]
    return out


def by_words(decoder: BatchDecoder, seqs, known: dict[tuple, tuple[bytes, float]], most: int = 500_000) -> list[tuple]:
    """``BatchDecoder.decode`` where sequences fall apart at silences: each distinct piece once, kept in ``known`` (up to ``most``)."""
    if len(known) > most:
        known.clear()
    lines = [cut_at_silences(seq) for seq in seqs]
    new: dict[tuple, list] = {}
    for piece in {p for line in lines for p in line if p not in known}:
        new.setdefault(piece[1:], []).append(piece)
    for (opens, ends), pieces in new.items():
        for piece, (tokens, cost) in zip(pieces, decoder.decode([np.frombuffer(x, np.int32) for x, _, _ in pieces], opens, ends)):
            known[piece] = np.array(tokens, np.int32).tobytes(), cost
    out = []
    for line in lines:
        parts = [known[p] for p in line]
        cost = sum(c for _, c in parts)
        out.append((np.frombuffer(b"".join(x for x, _ in parts), np.int32) if np.isfinite(cost) else [], cost))
    return out


def decode(obs: DataFrame, params: Parameters, lm: LetterModel, power: float = 1.0, beam: float = 12.0, drop_empty: bool = True) -> DataFrame:
    """(utt_id, tokens, cost): the best text of every sequence; without a path, no row or one without tokens."""
    shared = obs.sparkSession.sparkContext.broadcast((Parameters(params.lex**power, params.arcs), lm))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = BatchDecoder(*shared.value, beam)
        known: dict[tuple, tuple[bytes, float]] = {}
        for b in batches:
            if decoder.cut is None:
                found = decoder.decode([list(map(int, seq)) for seq in b["syms"]])
            else:
                found = by_words(decoder, b["syms"], known)
            rows = [(utt, tokens, cost) for utt, (tokens, cost) in zip(b["utt_id"], found) if np.isfinite(cost) or not drop_empty]
            yield pd.DataFrame(rows, columns=["utt_id", "tokens", "cost"])

    kind = dict(obs.dtypes)["utt_id"]
    return obs.select("utt_id", "syms").mapInPandas(run, f"utt_id {kind}, tokens array<int>, cost double")


def context_free(seen: DataFrame, target: DataFrame, start: DataFrame, steps: int) -> tuple[DataFrame, DataFrame]:
    """Expectation-maximisation without context: (restart, src, tgt, p) after ``steps``, and the log (restart, iter, cost) before each.

    ``seen`` (src, n) counts the observed symbols, ``target`` (tgt, q) has the letters' probabilities, ``start`` (restart, src, tgt, p) the
    lexical models. Counting the observations first leaves tables bounded by the alphabets; they come to the driver once, and steps are joins and windows over them.
    """
    spark = start.sparkSession
    small = lambda df: spark.createDataFrame(df.toPandas(), df.schema)
    pairs = small(start.join(seen, "src").join(target, "tgt").select("restart", "src", "tgt", "n", "q", "p"))
    by = lambda *c: Window.partitionBy("restart", *c)
    log = None
    for k in range(steps):
        joint = pairs.withColumn("w", F.col("q") * F.col("p")).withColumn("z", F.sum("w").over(by("src")))
        cost = joint.select("restart", "src", "n", "z").groupBy("restart", "src").agg(F.first("n").alias("n"), F.max("z").alias("z")).groupBy("restart").agg((-F.sum(F.col("n") * F.ln("z"))).alias("cost"))
        row = cost.select("restart", F.lit(k).alias("iter"), "cost")
        log = row if log is None else log.unionByName(row)
        share = F.col("n") * F.col("w") / F.col("z")
        pairs = joint.withColumn("c", share).withColumn("p", F.col("c") / F.sum("c").over(by("tgt"))).select("restart", "src", "tgt", "n", "q", "p")
    return pairs.select("restart", "src", "tgt", "p"), log
