"""Weighted acyclic automata over words: counts of n-grams, sharing what they begin with.

An automaton has a level of arcs for each place in an n-gram. An arc has the state it leaves (the number of an arc of
the level before), a word and the count of the n-gram that ends with it (0: only on the way to longer
ones). Arcs are in the order of the n-grams they end, word by word, so what lies between two n-grams is one stretch of each
level. States that nothing leaves are one and the same, and are not stored.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np

Phrase = tuple[bytes, ...]
Level = tuple[np.ndarray, np.ndarray, np.ndarray]  # state that an arc leaves, word, count


def _sums(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, sum of each, number of each key among them), exact in 64 bits."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sums = np.diff(np.r_[starts, len(keys)]) if counts is None else np.add.reduceat(counts[order], starts) if len(keys) else counts
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ranked[starts], sums, number


class Automaton:
    def __init__(self, words: list[bytes], levels: list[Level]) -> None:
        self.words, self.levels = words, levels  # words in order of their bytes

    def __len__(self) -> int:
        return sum(len(word) for _, word, _ in self.levels)

    # -------------------------------------------------------- to and from bytes

    def dump(self) -> bytes:
        """Words have no blanks; a level's states are stored as steps, numbers as narrow as they fit."""
        narrow = lambda x: x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)
        return pickle.dumps((b" ".join(self.words), [(narrow(np.diff(state, prepend=0)), narrow(word), narrow(count)) for state, word, count in self.levels]), 5)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        words, levels = pickle.loads(data)  # made by dump() in another task of this job
        wide = lambda x: x.astype(np.int64)
        return cls(words.split(b" ") if words else [], [(np.cumsum(wide(step)), wide(word), wide(count)) for step, word, count in levels])

    # -------------------------------------------------------- building

    @classmethod
    def of_text(cls, words: list[bytes], text: np.ndarray, orders: range, allowed: np.ndarray | None = None) -> Automaton:
        """Counts of the n-grams of a text, which is given as numbers of ``words`` with -1 between pieces.

        Only lengths in ``orders`` are counted; with ``allowed`` (a flag for each pair of neighbours) only n-grams all of whose pairs are.
        Each level is built from the sorted continuations of the last one's states.
        """
        v, levels = len(words), []
        pair = (text[:-1] >= 0) & (text[1:] >= 0) if len(text) else np.zeros(0, bool)
        if allowed is not None:
            pair &= allowed
        runs = {1: text >= 0}
        for n in range(2, orders.stop):
            runs[n] = runs[n - 1][:-1] & pair[n - 2 :] if n > 2 else pair
        at = np.flatnonzero(runs[orders.start])
        state = np.zeros(len(at), np.int64)
        for n in range(1, orders.stop):
            if n > orders.start:
                longer = runs[n][np.minimum(at, len(runs[n]) - 1)] & (at < len(runs[n])) if len(runs[n]) else np.zeros(len(at), bool)
                at, state = at[longer], state[longer]
            keys, counts, state = _sums(state * v + text[at + n - 1], None)
            levels.append((keys // v, keys % v, counts if n in orders else np.zeros(len(keys), np.int64)))
        return cls(words, levels)

    @classmethod
    def of_phrases(cls, phrases: Iterable[tuple[Phrase, int]]) -> Automaton:
        """From phrases in order, one after the other: what a phrase shares with the one before is there already."""
        arcs: list[tuple[list[int], list[bytes], list[int]]] = []
        last: Phrase = ()
        for phrase, count in phrases:
            shared = 0
            while shared < min(len(last), len(phrase)) and last[shared] == phrase[shared]:
                shared += 1
            for n in range(shared, len(phrase)):
                if n == len(arcs):
                    arcs.append(([], [], []))
                state, word, weight = arcs[n]
                state.append(len(arcs[n - 1][0]) - 1 if n else 0)
                word.append(phrase[n])
                weight.append(count if n == len(phrase) - 1 else 0)
            last = phrase
        words = sorted({w for _, word, _ in arcs for w in word})
        number = {w: i for i, w in enumerate(words)}
        return cls(words, [(np.array(s, np.int64), np.array([number[w] for w in word], np.int64), np.array(c, np.int64)) for s, word, c in arcs])

    @classmethod
    def union(cls, automata: list[Automaton]) -> Automaton:
        """Counts of equal n-grams are added."""
        words = sorted(set().union(*[a.words for a in automata]))
        number, v = {w: i for i, w in enumerate(words)}, max(1, len(words))
        names = [np.array([number[w] for w in a.words], np.int64) for a in automata]
        states, levels = [np.zeros(1, np.int64) for _ in automata], []
        for n in range(max((len(a.levels) for a in automata), default=0)):
            parts = [a.levels[n] if n < len(a.levels) else (np.zeros(0, np.int64),) * 3 for a in automata]
            keys, counts, at = _sums(np.concatenate([s[state] * v + name[word] for s, name, (state, word, _) in zip(states, names, parts)]), np.concatenate([c for *_, c in parts]))
            levels.append((keys // v, keys % v, counts))
            states = np.split(at, np.cumsum([len(p[0]) for p in parts])[:-1])
        return cls(words, levels)

    # -------------------------------------------------------- cutting

    def kept(self, flags: list[np.ndarray]) -> Automaton:
        """Only flagged n-grams and the ways to them; the counts of ways that aren't flagged become 0."""
        need = [f.copy() for f in flags]
        for n in range(len(need) - 1, 0, -1):
            need[n - 1][self.levels[n][0][need[n]]] = True
        used = np.unique(np.concatenate([word[f] for (_, word, _), f in zip(self.levels, need)])) if need else np.zeros(0, np.int64)
        levels, place = [], np.zeros(1, np.int64)
        for (state, word, count), f, flag in zip(self.levels, need, flags):
            levels.append((place[state[f]], np.searchsorted(used, word[f]), np.where(flag, count, 0)[f]))
            place = np.cumsum(f) - 1
        return Automaton([self.words[i] for i in used.tolist()], levels)

    def at_least(self, least: int) -> Automaton:
        return self.kept([count >= least for *_, count in self.levels])

    def before(self, phrase: Phrase) -> list[int]:
        """How many arcs of each level end n-grams that come before the phrase."""
        out, way = [], 0  # way: the state that the phrase's beginning leads to, or -1
        for n, (state, word, _) in enumerate(self.levels):
            less = out[-1] if out else 0
            if way < 0 or n >= len(phrase):
                out.append(int(np.searchsorted(state, less)) if n else 0)
                way = -1
                continue
            lo, hi = np.searchsorted(state, [way, way + 1]).tolist() if n else (0, len(word))
            at = bisect_left(self.words, phrase[n])
            place = lo + int(np.searchsorted(word[lo:hi], at))
            met = place < hi and at < len(self.words) and word[place] == at and self.words[at] == phrase[n]
            out.append(place + (met and n + 1 < len(phrase)))
            way = place if met else -1
        return out

    def ranges(self, bounds: list[Phrase]) -> Iterator[tuple[int, Automaton]]:
        """(i, n-grams from the bound before i on and before bound i) for each i that has some."""
        cuts = [[0] * len(self.levels), *(self.before(b) for b in bounds), [len(word) for _, word, _ in self.levels]]
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if lo == hi:
                continue
            first = lo[:]
            for n in range(len(first) - 1, 0, -1):  # the way to the first arcs begins before the bound
                if first[n] < hi[n]:
                    first[n - 1] = min(first[n - 1], int(self.levels[n][0][first[n]]))
            levels, up = [], 0
            for n, (state, word, count) in enumerate(self.levels):
                c = slice(first[n], hi[n])
                levels.append((state[c] - up if n else state[c], word[c], np.where(np.arange(first[n], hi[n]) < lo[n], 0, count[c])))
                up = first[n]
            used = np.unique(np.concatenate([word for _, word, _ in levels]))
            yield i, Automaton([self.words[j] for j in used.tolist()], [(s, np.searchsorted(used, w), c) for s, w, c in levels])

    # -------------------------------------------------------- reading

    def phrases(self) -> Iterator[tuple[Phrase, int]]:
        """(n-gram, count) of each n-gram with a count, level by level."""
        before: list[Phrase] = [()]
        for state, word, count in self.levels:
            here = [(*before[s], self.words[w]) for s, w in zip(state.tolist(), word.tolist())]
            yield from ((p, c) for p, c in zip(here, count.tolist()) if c)
            before = here

    def compose(self, asked: Automaton) -> Automaton:
        """``asked`` with the counts that its n-grams have here, 0 where they are not here or not asked for."""
        here = np.array([i if (i := bisect_left(self.words, w)) < len(self.words) and self.words[i] == w else -1 for w in asked.words], np.int64)
        v, met, levels = max(1, len(self.words)), np.zeros(1, np.int64), []
        for n, (state, word, count) in enumerate(asked.levels):
            at = np.full(len(word), -1, np.int64)
            if n < len(self.levels):
                mine = self.levels[n][0] * v + self.levels[n][1]
                known = (met[state] >= 0) & (here[word] >= 0)
                keys = met[state[known]] * v + here[word[known]]
                place = np.minimum(np.searchsorted(mine, keys), max(0, len(mine) - 1))
                at[known] = np.where(mine[place] == keys, place, -1) if len(mine) else -1
            found = np.zeros(len(word), np.int64)
            wanted = (at >= 0) & (count > 0)
            found[wanted] = self.levels[n][2][at[wanted]] if wanted.any() else 0
            levels.append((state, word, found))
            met = at
        return Automaton(asked.words, levels)
