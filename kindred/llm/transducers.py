"""Finite-state transducers over small alphabets of symbols, and their composition."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


class Transducer:
    """arcs[state][symbol]: pairs (symbol written, next state); one symbol is written for each that is read.

    Several arcs may read one symbol. A transducer that has one accepting path at most for every input
    is unambiguous; `read` returns what that path writes.
    """

    def __init__(self, start: Hashable, arcs: dict, finals: Iterable):
        self.start, self.arcs, self.finals = start, arcs, frozenset(finals)

    def then(self, after: Transducer) -> Transducer:
        """The composition: what this one writes, `after` reads. Only states that can be reached and can end stay."""
        start = (self.start, after.start)
        arcs, todo = {}, [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            p, q = state
            own = arcs[state] = {}
            for symbol, steps in self.arcs.get(p, {}).items():
                found = [(out, (p2, q2)) for middle, p2 in steps for out, q2 in after.arcs.get(q, {}).get(middle, ())]
                if found:
                    own[symbol] = found
                    todo += [s for _, s in found]
        finals = {s for s in arcs if s[0] in self.finals and s[1] in after.finals}
        ends, grown = set(finals), True
        while grown:
            grown = {s for s, own in arcs.items() if s not in ends and any(t in ends for steps in own.values() for _, t in steps)}
            ends |= grown
        kept = {s: {x: [(o, t) for o, t in steps if t in ends] for x, steps in own.items()} for s, own in arcs.items() if s in ends}
        return Transducer(start, {s: {x: steps for x, steps in own.items() if steps} for s, own in kept.items()}, finals)

    def read(self, symbols: Iterable) -> list | None:
        """What the accepting path writes, the first found if there are several; None if there is none."""
        alive: dict = {self.start: None}
        for symbol in symbols:
            following: dict = {}
            for state, path in alive.items():
                for out, to in self.arcs.get(state, {}).get(symbol, ()):
                    following.setdefault(to, (out, path))
            alive = following
        for state, path in alive.items():
            if state in self.finals:
                written = []
                while path is not None:
                    written.append(path[0])
                    path = path[1]
                return written[::-1]
        return None

    def every(self, symbols: tuple) -> Iterator[list]:
        """What each accepting path writes, one path after the other."""

        def walk(state: Hashable, at: int) -> Iterator[list]:
            if at == len(symbols):
                if state in self.finals:
                    yield []
                return
            for out, to in self.arcs.get(state, {}).get(symbols[at], ()):
                for rest in walk(to, at + 1):
                    yield [out, *rest]

        yield from walk(self.start, 0)


def mapping(changes: dict, alphabet: Iterable) -> Transducer:
    """One state; symbols of `changes` are rewritten, the others of the alphabet stay."""
    return Transducer(0, {0: {s: [(changes.get(s, s), 0)] for s in alphabet}}, [0])
