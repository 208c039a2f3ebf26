"""Weighted finite-state transducers over (max, +), letter to letter, and their composition.

A weight is a pair (times, constant): how often an arc takes the weight that comes with
what it reads, and what it adds. Weights along a path add up, the best path counts.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass

#: Next state, symbol written, (times, constant).
Arc = tuple[int, Hashable, tuple[int, float]]


@dataclass(frozen=True)
class Transducer:
    """State 0 is the start; a reading may end in the states of ``final``."""

    arcs: dict[tuple[int, Hashable], tuple[Arc, ...]]
    final: frozenset[int]


def build(start: Hashable, alphabet: Iterable[Hashable], step: Callable, ends: Callable) -> Transducer:
    """The transducer of the states that ``step(state, symbol)``, a list of arcs, reaches from ``start``."""
    alphabet = list(alphabet)
    number, todo = {start: 0}, [start]
    arcs: dict[tuple[int, Hashable], tuple[Arc, ...]] = {}
    for state in todo:
        for symbol in alphabet:
            made = []
            for after, written, weight in step(state, symbol):
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                made.append((number[after], written, weight))
            if made:
                arcs[number[state], symbol] = tuple(made)
    return Transducer(arcs, frozenset(k for state, k in number.items() if ends(state)))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what ``first`` reads, and writes what ``second`` writes of what ``first`` writes."""

    def step(state: tuple[int, int], symbol: Hashable) -> Iterator[tuple[tuple[int, int], Hashable, tuple[int, float]]]:
        for a, between, (n, c) in first.arcs.get((state[0], symbol), ()):
            for b, written, (m, d) in second.arcs.get((state[1], between), ()):
                yield (a, b), written, (n + m, c + d)

    return build((0, 0), dict.fromkeys(s for _, s in first.arcs), step, lambda s: s[0] in first.final and s[1] in second.final)


def best_path(machine: Transducer, read: list[tuple[Hashable, float]]) -> tuple[float, list[Hashable]] | None:
    """(weight, symbols written) of the best path over (symbol, its weight) rows; None if none ends well. Of equal paths one is kept, always the same."""
    alive: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for symbol, own in read:
        after: dict[int, tuple[float, tuple]] = {}
        for state, (total, trail) in alive.items():
            for target, written, (times, constant) in machine.arcs.get((state, symbol), ()):
                weight = total + times * own + constant
                if target not in after or weight > after[target][0]:
                    after[target] = weight, (trail, written)
        alive = after
    ended = [(weight, trail) for state, (weight, trail) in alive.items() if state in machine.final]
    if not ended:
        return None
    weight, trail = max(ended, key=lambda x: x[0])
    written = []
    while trail:
        trail, last = trail
        written.append(last)
    return weight, written[::-1]
