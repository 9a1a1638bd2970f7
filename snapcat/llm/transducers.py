"""Finite-state transducers over small alphabets: tables of arcs, and their composition."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass

State = Hashable
Symbols = tuple[str, ...]


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, symbol]`` is the next state and the symbols written."""

    start: State
    alphabet: frozenset[str]
    arcs: dict[tuple[State, str], tuple[State, Symbols]]

    def run(self, symbols: Iterable[str]) -> list[str]:
        state, written = self.start, []
        for symbol in symbols:
            state, out = self.arcs[state, symbol]
            written += out
        return written

    def numbered(self) -> list[dict[str, tuple[int, Symbols]]]:
        """Arcs by state number; the start is 0."""
        states = [self.start]
        states += sorted({s for s, _ in self.arcs} - {self.start}, key=repr)
        number = {s: i for i, s in enumerate(states)}
        table: list[dict[str, tuple[int, Symbols]]] = [{} for _ in states]
        for (state, symbol), (after, out) in self.arcs.items():
            table[number[state]][symbol] = (number[after], out)
        return table


def transducer(start: State, alphabet: Iterable[str], arc: Callable[[State, str], tuple[State, Symbols]]) -> Transducer:
    """The table of the states that ``arc`` reaches from ``start``."""
    alphabet = frozenset(alphabet)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            arcs[state, symbol] = after, _ = arc(state, symbol)
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return Transducer(start, alphabet, arcs)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what ``first`` reads and writes what ``second`` writes on reading what ``first`` wrote."""

    def arc(state: State, symbol: str) -> tuple[State, Symbols]:
        one, two = state
        one, between = first.arcs[one, symbol]
        written: Symbols = ()
        for s in between:
            two, out = second.arcs[two, s]
            written += out
        return (one, two), written

    return transducer((first.start, second.start), first.alphabet, arc)
