"""Finite-state transducers as arc tables, and their composition.

A machine reads one symbol (a bit mask below ``SYMBOLS``) a step and writes one.
``compose`` feeds the output of one machine to another: the product machine has
a state for every pair that can be reached, and its arcs are joined arc by arc.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

SYMBOLS = 256


class Transducer(NamedTuple):
    arcs: list[list[int]]  # arcs[state][symbol] is the next state; state 0 begins
    out: list[list[int]]  # the symbol written on that arc


def machine(states: int, step: Callable[[int, int], tuple[int, int]]) -> Transducer:
    """The table of ``step``: (state, symbol) to (next state, symbol written)."""
    made = [[step(s, x) for x in range(SYMBOLS)] for s in range(states)]
    return Transducer([[a for a, _ in row] for row in made], [[b for _, b in row] for row in made])


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that writes what ``second`` writes on the output of ``first``."""
    number = {(0, 0): 0}
    todo, arcs, out = [(0, 0)], [], []
    for a, b in todo:  # grows while new pairs are reached
        arcs.append([])
        out.append([])
        for x in range(SYMBOLS):
            middle = first.out[a][x]
            pair = first.arcs[a][x], second.arcs[b][middle]
            if pair not in number:
                number[pair] = len(number)
                todo.append(pair)
            arcs[-1].append(number[pair])
            out[-1].append(second.out[b][middle])
    return Transducer(arcs, out)


def run(made: Transducer, symbols: list[int]) -> list[int]:
    state, written = 0, []
    for x in symbols:
        written.append(made.out[state][x])
        state = made.arcs[state][x]
    return written
