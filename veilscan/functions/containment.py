"""Which matches of one text lie in a longer match of it, without comparing all pairs.

The distinct matches form one multi-pattern automaton; reading each distinct
match once through it names every match inside it. The work is linear in the
characters of the distinct matches and the occurrences found.
"""

from __future__ import annotations

from collections.abc import Sequence


def uncontained(matches: Sequence[str], ranks: Sequence[int]) -> list[int]:
    """Places of the matches that lie in no longer match of at least their rank, in order."""
    import ahocorasick

    top: dict[str, int] = {}
    for m, rank in zip(matches, ranks, strict=True):
        top[m] = max(rank, top.get(m, rank))
    automaton = ahocorasick.Automaton()
    for m in top:
        if m:
            automaton.add_word(m, m)
    # an empty match lies in every other one
    around = {"": max((rank for m, rank in top.items() if m), default=-1)}
    if len(automaton):
        automaton.make_automaton()
        for outer, rank in top.items():
            for _, inner in automaton.iter(outer):
                if len(inner) < len(outer) and around.get(inner, -1) < rank:
                    around[inner] = rank
    return [k for k, (m, rank) in enumerate(zip(matches, ranks, strict=True)) if around.get(m, -1) < rank]
