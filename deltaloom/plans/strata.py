"""Order of evaluation of rules with negation or aggregation."""

from __future__ import annotations

from collections.abc import Iterable

from ..errors import NotStratified


def stratify(rules: Iterable[tuple[str, Iterable[str], Iterable[str]]]) -> list[list[str]]:
    """Strata of relation names, lowest first.

    A rule is (head, relations used plainly, relations negated or aggregated). A head is no
    lower than what it uses and higher than what it negates; NotStratified if that can't be.
    """
    rules = [(h, set(p), set(n)) for h, p, n in rules]
    level = {x: 0 for h, p, n in rules for x in {h} | p | n}
    for _ in range(len(level) + 1):
        moved = False
        for h, p, n in rules:
            least = max([0, *[level[x] for x in p], *[level[x] + 1 for x in n]])
            if level[h] < least:
                level[h], moved = least, True
        if not moved:
            return [sorted(x for x in level if level[x] == k) for k in sorted(set(level.values()))]
    raise NotStratified("a relation depends on its own negation")
