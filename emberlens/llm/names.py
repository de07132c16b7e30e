"""Names of columns that an operator adds beside those it was given."""

from __future__ import annotations


def spared(columns: list[str], made: list[str]) -> list[str]:
    """The input's column names in their order; one that the operator makes itself gets ``_`` behind it until it is free."""
    taken = {c.lower() for c in (*columns, *made)}
    out = []
    for c in columns:
        name = c
        if c.lower() in {m.lower() for m in made}:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        out.append(name)
    return out
