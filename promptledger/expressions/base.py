"""Literals, bindings and array helpers."""

from __future__ import annotations


def raw(value: str) -> str:
    """A string literal taken as it is, for patterns and texts."""
    if "'" in value:
        raise ValueError("the literal must not hold a single quote")
    return f"r'{value}'"


NEWLINE = raw("\n")


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and refer to it by ``name`` in ``body``.

    Keeps a costly value from being repeated when the optimizer moves or merges the
    projection that uses it several times.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def empty(element: str) -> str:
    """An empty array of a type."""
    return f"CAST(array() AS ARRAY<{element}>)"


def runs(ordered: str, same: str) -> str:
    """Split a sorted array (a name) into runs of equal neighbours, in linear time.

    ``same`` compares ``a`` with its predecessor ``b``.
    """
    starts = (
        f"filter(transform({ordered}, (a, rj) -> CASE WHEN rj = 0 OR NOT "
        f"{let('b', f'get({ordered}, rj - 1)', same)} THEN rj END), rs -> rs IS NOT NULL)"
    )
    slices = (
        f"transform(starts, (rs, rr) -> slice({ordered}, rs + 1, "
        f"coalesce(get(starts, rr + 1), size({ordered})) - rs))"
    )
    return let("starts", starts, slices)
