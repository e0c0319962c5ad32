"""What a Python worker remembers between tasks: the words of one operator at a time.

Workers outlive tasks, so that an operator's memory of words speeds up the next task; without this each operator that a
worker has ever served would keep its own.
"""

from __future__ import annotations

from collections.abc import Callable

#: Letters that an operator remembers at most, besides its bound on words: a word may be a megabyte long.
MOST_LETTERS = 8_000_000

_owner: object = None
_forget: Callable[[], None] | None = None


def claim(owner: object, forget: Callable[[], None]) -> None:
    """``owner`` is about to use its memory; whoever used one before forgets."""
    global _owner, _forget
    if _owner is not owner:
        if _forget is not None:
            _forget()
        _owner, _forget = owner, forget
