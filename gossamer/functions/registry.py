"""Predicates whose subject or object is computed.

A built-in is looked up by its predicate. `test` decides bound pairs, `fwd` gives the object of a subject, `rev` the
subject of an object, `fwd_many` and `rev_many` arrays of them. All are built from columns of term strings; null means
"no match". An argument is an `Arg`: one column, or a list whose members are known one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gossamer.terms import c_items, c_list, c_lex, c_number, c_text


class Arg:
    def __init__(self, column: Column | None = None, items: list[Arg] | None = None):
        self._column, self._items = column, items

    @property
    def c(self) -> Column:
        """The term."""
        return self._column if self._items is None else c_list(F.array(*[i.c for i in self._items]) if self._items else F.array().cast("array<string>"))

    @property
    def items(self) -> Column:
        """The members, null for what is not a list or set."""
        if self._items is not None:
            return F.array(*[i.c for i in self._items]) if self._items else F.array().cast("array<string>")
        return c_items(self._column)

    def item(self, i: int) -> Arg:
        return self._items[i] if self._items is not None and i < len(self._items) else Arg(F.get(self.items, F.lit(i)))

    def sized(self, n: int, value: Column) -> Column:
        """value where the list has n members."""
        if self._items is not None:
            return value if len(self._items) == n else F.lit(None)
        return F.when(F.size(self.items) == n, value)

    @property
    def text(self) -> Column:
        return c_text(self.c)

    @property
    def lex(self) -> Column:
        return c_lex(self.c)

    @property
    def number(self) -> Column:
        return c_number(self.c)


@dataclass(frozen=True)
class Builtin:
    test: Callable[[Arg, Arg], Column] | None = None
    fwd: Callable[[Arg], Column] | None = None
    rev: Callable[[Arg], Column] | None = None
    fwd_many: Callable[[Arg], Column] | None = None
    rev_many: Callable[[Arg], Column] | None = None


BUILTINS: dict[str, Builtin] = {}


def add(namespace: str, **named: Builtin) -> None:
    for name, b in named.items():
        local = name.replace("_", "-") if namespace.endswith("xpath-functions#") else name
        BUILTINS[f"<{namespace}{local}>"] = b


def get(predicate: str) -> Builtin | None:
    """The built-in of a predicate term."""
    import gossamer.functions.library  # noqa: F401  fills the table

    return BUILTINS.get(predicate)
