"""Accumulators and reducers that the user writes, for running, windowed and live aggregation alike."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Accumulator:
    """create, add, merge and result over a state that is any value that can be pickled.

    merge(a, b) joins the state of earlier records with that of later ones, and add(s, row) must give what
    merge(s, add(create(), row)) gives; neither has to be commutative. A state may be changed in place by add and by
    merge (its first). result returns a tuple of the fields that `schema` names. A row has the columns that the
    operator is given, as attributes; nulls are None. A state that keeps rows keeps them as plain tuples.
    """

    schema: str

    def create(self) -> Any:
        raise NotImplementedError

    def add(self, state: Any, row: Any) -> Any:
        raise NotImplementedError

    def merge(self, a: Any, b: Any) -> Any:
        raise NotImplementedError

    def result(self, state: Any) -> tuple:
        raise NotImplementedError


class Reducer(Accumulator):
    """One record out of two: reduce(earlier, later), an associative function of tuples of the columns.

    The first record passes as it is; so the result has the columns' own fields.
    """

    def __init__(self, reduce: Callable[[tuple, tuple], tuple], schema: str) -> None:
        self.reduce, self.schema = reduce, schema

    def create(self) -> tuple | None:
        return None

    def add(self, state: tuple | None, row: tuple) -> tuple:
        return tuple(row) if state is None else self.reduce(state, tuple(row))

    def merge(self, a: tuple | None, b: tuple | None) -> tuple | None:
        return b if a is None else a if b is None else self.reduce(a, b)

    def result(self, state: tuple) -> tuple:
        return state


class RisingStreak(Accumulator):
    """The longest run of records each of which is higher than the one before; a null value breaks a run.

    The state is (records, run at the start, run at the end, longest, first value, last value).
    """

    schema = "longest_rise long"

    def __init__(self, value: str) -> None:
        self.value = value

    def create(self) -> tuple:
        return (0, 0, 0, 0, None, None)

    def add(self, state: tuple, row: Any) -> tuple:
        v = getattr(row, self.value)
        return self.merge(state, (1, 0, 0, 0, None, None) if v is None else (1, 1, 1, 1, v, v))

    def merge(self, a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return b if b[0] else a
        joins = a[2] > 0 and b[1] > 0 and a[5] < b[4]
        head = a[0] + b[1] if joins and a[1] == a[0] else a[1]
        tail = a[2] + b[0] if joins and b[2] == b[0] else b[2]
        return (a[0] + b[0], head, tail, max(a[3], b[3], a[2] + b[1] if joins else 0), a[4], b[5])

    def result(self, state: tuple) -> tuple:
        return (state[3],)


class SumAndCount(Accumulator):
    """Sum and number of a column's values; null until there is one, and 0."""

    def __init__(self, value: str) -> None:
        self.value, self.schema = value, f"sum_{value} long, n long"

    def create(self) -> tuple:
        return (None, 0)

    def add(self, state: tuple, row: Any) -> tuple:
        return self.merge(state, (getattr(row, self.value), 1))

    def merge(self, a: tuple, b: tuple) -> tuple:
        return (b[0] if a[0] is None else a[0] if b[0] is None else a[0] + b[0], a[1] + b[1])

    def result(self, state: tuple) -> tuple:
        return state


class TopDistinct(Accumulator):
    """A table aggregate: the n highest distinct values of a column with their places, highest first; nulls do not count."""

    def __init__(self, value: str, n: int, kind: str = "long") -> None:
        self.value, self.n, self.schema = value, n, f"{value} {kind}, place int"

    def create(self) -> tuple:
        return ()

    def add(self, state: tuple, row: Any) -> tuple:
        v = getattr(row, self.value)
        return state if v is None else self.merge(state, (v,))

    def merge(self, a: tuple, b: tuple) -> tuple:
        return tuple(sorted({*a, *b}, reverse=True)[: self.n])

    def result(self, state: tuple) -> list[tuple]:
        return [(v, k) for k, v in enumerate(state, 1)]


class CoGroup(Accumulator):
    """Both sides' records, which body gets as two lists and makes one tuple of `schema` of."""

    def __init__(self, side: str, body: Callable[[list, list], tuple], schema: str) -> None:
        self.side, self.body, self.schema = side, body, schema

    def create(self) -> tuple[list, list]:
        return [], []

    def add(self, state: tuple[list, list], row: Any) -> tuple[list, list]:
        state[getattr(row, self.side) != "left"].append(tuple(row))
        return state

    def merge(self, a: tuple[list, list], b: tuple[list, list]) -> tuple[list, list]:
        a[0].extend(b[0])
        a[1].extend(b[1])
        return a

    def result(self, state: tuple[list, list]) -> tuple:
        return self.body(*state)
