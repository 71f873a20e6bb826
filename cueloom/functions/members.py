"""Members of JSON text changed in place: what isn't named stays, as variants. Each level of a text is parsed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Change = Callable[[Column], Column]


def _once(x: Column, f: Change) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def with_members(body: Column, changes: dict[str, Change]) -> Column:
    """JSON text of an object with some members changed: a change gets a member as JSON text, null if it is absent, and gives
    its new JSON text, null to leave it. Null if the text isn't an object."""

    def made(m: Column) -> Column:
        new = {k: F.try_parse_json(f(F.to_json(F.try_element_at(m, F.lit(k))))) for k, f in changes.items()}

        def member(k: Column, v: Column) -> Column:
            out = v
            for name, value in new.items():
                out = F.when(k == name, F.coalesce(value, v)).otherwise(out)
            return out

        added = F.map_filter(F.create_map(*(x for k, v in new.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull() & ~F.map_contains_key(m, k))
        return F.to_json(F.map_concat(F.transform_values(m, member), added))

    return _once(F.from_json(body, "map<string,variant>"), made)


def with_elements(body: Column, change: Change) -> Column:
    """JSON text of an array with each element's text changed."""
    return _once(F.from_json(body, "array<variant>"), lambda a: F.to_json(F.transform(a, lambda x: F.try_parse_json(change(F.to_json(x))))))


def at_path(path: tuple, change: Change) -> Change:
    """``change`` at a path of member names and array places, where there is something at it."""
    if not path:
        return lambda x: F.when(x.isNotNull() & (x != "null"), change(x))
    inner, step = at_path(path[1:], change), path[0]
    if isinstance(step, str):
        return lambda x: F.when(x.isNotNull(), with_members(x, {step: inner}))

    def placed(x: Column) -> Column:
        return _once(F.from_json(x, "array<variant>"), lambda a: F.to_json(F.transform(a, lambda v, i: F.when(i == step, F.coalesce(F.try_parse_json(inner(F.to_json(v))), v)).otherwise(v))))

    return placed


def constant(value: str) -> Change:
    """A member's new JSON text, whatever it was."""
    return lambda x: F.lit(value)


def _object(body: Column) -> Column:
    """The text of an object, an empty one for anything else."""
    return F.when(F.from_json(body, "map<string,variant>").isNotNull(), body).otherwise("{}")


def with_path(body: Column, path: list[str], value: str) -> Column:
    """JSON text of an object with a value at a path, whose missing objects are made."""
    if not path:
        return F.lit(value)
    return with_members(_object(body), {path[0]: lambda x: with_path(x, path[1:], value)})


def without_path(body: Column, path: list[str]) -> Column:
    """JSON text of an object without the member at a path."""
    if len(path) > 1:
        return with_members(_object(body), {path[0]: lambda x: F.when(x.isNotNull(), without_path(x, path[1:]))})
    return F.to_json(F.map_filter(F.from_json(_object(body), "map<string,variant>"), lambda k, v: k != path[0]))
