"""Records whose keys are not known beforehand, as VARIANT columns.

A record is a VARIANT that holds an object; JSON text becomes one by :func:`record`. Objects
merge key by key, keys may be read and set by path, and keys that no rule has checked are
carried along. Each rule names its arguments once, so that nested rules do not repeat them.

Cases: a null record, or one that is no object, merges as one without keys, and as a value
replaces like any other; a JSON null is a value and not a missing key; text that is no JSON
is a null record; keys are ordered as VARIANT orders them, so equal records print alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.text import let

_MAP = "map<string,variant>"


def record(text: Column) -> Column:
    return F.try_parse_json(text)


def shown(value: Column) -> Column:
    """A record as JSON text."""
    return F.to_json(value)


def entries(value: Column) -> Column:
    """The keys and values of an object; none of anything else."""
    return F.coalesce(F.try_variant_get(value, "$", _MAP), F.create_map().cast(_MAP))


def _object(pairs: Column) -> Column:
    return F.to_variant_object(pairs)


def right_wins(left: Column, right: Column) -> Column:
    """All keys of both; those of both as the right has them."""
    return let(entries(right), lambda r: _object(F.map_concat(F.map_filter(entries(left), lambda k, v: ~F.map_contains_key(r, k)), r)))


def left_wins(left: Column, right: Column) -> Column:
    """All keys of both; those of both as the left has them."""
    return right_wins(right, left)


def path_get(value: Column, path: str, kind: str = "string") -> Column:
    """What stands at a dotted path, null if nothing does or it is of another kind; ``a.0`` is the first of a list."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.try_variant_get(value, "$" + steps, kind)


def path_set(value: Column, path: str, new: Column) -> Column:
    """The record with a value at a dotted path of keys; what lies on the way and is no object becomes one."""
    head, _, rest = path.partition(".")

    def put(pairs: Column) -> Column:
        inner = path_set(F.try_element_at(pairs, F.lit(head)), rest, new) if rest else new
        return _object(F.map_concat(F.map_filter(pairs, lambda k, v: k != head), F.create_map(F.lit(head), inner)))

    return let(entries(value), put)


def variant(value: Column) -> Column:
    """A plain value as a VARIANT."""
    return value.cast("variant")


def carried(validated: Column, extracted: Column, checked: tuple[str, ...]) -> Column:
    """A validated record with the keys of the extracted one that no rule has checked."""
    rest = F.map_filter(entries(extracted), lambda k, v: ~k.isin(*checked))
    return left_wins(validated, _object(rest))


def split_internal(value: Column) -> tuple[Column, Column]:
    """The public keys of a record, and those that begin with _."""
    own = entries(value)
    return _object(F.map_filter(own, lambda k, v: ~k.startswith("_"))), _object(F.map_filter(own, lambda k, v: k.startswith("_")))
