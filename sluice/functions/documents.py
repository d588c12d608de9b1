"""Changes and tests of JSON documents of any shape: what a constant path alone does not give.

A path is a list of keys, indexes (negative ones from the end), slices and `...`, which is every element. Types, keys
and attributes are read by built-in functions. What walks through a document is an Arrow-batched function of one
document; documents stay in their rows. A null document gives null.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.paths import delete_at, dump, each_once, from_events, get_path, load, merged, set_at

#: What a change returns for an element that is to go.
GONE = "\0gone"
#: The least types in the order of values; numbers, texts, arrays and objects follow.
_FIRST = {None: b"\x01", False: b"\x02", True: b"\x03"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _each(doc: Column | str, kind: str, of: Callable) -> Column:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(each_once(texts, lambda t: of(load(t))), dtype=object)

    return run(_c(doc))


# Types, keys, order


def type_of(doc: Column | str) -> Column:
    """null, boolean, number, string, array or object, by the first character of the JSON text."""
    first = F.substring(F.ltrim(_c(doc)), 1, 1)
    names = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
    out = F.lit("number")
    for sign, name in names.items():
        out = F.when(first == sign, name).otherwise(out)
    return F.when(_c(doc).isNotNull(), out)


def of_type(doc: Column | str, *types: str) -> Column:
    """Whether the document is of one of the types; `scalars` and `iterables` name several."""
    groups = {"scalars": ("null", "boolean", "number", "string"), "iterables": ("array", "object"), "values": ("boolean", "number", "string", "array", "object")}
    return type_of(doc).isin(*[t for name in types for t in groups.get(name, (name,))])


def has(doc: Column | str, key: str | float) -> Column:
    """Whether an object has a key, or an array an element at a whole index."""
    if isinstance(key, str):
        return F.array_contains(F.json_object_keys(_c(doc)), key)
    return (F.json_array_length(_c(doc)) > F.lit(key)) & F.lit(key == key and key >= 0 and key == int(key))


def in_(key: Column | str, doc: Column | str) -> Column:
    """Whether an object has the key that a column names."""
    return F.array_contains(F.json_object_keys(_c(doc)), _c(key))


def xml_attr(doc: Column | str, name: str | None = None) -> Column:
    """The attributes of an element, or one of them."""
    return get_path(doc, ["attributes"] if name is None else ["attributes", name])


def ordered(value) -> bytes:
    """Bytes that compare as values do: null, false, true, numbers, texts, arrays, objects (by their keys first)."""
    if value is None or isinstance(value, bool):
        return _FIRST[value]
    if isinstance(value, str):
        return b"\x05" + value.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff") + b"\0\0"
    if isinstance(value, list):
        return b"\x06" + b"".join(map(ordered, value)) + b"\0"
    if isinstance(value, dict):
        names = sorted(value)
        return b"\x07" + ordered(names) + b"".join(ordered(value[k]) for k in names)
    number = float(value)
    if number != number:
        return b"\x04" + bytes(8)
    bits = struct.unpack(">Q", struct.pack(">d", number + 0.0))[0]
    return b"\x04" + ((bits ^ 0xFFFFFFFFFFFFFFFF) if bits >> 63 else bits | 1 << 63).to_bytes(8, "big")


def order_key(doc: Column | str) -> Column:
    """A binary column: documents compare, sort, group and are distinct by it as their values do."""
    return _each(doc, "binary", ordered)


# Containment


def holds(a, b) -> bool:
    """Whether a contains b: objects by their keys, arrays by some element, texts as a part, others if equal."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and holds(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(holds(x, y) for x in a) for y in b)
    if isinstance(a, str) and isinstance(b, str):
        return b in a
    return type(a) is type(b) and a == b or _is_number(a) and _is_number(b) and a == b


def contains(doc: Column | str, value) -> Column:
    """Whether the documents contain a value, which is a column of JSON or a constant."""
    if not isinstance(value, Column):
        return _each(doc, "boolean", lambda d: holds(d, value))

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else holds(load(x), load(y)) for x, y in zip(a, b)], dtype=object)

    return run(_c(doc), value)


def inside(doc: Column | str, value) -> Column:
    """Whether a constant value contains the documents."""
    return _each(doc, "boolean", lambda d: holds(value, d))


# Arithmetic on values


def _is_number(x) -> bool:
    return isinstance(x, (int, float, Decimal)) and not isinstance(x, bool)


def _number(x: float):
    return int(x) if x == x and abs(x) < 1e17 and x == int(x) else Decimal(repr(x))


def _refuse(what: str, *values):
    raise ValueError(f"{' and '.join(map(dump, values))} cannot be {what}")


def plus(a, b):
    if a is None or b is None:
        return b if a is None else a
    if _is_number(a) and _is_number(b):
        return _number(float(a) + float(b))
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **b}
    return a + b if type(a) is type(b) and isinstance(a, (str, list)) else _refuse("added", a, b)


def minus(a, b):
    if _is_number(a) and _is_number(b):
        return _number(float(a) - float(b))
    return [x for x in a if not any(ordered(x) == ordered(y) for y in b)] if isinstance(a, list) and isinstance(b, list) else _refuse("subtracted", a, b)


def times(a, b):
    if _is_number(a) and _is_number(b):
        return _number(float(a) * float(b))
    if isinstance(a, dict) and isinstance(b, dict):
        return merged(a, b)
    text, n = (a, b) if isinstance(a, str) else (b, a)
    return (text * int(n) if n > 0 else None) if isinstance(text, str) and _is_number(n) else _refuse("multiplied", a, b)


def over(a, b):
    if isinstance(a, str) and isinstance(b, str):
        return (a.split(b) if b else list(a)) if a else []
    return _number(float(a) / float(b)) if _is_number(a) and _is_number(b) and b else _refuse("divided", a, b)


def modulo(a, b):
    if not (_is_number(a) and _is_number(b) and int(b)):
        return _refuse("divided", a, b)
    rest = abs(int(a)) % abs(int(b))
    return -rest if a < 0 else rest


def otherwise(a, b):
    return b if a is None or a is False else a


_OPERATORS = {"+": plus, "-": minus, "*": times, "/": over, "%": modulo, "//": otherwise}


# Changes


def changed(value, path: list | tuple, change: Callable):
    """The value with what is at the path changed; a change to GONE takes an element out."""
    if not path:
        return change(value)
    key, rest = path[0], path[1:]
    if key is ...:
        if isinstance(value, dict):
            return {k: v for k, v in ((k, changed(v, rest, change)) for k, v in value.items()) if v is not GONE and v != GONE}
        if isinstance(value, list):
            return [v for v in (changed(v, rest, change) for v in value) if v != GONE]
        raise ValueError(f"Cannot iterate over {dump(value)}")
    if isinstance(key, slice):
        part = list(value or [])
        i, j, _ = key.indices(len(part))
        new = changed(part[i : max(i, j)], rest, change)
        if new != GONE and not isinstance(new, list):
            raise ValueError("A slice of an array can only be assigned another array")
        return part[:i] + ([] if new == GONE else new) + part[max(i, j) :]
    if isinstance(key, str):
        if value is not None and not isinstance(value, dict):
            raise ValueError(f'Cannot index {dump(value)} with "{key}"')
        new = changed((value or {}).get(key), rest, change)
        return {k: v for k, v in (value or {}).items() if k != key} if new == GONE else {**(value or {}), key: new}
    own = list(value or [])
    index = key if key >= 0 else len(own) + key
    new = changed(own[index] if 0 <= index < len(own) else None, rest, change)
    if new == GONE:
        return own[:index] + own[index + 1 :] if 0 <= index else own
    return set_at(own, (key,), new)


def concrete(value, path: list | tuple) -> Iterator[tuple]:
    """The paths of keys and indexes that a path with `...` and slices stands for."""
    if not path:
        yield ()
        return
    key, rest = path[0], path[1:]
    at = list(value) if isinstance(value, dict) else list(range(len(value))) if isinstance(value, list) else []
    keys = at if key is ... else at[key] if isinstance(key, slice) else [key]
    for k in keys:
        for below in concrete(_child(value, k), rest):
            yield (k, *below)


def _child(value, key):
    if isinstance(value, dict) and isinstance(key, str):
        return value.get(key)
    return value[key] if isinstance(value, list) and isinstance(key, int) and -len(value) <= key < len(value) else None


def _at(value, path: tuple):
    for key in path:
        value = _child(value, key)
    return value


def update(doc: Column | str, path: list, change: Callable) -> Column:
    """Documents with what is at the path changed by a function of it; GONE takes it out."""
    return _each(doc, "string", lambda d: dump(changed(d, path, change)))


def assign(doc: Column | str, path: list, value) -> Column:
    return update(doc, path, lambda _: value)


def compound(doc: Column | str, path: list, operator: str, value) -> Column:
    """What is at the path, combined with a constant by + - * / % or //."""
    of = _OPERATORS[operator]
    return update(doc, path, lambda old: of(old, value))


def map_values(doc: Column | str, change: Callable) -> Column:
    return update(doc, [...], change)


def flattened(values: list, depth: float) -> list:
    out = []
    for v in values:
        out += flattened(v, depth - 1) if isinstance(v, list) and depth > 0 else [v]
    return out


def flatten(doc: Column | str, depth: float = float("inf")) -> Column:
    """Arrays with the elements of inner arrays in their place, to a depth."""
    if depth < 0:
        raise ValueError("flatten depth must not be negative")
    return _each(doc, "string", lambda d: dump(flattened(d, depth)))


def pick(doc: Column | str, *which: list) -> Column:
    """Only what is at the paths; what is not there is null."""

    def of(d):
        out = None
        for path in which:
            for p in concrete(d, path):
                out = set_at(out, p, _at(d, p))
        return dump(out)

    return _each(doc, "string", of)


def omit(doc: Column | str, *which: list) -> Column:
    return _each(doc, "string", lambda d: dump(delete_at(d, [p for path in which for p in concrete(d, path)])))


def rename(doc: Column | str, path: list, new: str) -> Column:
    """The key at the end of a path gets a new name and keeps its place."""
    old = path[-1]

    def of(value):
        if not isinstance(value, dict) or old not in value:
            return value
        return {new if k == old else k: v for k, v in value.items() if k == old or k != new}

    return update(doc, path[:-1], of)


def _where(value, holds_at: Callable, keep: bool, path: tuple = ()):
    """Only the parts for which holds_at(path, value) is true, or all but these."""
    if path and bool(holds_at(path, value)):
        return value if keep else GONE
    if isinstance(value, dict):
        out = {k: w for k, v in value.items() if (w := _where(v, holds_at, keep, (*path, k))) != GONE}
    elif isinstance(value, list):
        out = [w for i, v in enumerate(value) if (w := _where(v, holds_at, keep, (*path, i))) != GONE]
    else:
        return GONE if keep else value
    return GONE if keep and path and not out else out


def pick_where(doc: Column | str, holds_at: Callable) -> Column:
    """The parts of a document, whole, for which a function of path and value is true, in their places."""
    return _each(doc, "string", lambda d: dump(None if (out := _where(d, holds_at, True)) == GONE else out))


def omit_where(doc: Column | str, holds_at: Callable) -> Column:
    return _each(doc, "string", lambda d: dump(_where(d, holds_at, False)))


#: Fields of metadata that hold wherever a manifest is applied, in the order they are written (fixed values).
METADATA = ("annotations", "generateName", "labels", "name", "namespace")


def _cleaned(value):
    if not isinstance(value, dict):
        return value
    out = dict(value)
    if isinstance(out.get("metadata"), dict):
        out["metadata"] = {k: out["metadata"][k] for k in METADATA if k in out["metadata"]}
    if isinstance(out.get("items"), list):
        out["items"] = [_cleaned(v) for v in out["items"]]
    return out


def clean_k8s_metadata(doc: Column | str) -> Column:
    """Manifests with the portable fields of their metadata only, in lists of them too."""
    return _each(doc, "string", lambda d: dump(_cleaned(d)))


# Events, merging, writing


def truncate_stream(events: Column | str, depth: int) -> Column:
    """Events without the first `depth` parts of their paths; those whose paths are not longer go."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else [dump([e[0][depth:], *e[1:]]) for e in map(load, r) if len(e[0]) > depth])

    return run(_c(events))


def from_stream(events: Column | str) -> Column:
    """array<string>: the documents that events, as JSON, build; one ends where its outermost container does."""

    def documents(stream: list) -> Iterator[str]:
        held: list = []
        for e in map(load, stream):
            held.append(e)
            if len(e[0]) == (0 if len(e) == 2 else 1):
                yield dump(e[1] if len(e) == 2 else from_events(held))
                held = []

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else list(documents(r)))

    return run(_c(events))


def merge_all(docs: Column | str, deep: bool = True) -> Column:
    """The objects of an array<string> of JSON, later ones over earlier ones."""

    def of(texts: tuple) -> str:
        out: dict = {}
        for t in texts:
            if t is not None:
                out = merged(out, load(t), deep)
        return dump(out)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(each_once((None if r is None else tuple(r) for r in rows), of), dtype=object)

    return run(_c(docs))


def pretty(value, width: int = 2, at: int = 0) -> str:
    inner, outer = "\n" + " " * (at + width), "\n" + " " * at
    if isinstance(value, dict) and value:
        return "{" + ",".join(f"{inner}{json.dumps(k, ensure_ascii=False)}: {pretty(v, width, at + width)}" for k, v in value.items()) + outer + "}"
    if isinstance(value, list) and value:
        return "[" + ",".join(inner + pretty(v, width, at + width) for v in value) + outer + "]"
    return dump(value)


def indented(doc: Column | str, width: int = 2) -> Column:
    """The document on several lines."""
    return _each(doc, "string", lambda d: pretty(d, width))


# Every part of a document


def every(value, path: tuple = ()) -> Iterator[tuple[tuple, object]]:
    """Paths and values of the document and of all that is in it, parents first."""
    yield path, value
    for key, child in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from every(child, (*path, key))


def values(doc: Column | str) -> Column:
    """array<string>: the document and all that is in it, as JSON, parents first."""
    return _each(doc, "array<string>", lambda d: [dump(v) for _, v in every(d)])


def find_paths(doc: Column | str, holds_at: Callable) -> Column:
    """array<string>: the paths, as JSON, of the parts for which a function of path and value is true."""
    return _each(doc, "array<string>", lambda d: [dump(list(p)) for p, v in every(d) if p and holds_at(p, v)])


def walk_paths(doc: Column | str, change: Callable) -> Column:
    """The document changed from the bottom up by a function of path and value."""

    def of(value, path: tuple = ()):
        if isinstance(value, dict):
            value = {k: of(v, (*path, k)) for k, v in value.items()}
        elif isinstance(value, list):
            value = [of(v, (*path, i)) for i, v in enumerate(value)]
        return change(path, value)

    return _each(doc, "string", lambda d: dump(of(d)))


# Texts in a format


def parse(text: Column | str, kind: str) -> Column:
    """array<string>: the documents, as JSON, that a text holds in a format: json, jsonl or tsv (rows of texts)."""
    text = _c(text)
    lines = F.filter(F.split(text, "\r?\n", -1), lambda x: F.trim(x) != "")
    if kind == "json":
        return F.when(text.isNotNull(), F.array(F.trim(text)))
    if kind == "jsonl":
        return F.transform(lines, lambda x: F.trim(x))
    if kind == "tsv":
        return F.transform(lines, lambda x: F.to_json(F.split(x, "\t", -1)))
    raise ValueError(f"{kind} texts are read from files")


def render(docs: Column | str, kind: str) -> Column:
    """The text of an array<string> of documents in a format: json (several lines each) or jsonl."""
    if kind not in ("json", "jsonl"):
        raise ValueError(f"{kind} texts are written to files")
    write = pretty if kind == "json" else dump

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else "".join(write(load(d)) + "\n" for d in r))

    return run(_c(docs))


# TOML


def _toml(value) -> str:
    """A value inside a line."""
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{_toml_key(k)} = {_toml(v)}" for k, v in value.items()) + " }" if value else "{}"
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    if value is None:
        raise ValueError("TOML has no null")
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f")
    out = dump(value)
    return out if isinstance(value, (bool, int)) or set(out) & set(".eE") else out + ".0"


def _toml_key(key: str) -> str:
    return key if key and all(c.isascii() and (c.isalnum() or c in "_-") for c in key) else json.dumps(key, ensure_ascii=False)


def _toml_tables(value: dict, path: tuple = ()) -> Iterator[str]:
    """Plain keys first, then tables and rows of tables under their names."""
    tables = {k: v for k, v in value.items() if isinstance(v, dict) or isinstance(v, list) and v and all(isinstance(x, dict) for x in v)}
    for k, v in value.items():
        if k not in tables:
            yield f"{_toml_key(k)} = {_toml(v)}"
    for k, v in tables.items():
        name = ".".join(map(_toml_key, (*path, k)))
        for one in v if isinstance(v, list) else [v]:
            yield f"[[{name}]]" if isinstance(v, list) else f"[{name}]"
            yield from _toml_tables(one, (*path, k))


def toml(doc: Column | str) -> Column:
    """The document, an object, in TOML."""

    def of(d) -> str:
        if not isinstance(d, dict):
            raise ValueError("toml output requires an object at the document root")
        return "\n".join(_toml_tables(d))

    return _each(doc, "string", of)
