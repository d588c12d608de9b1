"""Functions of arrays and maps; all are built of higher-order functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def at(a: Column | str, index: int) -> Column:
    """The element at an index, from the end if it is negative; null where there is none."""
    a = _c(a)
    return F.get(a, F.lit(index)) if index >= 0 else F.get(a, F.size(a) + index)


def cut(a: Column | str, start: Column | float | None = None, stop: Column | float | None = None) -> Column:
    """a[start:stop] with negative bounds counted from the end; a fraction is rounded outwards."""
    a = _c(a)
    n = F.size(a)

    def bound(i: Column | float | None, default: Column, outwards: Callable) -> Column:
        if i is None:
            return default
        i = outwards(i if isinstance(i, Column) else F.lit(float(i))).cast("int")
        return F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(F.least(i, n))

    i, j = bound(start, F.lit(0), F.floor), bound(stop, n, F.ceil)
    return F.slice(a, i + 1, F.greatest(j - i, F.lit(0)))


def difference(a: Column | str, b: Column | str) -> Column:
    """Elements of a that b has not, null equal to null; what stays keeps its repeats."""
    return F.filter(_c(a), lambda x: ~F.exists(_c(b), lambda y: y.eqNullSafe(x)))


def sort_by(a: Column | str, key: Callable[[Column], Column]) -> Column:
    """By key, nulls first, ties in their order."""
    rows = F.transform(_c(a), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(rows), lambda r: r["x"])


def sort_by_desc(a: Column | str, key: Callable[[Column], Column]) -> Column:
    """By key downwards, ties in their order."""
    rows = F.transform(_c(a), lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x")))
    return F.transform(F.sort_array(rows, asc=False), lambda r: r["x"])


def unique_by(a: Column | str, key: Callable[[Column], Column]) -> Column:
    """The first element of each key, in the order of keys."""
    sorted_ = sort_by(a, key)
    return F.filter(sorted_, lambda x, i: (i == 0) | ~key(x).eqNullSafe(key(F.get(sorted_, i - 1))))


def min_by(a: Column | str, key: Callable[[Column], Column]) -> Column:
    """The first element with the least key."""
    rows = F.transform(_c(a), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.array_min(rows)["x"]


def max_by(a: Column | str, key: Callable[[Column], Column]) -> Column:
    """The last element with the greatest key."""
    rows = F.transform(_c(a), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.array_max(rows)["x"]


def add(a: Column | str, start: Column) -> Column:
    """The sum of numbers, or texts or arrays put together, from a start value; null for an empty array."""
    plus = F.concat if not isinstance(start, (int, float)) else (lambda x, y: x + y)
    zero = start if isinstance(start, Column) else F.lit(start)
    return F.when(F.size(_c(a)) > 0, F.aggregate(_c(a), zero, lambda acc, x: plus(acc, x)))


def running(a: Column | str, start: Column, step: Callable[[Column, Column], Column], kind: str = "double") -> Column:
    """All states of a fold, one for each element; kind is the type of states. The states so far are copied for every
    element: for arrays of some hundreds. Longer ones are rows, see tables.running()."""
    first = F.struct(start.cast(kind).alias("state"), F.array().cast(f"array<{kind}>").alias("out"))

    def next_(acc: Column, x: Column) -> Column:
        state = step(acc["state"], x).cast(kind)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(state)).alias("out"))

    return F.aggregate(_c(a), first, next_)["out"]


def until(start: Column, stops: Callable[[Column], Column], step: Callable[[Column], Column], most: int = 1000) -> Column:
    """The first state, from start on, at which it stops; an error if there is none in `most` steps."""
    out = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, lambda acc, _: F.when(stops(acc), acc).otherwise(step(acc)))
    return F.when(stops(out), out).otherwise(F.raise_error(F.lit(f"no end in {most} steps")))


def while_(start: Column, goes_on: Callable[[Column], Column], step: Callable[[Column], Column], kind: str = "long", most: int = 1000) -> Column:
    """The states, from start on, before the first at which it does not go on; an error if there are more than `most`."""
    first = F.struct(start.cast(kind).alias("state"), F.array().cast(f"array<{kind}>").alias("out"))

    def next_(acc: Column, _: Column) -> Column:
        more = F.struct(step(acc["state"]).cast(kind).alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out"))
        return F.when(goes_on(acc["state"]), more).otherwise(acc)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, next_)
    return F.when(~goes_on(out["state"]), out["out"]).otherwise(F.raise_error(F.lit(f"no end in {most} steps")))


def indices(a: Column | str, part: Column) -> Column:
    """Where an array begins in another, overlaps included; an empty one is nowhere."""
    a, n = _c(a), F.size(part)
    last = F.size(a) - n
    at_ = F.when((last >= 0) & (n > 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at_, lambda i: F.slice(a, i + 1, n) == part)


def flatten_to(a: Column | str, depth: int) -> Column:
    """An array of arrays of ... with `depth` levels put into their places."""
    if depth < 0:
        raise ValueError("flatten depth must not be negative")
    out = _c(a)
    for _ in range(depth):
        out = F.flatten(out)
    return out


def product(*arrays: Column | str) -> Column:
    """All combinations of an element of each array, as arrays, the last one varying first."""
    out = F.transform(_c(arrays[0]), lambda x: F.array(x))

    def longer(heads: Column, a: Column) -> Column:
        return F.flatten(F.transform(heads, lambda head: F.transform(a, lambda x: F.concat(head, F.array(x)))))

    for a in arrays[1:]:
        out = longer(out, _c(a))
    return out


def numbers(start: Column | int, stop: Column | int, step: int = 1) -> Column:
    """start, start + step, ... before stop; empty if there are none."""
    start, stop = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    last = stop - 1 if step > 0 else stop + 1
    some = start <= last if step > 0 else start >= last
    return F.when(some, F.sequence(start, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def bsearch(a: Column | str, x: Column) -> Column:
    """The index of x in an ascending array, or -1 - where it would be put."""
    a = _c(a)
    at_ = F.array_position(a, x) - 1
    return F.when(at_ >= 0, at_).otherwise(-1 - F.size(F.filter(a, lambda y: y < x)))


def transpose(a: Column | str) -> Column:
    """Rows to columns; short rows are filled up with nulls."""
    a = _c(a)
    width = F.coalesce(F.array_max(F.transform(a, F.size)), F.lit(0))
    return F.transform(numbers(F.lit(0), width), lambda i: F.transform(a, lambda row: F.get(row, i)))


def combinations(a: Column | str, b: Column | str) -> Column:
    """All pairs of elements of two arrays, as structs."""
    return F.flatten(F.transform(_c(a), lambda x: F.transform(_c(b), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def take_while(a: Column | str, holds: Callable[[Column], Column]) -> Column:
    """The elements before the first one for which it does not hold."""
    a = _c(a)
    stops = F.array_position(F.transform(a, lambda x: ~F.coalesce(holds(x), F.lit(False))), True)
    return F.when(stops > 0, F.slice(a, F.lit(1), (stops - 1).cast("int"))).otherwise(a)


def entries(m: Column | str) -> Column:
    return F.map_entries(_c(m))


def with_entries(m: Column | str, change: Callable[[Column], Column]) -> Column:
    """A map whose entries, struct(key, value), are changed one by one."""
    return F.map_from_entries(F.transform(F.map_entries(_c(m)), change))


def keys(m: Column | str) -> Column:
    return F.array_sort(F.map_keys(_c(m)))


def merge(left: Column | str, right: Column | str) -> Column:
    """A map of both; right counts where both have a key."""
    left, right = _c(left), _c(right)
    own = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(own, right)


def pick(m: Column | str, *names: str) -> Column:
    return F.map_filter(_c(m), lambda k, _: k.isin(*names))


def omit(m: Column | str, *names: str) -> Column:
    return F.map_filter(_c(m), lambda k, _: ~k.isin(*names))


def rename_key(m: Column | str, old: str, new: str) -> Column:
    """The entry keeps its place."""
    return F.transform_keys(_c(m), lambda k, _: F.when(k == old, F.lit(new)).otherwise(k))


def drop_nulls(m: Column | str) -> Column:
    return F.map_filter(_c(m), lambda _, v: v.isNotNull())


def sort_keys(m: Column | str) -> Column:
    return F.map_from_entries(F.sort_array(F.map_entries(_c(m))))


def alternative(*values: Column) -> Column:
    """The first value that is neither null nor the boolean false."""
    return F.coalesce(*[F.when(truthy(v), v) for v in values[:-1]], values[-1])


def truthy(v: Column) -> Column:
    """Whether a value is neither null nor the boolean false; a text is neither, whatever it says."""
    return v.isNotNull() & ~((F.typeof(v) == "boolean") & F.coalesce(v.cast("string") == "false", F.lit(False)))
