"""String functions as expressions of built-in ones; positions count characters, from 0."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as trimming knows it.
_SPACE = r"[\s\u0085\p{Z}]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_downcase(s: Column | str) -> Column:
    return F.translate(_c(s), _UPPER, _LOWER)


def ascii_upcase(s: Column | str) -> Column:
    return F.translate(_c(s), _LOWER, _UPPER)


def ltrim(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), "^" + _SPACE, "")


def rtrim(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), _SPACE + r"\z", "")


def trim(s: Column | str) -> Column:
    return rtrim(ltrim(s))


def ltrimstr(s: Column | str, prefix: str) -> Column:
    s = _c(s)
    return F.when(s.startswith(prefix), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)


def rtrimstr(s: Column | str, suffix: str) -> Column:
    s = _c(s)
    return F.when(s.endswith(suffix), F.substr(s, F.lit(1), F.length(s) - len(suffix))).otherwise(s)


def trimstr(s: Column | str, affix: str) -> Column:
    return rtrimstr(ltrimstr(s, affix), affix)


def split_on(s: Column | str, separator: str) -> Column:
    """The parts between literal separators; an empty text has none, an empty separator gives characters."""
    s = _c(s)
    parts = F.split(s, re.escape(separator), -1) if separator else F.split(s, "", -1)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(parts)


def join_values(values: Column | str, separator: str) -> Column:
    """Elements as text between separators, nulls as empty text."""
    return F.concat_ws(separator, F.transform(_c(values), lambda x: F.coalesce(x.cast("string"), F.lit(""))))


def indices(s: Column | str, needle: str) -> Column:
    """Where needle begins, overlaps included; an empty needle is nowhere."""
    s, n = _c(s), len(needle)
    if not n:
        return F.when(s.isNotNull(), F.array().cast("array<int>"))
    last = F.length(s) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.substr(s, i + 1, F.lit(n)) == needle)


def cut(s: Column | str, start: int | None = None, stop: int | None = None) -> Column:
    """s[start:stop] by characters, with negative bounds counted from the end."""
    s = _c(s)
    n = F.length(s)
    bound = lambda i, default: default if i is None else (F.least(F.lit(i), n) if i >= 0 else F.greatest(n + i, F.lit(0)))
    i, j = bound(start, F.lit(0)), bound(stop, n)
    return F.substr(s, i + 1, F.greatest(j - i, F.lit(0)))


def code_points(s: Column | str) -> Column:
    s = _c(s)
    return F.when(s == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(s, "", -1), F.ascii))


def from_code_points(points: Column | str) -> Column:
    """Text of code points; those that are none are U+FFFD."""
    bad = lambda p: (p < 0) | (p > 0x10FFFF) | p.between(0xD800, 0xDFFF)
    units = F.transform(_c(points), lambda p: F.lpad(F.hex(F.when(bad(p), F.lit(0xFFFD)).otherwise(p)), 8, "0"))
    return F.decode(F.unhex(F.array_join(units, "")), "UTF-32")


def repeat(s: Column | str, times: Column) -> Column:
    """The text floor(times) times; null for a negative number or NaN."""
    n = F.floor(times)
    return F.when((times >= 0) & ~F.isnan(times.cast("double")), F.repeat(_c(s), n.cast("int")))


def flagged(pattern: str, flags: str = "") -> str:
    """The pattern with flags i (case), x (extended), s (dot matches line feeds) put into it; g and n are the callers'."""
    if bad := set(flags) - set("gnixsl"):
        raise ValueError(f"{''.join(sorted(bad))} is not a valid modifier string")
    inline = "".join(f for f in "ixs" if f in flags)
    return f"(?{inline}){pattern}" if inline else pattern


def test(s: Column | str, pattern: str, flags: str = "") -> Column:
    return F.rlike(_c(s), F.lit(flagged(pattern, flags)))


def splits(s: Column | str, pattern: str, flags: str = "") -> Column:
    return F.split(_c(s), flagged(pattern, flags), -1)


def sub(s: Column | str, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match replaced, or with flag g every one; the replacement can name groups as $1."""
    s = _c(s)
    if "g" in flags:
        return F.regexp_replace(s, flagged(pattern, flags), replacement)
    # What is before the first match becomes a group, so that the pattern sees the whole text and matches but once.
    later = lambda sign: lambda m: f"{sign}{int(m[1]) + 2}"
    inner = re.sub(r"(?<!\\)\\([1-9])", later("\\"), pattern)
    return F.regexp_replace(s, flagged(rf"\A([\s\S]*?)({inner})", flags), "$1" + re.sub(r"\$(\d+)", later("$"), replacement))


def _groups(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _optional(pattern: str) -> bool:
    """Whether a group may take no part in a match: there are alternatives, or a group that may be left out."""
    return bool(re.search(r"\||\)(?:[?*]|\{0)", pattern))


def scan(s: Column | str, pattern: str, flags: str = "") -> Column:
    """All matches as texts; with groups in the pattern, an array of the groups for each match, null for one that took
    no part."""
    groups = _groups(pattern).groups
    if groups and _optional(pattern):
        return F.transform(match(s, pattern, flags + "g"), lambda m: F.transform(m["captures"], lambda c: c["string"]))
    pattern, s = flagged(pattern, flags), _c(s)
    if not groups:
        return F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    each = [F.regexp_extract_all(s, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    return F.transform(each[0], lambda _, i: F.array(*[F.get(e, i) for e in each]))


def capture(s: Column | str, pattern: str, flags: str = "") -> Column:
    """A struct of the named groups of the first match, null for one that took no part; null without a match."""
    order = sorted(_groups(pattern).groupindex.items(), key=lambda x: x[1])
    if _optional(pattern):
        first = F.get(match(s, pattern, flags), F.lit(0))["captures"]
        return F.when(test(s, pattern, flags), F.struct(*[F.get(first, F.lit(i - 1))["string"].alias(n) for n, i in order]))
    plain = flagged(pattern, flags)
    return F.when(F.rlike(_c(s), F.lit(plain)), F.struct(*[F.regexp_extract(_c(s), plain, i).alias(n) for n, i in order]))


def capture_all(s: Column | str, pattern: str, flags: str = "") -> Column:
    """array<map<string,string>>: the named groups of every match, null for one that took no part."""
    names = {i: n for n, i in _groups(pattern).groupindex.items()}
    keys = F.array(*[F.lit(names[i]) for i in sorted(names)])
    own = lambda m: F.array(*[F.get(m["captures"], F.lit(i - 1))["string"] for i in sorted(names)])
    return F.transform(match(s, pattern, flags + "g"), lambda m: F.map_from_arrays(keys, own(m)))


def match(s: Column | str, pattern: str, flags: str = "") -> Column:
    """array<struct<offset,length,string,captures>>: the first match, or with flag g all. No built-in gives offsets, so
    this is an Arrow-batched function; it takes classes as \\p{L} as test() does."""
    every, nonempty = "g" in flags, "n" in flags
    flagged(pattern, flags)
    kind = "array<struct<offset:int,length:int,string:string,captures:array<struct<offset:int,length:int,string:string,name:string>>>>"
    mode = (regex.IGNORECASE if "i" in flags else 0) | (regex.VERBOSE if "x" in flags else 0) | (regex.DOTALL if "s" in flags else 0)

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.Series:
        compiled = regex.compile(pattern, mode)
        names = {i: n for n, i in compiled.groupindex.items()}

        def of(text: str | None) -> list[dict] | None:
            if text is None:
                return None
            out = []
            for m in compiled.finditer(text):
                if nonempty and not m[0]:
                    continue
                groups = [{"offset": m.start(i), "length": -1 if m[i] is None else len(m[i]), "string": m[i], "name": names.get(i)} for i in range(1, compiled.groups + 1)]
                out.append({"offset": m.start(), "length": len(m[0]), "string": m[0], "captures": [{**g, "length": max(g["length"], 0)} for g in groups]})
                if not every:
                    break
            return out

        return texts.map(of)

    return found(_c(s))


def words(s: Column | str) -> Column:
    """Words of identifiers: runs of letters and digits, parted between digits and others and at humps."""
    edges = r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"
    return F.filter(F.split(_c(s), r"[^\p{IsAlphabetic}\p{N}]+|" + edges, -1), lambda w: w != "")


def kebab_case(s: Column | str) -> Column:
    return F.array_join(F.transform(words(s), F.lower), "-")


def snake_case(s: Column | str) -> Column:
    return F.array_join(F.transform(words(s), F.lower), "_")


def title_case(s: Column | str) -> Column:
    return F.array_join(F.transform(words(s), F.initcap), " ")


def camel_case(s: Column | str) -> Column:
    return F.array_join(F.transform(words(s), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.initcap(w))), "")


def slug(s: Column | str) -> Column:
    return kebab_case(s)


def regex_escape(s: Column | str) -> Column:
    """The text with a back slash before every character that means something in a pattern."""
    return F.regexp_replace(_c(s), r"([\\.+*?()|\[\]{}^$#&~-])", r"\\$1")


def index(s: Column | str, needle: str) -> Column:
    """Where needle first begins; null if nowhere."""
    return F.get(indices(s, needle), F.lit(0))


def rindex(s: Column | str, needle: str) -> Column:
    """Where needle last begins; null if nowhere."""
    return F.array_max(indices(s, needle))


def semver(s: Column | str) -> Column:
    """struct(major, minor, patch, prerelease, build) of a semantic version; null if it is none."""
    pattern = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"
    part = lambda i: F.regexp_extract(_c(s), pattern, i)
    numbers = [part(i + 1).cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch"))]
    rest = [F.nullif(part(i), F.lit("")).alias(n) for i, n in ((4, "prerelease"), (5, "build"))]
    return F.when(F.rlike(_c(s), F.lit(pattern)), F.struct(*numbers, *rest))


def semver_key(s: Column | str) -> Column:
    """What versions sort by: a release after its pre-releases, numbers before names, build numbers ignored."""
    v = semver(s)
    ids = F.transform(split_on(v["prerelease"], "."), lambda x: F.struct((~F.rlike(x, F.lit("^[0-9]+$"))).alias("named"), x.try_cast("long").alias("number"), x.alias("text")))
    return F.struct(v["major"], v["minor"], v["patch"], v["prerelease"].isNull(), ids)


def semver_bump(s: Column | str, part: str, label: str = "rc") -> Column:
    """The next major, minor or patch version, or the next prerelease of a label; null if the text is none."""
    v, names = semver(s), ("major", "minor", "patch")
    if part == "prerelease":
        own = F.concat_ws(".", *[v[n].cast("string") for n in names])
        ids = split_on(v["prerelease"], ".")
        last = F.element_at(ids, -1)
        counted = F.concat(F.array_join(F.slice(ids, F.lit(1), F.size(ids) - 1), "."), F.lit("."), (last.try_cast("long") + 1).cast("string"))
        following = F.when(F.get(ids, F.lit(0)) != label, f"{label}.1").when(F.rlike(last, F.lit("^[0-9]+$")), counted).otherwise(F.concat(v["prerelease"], F.lit(".1")))
        return F.when(v.isNotNull(), F.concat(own, F.lit("-"), F.when(v["prerelease"].isNull(), f"{label}.1").otherwise(following)))
    at = names.index(part)
    numbers = [v[n] if i < at else v[n] + 1 if i == at else F.lit(0) for i, n in enumerate(names)]
    return F.when(v.isNotNull(), F.concat_ws(".", *[n.cast("string") for n in numbers]))
