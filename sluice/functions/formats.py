"""Text formats of values: @csv, @tsv, @html, @uri, @sh, @base64, @json and their opposites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def csv_row(values: Column | str, text: bool = True) -> Column:
    """A line of an array: texts quoted, quotes doubled, nulls empty; text=False for numbers and booleans."""
    cell = (lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))) if text else (lambda x: x.cast("string"))
    return F.concat_ws(",", F.transform(_c(values), lambda x: F.coalesce(cell(x), F.lit(""))))


def tsv_row(values: Column | str) -> Column:
    """A line of an array: back slash, TAB, line feed and carriage return escaped, nulls empty."""

    def cell(x: Column) -> Column:
        for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            x = F.replace(x, F.lit(plain), F.lit(escaped))
        return F.coalesce(x, F.lit(""))

    return F.concat_ws("\t", F.transform(_c(values), lambda x: cell(x.cast("string"))))


def html(s: Column | str) -> Column:
    s = _c(s)
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(plain), F.lit(escaped))
    return s


def uri(s: Column | str) -> Column:
    """Percent-encoded but for letters, digits and -._~"""
    s = F.url_encode(_c(s))
    for plain, escaped in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        s = F.replace(s, F.lit(plain), F.lit(escaped))
    return s


def from_uri(s: Column | str) -> Column:
    return F.url_decode(F.replace(_c(s), F.lit("+"), F.lit("%2B")))


def sh(s: Column | str) -> Column:
    """A shell word in single quotes."""
    return F.concat(F.lit("'"), F.replace(_c(s), F.lit("'"), F.lit("'\\''")), F.lit("'"))


def shell_escape(s: Column | str) -> Column:
    """Like sh(), but safe words stay as they are."""
    return F.when(F.rlike(_c(s), F.lit(r"^[A-Za-z0-9@%_\-+=:,./]+$")), _c(s)).otherwise(sh(s))


def base64(s: Column | str, urlsafe: bool = False, pad: bool = True) -> Column:
    out = F.base64(_c(s).cast("binary"))
    out = F.replace(out, F.lit("\r\n"), F.lit(""))  # long texts come in lines
    out = F.translate(out, "+/", "-_") if urlsafe else out
    return out if pad else F.regexp_replace(out, "=+$", "")


def from_base64(s: Column | str) -> Column:
    """The text, from either alphabet, padded or not."""
    s = F.regexp_replace(F.translate(_c(s), "-_", "+/"), "=+$", "")
    padded = F.rpad(s, (F.ceil(F.length(s) / 4) * 4).cast("int"), F.lit("="))
    return F.decode(F.unbase64(padded), "UTF-8")


def digest(s: Column | str, algorithm: str = "sha256", encoding: str = "hex") -> Column:
    """The digest by sha1, sha256, sha512 or md5: lower-case hexadecimal, or base64."""
    of = {"sha1": F.sha1, "md5": F.md5, "sha256": lambda b: F.sha2(b, 256), "sha512": lambda b: F.sha2(b, 512)}
    out = of[algorithm](_c(s).cast("binary"))
    return {"hex": lambda x: x, "base64": lambda x: F.replace(F.base64(F.unhex(x)), F.lit("\r\n"), F.lit(""))}[encoding](out)


def text(value: Column | str) -> Column:
    """A text as it is, anything else as JSON."""
    value = _c(value)
    return F.when(F.typeof(value) == "string", value.cast("string")).otherwise(F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""))


def filled(kind: str, template: str, *values: Column | str) -> Column:
    """A template whose {} are the values in a format: text, json, html, uri, sh or base64. What is around them stays."""
    of = {"text": text, "json": lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", ""), "html": lambda x: html(text(x)), "uri": lambda x: uri(text(x)), "sh": lambda x: sh(text(x)), "base64": lambda x: base64(text(x))}[kind]
    parts = template.split("{}")
    if len(parts) != len(values) + 1:
        raise ValueError("a template has as many {} as there are values")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        out += [of(_c(value)), F.lit(part)]
    return F.concat(*out)


def sh_words(values: Column | str) -> Column:
    """The elements of an array as shell words between spaces."""
    return F.array_join(F.transform(_c(values), sh), " ")


def json(value: Column | str) -> Column:
    return F.to_json(_c(value), {"ignoreNullFields": "false"})
