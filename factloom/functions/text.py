"""Signatures, paths and other strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_extension(path: Column) -> Column:
    """A path without a closing ``.d.ts`` or ``.ts``."""
    return F.regexp_replace(path, r"(\.d)?\.ts$", "")


def file_signature(project: Column, path: Column) -> Column:
    return F.concat(F.lit("@"), project, F.lit("/"), without_extension(path), F.lit(": "))


def member_signature(owner: Column, name: Column) -> Column:
    return F.concat(owner, F.lit("."), name)


def method_signature(owner: Column, name: Column, types: Column) -> Column:
    """owner.name(types); repeated types appear once."""
    return F.concat(owner, F.lit("."), name, F.lit("("), F.array_join(F.array_distinct(types), ", "), F.lit(")"))


def posix_path(path: Column) -> Column:
    """Backslashes as slashes, repeated slashes and ``.`` parts gone, ``..`` taken off where something is before it."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/+"), lambda p: (p != "") & (p != "."))

    def add(done: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((p == "..") & absolute, done).otherwise(F.concat(done, F.array(p)))

    absolute = path.rlike(r"^[\\/]")
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), add), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def invocation_parts(text: Column) -> Column:
    """``a.b.c()`` as [a, b, c]; an empty array for anything else."""
    pattern = r"^([^.()]+)\.([^.()]+)\.([^.()]+)\(\)$"
    none = F.array().cast("array<string>")
    return F.when(text.rlike(pattern), F.array(*[F.regexp_extract(text, pattern, i) for i in (1, 2, 3)])).otherwise(none)


def last_bracket(text: Column) -> Column:
    """What stands in the last angle brackets before ``()>``."""
    return F.trim(F.regexp_extract(text, r"<([^<>]*)\(\)>$", 1))


def char_code_sum(text: Column) -> Column:
    """The sum of a string's UTF-16 units: a character above 65,535 is two of them."""

    def units(c: Column) -> Column:
        point, over = F.ascii(c), F.ascii(c) - 0x10000
        return F.when(over < 0, point).otherwise(0xD800 + F.shiftright(over, 10) + 0xDC00 + over.bitwiseAND(0x3FF))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a + units(c))


def accessor_name(name: Column) -> Column:
    """``Get-x`` as ``get x``, ``Set-x`` as ``set x``."""
    return F.regexp_replace(F.regexp_replace(name, "^Get-", "get "), "^Set-", "set ")


def api_version(text: Column, default: int = 9) -> Column:
    """The API number in a version text such as ``4.0.0(10)``."""
    n = F.regexp_extract(text, r"\(([0-9]+)\)", 1)
    return F.when(n == "", F.lit(default)).otherwise(n.cast("int"))


def first_lines(code: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(code, "\n"), 1, n), "\n")


def content_hash(code: Column) -> Column:
    return F.sha2(code, 256)
