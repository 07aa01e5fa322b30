"""Scalar rules over rendered types, operators and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operators by the kind of their result, and each relation's opposite.
ARITHMETIC = ["-", "*", "/", "%", "&", "|", "^", "<<", ">>", ">>>"]
RELATIONAL = ["<", "<=", ">", ">=", "==", "!=", "===", "!==", "&&", "||"]
OPPOSITE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "===": "!==", "!=": "==", "!==": "==="}
# Type names of the analysed language, and components without children.
PRIMITIVES = ["boolean", "number", "string", "undefined", "null", "any", "void", "never"]
# Syntax kinds of the analysed language and the types they stand for.
KEYWORDS = {
    "NumberKeyword": "number", "StringKeyword": "string", "BooleanKeyword": "boolean", "VoidKeyword": "void", "AnyKeyword": "any", "NullKeyword": "null", "UndefinedKeyword": "undefined", "NeverKeyword": "never",
    "TrueKeyword": "boolean", "FalseKeyword": "boolean", "NumericLiteral": "number", "FirstLiteralToken": "number", "StringLiteral": "string",
}
DECORATED_STATE = ["State", "Prop", "Link", "StorageProp", "StorageLink", "Provide", "Consume", "ObjectLink", "LocalStorageLink", "LocalStorageProp", "Local"]


def binary_result(op: str, left: str, right: str) -> str:
    """The type of ``left op right``, for plain strings."""
    if op in RELATIONAL:
        return "boolean"
    if op == "+" and "string" in (left, right):
        return "string"
    return "number" if (op == "+" or op in ARITHMETIC) and left == right == "number" else "unknown"


def binop_type(op: Column, left: Column, right: Column) -> Column:
    """The type of ``left op right``: relations and logic give boolean, ``+`` a string beside one, arithmetic of numbers a number, anything else is unknown."""
    return (
        F.when(op.isin(RELATIONAL), "boolean")
        .when((op == "+") & ((left == "string") | (right == "string")), "string")
        .when(op.isin("+", *ARITHMETIC) & (left == "number") & (right == "number"), "number")
        .otherwise("unknown")
    )


def literal_type(text: Column) -> Column:
    """The type of a literal's source text."""
    return (
        F.when(text.isNull(), "unknown")
        .when(text.isin("true", "false"), "boolean")
        .when(text.isin("null", "undefined"), text)
        .when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number")
        .when(text.rlike(r"""^(".*"|'.*'|`.*`)$"""), "string")
        .when(text.rlike(r"^\[.*\]$"), "array")
        .otherwise("unknown")
    )


def type_from_name(name: Column) -> Column:
    """A type annotation's rendering: primitives as they are, a regular expression its class, anything else an unresolved reference to its name."""
    return F.when(name.isin(PRIMITIVES), name).when(name == "RegularExpression", "class RegExp").otherwise(F.concat(F.lit("ref "), name))


def keyword_name(kind: Column) -> Column:
    """The type that a syntax kind stands for: ``NumberKeyword`` is number; any other kind is itself."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KEYWORDS.items() for x in kv]), kind), kind)


def element_type(members: Column) -> Column:
    """The type of an array literal's elements: what all of them are, unknown if they differ or there is none."""
    kinds = F.array_distinct(members)
    return F.when(F.size(kinds) == 1, kinds[0]).otherwise("unknown")


def negated(op: Column) -> Column:
    """The opposite relation, null for operators without one."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in OPPOSITE.items() for x in kv]), op)


def array_type(base: Column, dim: Column) -> Column:
    return F.concat(F.lit("("), base, F.lit(")"), F.repeat(F.lit("[]"), dim))


def union_type(members: Column) -> Column:
    return F.array_join(F.array_distinct(members), "|")


def default_constant(type_: Column) -> Column:
    """The text of a type's default value."""
    return F.when(type_ == "number", "0").when(type_ == "string", "''").when(type_ == "boolean", "false").when(type_ == "null", "null").otherwise("undefined")
