"""Exact values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as txt
from factloom.functions import types as ty


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("path, want", [("a\\b\\c", "a/b/c"), ("./a//b/", "a/b"), ("a/../b", "b"), ("../a", "../a"), ("/x/../../y", "/y"), ("", "."), ("a/..", ".")])
def test_posix_path(spark, path, want):
    assert one(spark, txt.posix_path(F.lit(path))) == want


def test_strings(spark):
    assert one(spark, txt.invocation_parts(F.lit("a.b.c()"))) == ["a", "b", "c"]
    assert one(spark, txt.invocation_parts(F.lit("a.b()"))) == []
    assert one(spark, txt.last_bracket(F.lit("<x.<C.m()>"))) == "C.m"
    assert one(spark, txt.without_extension(F.lit("a.d.ts"))) == "a" and one(spark, txt.without_extension(F.lit("a.ts.b"))) == "a.ts.b"
    assert one(spark, txt.char_code_sum(F.lit("ab"))) == 195
    assert one(spark, txt.api_version(F.lit("4.0(10)"))) == 10 and one(spark, txt.api_version(F.lit("x"))) == 9
    assert one(spark, txt.method_signature(F.lit("C"), F.lit("m"), F.array(F.lit("number"), F.lit("number")))) == "C.m(number)"
    assert one(spark, txt.first_lines(F.lit("a\nb\nc"), 2)) == "a\nb"


def test_types(spark):
    assert one(spark, ty.binop_type(F.lit("+"), F.lit("string"), F.lit("number"))) == "string"
    assert one(spark, ty.binop_type(F.lit("<"), F.lit("any"), F.lit("any"))) == "boolean"
    assert one(spark, ty.literal_type(F.lit("1.5e3"))) == "number" and one(spark, ty.literal_type(F.lit("'x'"))) == "string"
    assert one(spark, ty.negated(F.lit("<="))) == ">" and one(spark, ty.negated(F.lit("&&"))) is None
    assert one(spark, ty.array_type(F.lit("number"), F.lit(2))) == "(number)[][]"
