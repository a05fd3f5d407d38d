import pytest

from lodestone.llm import srcfilter
from lodestone.llm import srcfilter_kernel as k

HAND = "// Part of the kit, distributed under the terms in LICENSE.\nint add(int a, int b) {\n    // adds two numbers\n    return a + b;\n}\n" * 4
SCHEMA = "path string, line int, text string, language string, n_chars long, reason string"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "clash") for r in rows], SCHEMA)
    return {r["path"]: r["reason"] for r in srcfilter.machine_files(df).collect()}


@pytest.mark.parametrize(
    "top,gen,foreign",
    [
        ("// Code generated by tool. DO NOT EDIT.", 1, 0), ("# Automatically generated by tool 1.2; manual changes will be lost.", 1, 0), ("// <auto-generated> x </auto-generated>", 1, 0),
        ("// @generated by tool from a.in", 1, 0), ("# -*- coding: utf-8 -*-\n# DO NOT EDIT. This file was produced by t 2 from b.y.", 1, 0), ("// Diese Datei wurde automatisch aus a.i erzeugt (t 3).", 1, 0),
        ("// Machine-made output of tool 2.1 -- edit a.ui instead.", 1, 0), ("// Autogenerated file, source: a.proto. Regenerate with tool.", 1, 0), ("// Created by: x compiler version 3. All edits vanish when recompiled.", 1, 0),
        ("// Vendored from lib at tag v1.2, local patches: none.", 0, 1), ("// Copyright (c) 2014 the lib project. All rights reserved.", 0, 1), ("/* lib - single header library, version 2\n   upstream release, see the lib home page for updates */", 0, 1),
        ("// Do not edit the order of the entries below, the loader depends on it.", 0, 0), ("# The automatically generated mesh is checked here before use.", 0, 0), ("// Vendored libraries are loaded elsewhere.", 0, 0),
        ("// Inspired by third-party solvers, but written from scratch.", 0, 0), ("// This module generates the terrain patches for the demos.", 0, 0), ("// Part of the simulation kit, distributed under the terms in LICENSE.", 0, 0),
        ("int a; // generated by me", 0, 0),
    ],
)
def test_banners(top, gen, foreign):
    assert k.banners(top + "\nint x;\n", 1) == (gen, foreign)
    assert k.banners(top + "\nint x;\n", 500) == (0, 0)


def test_files(spark):
    numbers = "X = [\n" + "\n".join("    " + ", ".join(f"{i * 0.37 + j:.6f}" for j in range(8)) + "," for i in range(20)) + "\n]\n"
    blob = 'B = (\n' + "\n".join(f'    "{"aZ9/" * 19}"' for _ in range(20)) + "\n)\n"
    mini = "var " + ",".join(f"a{i}=t=>u.b{i}({i})" for i in range(120)) + ";\n"
    glue = "\n".join(f"SIMINTERN PyObject *_wrap_A_{i}(PyObject *self) {{ return Wrap_ConvertPtr(self); }}" for i in range(12))
    rows = [
        ("src/hand.cpp", 1, HAND), ("src/hand.cpp", 20, HAND), ("data/numbers.py", 1, numbers), ("data/numbers.py", 30, numbers), ("data/blob.py", 1, blob), ("web/app.js", 1, mini), ("w/glue.cpp", 1, glue),
        ("vendor/lib/a.h", 1, HAND), ("src/ThirdPartyBridge.cpp", 1, HAND), ("docs/gen.md", 1, "Code generated by tool. DO NOT EDIT."), ("forum/1", 1, mini), (None, 1, mini), ("src/none.py", None, None),
        ("src/empty.py", 1, ""), ("src/small.py", 1, "X = [1, 2, 3]\n"), ("src/late.c", 300, "// Code generated by t. DO NOT EDIT.\n" + HAND),
    ]
    assert found(spark, rows + rows) == {"data/numbers.py": "data", "data/blob.py": "data", "web/app.js": "minified", "w/glue.cpp": "generated", "vendor/lib/a.h": "foreign"}
    assert found(spark, rows)["web/app.js"] == "minified"
    assert found(spark, [("forum/1", 1, "x")]) == {}


def test_evidence_is_additive(spark):
    df = spark.createDataFrame([("a.c", n, HAND) for n in range(50)], "path string, line int, text string")
    one = srcfilter.file_evidence(df).first()
    f = dict(zip(k.SUMS + k.MAXES, k.features(HAND, 1)))
    assert one["n_chars"] == 50 * f["n_chars"] and one["max_line"] == f["max_line"]


def test_statement_in_a_long_leading_comment(spark):
    licence = "\n".join(f" * line {i} of some terms" for i in range(30))
    banner = " * This file was generated by makewrap 3.1"
    rows = [
        ("a.c", 1, f"/*\n{licence}\n{banner}\n */\nint x;"),
        ("b.c", 1, f"/*\n{licence}"), ("b.c", 32, f"{banner}\n */\nint x;"),
        ("c.c", 1, None), ("c.c", 40, f"/*\n{banner}\n */\nint x;"),  # what stands before it is unknown
        ("d.c", 1, "int y;\n" * 39), ("d.c", 40, f"/*\n{banner}\n */\nint x;"),  # code stands before it
        ("e.c", 1, f"/*\n{licence}\n */\nint x;"),
    ]
    df = spark.createDataFrame(rows, "path string, line int, text string")
    assert {r["path"] for r in srcfilter.machine_files(df).collect()} == {"a.c", "b.c"}


def test_layout_alone(spark):
    """Tables, dense text and long lines show a file in every language; copies of code do not."""
    table = "static const short t[] = {\n" + "\n".join("  " + ", ".join(f"{i * 37 % 997 - 400:5d}" for i in range(n, n + 10)) + "," for n in range(0, 300, 10)) + "\n};\n"
    proxy = "public class P {\n" + "\n".join(f"internal static object get{i}(P o){{return(o==null)?new object(null,System.IntPtr.Zero):o.native{i}(o,System.IntPtr.Zero,new object[]{{o}});}}" for i in range(9)) + "\n}\n"
    rows = [(f"a/t.{e}", 1, table) for e in ("c", "cc", "cpp", "h", "hxx", "cs", "py")] + [("a/p.cs", 1, proxy), ("extern/x/a.c", 1, HAND), ("a/hand.c", 1, HAND)]
    got = {r["path"]: (r["reason"], r["layout"]) for r in srcfilter.machine_files(spark.createDataFrame(rows, "path string, line int, text string")).collect()}
    assert got == {**{p: ("data", True) for p, _, t in rows if t is table}, "a/p.cs": ("minified", True), "extern/x/a.c": ("foreign", False)}


def test_literals_are_counted_in_prose_like_chunks():
    f = dict(zip(k.SUMS + k.MAXES, k.features("one two three four five six 7 eight nine", 1)))
    assert (f["n_numeric"], f["n_words"]) == (1, 8)


def test_idioms_are_searched_wherever_one_can_be():
    samples = "yytable yyparse YY_X YYLEX _wrap_a SWIGx Wrap_ConvertPtr wrap_type_info SIMINTERN .setObjectName( retranslateUi _serialized_start AddSerializedFile qt_meta_x staticMetaObject xPINVOKE ExceptionPending HandleRef __OVERLOAD_3".split()
    for word in [*samples, "#define ACME_HAS_X 1"]:
        text = f"a b {word} c" if not word.startswith("#") else word
        assert k._IDIOM.search(text) and dict(zip(k.SUMS, k.features(text, 1)))["n_idiom"] == 1, word
