import itertools

import pytest

from lodestone.llm import docpairs
from lodestone.llm import docpairs_kernel as k

GOOD = "Returns the spring that lies closest to the coarse frame in every step."


def names(path, text):
    return [p.name for p in k.pairs(path, text)]


def test_python():
    code = f'''import x

def good(a, b="("):
    """{GOOD}

    Args:
        a: x
    """
    def inner():
        r"{GOOD}"
        return 1
    return a

# {GOOD}
def only_comment():
    return 1

class C:
    """{GOOD}"""
    @property
    def p(self) -> int:
        \'\'\'{GOOD}
        >>> def fake():
        ...     "{GOOD}"
        \'\'\'
    async def q(self):
        doc = """{GOOD}"""
    def rotate_lidar(self):
        """Rotate lidar."""
    def todo(self):
        """TODO: document this function later please now"""
    def args_only(self, alpha_beta, gamma):
        """
        Args:
            alpha_beta: the value that is used for this and that
            gamma: another value that is used for this and that
        """
'''
    assert names("a/b.py", code) == ["good", "inner", "p"]


@pytest.mark.parametrize(
    "doc,found",
    [
        (f"/// {GOOD}", True), (f"/** {GOOD} */", True), (f"/**\n * @brief {GOOD}\n * @param a the a\n */", True), (f"// {GOOD}\ntemplate <typename T>", True),
        (f"/*! {GOOD}\n*/", True), (f"//! {GOOD}", True), ("/* The node is given in\n   contact coordinates and must be rigid. */", True), ("// Author: Nol Rusk of the machine institute up north", False), (f"/// <summary>{GOOD}</summary>", True), ("/// Ohne diese Prüfung läuft x über die zulässige Grenze von y hinaus.", True),
        (f"// {GOOD}\n", False), ("/** Get value.", False), ("// ------------------------", False), ("// ----- some long title of accessors -----", False), ("// clang-format off", False),
        ("// NOLINTNEXTLINE(readability-magic-numbers)", False), ("/// @param a the a to use in this call here\n/// @return the value that was computed", False), ("/// {@inheritDoc}", False),
        ("/// @copydoc Base::GetValue", False), ("/// See base class.", False), ("// foo->Set(1.5);\n// if (foo > 3) return;", False),
        ("// Part of the kit, Copyright (c) 2001 the kit project, all rights reserved here", False), ("/// Todo write docs", False), ("/// n/a", False), ("/// Get the value", False),
    ],
)
def test_c(doc, found):
    assert names("x/y.cpp", f"int z;\n{doc}\n[[nodiscard]] int Foo::GetValue(int a, std::vector<int> b) const noexcept {{\n  if (a) {{ return call(a); }}\n  return a;\n}}\n") == ["GetValue"] * found


def test_c_is_not_fooled():
    code = f"// {GOOD}\nvoid declared(int a);\n// {GOOD}\nclass K {{\n  // {GOOD}\n  void m() {{ for (int i = 0; i < 3; i++) {{ f(i); }} }}\n  // {GOOD}\n  K(int a) : x(a), y{{1}} {{}}\n  // {GOOD}\n  ~K() {{}}\n}};\nint v = f(1);\n"
    assert names("a.hpp", code) == ["m", "K", "~K"]
    unclosed = f"class Q {{\n  /** Reset it.\n  void Reset() {{ }}\n  /** {GOOD} */\n  void Next() {{ }}\n}};"
    assert names("a.cs", unclosed) == ["Next"]


def test_odd_input():
    assert k.pairs(None, "x") == k.pairs("a.py", None) == k.pairs("a.py", "") == k.pairs("a.py", "   ") == []
    assert k.pairs("forum/x.py", f'def f():\n    "{GOOD}"\n') == [] and k.pairs("a.md", f'def f():\n    "{GOOD}"\n') == []
    assert names("a.py", f'def f():\r\n    "{GOOD}"\r\n    return 1\r\n') == ["f"]
    for cut in range(0, 120, 7):
        k.pairs("a.py", f'def f(a):\n    """{GOOD}"""\n    return a\n'[:cut])
        k.pairs("a.cpp", f"/** {GOOD} */\nint f(int a) {{ return '\"'; }}\n"[:cut])
    long = "\n".join(f"// {GOOD}\nint f{i}(int a) {{ return a; }}" for i in range(3000))
    assert len(names("a.c", long)) == 3000


def test_assignment_is_optimal():
    import random

    r = random.Random(3)
    for _ in range(200):
        n, m = r.randint(1, 4), r.randint(1, 4)
        costs = {(i, j): float(r.randint(0, 9)) for i in range(n) for j in range(m) if r.random() < 0.7}
        got = k.assign(costs, n, m)
        best = None
        for size in range(min(n, m), -1, -1):
            options = [
                sum(costs[x] for x in zip(rows, cols)) for rows in itertools.combinations(range(n), size) for cols in itertools.permutations(range(m), size)
                if all(x in costs for x in zip(rows, cols))
            ]
            if options:
                best = (size, min(options))
                break
        assert (len(got), sum(costs[x] for x in got.items())) == best


OTHER = "Moves the wheel until the whole axle has come to rest again."


def test_assignment_beats_the_nearest_comment():
    code = f"// {OTHER}\n// @param alpha x\n\n// {GOOD}\n// @param beta x\nint f(int alpha) {{ return alpha; }} int g(int beta) {{ return beta; }}\n"
    got = {p.name: (p.text, p.place, p.rivals) for p in k.pairs("a.cpp", code, direct_only=False)}
    assert got == {"f": (OTHER, "gap", 1), "g": (GOOD, "above", 0)}  # greedy: f takes the nearest one, nothing plausible is left for g
    assert names("a.cpp", code) == ["g"]


def test_places():
    code = f"// {GOOD}\n\nint far(int a) {{\n  return a;\n}}\nint in(int a) {{\n\n  // {OTHER}\n  return a;\n}}\nint end(int a) {{  // {GOOD}\n  return a;\n}}\n"
    assert [(p.name, p.place) for p in k.pairs("a.c", code, direct_only=False)] == [("far", "gap"), ("in", "inside"), ("end", "trailing")]
    python = f"# {GOOD}\ndef f(a):\n    # {OTHER}\n    return a\n"
    assert [(p.place, p.rivals) for p in k.pairs("a.py", python, direct_only=False)] == [("gap", 1)] and names("a.py", python) == []
    away = f"// {GOOD}" + "\n" * 12 + "int f(int a) { return a; }\n"
    assert k.pairs("a.c", away, direct_only=False) == []  # too far
    foreign = f"// {GOOD}\n// @param b x\n\nint f(int a) {{ return a; }}\n"
    assert k.pairs("a.c", foreign, direct_only=False) == []  # tags of another function
    assert k.pairs("a.c", foreign.replace("param b", "param a"), direct_only=False)[0].place == "gap"


def test_links_are_cheapest():
    import random

    r = random.Random(4)
    for _ in range(300):
        n, m = r.randint(1, 5), r.randint(1, 5)
        costs = {(i, j): r.randint(-12, 18) / 10 for i in range(n) for j in range(m) if r.random() < 0.5}
        got = k.links(costs)
        assert len(set(got.values())) == len(got)
        best = min(
            sum(0 if j is None else costs.get((i, j), 99) - k.REJECT for i, j in enumerate(choice))
            for choice in itertools.product([None, *range(m)], repeat=n) if len(set(x for x in choice if x is not None)) == sum(x is not None for x in choice)
        )
        assert abs(sum(costs[x] - k.REJECT for x in got.items()) - best) < 1e-9


def test_link_report(spark):
    rows = [(1, "a.py", f'def f(a):\n    "{GOOD}"\n    # {OTHER}\n    return 1\n'), (2, "b.c", f"// {GOOD}\n\nint f(int a) {{ return a; }}\n")]
    df = spark.createDataFrame(rows, "chunk_id long, path string, text string")
    report = docpairs.link_report(docpairs.document_pairs(df, direct_only=False)).collect()
    assert {(x["place"], x["pairs"], x["contested"]) for x in report} == {("docstring", 1, 0), ("gap", 1, 0)}
    assert docpairs.document_pairs(df).count() == 1


def test_frame(spark):
    schema = "chunk_id long, path string, text string, func_name string, code string"
    rows = [(1, "a.py", f'def f():\n    "{GOOD}"\n    return 1\n', "clash", "clash"), (1, "a.py", f'def f():\n    "{GOOD}"\n    return 1\n', "clash", "clash"), (2, None, None, None, None), (3, "b.md", "def", None, None)]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in docpairs.documented_functions(df).collect()] == [(1, "f")]
    p = docpairs.document_pairs(df).collect()
    assert len(p) == 2 and p[0]["code"].startswith("def f():") and p[0]["documentation"] == GOOD and (p[0]["start_line"], p[0]["end_line"]) == (1, 4)
    assert docpairs.document_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        docpairs.document_pairs(df.drop("text"))
