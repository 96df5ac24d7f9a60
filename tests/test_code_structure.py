"""The structure scan against hand-worked cases and a token-stack scanner."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pairsieve.functions import code_structure as cs
from pairsieve.functions.text import TOKEN


def scan(spark, codes):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i long, c string")
    s = F.col("s")
    return [
        (
            sorted((m.name, m.arity) for m in r.d), sorted((m.name, m.arity) for m in r.v),
            r.err, r.eh, r.em, r.amb,
        )
        for r in df.select("i", cs.scan_code(F.col("c")).alias("s"))
        .select(
            "i", cs.declared_methods(s).alias("d"), cs.invoked_methods(s).alias("v"),
            cs.grammar_error(s).alias("err"), cs.empty_handler(s).alias("eh"),
            cs.empty_method(s).alias("em"), cs.ambiguous_type(s).alias("amb"),
        )
        .orderBy("i")
        .collect()
    ]


def test_signatures(spark):
    got = scan(
        spark,
        [
            "@Override public List<Map<K, V>> f(@A(x = {1, 2}) final Map<K, V> m, int... r)"
            " throws a.B, C { return g(h(1, 2), new X<K, V>(3, 4), (p, q) -> p).k(); }",
            "class A { A(int x) { super(x); this(1, 2); } void m() { if (a(1)) { b(); } } }",
            'void t() { verify(x, times(2)).save("a,b", \'(\'); Foo.<Bar>of(1); }',
        ],
    )
    assert got[0][0] == [("f", 1)]
    assert got[0][1] == [("g", 3), ("h", 2), ("k", 0)]
    assert got[1][0] == [("m", 0)]
    assert got[1][1] == [("a", 1), ("b", 0)]
    assert got[2][1] == [("of", 1), ("save", 2), ("times", 1), ("verify", 2)]
    assert not any(g[2] for g in got)


def test_text_blocks_comments_and_escapes(spark):
    got = scan(
        spark,
        [
            'String f() { return """\n { ( " ; \n"""; }',
            "/* { ( */ void f() { g(); /* C:\\*/ }",
            'void f() { s = "\\\\"; t = "\\""; g("{"); }',
            "void f() { g(); /* open",
            "void f() { int a = 1 # 2; }",
            "void f() { g(1]; }",
        ],
    )
    assert [g[2] for g in got] == [False, False, False, True, True, True]
    assert got[2][1] == [("g", 1)]


def test_long_and_deep_texts_stay_whole(spark):
    many = "void f() { " + " ".join(f'g{i}("{i}", \'\\\'\');' for i in range(5000)) + " }"
    deep = "void f() { " + "g(" * 300 + "1" + ")" * 300 + "; }"
    literal = 'void f() { g("' + "\\\\n\\\"" * 20000 + '"); }'
    late = "void f() { " + "a = 1; " * 20000 + " } }"
    got = scan(spark, [many, deep, literal, late])
    assert len(got[0][1]) == 5000 and not got[0][2]
    assert got[1][1] == [("g", 1)] * 300
    assert got[2][1] == [("g", 1)] and not got[2][2]
    assert got[3][2]


MALFORMED = [
    "int x = 5 int y = 6;",
    "void f() { return a +; }",
    "void f() { if } { a(); }",
    "Some plain prose about a method that was here",
    "hello world",
    "int f() { return a }",
    "void f() throws E { g() }",
    "Runnable r = () -> { g() };",
    "class A { int x }",
    "f(a,);",
    "if x > 3 { a(); }",
    "void f() { foo bar baz; }",
    "void f() { int foo bar; }",
    'String s = "a" "b";',
    'String s = size "b";',
    "void f() { g(a +); }",
    "void f() { a[1] b; }",
    "void f() { a[i -] = 2; }",
    "void f() { x = ; }",
    "void f() { foo.; }",
    "void f() { g(a, !, b); }",
]
WELL_FORMED = [
    "",
    "nan",
    "// only a comment",
    "import java.util.*; import static a.b.C.*; package a.b; class A extends B<String, Map<K, V>>"
    " implements C, D { private static final int[] X = {1, 2,}; static { go(); } { init(); }"
    " int a, b = 2; @Inject Foo foo; abstract static class E { } int y = 5; }",
    "int[] f(int[] a, String... s)[] throws E, F.G { for (int i = 0; i < a.length; i++) { a[i]++; }"
    " return new int[5]; }",
    'void f() { switch (x) { case 1: case 2: a(); break; default: } int y = switch (z) { case "a"'
    " -> 1; default -> { yield 2; } }; }",
    "void f() { label: while (true) { do { x--; } while (x > 0); continue label; } if (a) b(); else"
    " if (c) d(); else { e(); } }",
    "void f() { Runnable r = () -> { g(); }; List<String> l = a.stream().map(x -> x + 1)"
    ".collect(toList()); synchronized (this) { h(); } var q = new Foo<>() {{ add(1); }}; }",
    "@Test(expected = X.class) @Foo({1, 2}) public void t() throws Exception { assertEquals(1.,"
    " foo((int) 5, -3, !b, ~c, a ? \"x\" : 'c'), 0.5f); }",
    "public synchronized <T extends A & B> T f(final T a, @Nullable List<? extends X> b) { return"
    " a instanceof Foo f && f.x() ? null : (T) b; }",
    "record P(int x, int y) { P { check(x); } static P of() { return new P(1, 2); } }",
    "sealed interface S permits A, B { default int f() { return 1; } }",
    "void f() { try (A a = b(); C c = d()) { x(); } catch (A | B e) { y(); } finally { z(); }"
    " int[][] m = new int[3][]; m[0] = new int[] {1, 2}; Object o = (Foo & Bar) x; }",
    'void f() { assert x > 0 : "msg"; throw new A("x" + 1, e); }',
    "for (;;) { } for (String s : list) { } x <<= 2; y >>>= 3; a = b == c; z = Foo::new;"
    " i += 0x1F + 1_000L; int y = a [ 0 ] + b[1]; if (a[1] instanceof Foo) { } return;",
    'void f() { String t = "a" + /* b */ "c" /* d */; g(a /* e */, /* f */ b); /* g */ }',
    "int f() { return a ? b : c; /* end */ }",
]


def test_grammar_errors_with_balanced_brackets(spark):
    assert [c for c, g in zip(MALFORMED, scan(spark, MALFORMED)) if not g[2]] == []
    assert [c for c, g in zip(WELL_FORMED, scan(spark, WELL_FORMED)) if g[2]] == []


def test_scopes(spark):
    got = scan(
        spark,
        [
            "public enum A implements I { B(1), @X(9) C(k(2)) { void g() { h(1); } }, D; final int x"
            " = m(1); A(int x) { this.x = n(x); } static A of(int i) { return values()[i]; } }",
            "@interface X { int value() default 1; String[] names() default {}; int Y = f(2); }",
            "class K { enum E { B(1); } void f() { B(1); } @interface V { int v(); } void g() { v(); } }",
            "enum E { B(1) }",
            "interface I { int f(int x); }",
        ],
    )
    assert got[0][0] == [("g", 0), ("of", 1)]
    assert got[0][1] == [("h", 1), ("k", 1), ("m", 1), ("n", 1), ("values", 0)]
    assert got[1][:2] == ([], [("f", 1)])
    assert got[2][:2] == ([("f", 0), ("g", 0)], [("B", 1), ("v", 0)])
    assert got[3][:2] == ([], [])
    assert got[4][0] == [("f", 1)]
    assert [g[2] for g in got] == [False, False, False, False, True]


def test_a_filled_index_before_a_name_shifts_nothing(spark):
    got = scan(spark, ["void f(int a) { x = b[0] c(1, 2); d(3); }", "int[] f(int a) { return g()[1]; }"])
    assert got[0][:3] == ([("f", 1)], [("c", 2), ("d", 1)], True)
    assert got[1][:3] == ([("f", 1)], [("g", 0)], False)


def _brackets_by_stack(code):
    stack = []
    for c in code:
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and (not stack or stack.pop() + c not in ("()", "[]", "{}")):
            return True
    return bool(stack)


def test_bracket_matching_equals_a_stack(spark):
    rng = random.Random(11)
    codes = ["".join(rng.choices("()[]{}a;", k=rng.randint(0, 14))) for _ in range(3000)]
    codes += ["{" + _expression(rng, 4) + "}" for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(codes)), "i long, c string").repartition(4)
    got = dict(df.select("i", cs.scan_code(F.col("c"))["broken"]).collect())
    for i, code in enumerate(codes):
        assert got[i] == _brackets_by_stack(re.sub(r"'.*?'|\".*?\"", "", code)), code


def test_depth_costs_no_more_than_length(spark):
    """Seconds for twice the depth; what is fixed is taken off by the larger ones."""

    def seconds(n):
        code = "void f() { " + "f(" * n + "x" + ")" * n + "; }"
        df = spark.createDataFrame([(code,)] * 4, "c string").coalesce(1)
        start = time.perf_counter()
        assert df.select(F.size(cs.scan_code(F.col("c"))["groups"])).first()[0] == n + 1
        return time.perf_counter() - start

    seconds(100)
    assert seconds(8000) < 3 * seconds(4000)


def _calls_by_stack(code):
    """Names and argument counts of calls, from a token stack. Expressions only."""
    out, stack, prev = [], [], ""
    for tok in re.findall(TOKEN.replace(r"\z", r"\Z"), code):
        if tok in "([{":
            name = prev if tok == "(" and re.match(r"[A-Za-z_$]", prev) else None
            stack.append([name, 0, False])
        elif tok in ")]}":
            name, commas, filled = stack.pop()
            if name:
                out.append((name, commas + (1 if filled else 0)))
            if stack:
                stack[-1][2] = True
        elif tok == ",":
            stack[-1][1] += 1
        elif stack:
            stack[-1][2] = True
        prev = tok
    return sorted(out)


def _expression(rng, depth):
    kind = rng.randrange(7) if depth else rng.randrange(2)
    if kind == 0:
        return rng.choice(["1", "x", "a.b", '"s, ("', "'c'"])
    if kind == 1:
        return f"f{rng.randrange(9)}()"
    args = ", ".join(_expression(rng, depth - 1) for _ in range(rng.randrange(4)))
    if kind == 2:
        return f"m{rng.randrange(9)}({args})"
    if kind == 3:
        return f"o.n{rng.randrange(9)}({args}).k({args})"
    if kind == 4:
        return f"({_expression(rng, depth - 1)} + 2)"
    if kind == 5:
        return f"a[{_expression(rng, depth - 1)}]"
    return "(p, q) -> { go(" + args + "); }"


def test_calls_match_token_stack(spark):
    rng = random.Random(7)
    codes = ["{ x = " + _expression(rng, 5) + "; }" for _ in range(200)]
    got = scan(spark, codes)
    for code, row in zip(codes, got):
        assert row[1] == _calls_by_stack(code), code
        assert not row[2], code


@pytest.mark.parametrize("text,expected", [("汉字", True), ("한국", True), ("かな", True), ("naïve", False)])
def test_char_ranges(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(cs.in_char_ranges(F.col("t"))).first()[0] is expected
