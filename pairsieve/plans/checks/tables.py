"""Tables the registered queries read, and SQL texts both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.functions.text import TOKEN
from pairsieve.session import spread_counted

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry():
    """Two dictionaries and a decorator that enters a query and its SQL into them."""
    queries, oracles = {}, {}

    def query(sql=None):
        def enter(fn):
            queries[fn.__name__] = fn
            if sql is not None:
                oracles[fn.__name__] = sql
            return fn

        return enter

    return queries, oracles, query


# Method and test text per template number; {n} becomes a running number.
TEMPLATES = [
    # 0-11: one per rule outcome
    ("public int add{n}(int a, int b) { return a + b; }", "assertEquals(3, add{n}(1, 2));"),
    ("public <T> T get{n}() { return null; }", "assertNull(get{n}());"),
    ("public <T extends Number> T get{n}() { return null; }", "assertNull(get{n}());"),
    ("public void p{n}() { try { run(); } catch (Exception e) { } }", "p{n}();"),
    ("public void p{n}() { try { run(); } catch (Exception e) { /* ok */ } }", "p{n}();"),
    ("public void e{n}() { }", "e{n}();"),
    ("public int c{n}(int x) { return x * 2; }", 'assertEquals(5, "hello".length());'),
    ('@GetMapping("/api/{n}") public int g{n}() { return 1; }', "g{n}();"),
    ("public int s{n}(int x) { return x", "s{n}(1);"),
    ("public int z{n}() { return 1; } // 计算", "z{n}();"),
    ("public int v{n}(String... a) { return 0; }", 'v{n}("x", "y");'),
    ("public abstract int q{n}(int x);", "q{n}(1);"),
    # 12-19: deeper structure
    (
        "public Map<String, List<Integer>> m{n}(Map<String, Integer> a, List<List<String>> b)"
        " { return build(a, new HashMap<String, Integer>(), b.get(0)); }",
        "assertNotNull(m{n}(new HashMap<String, Integer>(), x));",
    ),
    ("public Widget{n}(int x) { this.x = x; }", "new Widget{n}(1);"),
    (
        "public void o{n}(int a) { Runnable r = new Runnable() { public void run()"
        " { ping(a, 1); } }; r.run(); }",
        "o{n}(1); verify(r, times(2)).run();",
    ),
    (
        'public int k{n}(int a) { String s = "open { ( "; return s.length(); }',
        "k{n}(/* none */ 1);",
    ),
    ("public void w{n}() { try { run(); } finally { } }", "w{n}();"),
    (
        'public int u{n}(int a) { return f(a, g(h(a), "x,y"), (b, c) -> b + c)[0]; }',
        "u{n}(inner(1, 2));",
    ),
    (
        "void i{n}(Foo this, int a) throws IOException, java.util.concurrent.TimeoutException"
        " { i(a); }",
        "obj.i{n}(5);",
    ),
    (
        'public List<String> j{n}(@Param("a") String a, @Param(value = "b", required = false)'
        " final String b) { return Arrays.asList(a, b); }",
        'j{n}("p", "q");',
    ),
    # 20-26: errors that leave brackets balanced
    ("public int n{n}() { int x = 5 int y = 6; return x; }", "n{n}();"),
    ("public int n{n}(int a) { return a +; }", "n{n}(1);"),
    ("public void n{n}(int a) { if } { a++; }", "n{n}(1);"),
    ("This method number {n} is described in plain words", "n{n}(1);"),
    ("public int n{n}(int a) throws E { int[] b = {1, 2}; return a }", "n{n}(1);"),
    ("public int n{n}(int a) { return a; }", "int[] b = {1, 2,}; F f = (a,) -> n{n}(1);"),
    ('public int n{n}(int a) { return a; }', 'String s = "a" + n{n}(b[0] c);'),
    # 27-30: names with brackets that are neither calls nor methods; what looks like an error
    (
        "public enum E{n} implements A, B { P(1), Q(k(2)) { int r() { return s(1); } };"
        " private int x = t(3); E{n}(int x) { this.x = u(x); } public int e{n}() { return x; } }",
        "Q.e{n}(); enum F { P(1), e{n}(2, 3); int x = v(4); }",
    ),
    (
        'public @interface N{n} { int w{n}() default 1; String[] name() default {}; }',
        "w{n}(); @interface M { int q{n}() default 1; int Z = w{n}(1); }",
    ),
    (
        "class K{n} { final int[] a = {1, 2,}; static { go(); } int l{n}(int x) { switch (x) {"
        " case 1: return a[0]++; default: } do { x--; } while (x > 0); return x > 1. ? x : -x; } }",
        "import java.util.*; for (;;) { l{n}(a instanceof B ? 1 : 2); } assert x : \"no\";",
    ),
    (
        "public final int y{n}(@A(1) final int x, B... y) { if (x > 0) z(); else { z(x); }"
        " label: for (int i : y) { continue label; } return new int[] {1, 2}[0]; }",
        "Runnable r = () -> { y{n}(1); }; r.run(); y{n}((int) 'c');",
    ),
]


def _template_sql(texts) -> str:
    def sql_text(text):
        return "concat('" + text.replace("'", "''").replace("{n}", "', n, '") + "')"

    whens = " ".join(f"WHEN {i} THEN {sql_text(t)}" for i, t in enumerate(texts))
    return f"CASE k {whens} END"


# One (method, test) pair per order; text templates, so both engines build the same table.
CODE_PAIRS = f"""
SELECT row_id,
       {_template_sql([s for s, _ in TEMPLATES])} AS src_fm,
       {_template_sql(['@Test public void t() { ' + t + ' }' for _, t in TEMPLATES])} AS target,
       cast(row_id % 200 AS double) / 100 AS condition_cover_rate,
       status
FROM (SELECT o_orderkey AS row_id, o_orderkey % {len(TEMPLATES)} AS k,
             cast(o_orderkey % 1000 AS string) AS n, o_orderstatus AS status
      FROM orders) AS o"""

# One pair per document, its whole text in comments and literals: long and nearly all distinct.
TEXT_PAIRS = """
SELECT row_id, condition_cover_rate,
  CASE k
    WHEN 0 THEN concat('public int d', n, '(int a, String b) { /* ', note, ' */ return g(a, "',
                       quoted, '"); }')
    WHEN 1 THEN concat('/* ', note, ' */ public void d', n, '(int a, String b) { try { go("', quoted,
                       '"); } catch (Exception e) { } }')
    WHEN 2 THEN concat('public <T> T d', n, '(int a, String b) { String s = "', quoted,
                       '"; /* ', note, ' */ return null; }')
    WHEN 3 THEN concat('public void d', n, '(int a, String b) { /* ', note, ' */ }')
    WHEN 4 THEN concat('public int d', n, '(int a, String b) { String s = "', quoted, '" return a; }')
    WHEN 5 THEN concat('public void d', n, '(int a, String b) { } /* ', note, ' */')
    ELSE concat('@GetMapping("', quoted, '") public int d', n, '(int a, String b) { return a; }')
  END AS src_fm,
  concat('@Test public void t() { /* ', note, ' */ ',
    CASE WHEN n % 5 = 0 THEN concat('other("d', n, '(1, 2) ', quoted, '"); }')
         ELSE concat('assertEquals("', quoted, '", d', n, '(1, "', quoted, '")); }') END) AS target
FROM (SELECT doc_id AS row_id, doc_id AS n, doc_id % 13 AS k,
        cast(doc_id % 200 AS double) / 100 AS condition_cover_rate,
        replace(replace(text, '*', '+'), '/', '|') AS note,
        replace(replace(replace(text, '"', '`'), '|', '/'), chr(10), ' ') AS quoted
      FROM (SELECT doc_id, replace(coalesce(text, ''), chr(92), '|') AS text FROM documents) AS t)
  AS d"""

PATTERN = "@GetMapping("


def code_pairs(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """The pairs; ``spread``: dealt by their number, for queries that scan every pair's texts."""
    literal = CODE_PAIRS.replace("{", "{{").replace("}", "}}")
    orders = table(spark, sf_dir, "orders")
    if spread:
        orders = spread_counted(orders.select("o_orderkey", "o_orderstatus"))
    return spark.sql(literal.replace("FROM orders", "FROM {orders}"), orders=orders)


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = TEXT_PAIRS.replace("{", "{{").replace("}", "}}")
    return spark.sql(
        literal.replace("FROM documents", "FROM {documents}"),
        documents=table(spark, sf_dir, "documents"),
    )


def one_pattern(spark: SparkSession) -> DataFrame:
    """The dictionary that goes with the code pairs (a parameter, not an input table)."""
    return spark.range(1).select(F.lit(PATTERN).alias("pattern"))


def document_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("text").alias("pattern"))


# The same token language, without possessive marks.
DUCK_TOKEN = TOKEN.replace("*+", "*").replace("'", "''")


def scan_sql(rows: str, name: str, code: str = "code") -> str:
    """CTEs ``{name}_groups`` and ``{name}_broken`` over a relation (id, code).

    Written on tokens and bracket depth, another way to the same answers as the columns
    in functions.code_structure.
    """
    control = (
        "'if','for','while','switch','catch','synchronized','try','return','throw','new',"
        "'this','super','assert'"
    )
    not_type = control + (
        ",'else','case','yield','do','instanceof','public','protected','private','static',"
        "'final','abstract','native','strictfp','default','transient','volatile','class',"
        "'interface','enum','record'"
    )
    keyword = not_type + (
        ",'transient','extends','implements','import','package','throws','break','continue',"
        "'finally','var','permits','sealed','when','const','goto','boolean','byte','char',"
        "'short','int','long','float','double','void'"
    )
    primitive = "'boolean','byte','char','short','int','long','float','double','void'"
    generic = r"([A-Za-z0-9_])<[A-Za-z0-9_, ?.]*>"
    free = r"([ ])<[A-Z][A-Za-z0-9_, ?.]*>"
    return rf"""
{name}_t0 AS (
  SELECT id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM (
    SELECT id, regexp_extract_all(
      regexp_replace(regexp_replace(regexp_replace({code},
        '{generic}', '\1', 'g'), '{generic}', '\1', 'g'), '{free}', '\1', 'g'),
      '{DUCK_TOKEN}') AS toks FROM {rows})),
{name}_t AS (
  SELECT *, tok LIKE '//%' OR tok LIKE '/*%' AS note,
    sum(CASE WHEN tok IN ('(','[','{{') THEN 1 WHEN tok IN (')',']','}}') THEN -1 ELSE 0 END)
      OVER (PARTITION BY id ORDER BY pos) AS depth
  FROM {name}_t0),
{name}_c AS (
  SELECT *, lag(tok) OVER w AS p1, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3,
    lead(tok) OVER w AS n1
  FROM {name}_t WHERE NOT note WINDOW w AS (PARTITION BY id ORDER BY pos)),
{name}_b AS (
  SELECT id, pos, tok, level, lead(pos) OVER w AS close_pos, lead(tok) OVER w AS close_tok
  FROM (SELECT id, pos, tok, depth + (tok IN (')',']','}}'))::int AS level FROM {name}_t
        WHERE tok IN ('(','[','{{',')',']','}}'))
  WINDOW w AS (PARTITION BY id, level ORDER BY pos)),
{name}_broken AS (
  SELECT id, max(depth) FILTER (depth < 0) IS NOT NULL
      OR min(depth) < 0 OR arg_max(depth, pos) <> 0
      OR bool_or(tok IN ('"', '''', '#', '`', '\'))
      OR bool_or(tok LIKE '/*%' AND tok NOT LIKE '/*%*/')
      OR id IN (SELECT id FROM {name}_b WHERE tok IN ('(','[','{{')
                AND concat(tok, close_tok) NOT IN ('()','[]','{{}}')) AS broken
  FROM {name}_t GROUP BY id),
{name}_k AS (
  SELECT *, regexp_full_match(tok, '[0-9].*') OR tok LIKE '"_%' OR tok LIKE '''_%'
      OR (regexp_full_match(tok, '[A-Za-z_$].*') AND tok <> 'instanceof') AS operand,
    CASE WHEN regexp_full_match(tok, '[A-Za-z_$].*') AND tok NOT IN ({keyword}) THEN 'plain'
         WHEN tok IN ({primitive}) THEN 'primitive'
         WHEN regexp_full_match(tok, '[0-9].*') THEN 'number'
         WHEN tok LIKE '"_%' OR tok LIKE '''_%' THEN 'literal' END AS kind
  FROM {name}_c),
{name}_w AS (
  SELECT *, lead(operand) OVER w AS next_operand, lead(kind) OVER w AS next_kind,
    lag(kind) OVER w AS kind1, lag(kind, 2) OVER w AS kind2
  FROM {name}_k WINDOW w AS (PARTITION BY id ORDER BY pos)),
{name}_heads AS (
  SELECT b.id, b.pos, b.close_pos, b.level,
    c.p1 IN (')', 'else', 'do', 'try', 'finally', 'static') OR c.p1 = '>' AND c.p2 = '-'
      OR c.p1 = '->' OR c.p2 IN ('throws', 'class', 'interface') AS statements,
    c.p2 = 'enum' OR EXISTS (
      SELECT 1 FROM {name}_c e WHERE e.id = b.id AND e.tok = 'enum' AND e.pos < b.pos
        AND NOT EXISTS (SELECT 1 FROM {name}_c s WHERE s.id = b.id AND s.pos > e.pos
                        AND s.pos < b.pos AND s.tok IN (';', '=', '(', ')', '{{', '}}')))
      AS is_enum,
    coalesce(c.p2 = 'interface' AND c.p3 = '@', false) AS is_annotation
  FROM {name}_b b JOIN {name}_c c ON c.id = b.id AND c.pos = b.pos
  WHERE b.tok = '{{' AND b.close_tok = '}}'),
{name}_bad AS (
  SELECT id FROM {name}_w WHERE next_operand AND (kind IN ('number', 'literal')
      OR tok = ']' AND p1 <> '[')
    OR kind = 'plain' AND next_kind IN ('number', 'literal')
    OR kind = 'plain' AND kind1 = 'plain' AND kind2 IN ('plain', 'primitive')
       AND coalesce(p3, '') NOT IN ('.', '@', 'new')
    OR coalesce(n1, ';') IN (';', ',', ')', ']') AND (
       tok IN ('/', '%', '&', '|', '^', '=', '<', '!', '~') OR tok IN ('+', '-') AND p1 <> tok
       OR tok = '*' AND p1 <> '.' OR tok = '.')
    OR tok = ',' AND n1 IN (')', ']')
    OR tok IN ('if', 'for', 'while', 'switch', 'catch') AND coalesce(n1, '') <> '('
  UNION
  SELECT h.id FROM {name}_heads h JOIN {name}_c c ON c.id = h.id AND c.pos = h.close_pos
  WHERE h.statements AND c.p1 NOT IN (';', '}}', ':', '{{')
  UNION
  SELECT id FROM {name}_c GROUP BY id
  HAVING NOT bool_or(tok IN (';', '{{', '(')) AND count(*) > 1),
{name}_none AS (
  SELECT h.id, g.pos FROM {name}_heads h
  JOIN {name}_b g ON g.id = h.id AND g.tok = '(' AND g.level = h.level + 1
    AND g.pos > h.pos AND g.pos < h.close_pos
  JOIN {name}_c c ON c.id = g.id AND c.pos = g.pos
  WHERE h.is_enum AND NOT EXISTS (
      SELECT 1 FROM {name}_t s WHERE s.id = h.id AND s.tok = ';' AND s.depth = h.level
        AND s.pos > h.pos AND s.pos < g.pos)
    OR h.is_annotation AND (c.p2 = ']' OR regexp_full_match(c.p2, '[A-Za-z0-9_$]+'))),
{name}_g AS (
  SELECT c.id, c.pos, c.p1 AS name, coalesce(c.p2, '') AS before, b.close_pos, b.level
  FROM {name}_c c JOIN {name}_b b ON c.id = b.id AND c.pos = b.pos
  WHERE c.tok = '(' AND b.close_tok = ')' AND regexp_full_match(c.p1, '[A-Za-z_$].*')
    AND coalesce(c.p2, '') NOT IN ('@', 'new')
    AND (c.id, c.pos) NOT IN (SELECT id, pos FROM {name}_none)),
{name}_a AS (
  SELECT g.id, g.pos,
    count(*) FILTER (t.tok = ',' AND t.depth = g.level) AS commas,
    count(*) FILTER (NOT t.note) AS words,
    count(*) FILTER (t.note AND t.depth = g.level) AS notes,
    count(*) FILTER (t.tok IN ('...', 'this') AND t.depth = g.level) AS uncounted
  FROM {name}_g g LEFT JOIN {name}_t t
    ON t.id = g.id AND t.pos > g.pos AND t.pos < g.close_pos
  GROUP BY g.id, g.pos),
{name}_n AS (
  SELECT g.id, g.pos,
    min(c.pos) FILTER (c.pos > g.close_pos) AS next_pos,
    arg_min(c.tok, c.pos) FILTER (c.pos > g.close_pos) AS next_tok,
    min(c.pos) FILTER (c.pos > g.close_pos AND c.tok IN ('{{', ';')) AS body_pos,
    arg_min(c.tok, c.pos) FILTER (c.pos > g.close_pos AND c.tok IN ('{{', ';')) AS body_tok
  FROM {name}_g g LEFT JOIN {name}_c c ON c.id = g.id AND c.pos > g.close_pos
  GROUP BY g.id, g.pos),
{name}_s AS (
  SELECT g.id, g.pos, g.name, g.before, a.commas, a.words, a.notes, a.uncounted,
    CASE WHEN n.next_tok IS NULL THEN 'none'
         WHEN n.next_tok IN ('{{', ';') OR n.next_tok = 'throws' THEN
           CASE WHEN n.body_tok = '{{' THEN 'body' ELSE 'none' END
         ELSE '' END AS tail,
    e.tok = '}}' AS empty_body
  FROM {name}_g g JOIN {name}_a a ON a.id = g.id AND a.pos = g.pos
  JOIN {name}_n n ON n.id = g.id AND n.pos = g.pos
  LEFT JOIN {name}_t e ON e.id = g.id AND e.pos = n.body_pos + 1),
{name}_groups AS (
  SELECT id, name, tail, coalesce(empty_body AND tail = 'body', false) AS is_empty, kind,
    CASE WHEN kind = 'declaration' THEN (words > 0)::int + commas - uncounted
         ELSE (words > 0)::int + commas + notes END AS arity
  FROM (SELECT *, CASE
      WHEN name IN ({control}) THEN 'control'
      WHEN tail <> '' AND before <> '' AND before NOT IN ({not_type})
        AND (regexp_full_match(before, '[A-Za-z0-9_$]+') OR before = ']') THEN 'declaration'
      WHEN tail = 'body' THEN 'other'
      WHEN before IN ('public','protected','private','static','final','abstract','native',
        'synchronized','strictfp','default','transient','volatile','class','interface',
        'enum','record') THEN 'other'
      ELSE 'invocation' END AS kind FROM {name}_s))"""
