"""Structure of Java code as Spark columns, without a parser and without Python UDFs.

``scan_code`` reduces a code string to a small struct in row-local steps:

1. *mask*: literals and comments become one placeholder character each, so that
   brackets and commas inside them can no longer be mistaken for structure;
2. *flatten*: type arguments, annotation names and constructor type names are removed;
3. *nest*: the text is cut at its brackets. A running sum gives each piece its depth; sorted
   by depth and position, the pieces that lie directly in a group stand next to each
   other, with a placeholder for each group inside it. In that order the k-th placeholder
   stands for the k-th group, so one pass matches all brackets, however deep they nest;
4. *read*: ``name(arguments)`` groups are told apart by the words around them and by the
   kind of block they stand in; the groups' own texts are checked for grammar errors.

The running sum of a long text doubles its reach in each of log2(n) rounds over n brackets, so
the cost is n log n plus the length of the text. Everything runs inside the JVM on the
partition that holds the row: no shuffle.

The flags and lists (`grammar_error`, `declared_methods`, ...) read the scan struct.
"""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholders. Control characters cannot appear in Java code outside literals and
# comments; ones that do are turned into '#', itself an illegal character.
# INDEX is "[]", INDEXED a bracket pair that holds something; VIRTUAL ends a group that nothing
# closes. SEP stands in front of each group's own text.
COMMENT, LITERAL, PARENS, BLOCK, EMPTY_BLOCK, INDEX, TYPE_NAME, INDEXED = (
    chr(i) for i in range(1, 9)
)
SEP, VIRTUAL = chr(14), chr(15)
# Escaped quotes and backslashes must not end a literal; control characters would be taken
# for placeholders. Two '#' stand in: hidden inside literals, illegal outside, as they are.
_HIDDEN = r"""\\[\\"']|[\x01-\x08\x0e-\x1f]"""

# Characters of a name. All of non-ASCII counts as letters: cheaper to test than the
# Unicode letter classes, and other non-ASCII characters are illegal there anyway. The matcher
# looks single characters up in one table, but tries ranges one after the other.
_LETTERS = ascii_letters + r"_$\u0080-\uffff"
_WORD = digits + _LETTERS
_W = rf"[{_WORD}]"
_GAP = rf"[ {COMMENT}]"

# Java keywords by the part they play before a "name(...)" group.
CONTROL_WORDS = [
    "if", "for", "while", "switch", "catch", "synchronized", "try", "return", "throw",
    "new", "this", "super", "assert",
]
STATEMENT_WORDS = [
    "return", "throw", "else", "new", "case", "yield", "assert", "do", "instanceof",
]
MODIFIERS = [
    "public", "protected", "private", "static", "final", "abstract", "native",
    "synchronized", "strictfp", "default", "transient", "volatile",
]
TYPE_KEYWORDS = ["class", "interface", "enum", "record"]
PRIMITIVES = ["boolean", "byte", "char", "short", "int", "long", "float", "double", "void"]
# Words that may stand next to other words without being a type or a name.
OTHER_KEYWORDS = [
    "break", "continue", "extends", "finally", "implements", "import", "package", "throws",
    "permits", "sealed", "var", "when", "const", "goto",
]

# The matcher tries a pattern at every character of a text, so every pattern starts with
# a character that is rare in code; conditions on what stands before it come second.
_LITERAL_OR_COMMENT = (
    r'(?=["\'/])(?:(//[^\n]*|/\*[\s\S]*?\*/)|(/\*)[\s\S]*\z|"""[\s\S]*?"""|"[^"\n]*"|'
    r"'[^'\n]*')"
)
_MARKED_COMMENT = rf"/(?:/[^\n{LITERAL}]*|\*[^{LITERAL}]*?\*/){LITERAL}"
_ANNOTATION_NAME = rf"@ ?(?!interface(?!{_W}))[{_LETTERS}][{_WORD}.]*"
# Type arguments hug the name before them (List<String>, Foo::<T>bar, x.<T>y()).
_TYPE_ARGUMENTS = (
    rf"<(?<=[{_WORD}.:]<)(?=[\s{COMMENT}]*(?:[?>@_$A-Z]|{_W}+[.\[]))"
    rf"(?![^<>]*&&)[{_WORD} ,.?&@\[\]{COMMENT}{TYPE_NAME}]*>"
)
# Type parameters of a declaration stand free (public <T> T get()).
_FREE_TYPE_PARAMETERS = rf"<(?<![{_WORD}.:]<)[@{_LETTERS}][^<>(){{}};=]*>"
_UNBOUNDED_TYPE_PARAMETERS = (
    rf"<(?<![{_WORD}.:]<)(?![^<>]*extends)[@{_LETTERS}][^<>(){{}};=]*>{_GAP}*"
    rf"(?:@{TYPE_NAME}{_GAP}*)*[{_LETTERS}][{_WORD}.]*(?: ?\[ ?\])*{_GAP}+"
    rf"{_W}+{_GAP}*\("
)
_NEW_TYPE = rf"new (?<!{_W}new )[{_WORD}.]+"
_EMPTY_FINALLY = rf"finally(?<!{_W}finally){_GAP}*{EMPTY_BLOCK}"
_BRACKET = r"[(){}\[\]]"
_GROUP = f"{PARENS}{INDEXED}{BLOCK}{VIRTUAL}"
# Behind SEP: which bracket opens the group. Braces around statements or members get a mark of
# their own.
_OPENERS, _STATEMENTS = "([{", "}"
_NAME = rf"(?<!{_W})[{_LETTERS}]{_W}*+"
_TYPED_NAME = rf"(?:(?<!{_W}){_W}++{_GAP}++|[{INDEX}{INDEXED}]{_GAP}*+){_NAME}{_GAP}*{PARENS}$"
# Read from right to left, so that a match starts at a placeholder: each with what stands before
# it, name and [previous word or array dims], as groups 1 and 2.
_BEFORE_GROUP_REVERSED = (
    rf"{PARENS}{_GAP}*+({_W}++)(?<=[{_LETTERS}])(?:{_GAP}*+({_W}++|{INDEX}))?|[{_GROUP}]"
)
# Each placeholder; what follows a parameter list up to the body as group 1.
_BEHIND_GROUP = (
    rf"[{_GROUP}](?=[{INDEX} {COMMENT}]*+(?:throws{_GAP}[^;{_GROUP}{EMPTY_BLOCK}{SEP}]*+)?"
    rf"([;{EMPTY_BLOCK}{BLOCK}{VIRTUAL}])|)"
)
_ENUM_HEAD = rf"(?<![{_WORD}.@])enum{_GAP}+{_NAME}[^;={_GROUP}]*{BLOCK}$"
_ANNOTATION_HEAD = rf"@ ?interface{_GAP}+{_NAME}{_GAP}*{BLOCK}$"
# A block after one of these holds statements or members, each with an end of its own.
_STATEMENTS_HEAD = (
    rf"(?:^\)[{INDEX} {COMMENT}]*(?:throws{_GAP}[^;=]*)?|->{_GAP}*|"
    rf"(?<![{_WORD}.])(?:else|do|try|finally|static){_GAP}*|"
    rf"(?<![{_WORD}.])(?:class|interface){_GAP}+{_NAME}[^;=]*)$"
)

_KEYWORDS = "|".join(
    dict.fromkeys(
        CONTROL_WORDS + STATEMENT_WORDS + MODIFIERS + TYPE_KEYWORDS + PRIMITIVES + OTHER_KEYWORDS
    )
)
_KEYWORD = rf"(?:{_KEYWORDS})(?!{_W})"
_OPERAND = rf"(?!instanceof(?!{_W}))[{_WORD}{LITERAL}]"
_OPERATOR = r"(?:\+(?<!\+\+)|-(?<!--)|\*(?<!\.\*)|[/%&|^=<!~]|\.(?<![.0-9]\.))"
# The automaton of grammar errors that leave brackets balanced, over the groups' own texts
# (comments and white space as one blank). What a word is follows last: most words fail before.
# All that starts at a word stands behind one look for its start.
MALFORMED = "|".join(
    [
        rf"(?=[{_LETTERS}])(?<!{_W})(?:"
        # an operand behind a word that is no keyword
        rf"(?={_W}++ [{digits}{LITERAL}])(?!{_KEYWORD})|"
        # three words in a row of which none is a keyword, or two after a primitive type
        rf"(?<!\.)(?={_W}++ {_W}++ [{_LETTERS}])"
        rf"(?:(?!{_KEYWORD})|(?=(?:{'|'.join(PRIMITIVES)}) )){_W}++ "
        rf"(?!{_KEYWORD})[{_LETTERS}]{_W}*+ (?!{_KEYWORD})|"
        # a condition without its brackets
        rf"(?<!\.)(?:if|for|while|switch|catch)(?!{_W}) ?+(?!{PARENS}))",
        # an operand beside an operand
        rf"[{digits}](?<![{_WORD}.][{digits}])[{_WORD}.]*+ {_OPERAND}",
        rf"[{LITERAL}{INDEXED}] ?{_OPERAND}",
        # an operator without its second operand
        rf"(?=[+\-*/%&|^=<!~.]){_OPERATOR} ?[;,{SEP}]",
        # a comma at the end of a list in brackets, a last statement without its end
        rf"{SEP}(?:[(\[][^{SEP}]*+(?<=, ?)|"
        rf"{_STATEMENTS}[^{SEP}]*+(?<![;:{BLOCK}{EMPTY_BLOCK}{_STATEMENTS}] ?))",
    ]
)


def _rep(col: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(replacement))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda.

    The value is what an aggregate of no elements ends with: unlike elements of an array, neither
    it nor the result is copied.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def mask_code(code: Column) -> Column:
    """Comments and literals become one character each, whitespace one blank."""
    rare = code.rlike(r"[\\\x01-\x08\x0e-\x1f]")
    plain = F.when(rare, _rep(code, _HIDDEN, "##")).otherwise(code)
    marked = _rep(plain, _LITERAL_OR_COMMENT, "$1$2" + LITERAL)
    # A comment that is never closed swallows the rest and breaks the text.
    masked = _rep(_rep(marked, rf"/\*{LITERAL}", "#"), _MARKED_COMMENT, COMMENT)
    return F.trim(_rep(masked, r"\s+", " "))


def _until_stable(text: Column, rounds: Column, step) -> Column:
    """Apply ``step`` until the text stops changing (at most ``rounds`` times)."""
    start = F.struct(text.alias("s"), F.lit(False).alias("done"))
    return F.aggregate(
        F.sequence(F.lit(1), rounds),
        start,
        lambda st, _: F.when(st["done"], st).otherwise(
            _let(
                step(st["s"]),
                lambda t: F.struct(t.alias("s"), (t == st["s"]).alias("done")),
            )
        ),
        lambda st: st["s"],
    )


def flatten_names(masked: Column) -> Column:
    """Drop annotation names and type arguments; keep free type parameters."""
    return _let(
        _rep(masked, _ANNOTATION_NAME, "@" + TYPE_NAME),
        lambda t: F.when(
            F.contains(t, F.lit("<")),
            _until_stable(
                t,
                F.size(F.split(t, "<")),
                lambda s: _rep(s, _TYPE_ARGUMENTS, ""),
            ),
        ).otherwise(t),
    )


def _running_sum(steps: Column) -> Column:
    """Sums of the numbers up to each place; each round doubles how far they reach back."""
    rounds = F.ceil(F.log2(F.size(steps))).cast("int")
    return F.aggregate(
        F.sequence(F.lit(0), F.greatest(rounds - 1, F.lit(0))),
        steps,
        lambda sums, k: F.transform(
            sums,
            lambda x, i: x
            + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)),
        ),
    )


# Up to so many brackets, counting those in front of each is cheaper than a running sum.
_FEW = 96


def _depths(brackets: Column) -> Column:
    """The depth behind each bracket of a text of brackets."""
    few = F.transform(
        F.sequence(F.lit(1), F.length(brackets)),
        lambda i: 2 * F.length(F.translate(F.substring(brackets, 1, i), ")]}", "")) - i,
    )
    many = _running_sum(
        F.transform(F.split(brackets, ""), lambda b: F.when(b.isin(")", "]", "}"), -1).otherwise(1))
    )
    return (
        F.when(brackets == "", F.array().cast("array<int>"))
        .when(F.length(brackets) <= _FEW, few)
        .otherwise(many)
    )


def _opening(bracket: Column, before: Column) -> Column:
    """SEP and the mark of the group a bracket opens."""
    statements = (bracket == "{") & before.rlike(_STATEMENTS_HEAD)
    return F.when(statements, F.lit(SEP + _STATEMENTS)).otherwise(F.concat(F.lit(SEP), bracket))


def _placed(texts: Column, brackets: Column, depths: Column) -> Column:
    """array<struct<depth, i, t>>: each bracket's mark or placeholder with the text behind it."""
    return F.transform(
        depths,
        lambda depth, k: _let(
            F.substring(brackets, k + 1, F.lit(1)),
            lambda b: F.struct(
                depth.alias("depth"),
                k.alias("i"),
                F.concat(
                    F.when(
                        b.isin(*_OPENERS),
                        _opening(
                            b, F.concat(F.substring(brackets, k, F.lit(1)), F.get(texts, k))
                        ),
                    ).otherwise(F.translate(b, ")]}", PARENS + INDEXED + BLOCK)),
                    F.get(texts, k + 1),
                ).alias("t"),
            ),
        ),
    )


def _evened(placed: Column, first: Column, depths: Column) -> Column:
    """With the text in front, and with groups for brackets that nothing opens or closes."""
    def entry(depth, i, t):
        return F.struct(depth.cast("int").alias("depth"), i.cast("int").alias("i"), t.alias("t"))

    lowest = F.coalesce(F.least(F.array_min(depths), F.lit(0)), F.lit(0))
    last = F.coalesce(F.try_element_at(depths, F.lit(-1)), F.lit(0))
    top = F.concat(F.lit(SEP), first)
    even = F.concat(F.array(entry(F.lit(0), F.lit(-1), top)), placed)
    # Depths start at the lowest, one group around the other.
    opened = F.transform(
        F.sequence(lowest, F.lit(0)),
        lambda d: entry(d, d - 1, F.when(d == 0, top).otherwise(F.lit(SEP))),
    )
    closed = F.transform(
        F.sequence(lowest, last - 1),
        lambda d: entry(d, F.size(depths) + last - d, F.lit(VIRTUAL)),
    )
    return (
        F.when((lowest == 0) & (last == 0), even)
        .when(lowest < last, F.concat(opened, placed, closed))
        .otherwise(F.concat(opened, placed))
    )


def _nest(text: Column) -> Column:
    """struct<unbalanced, malformed, groups>: see the module's steps 3 and 4."""

    def read(own_texts, depths):
        # the brackets that open the groups and those that close them, in the same order
        kinds = F.translate(_rep(own_texts, rf"[^({{}}\[]", ""), _STATEMENTS, "{")
        closes = F.translate(
            _rep(own_texts, rf"[^{_GROUP}]", ""), PARENS + INDEXED + BLOCK, _OPENERS
        )
        plain = _rep(own_texts, rf"{_GAP}+", " ")
        return F.struct(
            (
                (kinds != closes)
                | F.coalesce(F.array_min(depths) < 0, F.lit(False))
            ).alias("unbalanced"),
            F.concat(plain, F.lit(SEP)).rlike(MALFORMED).alias("malformed"),
            _named_groups(own_texts).alias("groups"),
        )

    def nest(texts, brackets):
        return _let(
            _depths(brackets),
            lambda depths: _let(
                F.array_join(
                    F.sort_array(
                        _evened(_placed(texts, brackets, depths), F.get(texts, F.lit(0)), depths)
                    )["t"],
                    "",
                ),
                lambda own_texts: read(own_texts, depths),
            ),
        )

    return _let(
        F.split(text, _BRACKET),
        lambda texts: _let(
            _rep(text, r"[^(){}\[\]]+", ""), lambda brackets: nest(texts, brackets)
        ),
    )


def _group_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, _GROUP, ""))


def _no_calls(own: Column, heads: Column) -> Column:
    """Numbers of the groups behind enum constants and annotation members.

    ``own`` are the groups' own texts, ``heads`` the texts that end in the groups'
    placeholders.
    """
    def numbers(start, n):
        return F.when(n > 0, F.sequence(start, start + n - 1)).otherwise(
            F.array().cast("array<int>")
        )

    def inside(k, text, behind):
        # the groups directly in group k are numbered on from those in the groups before
        n = _group_count(text)
        start = behind - n
        constants = numbers(start, _group_count(F.substring_index(text, ";", 1)))
        members = F.filter(
            numbers(start, n),
            lambda m: _let(
                F.substring_index(F.get(heads, m), ";", -1),
                lambda t: ~F.contains(t, F.lit("=")) & t.rlike(_TYPED_NAME),
            ),
        )
        head = F.get(heads, k)
        return (
            F.when(head.rlike(_ENUM_HEAD), constants)
            .when(head.rlike(_ANNOTATION_HEAD), members)
            .otherwise(F.array().cast("array<int>"))
        )

    return _let(
        _running_sum(F.transform(own, _group_count)),
        lambda behind: F.flatten(
            F.transform(
                F.slice(own, 2, F.size(own)),
                lambda text, k: inside(k, text, F.get(behind, k + 1)),
            )
        ),
    )


def _named_groups(own_texts: Column) -> Column:
    """array<struct<kind, name, inner, tail>> of the ``name(...)`` groups."""

    def before_groups(group):
        found = F.regexp_extract_all(
            F.reverse(own_texts), F.lit(_BEFORE_GROUP_REVERSED), F.lit(group)
        )
        return F.reverse(found)

    def parts(own, names, before, behind):
        numbers = F.filter(
            F.sequence(F.lit(0), F.size(names)),
            lambda k: (F.get(names, k) != "") & F.startswith(F.get(own, k + 1), F.lit("(")),
        )
        wanted = F.when(
            own_texts.rlike("(?:enum|interface) "),
            _let(
                F.split(own_texts, rf"(?<=[{_GROUP}])"),
                lambda heads: _let(
                    numbers, lambda found: F.array_except(found, _no_calls(own, heads))
                ),
            ),
        ).otherwise(numbers)
        return F.transform(
            wanted,
            lambda k: _group_parts(
                F.reverse(F.get(before, k)),
                F.reverse(F.get(names, k)),
                F.substring(F.get(own, k + 1), 2, (1 << 31) - 1),
                _tail(F.get(behind, k), F.get(own, k + 2)),
            ),
        )

    return _let(
        F.struct(
            # the text in front of the first SEP is empty
            F.split(F.substring(own_texts, 2, (1 << 31) - 1), SEP).alias("own"),
            before_groups(1).alias("names"),
            before_groups(2).alias("before"),
            F.regexp_extract_all(own_texts, F.lit(_BEHIND_GROUP), F.lit(1)).alias("behind"),
        ),
        lambda x: parts(x["own"], x["names"], x["before"], x["behind"]),
    )


def _tail(last: Column, next_group: Column) -> Column:
    """What follows a parameter list: 'body', 'empty' body, 'none' (a semicolon), or ''."""
    block = F.substring(next_group, 1, 1).isin("{", _STATEMENTS)
    return (
        F.when(last == "", F.lit(""))
        .when(last == ";", F.lit("none"))
        .when(last == EMPTY_BLOCK, F.lit("empty"))
        .when((last == BLOCK) | block, F.lit("body"))
        .otherwise(F.lit(""))
    )


def _group_parts(prev: Column, name: Column, inner: Column, tail: Column) -> Column:
    """struct<kind, name, inner, tail> of a group, from what stands before and behind it."""
    return _let(
        tail,
        lambda t: F.struct(
            F.when(name.isin(*CONTROL_WORDS), F.lit("control"))
            .when((t != "") & _type_like(prev), F.lit("declaration"))
            .when(t.isin("body", "empty"), F.lit("other"))
            .when(prev.isin(*MODIFIERS, *TYPE_KEYWORDS), F.lit("other"))
            .otherwise(F.lit("invocation")).alias("kind"),
            name.alias("name"),
            inner.alias("inner"),
            t.alias("tail"),
        ),
    )


def _type_like(prev: Column) -> Column:
    return (prev != "") & ~prev.isin(
        *STATEMENT_WORDS, *MODIFIERS, *TYPE_KEYWORDS, *CONTROL_WORDS
    )


def scan_code(code: Column) -> Column:
    """struct<ambiguous, broken, malformed, empty_finally, groups>, null for null code.

    ``broken``: brackets, literals or comments that do not close, or illegal characters.
    ``malformed``: errors that leave brackets balanced (see ``MALFORMED``), or no statement.
    ``groups``: array<struct<kind, name, inner, tail>> of the ``name(...)`` groups.
    """

    def prepare(flat):
        ready = _rep(flat, _FREE_TYPE_PARAMETERS, "")
        ready = _rep(ready, _NEW_TYPE, "new " + TYPE_NAME)
        # The end of the text counts as the end of a statement.
        ready = F.concat(_rep(ready, r"\{ ?\}", EMPTY_BLOCK), F.lit(" ;"))
        return _rep(ready, r"\[ ?\]", INDEX)

    def finish(flat, ready):
        # A lone name may be the start of one.
        no_statement = ~flat.rlike(r"[;({]") & ~flat.rlike(rf"^{_GAP}*+{_W}*+{_GAP}*+$")
        return _let(
            _nest(ready),
            lambda st: F.struct(
                flat.rlike(_UNBOUNDED_TYPE_PARAMETERS).alias("ambiguous"),
                ready.rlike(_EMPTY_FINALLY).alias("empty_finally"),
                (flat.rlike(r"""["'#`\\]|/\*""") | st["unbalanced"]).alias("broken"),
                (no_statement | st["malformed"]).alias("malformed"),
                st["groups"].alias("groups"),
            ),
        )

    return F.when(
        code.isNotNull(),
        _let(
            flatten_names(mask_code(code)),
            lambda flat: _let(prepare(flat), lambda ready: finish(flat, ready)),
        ),
    )


def _parameter_count(inner: Column) -> Column:
    # Varargs and the receiver parameter are not counted.
    return F.size(
        F.filter(
            F.split(F.translate(inner, COMMENT, " "), ","),
            lambda p: (F.trim(p) != "")
            & ~F.contains(p, F.lit("..."))
            & ~p.rlike(r"(?:^|[ .])this *$"),
        )
    )


def _argument_count(inner: Column) -> Column:
    # A comment next to a comma or bracket counts as an argument; one inside an
    # expression does not.
    inside = rf"([^, {COMMENT}]) *{COMMENT}[ {COMMENT}]*(?=[^, {COMMENT}])"

    def named(text):
        return F.size(F.filter(F.split(text, ","), lambda p: F.trim(p) != ""))

    return F.when(
        F.contains(inner, F.lit(COMMENT)),
        _let(
            _rep(inner, inside, "$1 "),
            lambda k: named(F.translate(k, COMMENT, ""))
            + F.regexp_count(k, F.lit(COMMENT)),
        ),
    ).otherwise(named(inner))


def _signature(name: Column, arity: Column) -> Column:
    return F.struct(name.alias("name"), arity.cast("int").alias("arity"))


def _no_signatures() -> Column:
    return F.array().cast("array<struct<name:string,arity:int>>")


def declared_methods(scan: Column) -> Column:
    """array<struct<name, arity>> of the method declarations, duplicates kept."""
    return F.coalesce(
        F.transform(
            F.filter(scan["groups"], lambda g: g["kind"] == "declaration"),
            lambda g: _signature(g["name"], _parameter_count(g["inner"])),
        ),
        _no_signatures(),
    )


def invoked_methods(scan: Column) -> Column:
    """array<struct<name, arity>> of the method calls, duplicates kept."""
    return F.coalesce(
        F.transform(
            F.filter(scan["groups"], lambda g: g["kind"] == "invocation"),
            lambda g: _signature(g["name"], _argument_count(g["inner"])),
        ),
        _no_signatures(),
    )


def grammar_error(scan: Column) -> Column:
    """Broken or malformed text, or a method declaration without a body.

    A null text (null scan) counts as broken.
    """
    return F.coalesce(
        scan["broken"]
        | scan["malformed"]
        | F.exists(
            scan["groups"], lambda g: (g["kind"] == "declaration") & (g["tail"] == "none")
        ),
        F.lit(True),
    )


def empty_handler(scan: Column) -> Column:
    """A catch or finally block that holds nothing, not even a comment."""
    return F.coalesce(
        scan["empty_finally"]
        | F.exists(
            scan["groups"],
            lambda g: (g["name"] == "catch") & (g["tail"] == "empty"),
        ),
        F.lit(False),
    )


def empty_method(scan: Column) -> Column:
    """A method declaration whose body holds nothing, not even a comment."""
    return F.coalesce(
        F.exists(
            scan["groups"], lambda g: (g["kind"] == "declaration") & (g["tail"] == "empty")
        ),
        F.lit(False),
    )


def ambiguous_type(scan: Column) -> Column:
    """A method with type parameters of which none is bounded."""
    return F.coalesce(scan["ambiguous"], F.lit(False))


def relevance_score(src_scan: Column, target_scan: Column) -> Column:
    """Number of (name, arity) pairs declared in the source and invoked in the target."""
    return F.size(
        F.array_intersect(declared_methods(src_scan), invoked_methods(target_scan))
    )


# Character ranges of the non-English rule (Chinese, Korean, Japanese).
NON_ENGLISH_RANGES = [
    ("\u4e00", "\u9fa5"),
    ("\uac00", "\ud7ff"),
    ("\u30a0", "\u30ff"),
    ("\u3040", "\u309f"),
]


def in_char_ranges(text: Column, ranges=NON_ENGLISH_RANGES) -> Column:
    """True if any character of the text lies in one of the ranges.

    Pure ASCII text, told by its byte count, is not searched for non-ASCII ranges.
    """
    spans = "".join(f"{lo}-{hi}" for lo, hi in ranges)
    found = text.rlike(f"[{spans}]")
    if all(lo > "\x7f" for lo, _ in ranges):
        found = (F.octet_length(text) > F.char_length(text)) & found
    return F.coalesce(found, F.lit(False))
