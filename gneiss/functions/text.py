"""Line counts, symbols, terms and shingles of a file's text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gneiss.functions import udfs

#: How a comment line starts in each language; // elsewhere.
COMMENTS = {"#": ("Python", "Ruby", "Shell", "YAML", "TOML"), "<!--": ("Markdown",)}
#: What marks a test inside a source file.
INLINE_TESTS = {
    ("Rust",): ("#[cfg(test)]", "#[test]"),
    ("Go",): ("func Test", "func Benchmark"),
    ("Python",): ("def test_", "class Test"),
    ("JavaScript", "JSX", "TypeScript", "TSX"): ("describe(", "test(", "it("),
    ("Swift",): ("XCTestCase", "@Test"),
}
#: Declarations by language; group 1 is the symbol.
SYMBOLS = {
    ("Rust",): r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe)\s+)?(?:fn|struct|enum|trait|mod|const|static)\s+([A-Za-z_][A-Za-z0-9_]*)",
    ("Python",): r"(?m)^\s*(?:async\s+)?(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)",
    ("Go",): r"(?m)^\s*(?:func(?:\s+\([^)]*\))?|type)\s+([A-Za-z_][A-Za-z0-9_]*)",
    ("JavaScript", "JSX", "TypeScript", "TSX"): r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|interface|type)\s+([A-Za-z_$][A-Za-z0-9_$]*)",
    ("Markdown",): r"(?m)^\s{0,3}#{1,6}\s+([^#\r\n]+?)\s*#*\s*$",
}
#: Words that say nothing about a file's structure, and words common to all languages.
UNHELPFUL = tuple(
    "all and any arg args assert base buf byte bytes const else enum false fn for from git if impl into let loop match mod mut none pub ref repo return root run self some static std str struct then the this trait true type unsafe unwrap use value where while with".split()
)
COMMON = tuple(
    "arg args let mut assert run byte bytes if else for while match return self this true false none null some result string str path format from into impl pub use mod fn const static class def func var import export value values text item items data get set new default error ok map iter type name object array only other when then file key json schema".split()
)


def lines(text: Column) -> Column:
    """Lines without their ends; a last line end opens no line."""
    clean = F.regexp_replace(text, "\r\n", "\n")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(clean, r"\n\z", ""), "\n"))


def text_lines(text: Column, language: Column) -> Column:
    """struct(total, code, comment, blank, prose, fenced) of a text's lines, in one pass over each text.

    Block comments run from a line that starts one to the line that ends it;
    prose and fenced lines are those outside and inside of Markdown fences,
    which count as neither. A null text has no lines.
    """
    mark = F
    for start, names in COMMENTS.items():
        mark = mark.when(language.isin(*names), start)
    return udfs.count_lines(text, mark.otherwise("//"))


def generated_marker(text: Column) -> Column:
    """One of the first three lines starts with a comment that says the file is generated."""
    return F.exists(F.slice(lines(text), 1, 3), lambda x: F.lower(F.trim(x)).rlike(r"^(#|//|/\*) @generated"))


def inline_tests(text: Column, language: Column) -> Column:
    found = F.lit(False)
    for names, marks in INLINE_TESTS.items():
        some = F.lit(False)
        for mark in marks:
            some = some | text.contains(mark)
        found = found | (language.isin(*names) & some)
    return found


def symbols(text: Column, language: Column) -> Column:
    """Declared names of at least three bytes, in the order of their first declaration."""
    found = F
    for names, pattern in SYMBOLS.items():
        found = found.when(language.isin(*names), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    found = found.otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(found, F.trim), lambda s: F.octet_length(s) >= 3))


def split_case(text: Column) -> Column:
    """A space between an acronym and a word, and before a capital inside a word."""
    return F.regexp_replace(F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\b\d+(?:\.\d+)?\b", " 0 ")


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits, underscores and apostrophes of more than one character."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_']+"), F.lit(0)), lambda t: F.length(t) > 1)


def _undouble(base: Column) -> Column:
    n = F.length(base)
    return F.when(F.substring(base, -1, 1) == F.substring(base, n - 1, F.lit(1)), F.substring(base, F.lit(1), n - 1)).otherwise(base)


def _without(term: Column, suffix: str, least: int) -> tuple[Column, Column]:
    base = F.left(term, F.length(term) - len(suffix))
    return term.endswith(suffix) & (F.octet_length(term) >= least + len(suffix)), base


def _endings(term: Column, plural: Column) -> Column:
    ies, a = _without(term, "ies", 3)
    ing, b = _without(term, "ing", 4)
    ed, c = _without(term, "ed", 4)
    return F.when(ies, F.concat(a, F.lit("y"))).when(ing, _undouble(b)).when(ed, _undouble(c)).otherwise(plural)


def stem(term: Column) -> Column:
    """Strips ies, ing, ed and a plural s; what a plural leaves is stripped once more (its own plural has gone)."""
    s, base = _without(term, "s", 4)
    again, base2 = _without(base, "s", 4)
    again = again & ~base.rlike("(ss|us|is)$")
    inner = _endings(base, F.when(again, _endings(base2, base2)).otherwise(base))
    return _endings(term, F.when(s & ~term.rlike("(ss|us|is)$"), inner).otherwise(term))


def shingles(tokens: Column, width: int, step: int) -> Column:
    """Windows of width tokens every step tokens, joined; fewer tokens stand for themselves."""
    n = F.size(tokens)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)), F.lit(step)), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(width)), "\x1f"))
    return F.array_distinct(F.when(n < width, tokens).otherwise(windows))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; two empty sets are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))
