"""Facts about a file that follow from its path alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Languages by extension; every other extension is Plain Text.
LANGUAGES = {
    "Rust": "rs", "Python": "py pyi", "JavaScript": "js mjs cjs", "JSX": "jsx", "TypeScript": "ts mts cts", "TSX": "tsx", "Swift": "swift",
    "Kotlin": "kt kts", "Java": "java", "Go": "go", "Ruby": "rb", "PHP": "php", "C": "c h", "C++": "cc cpp cxx hpp", "C#": "cs",
    "Shell": "sh bash zsh", "Markdown": "md mdx", "JSON": "json jsonl", "YAML": "yaml yml", "TOML": "toml", "XML": "xml", "HTML": "html htm",
    "CSS": "css scss sass less", "SQL": "sql", "GraphQL": "graphql gql", "CSV": "csv", "TSV": "tsv", "SVG": "svg",
}
#: Classes in the order they are tried, each with a pattern over the lower-cased path.
CLASSES = (
    ("vendored", r"(^|/)(vendor|third_party)/|^node_modules/"),
    ("generated", r"(^|/)generated/|^dist/|\.generated\.(rs|ts|js)$"),
    ("snapshot", r"(^|/)(snapshots|golden)/|/__snapshots__/|\.snap$"),
    ("fixture", r"(^|/)(fixtures|testdata)/|fixture[^/]*$"),
    ("migration_fixture", r"(^|/)migrations/.*test|test.*/migrations/|fixture.*/migrations/|(^|/)migrations/.*fixture"),
    ("test", r"(^|/)tests?/|\.test\.[^/]*$|_test\.[^/]*$|(^|/)test_[^/]*$|(^|/)tests\.rs$|__tests__"),
    ("workflow", r"^\.github/workflows/|^action\.ya?ml$"),
    ("config", r"^\.github/issue_template/|^\.github/funding\.yml$|^schemas/|^plugins/(.*/)?(plugin|marketplace|marketplace-source)\.json$|^\.agents/plugins/|^\.codex-plugin/"),
    ("generated", r"^man/|\.1$"),
    ("docs", r"^docs/|\.mdx?$"),
    ("tool", r"^(action|scripts|tools)/|^\.github/actions/"),
    ("config", r"^config/|(^|/)(cargo\.toml|pyproject\.toml|package\.json|tsconfig\.json|wrangler\.toml)$"),
    ("source", r"^(src|xtask/src|app|lib|crates|packages)/"),
)
DERIVED = ("generated", "vendored", "snapshot", "fixture", "migration_fixture")
#: Extensions of data files, and of each structural mode other than code.
DATA_EXTENSIONS = ("csv", "tsv", "parquet", "ndjson", "jsonl", "sqlite", "db", "xml", "json")
MODES = {"markdown": ("md", "mdx"), "prose": ("txt",), "sql": ("sql",), "markup": ("html", "htm", "xml", "svg")}
TEST = r"(^|/)tests?/|__tests__|(^|/)tests\.rs$|(^|/)test_[^/]*$|_test\.[^/]*$|\.test\.[^/]*$|\.spec\.[^/]*$"
VERIFICATION = r"^\.github/workflows/|(^|/)scripts/(.*/)?[^/]*(test|check|validate|verify|ci)[^/]*$"
DATA_PATH = r"(^|/)data/|fixtures/|reference_data/"


def extension(path: Column) -> Column:
    return F.element_at(F.split(F.lower(path), r"\."), -1)


def language(path: Column) -> Column:
    pairs = [F.lit(v) for name, many in LANGUAGES.items() for e in many.split() for v in (e, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("Plain Text"))


def ladder(subject: Column, rungs: tuple[tuple[str, str], ...], otherwise: str) -> Column:
    """The name of the first pattern that matches."""
    found = None
    for name, pattern in rungs:
        hit = subject.rlike(pattern)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.otherwise(otherwise)


def classification(path: Column) -> Column:
    return ladder(F.lower(path), CLASSES, "other")


def profile(path: Column, size: Column, min_bytes: int) -> Column:
    is_data = extension(path).isin(*DATA_EXTENSIONS) & (F.lower(path).rlike(DATA_PATH) | (size >= min_bytes))
    return F.when(is_data, "data_context").otherwise("agent_context")


def structural_mode(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.when(F.instr(name, ".") > 1, F.element_at(F.split(name, r"\."), -1))
    found = F
    for mode, many in MODES.items():
        found = found.when(ext.isin(*many), mode)
    return found.otherwise("code")


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(TEST)


def is_verification(path: Column) -> Column:
    return F.lower(path).rlike(VERIFICATION)


def root(path: Column) -> Column:
    """The first segment; a file at the top is its own root."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def parent(path: Column) -> Column:
    """The folder that holds the file, . at the top."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", ".").otherwise(found)


def ancestors(path: Column) -> Column:
    """. and every folder above the file, outermost first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    above = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return F.concat(F.array(F.lit(".")), F.coalesce(above, F.array().cast("array<string>")))


def clean_scope(scope: str) -> str:
    """A scope without empty and . parts, empty for everything. Absolute scopes and .. are refused."""
    parts = [p for p in scope.replace("\\", "/").split("/") if p not in ("", ".")]
    if scope.startswith("/") or ".." in parts:
        raise ValueError(f"not a scope inside the repository: {scope}")
    return "/".join(parts)


def in_scope(path: Column, scope: str) -> Column:
    """The scope itself and all below it; . is everything."""
    clean = clean_scope(scope)
    return F.lit(True) if not clean else (path == clean) | path.startswith(clean + "/")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob whose * also crosses folders."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern[i : i + 3] == "**/":
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            out.append(".*")
            while pattern[i : i + 1] == "*":
                i += 1
            continue
        if c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = end + 1
            continue
        if c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out.append("(?:" + "|".join(glob_regex(p)[1:-1] for p in pattern[i + 1 : end].split(",")) + ")")
            i = end + 1
            continue
        out.append("." if c == "?" else ("\\" + c if c in r"\.+^$()|{}[]" else c))
        i += 1
    return "^" + "".join(out) + "$"


def ignore_pattern(globs: tuple[str, ...]) -> str:
    """One regular expression for what any glob matches; a glob without a slash matches in every folder."""
    return "|".join([glob_regex(g) for g in globs] + [glob_regex("**/" + g) for g in globs if "/" not in g])


def ignored(path: Column, globs: tuple[str, ...]) -> Column:
    """Any glob matches; one without a slash matches in every folder."""
    return path.rlike(ignore_pattern(globs)) if globs else F.lit(False)
