"""Predicates on paths and names, as columns in a common regular dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of source files, excluded parts of paths, and what marks tests, generated and minor files.
SOURCE_EXTENSIONS = (".java", ".js", ".jsx", ".ts", ".tsx", ".mjs")
EXCLUDED = (".git", ".tessera", ".idea", ".vscode", ".trae", "node_modules", "target", "build", "dist", ".DS_Store", ".iml")
TEST_DIRECTORIES = ("tests", "test", "__tests__", "spec", "specs", "testlib", "testing")
TEST_TOP_DIRECTORIES = ("test", "tests", "spec", "specs")
OTHER_DIRECTORIES = ("integration", "sample", "samples", "example", "examples", "fixture", "fixtures", "benchmark", "benchmarks", "demo", "demos")
LOW_VALUE_DIRECTORIES = ("tests", "spec", "__tests__", "test", "specs", "icons", "i18n")
LOW_VALUE_ENDS = ("_test.go", "_test.py", "_spec.rb", "_test.rb", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", ".spec.js", ".test.java", ".spec.java", "_test.java", "_spec.java", "_tests.java", "_test.kt", "_spec.kt")
PLAIN_TEST_PARTS = ("/tests/", "/spec/", "/__tests__/", "/test/", "_test.", "_spec.")
PLAIN_TEST_ENDS = (".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", ".spec.js")
GENERATED_PARTS = (".pb.", "/generated/", "/generated_src/")
GENERATED_ENDS = (".pulsar.go", "_mocks.go", "_mock.go", "_generated.java", "_generated.kt")


def literal(text: str) -> str:
    """text for a regular expression of any dialect."""
    return "".join("\\" + c if c in ".$^*+?()[]{}|\\" else c for c in text)


def any_of(parts: tuple[str, ...]) -> str:
    return "(" + "|".join(map(literal, parts)) + ")"


#: Patterns over lower-cased paths, but for those named CASED.
SOURCE = any_of(SOURCE_EXTENSIONS) + "$"
TEST_NAME = r"^test[_.]|[._-](test|tests|spec|specs)\.[a-z0-9]+$"
TEST_NAME_CASED = r"(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$"
TEST_DIRECTORY = f"/{any_of(TEST_DIRECTORIES)}/|^{any_of(TEST_TOP_DIRECTORIES)}/|(^|/){any_of(OTHER_DIRECTORIES)}/"
TEST_DIRECTORY_CASED = r"^/?[A-Za-z0-9]*(Test|Tests|Spec)/"
LOW_VALUE_DIRECTORY = f"/{any_of(LOW_VALUE_DIRECTORIES)}/"
LOW_VALUE_CASED = any_of(LOW_VALUE_ENDS) + "$"
PLAIN_TEST = f"{any_of(PLAIN_TEST_PARTS)}|{any_of(PLAIN_TEST_ENDS)}$"
GENERATED = f"{any_of(GENERATED_PARTS)}|{any_of(GENERATED_ENDS)}$|generated_.*\\.(java|kt)$"
EXCLUDED_SEGMENT = f"(^|/){any_of(EXCLUDED[:-1])}(/|$)|\\.iml$"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_of(path: Column, none: str = "") -> Column:
    """The path before its last slash; none where there is no slash."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, "^(.*)/", 1)).otherwise(none)


def is_source(path: Column) -> Column:
    return F.lower(path).rlike(SOURCE)


def is_kept(path: Column, compatible: bool = False) -> Column:
    """No excluded part: a whole segment or an extension, or, compatibly, any stretch of the path."""
    return ~path.rlike(any_of(EXCLUDED) if compatible else EXCLUDED_SEGMENT)


def is_generated(path: Column) -> Column:
    return F.lower(path).rlike(GENERATED)


def is_test(path: Column) -> Column:
    name = name_of(path)
    return F.lower(name).rlike(TEST_NAME) | name.rlike(TEST_NAME_CASED) | F.lower(path).rlike(TEST_DIRECTORY) | path.rlike(TEST_DIRECTORY_CASED)


def is_plain_test(path: Column) -> Column:
    """The narrower test by which covering tests are counted."""
    return F.lower(path).rlike(PLAIN_TEST)


def is_low_value(path: Column) -> Column:
    return F.lower(path).rlike(LOW_VALUE_DIRECTORY) | path.rlike(LOW_VALUE_CASED)


def is_config_leaf(kind: Column, name: Column, qualified: Column) -> Column:
    return kind.isin("constant", "field") & (name.startswith("${") | qualified.contains(".properties") | qualified.contains(".yml") | qualified.contains(".yaml"))


#: Words by which a query means tests, for ranking and for what is left out.
RANKED_TEST_WORDS, TEST_WORDS = ("test", "spec"), ("test", "testing", "spec", "verify")


def mentions_tests(query: str, words: tuple[str, ...] = TEST_WORDS) -> bool:
    return any(w in query.lower() for w in words)


def mentioning_tests(query: Column, words: tuple[str, ...] = TEST_WORDS) -> Column:
    """mentions_tests() of a column; null as without."""
    return F.coalesce(F.lower(query).rlike(any_of(words)), F.lit(False))


#: Languages by extension.
LANGUAGES = {"java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "rs": "rust", "md": "markdown", "xml": "xml", "yml": "yaml", "yaml": "yaml", "json": "json", "properties": "properties"}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[F.lower(F.substring_index(path, ".", -1))], F.lit("text"))
