"""How nodes are shown: colours, titles, code fences, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A colour for each kind of node, and one for any other.
COLOURS = {
    "file": "#6b7280", "module": "#6b7280", "class": "#f59e0b", "struct": "#f59e0b", "interface": "#eab308", "trait": "#eab308", "protocol": "#eab308", "function": "#3b82f6",
    "method": "#2563eb", "property": "#06b6d4", "field": "#06b6d4", "variable": "#10b981", "constant": "#10b981", "enum": "#a855f7", "enum_member": "#a855f7", "type_alias": "#8b5cf6",
    "namespace": "#94a3b8", "parameter": "#94a3b8", "import": "#cbd5e1", "export": "#cbd5e1", "route": "#ef4444", "component": "#ec4899",
}
OTHER_COLOUR = "#94a3b8"
#: The name that a fenced block has for an extension.
FENCES = {
    "java": "java", "kt": "kotlin", "kts": "kotlin", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go",
    "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp", "scala": "scala",
    "lua": "lua", "dart": "dart", "vue": "vue", "svelte": "svelte", "astro": "astro",
}


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def colour(kind: Column) -> Column:
    return F.coalesce(_table(COLOURS)[F.lower(kind)], F.lit(OTHER_COLOUR))


def fence(path: Column) -> Column:
    """The language that a file's extension stands for, empty for others."""
    return F.when(F.instr(path, ".") > 0, F.coalesce(_table(FENCES)[F.substring_index(path, ".", -1)], F.lit(""))).otherwise("")


def fence_of(path: str) -> str:
    return FENCES.get(path.rpartition(".")[2], "") if "." in path else ""


def title(kind: Column, qualified_name: Column, path: Column, line: Column) -> Column:
    """What a drawn node says when pointed at."""
    return F.concat(kind, F.lit(" "), qualified_name, F.lit("\n"), path, F.lit(":"), line.cast("string"))


def section(path: Column, what: Column) -> Column:
    """The head of a file's section: its name, what is shown of it, its path."""
    return F.concat(F.lit("**"), F.substring_index(path, "/", -1), F.lit("** — "), what, F.lit(" — `"), path, F.lit("`"))


def section_of(path: str, what: str) -> str:
    return f"**{path.rsplit('/', 1)[-1]}** — {what} — `{path}`"


def escape_markdown(text: Column) -> Column:
    """A backslash before backticks and stars; null as empty."""
    return F.coalesce(F.replace(F.replace(text, F.lit("`"), F.lit("\\`")), F.lit("*"), F.lit("\\*")), F.lit(""))


def escape_json(text: Column) -> Column:
    """A backslash before backslashes and double quotes; null as empty."""
    return F.coalesce(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit(""))


def capitalized(text: Column) -> Column:
    """The first letter in upper case, the others as they are."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def title_cased(text: Column) -> Column:
    """The first letter in upper case, the others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def truncated(text: Column, most: int) -> Column:
    """text, or its first most characters and three dots where it is longer; null as the word null."""
    return F.coalesce(F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("..."))), F.lit("null"))
