"""Terms of a query: driver-side scalars, since a query is one short string."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search leaves out.
STOP_WORDS = frozenset(
    "the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should may might can shall not no all each "
    "every how what where when who which why i me my we our you your he she they show give tell been done made used using work works found also into then than just more some such "
    "over only out its so up as if look need needs want happen happens affect affected break breaks failing implemented implement "
    "code file files function method class type fix bug called".split()
)
FILE_ENDS = (".java", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".py", ".go", ".rs", ".kt", ".xml", ".yml", ".yaml", ".properties", ".json", ".md")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*((::|\.)[\w$]+)*", re.ASCII)
MOST_SYMBOLS = 16


def symbols(query: str) -> list[str]:
    """Identifiers of a query in order: parts between white space, commas and brackets, without a file's extension, of three characters at least."""
    out = []
    for part in re.split(r"[\s,()\[\]]+", query or ""):
        for end in FILE_ENDS:
            if part.lower().endswith(end) and len(part) > len(end):
                part = part[: -len(end)]
                break
        if len(part) >= 3 and _IDENTIFIER.fullmatch(part):
            out.append(part)
    return out[:MOST_SYMBOLS]


# Endings, the least length of a term that each is taken off, and what comes in its place, one form after another; "~" is the stem with a doubled last letter made single.
STEM_RULES = (
    ("ing", 6, ("", "e", "~")),
    ("tion", 6, ("t",)),
    ("sion", 6, ("s",)),
    ("ment", 7, ("",)),
    ("ies", 5, ("y",)),
    ("es", 5, ("",)),
    ("s", 5, ("",)),
    ("ed", 5, ("e", "")),
    ("ied", 6, ("y",)),
    ("er", 5, ("", "e", "~")),
)
#: Of these endings only the first that fits counts; and endings that look like another but aren't it.
PLURALS, NOT_THESE = ("ies", "es", "s"), {"s": "ss", "ed": "eed"}


def stems(term: str) -> list[str]:
    """Shorter forms of a term by its ending, each of three characters at least, in order and without the term."""
    t, found, plural = term.lower(), [], False
    for end, least, forms in STEM_RULES:
        if not t.endswith(end) or len(t) < least or t.endswith(NOT_THESE.get(end, " ")) or (end in PLURALS and plural):
            continue
        plural = plural or end in PLURALS
        base = t[: -len(end)]
        doubled = len(base) >= 2 and base[-1] == base[-2]
        found += [base[:-1] if form == "~" else base + form for form in forms if form != "~" or doubled]
    return list(dict.fromkeys(v for v in found if len(v) >= 3 and v != t))


#: Humped words, and words joined by underscores, which terms takes whole as well.
HUMPED = r"\b(?:[a-zA-Z][a-zA-Z0-9]*(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]*)+)\b"
UNDERSCORED = r"\b[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+\b"


def split_camel(text: str) -> str:
    """text with a space before each new hump."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text)


def terms(query: str, with_stems: bool = False) -> list[str]:
    """Search terms of a query in order: compounds whole, then their words, without short and stop words."""
    query = query or ""
    found = [m.lower() for m in re.findall(HUMPED, query)]
    found += [m.lower() for m in re.findall(UNDERSCORED, query)]
    found = [x for x in found if len(x) >= 3]
    for w in re.split(r"[^a-zA-Z0-9]+", split_camel(query).replace("_", " ").replace(".", " ")):
        if len(w) >= 3 and w.lower() not in STOP_WORDS:
            found.append(w.lower())
    out = list(dict.fromkeys(found))
    return list(dict.fromkeys([*out, *(s for t in out for s in stems(t))])) if with_stems else out


def is_distinctive(token: str) -> bool:
    return bool(re.search(r"[_0-9]|.[A-Z]", token))


def title_case(word: str) -> str:
    return word[:1].upper() + word[1:].lower()


def line_of_offset(text: Column, offset: Column) -> Column:
    """The line, from 1 on, of the character at offset, which counts from 0; beyond the end the last line."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def distinctive(token: Column) -> Column:
    """is_distinctive() of a column."""
    return token.rlike("[_0-9]|.[A-Z]")
