"""The answer to a question about code: ranked files with their source, what depends on the symbols found, and how they hang together.

Search, walks, seeds and rankings are distributed. What is shown is bounded by a budget,
so the few hundred nodes around the answer and the texts of the files shown are fetched,
and the text is put together on the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions import presentation
from tessera.functions.predicates import mentions_tests
from tessera.operators import aggregates, analytics, flow, rank, search, subgraph, traverse
from tessera.operators.joins import induced
from tessera.operators.render import ENVELOPE_KINDS
from tessera.plans.graph import PropertyGraph
from tessera.plans.lineage import cut

#: Kinds whose bodies a skeleton may show, files that an answer has at most, and what sections take beside their source.
BODY_KINDS, MOST_FILES, SECTION_CHARS, SKELETON_CHARS = ("method", "function", "component", "constructor", "property"), 20, 200, 120
#: Files whose texts are fetched together.
FETCHED = 20


class Answer(NamedTuple):
    """Ranked files (file_path, named, entry, central, hits, graph_score, score, n), the nodes and edges around the answer, roots (id, score), seeds and glue (id), and the way between named symbols."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    seeds: DataFrame
    glue: DataFrame
    way: DataFrame
    budget: rank.Budget


def answer(g: PropertyGraph, query: str) -> Answer:
    """What a query finds, before anything is shown."""
    roots, around = search.relevant(g, query)
    around = cut(around)
    glue = cut(traverse.glue(g, roots, around).select("id"))
    tokens = search.symbols(query)
    seeds = cut(flow.named_seeds(g.nodes, tokens).select("id"))
    ids = cut(around.select("id").union(glue).union(seeds).distinct())
    lines = ["start_line", "end_line" if "end_line" in g.nodes.columns else F.col("start_line").alias("end_line")]
    nodes = cut(g.nodes.join(F.broadcast(ids), "id").select("id", "kind", "name", "qualified_name", "file_path", *lines))
    edges = cut(induced(g.steady_edges(search.RELEVANT_KINDS), F.broadcast(ids)).select("source", "target", "kind", "line"))
    entries = cut(subgraph.entries(roots, seeds))
    members = rank.countable(nodes)
    files = rank.file_scores(members, seeds, entries, subgraph.connected(edges, entries))
    budget = rank.budget(g.nodes.select("file_path").distinct().count())
    if not budget.full and not mentions_tests(query):
        files = rank.without_low_value(files)
    # a few hundred nodes by the limits above: they are walked over on the driver
    walk = analytics.random_walk_small([r.id for r in ids.collect()], [(r.source, r.target) for r in edges.where(F.col("kind").isin(*analytics.RANK_KINDS)).collect()], [r.id for r in entries.collect()])
    mass = g.nodes.sparkSession.createDataFrame(list(walk.items()), "id string, score double")
    words = [w for w in query.lower().split() if len(w) >= 3]
    files = files.join(rank.graph_scores(nodes, mass), "file_path").join(rank.term_hits(members, words), "file_path")
    mark = lambda ids, name: subgraph.files_of(nodes, ids).withColumn(name, F.lit(True))
    files = files.join(mark(seeds, "named"), "file_path", "left").join(mark(entries, "entry"), "file_path", "left")
    files = cut(files.na.fill(False, ["named", "entry"]))
    files = files.join(F.broadcast(rank.central(files).withColumn("central", F.lit(True))), "file_path", "left").na.fill(False, ["central"])
    return Answer(cut(rank.ranked(files, 1_000)), nodes, edges, roots, seeds, glue, cut(flow.flow(g.nodes, g.edges, tokens)), budget)


def explore(g: PropertyGraph, query: str, texts: DataFrame, max_files: int | None = None) -> str:
    """The answer to a query as markdown. texts (path, text) has the files' current source; a file without is left out."""
    a = answer(g, query)
    found = a.nodes.collect()
    if not found:
        return f'No relevant code found for "{query}"'
    files = a.files.collect()
    most = max(1, min(max_files or a.budget.files, MOST_FILES))
    out = [f"**Exploration: {query.replace('`', chr(92) + '`').replace('*', chr(92) + '*')}**", "", f"Found {len(found)} symbols across {len({n.file_path for n in found})} files.", ""]
    out += blast_radius(g, a)
    if a.budget.full:
        out += relations(a)
    shown = _Shown(g, a, found, files)
    text, trimmed, n = shown.source("\n".join(out), texts, most)
    if a.budget.full:
        if trimmed or n < len(files):
            text += "\n*Some files were trimmed or left out to keep within the budget.*\n"
        text += f"\n*Budget: {len(text)}/{a.budget.chars} characters, {n}/{most} files.*\n"
    return text


def blast_radius(g: PropertyGraph, a: Answer) -> list[str]:
    """Lines on what calls the first roots, with the files of callers and of tests among them."""
    roots = aggregates.first_roots(g.nodes, a.roots.withColumn("less", -F.col("score")), order="less")
    rows = aggregates.blast_radius(g.nodes, g.edges, roots).join(g.nodes.select("id", "name", "file_path", "start_line"), "id").orderBy("id").collect()
    if not rows:
        return []
    out = ["**Blast radius — what depends on these**", ""]
    for r in rows:
        callers = "1 caller" if r.callers == 1 else f"{r.callers} callers"
        tests = f"; tests: {r.tests.replace(',', ', ')}" if r.tests else "; no covering tests found"
        out.append(f"- `{r['name']}` ({r.file_path.rsplit('/', 1)[-1]}:{r.start_line}) — {callers} in {r.files.replace(',', ', ') or '(no files but tests)'}{tests}")
    return [*out, ""]


def relations(a: Answer) -> list[str]:
    """Lines on the edges around the answer, by kind, a few of each."""
    rows = aggregates.relations_by_kind(a.edges.where("kind <> 'contains'"), a.nodes, a.budget.relations_per_kind).orderBy("kind", "rank").collect()
    out: list[str] = ["**Relationships**", ""] if rows else []
    for kind in dict.fromkeys(r.kind for r in rows):
        own = [r for r in rows if r.kind == kind]
        out += [f"**{kind}:**", *(f"- {r.source_name} → {r.target_name}" for r in own), *([f"- ... and {own[0].more} more"] if own[0].more > 0 else []), ""]
    return out


class _Shown:
    """Puts the source section together."""

    def __init__(self, g: PropertyGraph, a: Answer, found: list[Row], files: list[Row]) -> None:
        self.a, self.files, self.budget = a, files, a.budget
        ids = lambda df: {r.id for r in df.select("id").collect()}
        self.glue, self.seeds = ids(a.glue), ids(a.seeds)
        self.entries = self.seeds | ids(a.roots)
        way = a.way.collect()
        self.way, self.named, self.unique = {r.id for r in way}, {r.id for r in way if r.role == "named"}, {r.id for r in way if r.is_unique}
        edges = a.edges.select("source", "target").collect()
        self.near = {e.target for e in edges if e.source in self.entries} | {e.source for e in edges if e.target in self.entries}
        self.by_file: dict[str, list[Row]] = {}
        for n in sorted(found, key=lambda n: (n.file_path, n.start_line or 1 << 31, n.id)):
            if n.kind not in ("import", "export"):
                self.by_file.setdefault(n.file_path, []).append(n)
        here = a.nodes.select("id")
        self.siblings = ids(aggregates.polymorphic_siblings(g.edges).join(F.broadcast(here), "id", "left_semi"))
        self.supers = ids(aggregates.supertypes(g.edges).join(F.broadcast(here), "id", "left_semi"))

    def source(self, head: str, texts: DataFrame, most: int) -> tuple[str, bool, int]:
        """The text so far with the files' sections, whether a file was trimmed, and how many files are shown."""
        out = [head, "**Source Code**", "", "> Current source with line numbers: what is shown needn't be read again.", ""]
        total, n, trimmed = len("\n".join(out)), 0, False
        for k in range(0, len(self.files), FETCHED):
            if n >= most:
                break
            part = self.files[k : k + FETCHED]
            lines = {r.path: r.text.split("\n") for r in texts.where(F.col("path").isin([f.file_path for f in part])).collect() if r.text is not None}
            for f in part:
                if n >= most or f.file_path not in lines:
                    continue
                nodes = self.by_file.get(f.file_path, [])
                needed = any(x.id in self.entries or x.id in self.way for x in nodes)
                if not needed and total > self.budget.chars * 0.9:
                    trimmed = True
                    continue
                section = self.section(f, nodes, lines[f.file_path], needed, total)
                if section is None:
                    trimmed = True
                elif section:
                    out += section
                    total += len("\n".join(section))
                    n += 1
        return "\n".join(out) + "\n", trimmed, n

    def mode(self, f: Row, nodes: list[Row], lines: list[str]) -> str:
        """How a file is shown: as a skeleton, whole, or in clusters."""
        on_way = any(n.id in self.way for n in nodes)
        callable_ = [n for n in nodes if n.kind in ("method", "function", "component", "constructor")]
        named = sum(len(_part(lines, n.start_line, n.end_line)) for n in callable_ if n.id in self.way and n.end_line and n.start_line and n.end_line > n.start_line)
        god = on_way and named > self.budget.chars_per_file and any(n.id in self.unique and n.id not in self.way for n in callable_)
        spared = any(n.id in self.unique for n in nodes) and not any(n.id in self.supers for n in nodes)
        if god or (not on_way and any(n.id in self.siblings for n in nodes) and not spared):
            return "skeleton"
        whole = rank.WHOLE_LINES_CENTRAL if f.central else rank.WHOLE_LINES
        return "whole" if len(lines) <= whole and len(lines) * rank.LINE_CHARS <= 3 * self.budget.chars_per_file else "clustered"

    def section(self, f: Row, nodes: list[Row], lines: list[str], needed: bool, total: int) -> list[str] | None:
        """A file's lines; none to be passed over, None if there is no room."""
        mode, fence = self.mode(f, nodes, lines), presentation.fence_of(f.file_path)
        if mode == "whole":
            if not needed and total + len(lines) * rank.LINE_CHARS + SECTION_CHARS > self.budget.chars:
                return None
            names = list(dict.fromkeys(n.name for n in nodes))
            more = len(names) - self.budget.header_symbols
            what = ", ".join(names[: self.budget.header_symbols]) + (f", +{more} more" if more > 0 else "")
            return [presentation.section_of(f.file_path, what), "", f"```{fence}", numbered(lines, 1, len(lines)), "```", ""]
        if mode == "skeleton":
            text = skeleton(nodes, lines, self.way, self.unique, self.budget)
            what = "focused (named methods in full, the others as signatures)" if self.way and self.named else "skeleton (signatures only)"
            return [presentation.section_of(f.file_path, what), "", f"```{fence}", text, "```", ""] if text else []
        parts = clusters(nodes, lines, self.importance, self.budget)
        return [presentation.section_of(f.file_path, "clustered"), "", *(x for a, b in parts for x in (f"```{fence}", numbered(lines, a, b), "```", ""))] if parts else []

    def importance(self, n: Row) -> int:
        return next((points for points, ids in ((10, self.entries), (9, self.named), (6, self.glue), (3, self.near)) if n.id in ids), 1)


def _part(lines: list[str], first: int, last: int) -> str:
    return "\n".join(lines[max(0, first - 1) : last])


def numbered(lines: list[str], first: int, last: int) -> str:
    """Lines first to last with their numbers."""
    return "\n".join(f"{k}\t{x}" for k, x in enumerate(lines[max(0, first - 1) : last], max(1, first)))


def skeleton(nodes: list[Row], lines: list[str], way: set[str], unique: set[str], budget: rank.Budget) -> str:
    """Symbols of a file in order: bodies of those on the way or nearly unique while they fit, the first line of others."""
    symbols = sorted(nodes, key=lambda n: (n.start_line if n.start_line and n.start_line > 0 else 1 << 31, n.id))
    bodies, used = set(), 0
    for n in symbols:
        if n.kind in BODY_KINDS and (n.id in way or n.id in unique) and (n.end_line or 0) >= (n.start_line or 0) > 0:
            size = len(_part(lines, n.start_line, n.end_line))
            if not bodies or used + size <= 1.5 * budget.chars_per_file:
                bodies.add(n.id)
                used += size
    out, until, signatures, dropped = [], 0, 0, 0
    most = max(12, 2 * budget.header_symbols)
    for n in symbols:
        start = n.start_line or 0
        if 0 < start <= until or not 0 < start <= len(lines):
            continue
        if n.id in bodies:
            out.append(numbered(lines, start, n.end_line))
            until = n.end_line
            continue
        at = next((k for k in range(start, min(start + 4, len(lines) + 1)) if n.name in lines[k - 1]), start)
        if at <= until or not lines[at - 1].strip():
            continue
        if signatures >= most:
            dropped += 1
            continue
        out.append(f"{at}\t{lines[at - 1].strip()}")
        signatures += 1
    return "\n".join([*out, *([f"… +{dropped} more (signatures left out)"] if dropped else [])])


def clusters(nodes: list[Row], lines: list[str], importance, budget: rank.Budget) -> list[tuple[int, int]]:
    """Line ranges of a file to show: those of symbols, merged over gaps, of some importance, while they fit."""
    merged: list[list[int]] = []
    for n in sorted(nodes, key=lambda n: (n.start_line or 0, n.end_line or 0, n.id)):
        if not n.start_line or n.start_line <= 0 or (n.end_line or 0) <= n.start_line or (n.kind in ENVELOPE_KINDS and n.end_line - n.start_line + 1 > len(lines) * 0.5):
            continue
        if merged and n.start_line - merged[-1][1] <= budget.gap:
            merged[-1][1:] = [max(merged[-1][1], n.end_line), max(merged[-1][2], importance(n))]
        else:
            merged.append([n.start_line, n.end_line, importance(n)])
    out, used = [], 0
    for a, b, points in merged:
        size = len(_part(lines, a, b))
        if points >= 3 and (not out or used + size <= 3 * budget.chars_per_file):
            out.append((a, b))
            used += size
    return out[: budget.chars_per_file // 40]
