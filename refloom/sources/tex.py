"""TeX and BibTeX as tables: entries, citation sites, table cells. Parsers run once per file, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from refloom.functions.tex import strip_tex
from refloom.sources.claims import TEX_SENTENCE, TEX_WINDOW, Places, sentence


def balanced(text: str, at: int, opening: str = "{", closing: str = "}") -> int:
    """Where the group that opens at ``at`` ends (past its closing mark); the end of text if it never does."""
    depth = 0
    i = at
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        depth += (text[i] == opening) - (text[i] == closing)
        i += 1
        if depth == 0:
            return i
    return len(text)


def bib_entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(key, type, fields) of each BibTeX entry; values lose their braces or quotes."""
    out = []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s{}]+)\s*,", text):
        kind = m.group(1).lower()
        if kind in ("comment", "string", "preamble"):
            continue
        body, fields, i = text[m.end() : balanced(text, text.index("{", m.start())) - 1], {}, 0
        while f := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(body, i):
            j = f.end()
            if body[j : j + 1] == "{":
                end = balanced(body, j)
                value = body[j + 1 : end - 1]
            elif body[j : j + 1] == '"':
                end = body.find('"', j + 1)
                end = len(body) if end < 0 else end + 1
                value = body[j + 1 : end - 1]
            else:
                bare = re.compile(r"[^,}\n]*").match(body, j)
                end, value = bare.end(), bare.group()
            fields.setdefault(f.group(1).lower(), re.sub(r"\s+", " ", re.sub(r"[{}]", "", value)).strip())
            i = end
        out.append((m.group(2), kind, fields))
    return out


def bibitems(text: str) -> list[tuple[str, str]]:
    """(key, body) of each \\bibitem; a body ends where the next one begins, or the environment does."""
    found = list(re.finditer(r"\\bibitem\s*(?:\[[^\]]*\])?\s*\{([^}]+)\}", text))
    out = []
    for a, b in zip(found, [*found[1:], None], strict=True):
        body = text[a.end() : b.start() if b else len(text)]
        out.append((a.group(1).strip(), re.sub(r"\s+", " ", body.split("\\end{thebibliography}")[0]).strip()))
    return out


#: The commands that cite in running text, that begin a section, and the environments of tables.
CITES = ("cite", "citep", "citet", "citealp", "citealt", "citeauthor", "citeyear", "citenum", "parencite", "textcite", "autocite", "footcite")
SECTIONS = ("section", "subsection", "subsubsection", "chapter", "paragraph")
TABLES = ("table", "table*", "tabular", "tabular*", "tabularx", "longtable", "wraptable", "sidewaystable", "threeparttable")
_COMMAND = re.compile(r"\\([A-Za-z]+\*?)\s*")


def commands(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(name, begin, end, argument) of each command: its first braced argument, after up to two optional ones; '' without one."""
    for m in _COMMAND.finditer(text):
        at = m.end()
        for _ in range(2):
            if text[at : at + 1] == "[":
                at = text.find("]", at) + 1 or len(text)
                at = re.compile(r"\s*").match(text, at).end()
        end = text.find("}", at) + 1 if text[at : at + 1] == "{" else 0
        yield m.group(1), m.start(), end or m.end(), text[at + 1 : end - 1] if end else ""


def environments(text: str, names: tuple[str, ...]) -> list[tuple[int, int]]:
    """(begin, end) of the outermost environments of these names; one that is never closed is left out."""
    spans, stack = [], []
    for name, begin, end, argument in commands(text):
        if name == "begin" and argument in names:
            stack.append((argument, begin))
        elif name == "end" and any(x == argument for x, _ in stack):
            while stack[-1][0] != argument:
                stack.pop()
            _, first = stack.pop()
            if not stack:
                spans.append((first, end))
    return spans


def cite_sites(text: str, window: int = TEX_WINDOW) -> list[tuple[str, int, int, str, bool, str, int, int]]:
    """(key, start, end, section, in a table, sentence, first, last) of each key of each citation: where the citation stands, and where its sentence does, which is TeX still.

    Line comments don't count; a key that a sentence cites twice counts once; a text without any citation gives none.
    """
    text = re.sub(r"(?<!\\)%[^\n]*", "", text)
    places = Places([(b, re.sub(r"\\[a-zA-Z]+", "", arg).strip()) for name, b, _, arg in commands(text) if name.rstrip("*") in SECTIONS], environments(text, TABLES))
    out, seen = [], set()
    for name, begin, end, argument in commands(text):
        if name.rstrip("*") in CITES:
            first, last = sentence(text, begin, window, TEX_SENTENCE)
            for key in (k.strip() for k in argument.split(",")):
                if key and (key, first, last) not in seen:
                    seen.add((key, first, last))
                    out.append((key, begin, end, " ".join(places.section(begin).split()), places.inside(begin), text[first:last], first, last))
    return out


def _top_level(text: str, separators: str) -> list[str]:
    """Split at separators outside braces."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(text):
        if text.startswith("\\\\", i) and "\\" in separators and depth == 0:
            out.append(text[at:i])
            i += 2
            skip = re.compile(r"\s*\[[^\]]*\]").match(text, i)
            at = i = skip.end() if skip else i
            continue
        if text[i] == "\\":
            i += 2
            continue
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0 and text[i] == "&" and "&" in separators:
            out.append(text[at:i])
            at = i + 1
        i += 1
    return [*out, text[at:]]


def tabular_cells(body: str) -> list[tuple[int, int, str, int]]:
    """(row, column, raw, span) of a tabular's body; \\multicolumn spans columns, rules are dropped."""
    body = re.sub(r"\\(hline|toprule|midrule|bottomrule)|\\c(line|midrule)(\([^)]*\))?\{[^}]*\}", " ", body)
    out, r = [], 0
    for row in _top_level(body, "\\"):
        if not row.strip():
            continue
        c = 0
        for cell in _top_level(row, "&"):
            span = 1
            if m := re.match(r"\s*\\multicolumn\s*\{(\d+)\}\s*\{[^}]*\}\s*", cell):
                span, cell = int(m.group(1)), cell[m.end() :].strip()
                cell = cell[1:-1] if cell.startswith("{") else cell
            out.append((r, c, re.sub(r"\s+", " ", cell).strip(), span))
            c += span
        r += 1
    return out


def parsed(files: DataFrame, schema: str, parse: Callable[[str], list[tuple]], column: str = "text", carry: str = "file") -> DataFrame:
    """A table function: each file's rows of parse(text), with the file. A null text gives none."""
    kind = files.select(carry).schema[0].dataType.simpleString()
    names = [x.strip().split(" ")[0] for x in f"{carry} {kind}, {schema}".split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(own, *x) for own, text in zip(batch[carry], batch[column], strict=True) if text for x in parse(text)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select(carry, column).mapInPandas(run, f"`{carry}` {kind}, {schema}")


def bib_table(files: DataFrame) -> DataFrame:
    return parsed(files, "key string, type string, fields map<string,string>", bib_entries)


def site_table(files: DataFrame) -> DataFrame:
    """Citation sites of each file, their sentences as plain prose."""
    sites = parsed(files, "key string, start int, end int, section string, in_table boolean, sentence string, first int, last int", cite_sites)
    return sites.withColumn("sentence", strip_tex("sentence"))


def cell_table(files: DataFrame) -> DataFrame:
    return parsed(files, "r int, c int, raw string, span int", tabular_cells)
