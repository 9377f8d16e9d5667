"""Source extraction: symbols, references, dependencies, complexity and symbol bodies.

Lexers keep state across lines (comments, strings, nesting), so they run in Arrow
batches; what they emit is exploded into tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import source_text as S

LANGUAGES = ("java", "rust", "python", "javascript", "typescript")

# --- fixed values: declarations, imports and non-calls by language ----------------------
_DECLARATIONS = {
    "rust": re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?P<kind>fn|struct|enum|trait|mod|impl|type)\s+(?:<[^>]*>\s*)?(?P<name>[A-Za-z_]\w*)"),
    "python": re.compile(r"^\s*(?:async\s+)?(?P<kind>def|class)\s+(?P<name>[A-Za-z_]\w*)"),
    "java": re.compile(
        r"^\s*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*(?:(?P<kind>class|interface|enum|record)\s+(?P<name>[A-Za-z_]\w*)"
        r"|(?:[\w<>\[\],.?]+\s+)(?P<method>[A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws\s+[\w.,\s]+)?\{)"
    ),
    "javascript": re.compile(
        r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(?P<kind>function\*?|class|interface|enum|type)\s+(?P<name>[A-Za-z_$][\w$]*)"
        r"|(?:const|let|var)\s+(?P<method>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>)"
    ),
}
_IMPORTS = {
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+(?P<dep>[\w:]+)"),
    "python": re.compile(r"^\s*(?:from\s+(?P<dep>[\w.]+)\s+import|import\s+(?P<alt>[\w.]+))"),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?(?P<dep>[\w.]+)"),
    "javascript": re.compile(r"(?:^\s*(?:import|export)\b.*?\bfrom\s+|^\s*import\s+|\brequire\()\s*['\"](?P<dep>[^'\"]+)['\"]"),
}
_CALL = re.compile(r"(?P<name>[A-Za-z_$][\w$]*(?:(?:::|\.)[A-Za-z_$][\w$]*)*)\s*!?\(")
_NOT_CALLS = frozenset("if for while match return switch catch def class fn elif with assert and or not in lambda function new super typeof await print".split())
_BRANCH = {
    "python": re.compile(r"\b(?:if|elif|for|while|except|and|or|case)\b"),
    "": re.compile(r"\b(?:if|for|while|case|catch|match|loop)\b|&&|\|\||\?(?=\s)"),
}
_COMMENT = {"python": "#", "": "//"}


def family(language: str) -> str:
    return "javascript" if language == "typescript" else language


def _code_lines(text: str, language: str, fidelity: bool) -> Iterator[tuple[int, str, str]]:
    """Numbered lines with strings and comments blanked, and as they are.

    ``fidelity`` strips Python comments at ``//`` alone, as the original does.
    """
    return S.code_lines(text, language, "//" if fidelity and language == "python" else None)


def extract_graph(text: str, language: str, fidelity: bool = False) -> dict[str, list]:
    """Symbols ``(name, kind, line, column)``, refs ``(symbol, line, column)`` and deps of a source text."""
    lang = family(language)
    out: dict[str, list] = {"symbols": [], "refs": [], "deps": []}
    if language not in LANGUAGES:
        return out
    declare, imports = _DECLARATIONS[lang], _IMPORTS[lang]
    for n, line, raw in _code_lines(text, lang, fidelity):
        m = imports.search(raw)
        if m and line[at := m.start() + len(m[0]) - len(m[0].lstrip())] == raw[at]:
            out["deps"].append(next(g for g in m.groups() if g))
            continue
        m = declare.match(line)
        own = None
        if m:
            own = m.groupdict().get("name") or m.groupdict().get("method")
            kind = m.groupdict().get("kind") or "method"
            if own and own not in _NOT_CALLS:
                out["symbols"].append((own, kind, n, m.start("name" if m.groupdict().get("name") else "method") + 1))
        for c in _CALL.finditer(line):
            name = c["name"]
            if name not in _NOT_CALLS and name != own:
                out["refs"].append((name, n, c.start() + 1))
    out["deps"] = sorted(set(out["deps"]))
    return out


def complexity(text: str, language: str) -> dict[str, int]:
    """Branches, cyclomatic and cognitive complexity, nesting, early returns, longest function, parameters, TODOs.

    Cyclomatic is branches plus one; cognitive sums one plus the nesting of each branch.
    """
    lang = family(language)
    branch = _BRANCH.get(lang, _BRANCH[""])
    declare = _DECLARATIONS.get(lang)
    branches = cognitive = deepest = returns = longest = params = exports = members = depth = 0
    begun: list[tuple[int, int]] = []
    last = 0
    for n, line, _ in _code_lines(text, lang, False):
        if not line.strip():
            continue
        last = n
        if lang == "python":
            depth = (len(line) - len(line.lstrip())) // 4
            while begun and depth <= begun[-1][1]:
                longest = max(longest, n - begun.pop()[0])
        base = begun[-1][1] + 1 if begun else 0
        sites = len(branch.findall(line))
        nesting = max(0, depth - base)
        branches += sites
        cognitive += sites * (1 + nesting)
        deepest = max(deepest, nesting)
        returns += len(re.findall(r"\breturn\b", line)) if nesting > 0 else 0
        m = declare.match(line) if declare else None
        if m:
            kind = m.groupdict().get("kind") or "method"
            exports += bool(re.match(r"\s*(pub\b|export\b|public\b)", line)) or (lang == "python" and depth == 0)
            members += bool(begun) or depth > 0
            if kind in ("fn", "def", "function", "function*", "method"):
                inner = re.search(r"\(([^)]*)\)", line)
                params = max(params, len([p for p in inner[1].split(",") if p.strip()]) if inner else 0)
                begun.append((n, depth))
        if lang != "python":
            depth += line.count("{") - line.count("}")
            while begun and depth <= begun[-1][1] and n > begun[-1][0]:
                longest = max(longest, n - begun.pop()[0] + 1)
    for a, _ in begun:
        longest = max(longest, last - a + 1)
    return {
        "max_cyclomatic_complexity": branches + 1,
        "max_cognitive_complexity": cognitive,
        "branch_count": branches,
        "early_return_count": returns,
        "max_nesting_depth": deepest,
        "max_function_lines": longest,
        "max_parameters_per_function": params,
        "max_export_count_per_file": exports,
        "max_class_member_count": members,
        "max_todo_count_per_file": len(re.findall(r"\b(?:TODO|FIXME)\b", text)),
    }


METRICS = tuple(complexity("", "rust"))
GRAPH_SCHEMA = (
    "path string, language string, symbols array<struct<name:string,kind:string,line:int,column:int>>, "
    "refs array<struct<symbol:string,line:int,column:int>>, deps array<string>, metrics map<string,bigint>"
)


def source_facts(files: DataFrame, fidelity: bool = False) -> DataFrame:
    """One row for each source file with its symbols, references, dependencies and metrics.

    ``files(path, language, text)``; files of other languages are filtered before they
    reach Python.
    """
    kinds = [
        pa.string(),
        pa.string(),
        pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("column", pa.int32())])),
        pa.list_(pa.struct([("symbol", pa.string()), ("line", pa.int32()), ("column", pa.int32())])),
        pa.list_(pa.string()),
        pa.map_(pa.string(), pa.int64()),
    ]
    names = ["path", "language", "symbols", "refs", "deps", "metrics"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                g = extract_graph(text or "", language, fidelity)
                symbols = [dict(zip(("name", "kind", "line", "column"), s)) for s in g["symbols"]]
                refs = [dict(zip(("symbol", "line", "column"), r)) for r in g["refs"]]
                rows.append((path, language, symbols, refs, g["deps"], list(complexity(text or "", language).items())))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    own = files.where(F.col("language").isin(*LANGUAGES)).select("path", "language", "text")
    return own.mapInArrow(run, GRAPH_SCHEMA)


def symbols_of(facts: DataFrame) -> DataFrame:
    return facts.select("path", "language", F.explode("symbols").alias("s")).select("path", "language", "s.*")


def refs_of(facts: DataFrame) -> DataFrame:
    return facts.select("path", "language", F.explode("refs").alias("r")).select("path", "language", "r.*")


def deps_of(facts: DataFrame) -> DataFrame:
    return facts.select("path", "language", F.explode("deps").alias("dep"))


def metrics_of(facts: DataFrame) -> DataFrame:
    return facts.select("path", F.explode("metrics").alias("metric_id", "value"))


def symbol_body(text: str, language: str, line: int) -> tuple[int, int, str]:
    """``(first line, last line, body)`` of the declaration at ``line``: by indent or by braces, strings and comments aside."""
    lines, lang = text.splitlines(), family(language)
    if not 1 <= line <= len(lines):
        return 0, 0, ""
    code = S.blank_code(text, lang).splitlines()
    if lang == "python":
        indent = len(code[line - 1]) - len(code[line - 1].lstrip())
        end = line
        for k in range(line, len(code)):
            s = code[k]
            if s.strip() and len(s) - len(s.lstrip()) <= indent:
                break
            if lines[k].strip():
                end = k + 1
        return line, end, "\n".join(lines[line - 1 : end])
    depth, opened = 0, False
    for k in range(line - 1, len(code)):
        depth += code[k].count("{") - code[k].count("}")
        opened = opened or "{" in code[k]
        if (opened and depth <= 0) or (not opened and code[k].rstrip().endswith(";")):
            return line, k + 1, "\n".join(lines[line - 1 : k + 1])
    return line, len(lines), "\n".join(lines[line - 1 :])
