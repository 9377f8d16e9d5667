"""Glob and ignore patterns as regular expressions, index scopes and profiles.

Patterns are compiled on the driver; the table is filtered by one native expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import text as T

MAX_VARIANTS, MAX_ALTERNATIVES, MAX_NESTING = 4096, 256, 32

# --- fixed values: paths that each index profile includes -------------------------------
PROFILES = {
    "rust-monorepo": ("Cargo.toml", "crates/**", "src/**", "tests/**", "docs/**", "schemas/**", "README.md"),
    "mixed": ("**",),
    "docs-heavy": ("docs/**", "**/*.md", "**/*.mdx", "README.md"),
}


def expand_braces(pattern: str) -> list[str]:
    """All variants of ``{a,b}`` groups, nested ones too."""
    out, todo = [], [(pattern, 0)]
    while todo:
        p, level = todo.pop()
        m = re.search(r"\{([^{}]*,[^{}]*)\}", p)
        if not m:
            out.append(p)
            continue
        parts = m[1].split(",")
        if len(parts) > MAX_ALTERNATIVES or level >= MAX_NESTING:
            raise ValueError("too many alternatives or too deep nesting in a pattern")
        todo += [(p[: m.start()] + x + p[m.end() :], level + 1) for x in reversed(parts)]
        if len(out) + len(todo) > MAX_VARIANTS:
            raise ValueError("a pattern has too many variants")
    return out


def _segment(p: str) -> str:
    """One path segment: ``* ? [..]`` and ``@( ?( +( *( !(`` with alternatives."""
    out, k = "", 0
    while k < len(p):
        c = p[k]
        if c in "@?+*!" and p[k + 1 : k + 2] == "(":
            depth, m = 1, k + 2
            while m < len(p) and depth:
                depth += (p[m] == "(") - (p[m] == ")")
                m += 1
            if depth:
                raise ValueError(f"open group in {p!r}")
            inner = "|".join(_segment(x) for x in p[k + 2 : m - 1].split("|"))
            rest = p[m:]
            if c == "!":
                return out + f"(?!(?:{inner}){_segment(rest)}(?:/|$))[^/]*" + _segment(rest)
            out += f"(?:{inner})" + {"@": "", "?": "?", "+": "+", "*": "*"}[c]
            k = m
        elif c == "*":
            out += "[^/]*"
            k += 1
        elif c == "?":
            out += "[^/]"
            k += 1
        elif c == "[":
            end = p.find("]", k + 2)
            if end < 0:
                raise ValueError(f"open class in {p!r}")
            body = p[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            k = end + 1
        else:
            out += re.escape(c)
            k += 1
    return out


def glob_regex(pattern: str) -> str:
    """A regex for whole paths; ``**`` stands for any number of segments.

    A plain path also matches everything below it.
    """
    out = []
    for variant in expand_braces(pattern.strip().removeprefix("./").rstrip("/")):
        if not re.search(r"[*?\[(]", variant):
            out.append(re.escape(variant) + "(?:/.*)?")
            continue
        parts, rx = variant.split("/"), ""
        for k, part in enumerate(parts):
            last = k + 1 == len(parts)
            if part == "**":
                rx += ".*" if last else "(?:[^/]+/)*"
            else:
                rx += _segment(part) + ("" if last else "/")
        out.append(rx)
    return "^(?:" + "|".join(out) + ")$"


def scope(path: Column, include: list[str] | tuple[str, ...] = (), exclude: list[str] | tuple[str, ...] = (), profile: str | None = None) -> Column:
    """True for paths within the profile and the includes and outside the excludes."""
    ok = F.lit(True)
    if profile is not None:
        ok = ok & T.any_of([path.rlike(glob_regex(p)) for p in PROFILES[profile]])
    if include:
        ok = ok & T.any_of([path.rlike(glob_regex(p)) for p in include])
    if exclude:
        ok = ok & ~T.any_of([path.rlike(glob_regex(p)) for p in exclude])
    return ok


def default_profile(paths: list[str]) -> str:
    """rust-monorepo for a root manifest with a crates or src folder, else mixed."""
    rust = "Cargo.toml" in paths and any(p.startswith(("crates/", "src/")) for p in paths)
    return "rust-monorepo" if rust else "mixed"


def gitignore(path: Column, lines: list[str]) -> Column:
    """True for paths that an ignore file excludes; the last rule that fits decides."""
    out = F.lit(False)
    for raw in lines:
        rule = raw.strip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        body = rule[keep:].rstrip("/")
        anchored = "/" in body
        parts = "/".join(".*" if s == "**" else _segment(s) for s in body.lstrip("/").split("/")).replace(".*/", "(?:.*/)?")
        rx = ("^" if anchored else "(?:^|/)") + parts + ("/" if rule.endswith("/") else "(?:/|$)")
        out = F.when(path.rlike(rx), F.lit(not keep)).otherwise(out)
    return out


def scope_preview(files, include=(), exclude=(), profile=None):
    """``(bucket, n, paths)``: what a scope takes, leaves out or ignores, without reading any file."""
    path = F.col("path")
    bucket = F.when(T.is_ignored(path), "ignored").when(scope(path, include, exclude, profile), "included").otherwise("excluded_by_scope")
    return files.select("path", bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("path")), 1, 20).alias("paths"))
