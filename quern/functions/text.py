"""Text, path and language expressions: columns in, columns out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_CHARS = 4096
MAX_FILE_BYTES = 1 << 20

# --- fixed values: file extensions and the language they stand for --------------------
LANGUAGE_BY_EXTENSION = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp",
    "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "csharp", "php": "php", "rb": "ruby", "kt": "kotlin", "kts": "kotlin",
    "swift": "swift", "scala": "scala", "sc": "scala", "lua": "lua", "sh": "shell", "bash": "shell", "zsh": "shell",
    "ps1": "powershell", "sql": "sql", "html": "html", "css": "css", "scss": "css", "sass": "css", "less": "css",
    "vue": "vue", "svelte": "svelte", "md": "markdown", "json": "json", "toml": "toml",
}

# --- fixed values: parts of a path that mark generated or foreign files ---------------
IGNORED_PARTS = (
    ".git/", ".hg/", ".svn/", "target/", "dist/", "build/", "coverage/", "node_modules/", ".pnpm-store/", ".npm/",
    ".yarn/", ".parcel-cache/", ".next/", ".nuxt/", ".svelte-kit/", ".venv/", "venv/", "env/", ".tox/", ".nox/",
    "__pycache__/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/", ".pytype/", ".eggs/", ".gradle/", ".terraform/",
    ".serverless/", ".aws-sam/", ".direnv/", ".idea/", ".vscode/",
)

# --- fixed values: weights of the token estimate, by preset ---------------------------
#: ASCII characters a token, other characters a token, weight of punctuation, of line feeds.
TOKEN_PRESETS = {
    "default": (3.8, 1.55, 0.30, 0.17),
    "o200k": (4.1, 1.7, 0.28, 0.16),
    "claude": (3.6, 1.45, 0.31, 0.18),
    "legacy": (4.0, 4.0, 0.0, 0.0),
}
SYMBOL_WEIGHT = 0.55


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def contains_any(text: Column, needles: tuple[str, ...] | list[str]) -> Column:
    return any_of([F.contains(text, F.lit(n)) for n in needles])


def lines(text: Column) -> Column:
    """Lines of a text: a last line feed ends a line rather than opening another one."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(body, "\r?\n"))


def tokens(text: Column) -> Column:
    """Sorted distinct lower-case runs of letters, digits and ``_`` of two or more characters."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 2)))


def token_list(text: Column) -> Column:
    """The same tokens in order, repeated ones included."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= 2)


def match_key(text: Column) -> Column:
    """Form for accent-insensitive matching: lower case, marks dropped, letters folded."""
    folded = F.translate(F.lower(text), _FOLD_FROM, _FOLD_TO)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.regexp_replace(folded, r"\p{M}", "")


_FOLD_FROM = "àáâãäåāăąçćĉċčďđèéêëēĕėęěĝğġģìíîïĩīĭįıñńņňòóôõöøōŏőùúûüũūŭůűųýÿŕřśŝşšťţŵźżž"
_FOLD_TO = "aaaaaaaaacccccddeeeeeeeeeggggiiiiiiiiinnnnooooooooouuuuuuuuuuyyrrssssttwzzz"


def symbol_tail(symbol: Column) -> Column:
    """What follows the last ``::``, else the last point."""
    by_colons = F.substring_index(symbol, "::", -1)
    return F.when(F.contains(symbol, F.lit("::")), by_colons).otherwise(F.substring_index(symbol, ".", -1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def percent_encode(path: Column) -> Column:
    """All bytes but letters, digits and ``/ . - _`` as ``%XX``.

    The engine's form encoding does the rest; it keeps ``*``, writes a blank as ``+`` and ``/`` as ``%2F``.
    """
    out = F.url_encode(path)
    for was, now in (("+", "%20"), ("*", "%2A"), ("%2F", "/")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("text"))


def is_ignored(path: Column) -> Column:
    special = (path == ".gitignore") | path.endswith("/.gitignore")
    return special | contains_any(path, IGNORED_PARTS)


def file_kind(path: Column) -> Column:
    low = F.lower(path)
    test = any_of([F.startswith(low, F.lit(d)) for d in ("tests/", "benches/", "examples/")]) | contains_any(
        low, ("/tests/", "/benches/", "/examples/", ".test.", ".spec.", "_test.")
    )
    config = file_name(path).isin("Cargo.lock", ".gitignore", ".editorconfig") | extension(path).isin(
        "toml", "json", "yaml", "yml", "ini", "cfg"
    )
    return F.when(test, "test").when(config, "config").otherwise("default")


def count_chars(text: Column, klass: str) -> Column:
    """How many characters of ``text`` belong to the regex class."""
    return F.length(F.regexp_replace(text, rf"[^{klass}]+", ""))


def token_estimate(text: Column, preset: str = "default") -> Column:
    """Estimated number of model tokens; 0 for an empty text, else 1 at least."""
    ascii_rate, other_rate, punct_weight, feed_weight = TOKEN_PRESETS[preset]
    # One pass each by a class that the engine knows as a whole; what is left is short.
    only = lambda outside, less: F.length(F.regexp_replace(F.regexp_replace(text, outside, ""), less, ""))
    words = F.length(F.regexp_replace(text, r"\W+", ""))
    punct = only(r"\P{Punct}+", "_+")
    symbols = punct + only(r"\P{Cntrl}+", r"[\x09-\x0D]+")
    other = only(r"\p{ASCII}+", r"[\u0085   -     　]+")
    feeds = only(r"\P{Cntrl}+", r"[^\n]+")
    total = words / ascii_rate + symbols * SYMBOL_WEIGHT + other / other_rate + punct * punct_weight + feeds * feed_weight
    # No condition around the counts, so that several presets share them.
    return F.greatest(F.least(F.length(text), F.lit(1)), F.ceil(F.round(total, 6))).cast("long")


def compact(text: Column, width: int = 180) -> Column:
    """White space as single spaces, cut to ``width`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("..."))).otherwise(flat)


def excerpt(text: Column, needle: Column, width: int = 180) -> Column:
    """``width`` characters around the first match of ``needle``, with ellipses where cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.greatest(F.position(F.lower(needle), F.lower(flat)), F.lit(1))
    begin = F.greatest(F.lit(1), at - width // 3)
    body = F.substr(flat, begin, F.lit(width))
    left = F.when(begin > 1, "...").otherwise("")
    right = F.when(begin + width <= F.length(flat), "...").otherwise("")
    return F.concat(left, body, right)


def escape_like(pattern: str) -> str:
    """``pattern`` with the wildcards of LIKE taken literally, backslash as escape."""
    return pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def has_nul(content: Column) -> Column:
    """True for binary content: a zero byte anywhere."""
    return F.position(F.lit(bytearray(b"\x00")), content) > 0
