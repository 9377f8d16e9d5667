"""Line operators: one row per file in, metrics or findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

_SCRIPT = ("javascript", "jsx", "mjs", "cjs", "typescript", "tsx")

# --- fixed values: what marks a smell, by language -------------------------------------
PATH_INPUTS = ("user", "input", "path", "req.", "argv", "param")
SQL_WORDS = ("select ", "insert into", "update ", "delete from")
SQL_GLUE = ("format!(", 'f"', "f'", "${", "%s", " + ")
NO_SMELL_LANGUAGES = ("markdown", "text", "json", "yaml", "toml")
NO_SMELL_PATHS = ("/tests/", "/examples/", "/benches/")
# --- fixed values: names and values of secrets -----------------------------------------
SECRET_NAMES = ("password", "secret", "token", "api_key", "apikey")
PLACEHOLDER_WORDS = ("placeholder", "example", "sample", "dummy", "fake", "test")
MASKS = ("****", "xxxx", "<redacted>", "REDACTED")
SENSITIVE_MAX_BYTES = 256 * 1024


def is_import(language: Column, line: Column) -> Column:
    body = F.ltrim(line)
    starts = lambda *p: T.any_of([F.startswith(body, F.lit(x)) for x in p])
    script = starts("import ") | (
        starts("export ") & F.contains(body, F.lit(" from ")) & ~starts("export default")
    )
    return (
        F.when(language == "rust", starts("use ", "pub use "))
        .when(language == "python", starts("import ", "from "))
        .when(language.isin(*_SCRIPT), script)
        .otherwise(F.lit(False))
    )


def line_metrics(files: DataFrame) -> DataFrame:
    """Counts of lines, the longest line and the import region of every file.

    One pass over arrays; nothing is exploded or shuffled.
    """
    f = files.select("path", "language", T.lines(F.col("text")).alias("lines"))
    lengths = F.transform("lines", lambda x: F.length(x))
    longest = F.coalesce(F.array_max(lengths), F.lit(0))
    flags = F.transform("lines", lambda x: is_import(F.col("language"), x))
    hits = F.filter(F.transform(flags, lambda x, k: F.when(x, k + 1)), lambda k: k.isNotNull())
    return f.select(
        "path",
        F.size("lines").cast("long").alias("total_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"\S"))).cast("long").alias("non_empty_lines"),
        F.size(hits).cast("long").alias("import_count"),
        longest.cast("long").alias("max_line_length"),
        F.when(F.size("lines") > 0, F.array_position(lengths, longest)).cast("long").alias("max_line"),
        F.array_min(hits).cast("long").alias("import_first"),
        F.array_max(hits).cast("long").alias("import_last"),
    )


def exploded_lines(files: DataFrame, *keep: str) -> DataFrame:
    """``(path, *keep, line_no, line)``, lines counted from 1."""
    f = files.select("path", *keep, F.posexplode(T.lines(F.col("text"))).alias("k", "line"))
    return f.select("path", *keep, (F.col("k") + 1).alias("line_no"), "line")


def smell_kinds(language: Column, line: Column) -> Column:
    """Array of the smells of one line, with the confidence of each."""
    body = F.trim(line)
    has = lambda *n: T.contains_any(body, n)
    shell = (
        F.when(language == "rust", has("Command::new("))
        .when(language == "python", has("subprocess.") & has("shell=True"))
        .when(language.isin(*_SCRIPT), has("child_process.exec(", "execSync("))
        .otherwise(F.lit(False))
    )
    opens = (
        F.when(language == "rust", has("File::open(", "fs::read(", "fs::read_to_string("))
        .when(language == "python", has("open(", "Path("))
        .when(language.isin(*_SCRIPT), has("readFile(", "readFileSync("))
        .otherwise(F.lit(False))
    )
    sql = T.contains_any(F.lower(body), SQL_WORDS) & has(*SQL_GLUE)
    load = has("pickle.load(", "pickle.loads(") | (has("yaml.load(") & ~has("safe_load"))
    found = [
        (shell, "shell_exec", "medium"),
        (opens & has(*PATH_INPUTS), "path_traversal", "low"),
        (sql, "raw_sql", "medium"),
        (load, "unsafe_deserialize", "high"),
    ]
    rows = F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("confidence"))) for c, k, s in found])
    return F.filter(rows, lambda x: x.isNotNull())


def security_smells(files: DataFrame) -> DataFrame:
    """``(path, kind, confidence, match_count, first_line)`` of the four smells."""
    scanned = ~F.col("language").isin(*NO_SMELL_LANGUAGES) & ~T.contains_any(F.lower("path"), NO_SMELL_PATHS)
    rows = exploded_lines(files.where(scanned), "language")
    rows = rows.select("path", "line_no", F.explode(smell_kinds(F.col("language"), F.col("line"))).alias("s"))
    return rows.groupBy("path", F.col("s.kind").alias("kind"), F.col("s.confidence").alias("confidence")).agg(
        F.count("*").alias("match_count"), F.min("line_no").alias("first_line")
    )


def _realistic(value: Column, line: Column) -> Column:
    return ~T.contains_any(F.lower(F.concat_ws(" ", value, line)), PLACEHOLDER_WORDS) & ~T.contains_any(value, MASKS)


def redact(value: Column) -> Column:
    tail = F.substr(value, F.length(value) - 3, F.lit(4))
    return F.when(F.octet_length(value) <= 8, "<redacted>").otherwise(F.concat(F.substring(value, 1, 4), F.lit("…"), tail))


def sensitive_data(files: DataFrame, include_low_confidence: bool = True) -> DataFrame:
    """``(path, line_no, kind, confidence, urgency, excerpt)`` of secrets in text.

    Files over 256 KiB are not scanned. Lines without any marker are dropped before
    words are taken apart.
    """
    rows = exploded_lines(files.where(F.col("size_bytes") <= SENSITIVE_MAX_BYTES))
    line = F.col("line")
    secret = lambda kind, confidence, urgency, value: F.struct(
        F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(urgency).alias("urgency"), redact(value).alias("excerpt")
    )
    empty = F.array().cast("array<struct<kind:string,confidence:string,urgency:string,excerpt:string>>")
    key = F.when(F.contains(line, F.lit("BEGIN PRIVATE KEY")), F.array(secret("private_key", "high", "critical", line))).otherwise(empty)
    words = F.filter(F.split(line, r"[^A-Za-z0-9_.-]"), lambda w: F.length(w) >= 20)

    def token(w: Column) -> Column:
        hit = (
            F.when(w.rlike(r"^AKIA[A-Z0-9]{16}$"), secret("aws_access_key", "high", "critical", w))
            .when(w.rlike(r"^ghp_[A-Za-z0-9]{16,}$"), secret("github_pat", "high", "high", w))
            .when(w.rlike(r"^sk-[A-Za-z0-9-]{21,}$"), secret("openai_api_key", "high", "high", w))
        )
        return F.when(_realistic(w, line), hit)

    tokens = F.when(line.rlike(r"AKIA|ghp_|sk-"), F.filter(F.transform(words, token), lambda x: x.isNotNull())).otherwise(empty)
    parts = [key, tokens]
    if include_low_confidence:
        value = F.regexp_replace(F.trim(F.get(F.split(line, "[=:]"), F.lit(1))), '^"+|"+$', "")
        value = F.regexp_replace(value, "^'+|'+$", "")
        named = T.contains_any(F.lower(line), SECRET_NAMES) & (F.octet_length(value) >= 12) & _realistic(value, line)
        parts.append(F.when(named, F.array(secret("credential_assignment", "medium", "medium", value))).otherwise(empty))
    marked = T.contains_any(line, ("BEGIN PRIVATE KEY", "AKIA", "ghp_", "sk-")) | T.contains_any(F.lower(line), SECRET_NAMES)
    return rows.where(marked).select("path", "line_no", F.explode(F.concat(*parts)).alias("s")).select("path", "line_no", "s.*")


def rank_sensitive(findings: DataFrame, limit: int) -> DataFrame:
    """The most pressing findings: by confidence, urgency, path and line."""
    order = lambda c, *v: F.array_position(F.array(*[F.lit(x) for x in v]), F.col(c))
    return findings.orderBy(
        order("confidence", "high", "medium", "low"), order("urgency", "critical", "high", "medium", "low"), "path", "line_no", "kind", "excerpt"
    ).limit(limit)


# --- fixed values: marks of generated files ---------------------------------------------
GENERATED_PATHS = ("/generated/", "/gen/", ".generated.", "_generated.", ".pb.", ".min.js", "/vendor/")
GENERATED_MARKS = ("@generated", "do not edit", "code generated", "auto-generated", "autogenerated")


def generated_lineage(files: DataFrame) -> DataFrame:
    """``(path, generated, reason, source_hint)`` from path and content markers."""
    head = F.lower(F.substring("text", 1, 2048))
    by_path = T.contains_any(F.concat(F.lit("/"), F.lower("path")), GENERATED_PATHS)
    by_mark = T.contains_any(head, GENERATED_MARKS)
    hint = F.regexp_extract(head, r"(?:generated (?:from|by)|source:)\s+(\S+)", 1)
    return files.select(
        "path",
        (by_path | by_mark).alias("generated"),
        F.when(by_mark, "content_marker").when(by_path, "path_marker").otherwise("none").alias("reason"),
        F.when((by_path | by_mark) & (hint != ""), hint).alias("source_hint"),
    )


def dead_code_candidates(files: DataFrame) -> DataFrame:
    """``(path, exported, confidence)``: exported lines where nothing registers at run time."""
    runtime = ("inventory::submit", "#[ctor]", "linkme", "register(", "plugin", "entry_point", "__all__")
    ls = F.filter(T.lines(F.col("text")), lambda x: F.ltrim(x).rlike(r"^(pub (fn|struct|enum|trait|mod) |export |def [a-z]|class [A-Z])"))
    f = files.where(~T.contains_any(F.col("text"), runtime)).select("path", F.size(ls).cast("long").alias("exported"))
    return f.where("exported > 0").withColumn("confidence", F.when(F.col("exported") <= 2, "medium").otherwise("low"))
