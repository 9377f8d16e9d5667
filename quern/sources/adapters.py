"""Views of the driver's tables in the engine's own data model.

``files``: documents as files. ``symbols``: long words as names, each defined by the
document of the least path that holds it. ``refs``: all words as references. Each view comes with the same
view in SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T

#: Characters of a word that is a name, at least.
SYMBOL_CHARS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang"))
    return docs.select(
        path.alias("path"),
        F.col("lang").alias("language"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.substring("text", 1, T.SAMPLE_CHARS).alias("sample"),
        "text",
    )


FILES = """files AS (
  SELECT source || '/' || doc_id || '.' || lang AS path, lang AS language,
         CAST(strlen(text) AS BIGINT) AS size_bytes, substr(text, 1, 4096) AS sample, text
  FROM documents)"""


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, symbol, pos)``: every word of every document, a reference each."""
    f = files(spark, sf_dir)
    return f.select("path", F.posexplode(T.token_list(F.col("text"))).alias("pos", "symbol"))


REFS = """refs AS (
  SELECT path, unnest(w) AS symbol, CAST(unnest(range(len(w))) AS INTEGER) AS pos
  FROM (SELECT path, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2) AS w FROM files))"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, name)``: long words with the document that defines each, the first one that holds it."""
    r = refs(spark, sf_dir).where(F.length("symbol") >= SYMBOL_CHARS)
    return r.groupBy(F.col("symbol").alias("name")).agg(F.min("path").alias("path")).select("path", "name")


SYMBOLS = f"""symbols AS (
  SELECT min(path) AS path, symbol AS name FROM refs WHERE length(symbol) >= {SYMBOL_CHARS} GROUP BY symbol)"""


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, dep)``: orders as files, parts as the modules they depend on."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_partkey").cast("string").alias("dep")).distinct()


DEPS = """deps AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_partkey AS VARCHAR) AS dep FROM lineitem)"""


#: Folders and file types of the tree that documents play in :func:`app_files`.
APP_FOLDERS = ("app/services/", "app/api/", "app/crud/", "app/models/", "app/tests/", "app/plain/", "ui/", "app/query/", "app/validators/")
APP_TYPES = {"en": ("py", "python"), "de": ("rs", "rust"), "fr": ("ts", "typescript"), "es": ("js", "javascript")}
#: Characters of a word that is a dependency there.
DEP_CHARS = 12


def app_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a source tree: folders that play roles, types by language, ``doc_id`` kept.

    Nine documents in a row are one part, a file in each folder, among them its test.
    """
    docs = table(spark, sf_dir, "documents")
    folder = F.element_at(F.array(*[F.lit(x) for x in APP_FOLDERS]), (F.col("doc_id") % len(APP_FOLDERS) + 1).cast("int"))
    kind, language = F.lit("txt"), F.lit("text")
    for lang, (ext, name) in APP_TYPES.items():
        kind = F.when(F.col("lang") == lang, ext).otherwise(kind)
        language = F.when(F.col("lang") == lang, name).otherwise(language)
    number = F.floor(F.col("doc_id") / len(APP_FOLDERS))
    test = F.col("doc_id") % len(APP_FOLDERS) == APP_FOLDERS.index("app/tests/")
    deeper = F.when(test & (number % 5 == 0), "integration/").otherwise("")
    path = F.concat(folder, deeper, F.lit("part"), number.cast("string"), F.when(test, "_test").otherwise(""), F.lit("."), kind)
    return docs.select("doc_id", path.alias("path"), language.alias("language"), F.substring("text", 1, T.SAMPLE_CHARS).alias("sample"), "text")


def app_refs(files_df: DataFrame) -> DataFrame:
    """``(path, symbol, pos)``: long words; those of Rust files qualified, so that only their tails match."""
    words = files_df.select("path", "language", F.posexplode(T.token_list(F.col("text"))).alias("pos", "word")).where(F.length("word") >= SYMBOL_CHARS)
    return words.select("path", F.when(F.col("language") == "rust", F.concat(F.lit("m::"), "word")).otherwise(F.col("word")).alias("symbol"), "pos")


def app_symbols(refs_df: DataFrame) -> DataFrame:
    """``(path, name)``: names with the first file that holds each; those of even length are defined by the last one too."""
    r = refs_df.select("path", T.symbol_tail(F.col("symbol")).alias("name")).groupBy("name").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    ends = F.when(F.length("name") % 2 == 0, F.array("a", "b")).otherwise(F.array("a"))
    return r.select(F.explode(F.array_distinct(ends)).alias("path"), "name")


def app_deps(refs_df: DataFrame) -> DataFrame:
    """``(path, dep)``: the longest words are modules that a file depends on."""
    return refs_df.where(F.length("symbol") >= DEP_CHARS).select("path", F.col("symbol").alias("dep")).distinct()


def _case(column: str, values: dict[str, str], otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{otherwise}' END"


APP = f"""files AS MATERIALIZED (
  SELECT doc_id, {list(APP_FOLDERS)!r}[doc_id % {len(APP_FOLDERS)} + 1]
      || CASE WHEN doc_id % {len(APP_FOLDERS)} = {APP_FOLDERS.index("app/tests/")} THEN CASE WHEN doc_id // {len(APP_FOLDERS)} % 5 = 0 THEN 'integration/' ELSE '' END || 'part' || doc_id // {len(APP_FOLDERS)} || '_test' ELSE 'part' || doc_id // {len(APP_FOLDERS)} END || '.' || {_case("lang", {k: v[0] for k, v in APP_TYPES.items()}, "txt")} AS path,
    {_case("lang", {k: v[1] for k, v in APP_TYPES.items()}, "text")} AS language, substr(text, 1, 4096) AS sample, text FROM documents),
words AS MATERIALIZED (SELECT path, language, unnest(w) AS word, CAST(unnest(range(len(w))) AS INTEGER) AS pos
  FROM (SELECT path, language, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 2) AS w FROM files)),
refs AS MATERIALIZED (SELECT path, CASE WHEN language = 'rust' THEN 'm::' ELSE '' END || word AS symbol, word AS tail, pos FROM words WHERE length(word) >= {SYMBOL_CHARS}),
symbols AS MATERIALIZED (SELECT DISTINCT path, name FROM (SELECT tail AS name, min(path) AS path FROM refs GROUP BY tail
  UNION ALL SELECT tail, max(path) FROM refs WHERE length(tail) % 2 = 0 GROUP BY tail)),
deps AS MATERIALIZED (SELECT DISTINCT path, symbol AS dep FROM refs WHERE length(symbol) >= {DEP_CHARS})"""


#: What a line of a document becomes as code, by its length; %a to %c are the first words of the line.
CODE = {
    "python": (
        "import %a.%b", "def %a(%b, %c):", "    return %b(%c)", '    rows = f"select {%a} from %b"', "    %a = %b", "class %a:",
        "    if %a and %b:", "    for %a in %b:", "    # %a %b %c", "    %a.%b(%c)", "    %b = %a + %c", "",
    ),
    "rust": (
        "use %a::%b;", "pub fn %a(%b: %c) {", "    %b(%c)", '    let rows = format!("select {} from %b", %a);', "    let %a = %b;", "pub struct %a {",
        "    if %a && %b {", "    for %a in %b {", "    // %a %b %c", "    %a.%b(%c);", "    let %b = %a + %c;", "}",
    ),
    "script": (
        "import { %a } from '%b';", "export function %a(%b, %c) {", "  return %b(%c);", "  const rows = `select ${ %a } from %b`;", "  const %a = %b;", "export class %a {",
        "  if (%a && %b) {", "  for (const %a of %b) {", "  // %a %b %c", "  %a.%b(%c);", "  const %b = %a + %c;", "}",
    ),
}
#: (template, remainder of the twelfth of the length by ten) of lines that are smells.
CODE_SMELLS = {
    "python": {(4, 3): "    %a = yaml.load(%b)", (9, 4): "    subprocess.run(%a, shell=True)", (10, 5): "    return open(path_%a).read()"},
    "rust": {(4, 3): "    let %a = yaml.load(%b);", (9, 4): "    Command::new(%a);", (10, 5): "    let %b = fs::read(path_%a);"},
    "script": {(4, 3): "  const %a = yaml.load(%b);", (9, 4): "  execSync(%a);", (10, 5): "  readFile(path_%a);"},
}


def _parts(template: str) -> list[str]:
    """Literal and variable parts of a template, the variables as ``%a``."""
    import re

    return [x for x in re.split(r"(%[abc])", template) if x]


def _kinds(language):
    """(condition on the language, its templates) of the three kinds of code, the last for all other."""
    return (("rust", language == "rust"), ("script", language.isin("typescript", "javascript")), ("python", None))


def app_code(files_df: DataFrame) -> DataFrame:
    """:func:`app_files` with code for text: every line by its length, made of its first words, so copies stay copies."""

    # One array a step: what a lambda makes is made again wherever it is used, so words are cut once and used from a struct.
    def words(x):
        return F.struct(F.length(x).alias("n"), F.filter(F.split(F.lower(x), "[^a-z]+"), lambda w: F.length(w) >= 2).alias("w"))

    def named(x):
        return F.struct(x["n"].alias("n"), *[F.coalesce(F.get(x["w"], F.lit(i)), F.lit("x")).alias(v) for i, v in enumerate("abc")])

    def line(x):
        text = lambda t: F.concat(F.lit(""), *[x[p[1]] if p in ("%a", "%b", "%c") else F.lit(p) for p in _parts(t)])
        number, smell = x["n"] % 12, F.floor(x["n"] / 12) % 10

        def of(kind):
            out = F.when(number == 0, text(CODE[kind][0]))
            for n, t in enumerate(CODE[kind][1:], 1):
                own = text(t)
                for (m, r), other in CODE_SMELLS[kind].items():
                    own = F.when(smell == r, text(other)).otherwise(own) if m == n else own
                out = out.when(number == n, own)
            return out

        out = of("python")
        for kind, condition in _kinds(F.col("language")):
            out = out if condition is None else F.when(condition, of(kind)).otherwise(out)
        return out

    made = F.transform(F.transform(F.transform(T.lines(F.col("text")), words), named), line)
    return files_df.withColumn("text", F.array_join(made, "\n"))


def _sql_template(t: str) -> str:
    return " || ".join(["''"] + [p[1] if p[0] == "%" and len(p) == 2 and p[1] in "abc" else "'" + p.replace("'", "''") + "'" for p in _parts(t)])


def _sql_code(kind: str) -> str:
    smells = " ".join(f"WHEN n = {n} AND r = {r} THEN {_sql_template(t)}" for (n, r), t in CODE_SMELLS[kind].items())
    plain = " ".join(f"WHEN n = {n} THEN {_sql_template(t)}" for n, t in enumerate(CODE[kind]))
    return f"CASE {smells} {plain} END"


#: ``code(path, doc_id, language, i, n, t)``: the lines of :func:`app_code`.
APP_CODE = f"""code AS MATERIALIZED (SELECT path, doc_id, language, i, n, CASE WHEN language = 'rust' THEN {_sql_code("rust")} WHEN language IN ('typescript', 'javascript') THEN {_sql_code("script")} ELSE {_sql_code("python")} END AS t
  FROM (SELECT path, doc_id, language, i, length(line) % 12 AS n, length(line) // 12 % 10 AS r, coalesce(w[1], 'x') AS a, coalesce(w[2], 'x') AS b, coalesce(w[3], 'x') AS c
  FROM (SELECT path, doc_id, language, i, line, list_filter(regexp_split_to_array(lower(line), '[^a-z]+'), lambda x: length(x) >= 2) AS w
  FROM (SELECT path, doc_id, language, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i
  FROM (SELECT path, doc_id, language, CASE WHEN length(text) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace(text, '\\n\\z', ''), '\\r?\\n') END AS ls FROM files)))))"""


def with_views(*views: str) -> str:
    """``WITH`` clause of the named views, each with those it needs, in order."""
    return "WITH " + ",\n".join(views)
