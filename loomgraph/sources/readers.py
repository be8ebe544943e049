"""Sources: repositories of files, tables, logs and manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.common import small

# Languages by extension, names of files, and interpreters.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp",
    "swift": "swift", "scala": "scala", "sh": "shell", "sql": "sql", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "html": "html", "css": "css",
}
FILE_NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile"}
INTERPRETERS = {"node": "javascript", "nodejs": "javascript", "bun": "javascript", "ts-node": "typescript", "tsx": "typescript", "deno": "typescript", "bash": "shell", "sh": "shell", "zsh": "shell", "dash": "shell", "ruby": "ruby"}
LOCKFILES = {"package-lock.json": "npm", "yarn.lock": "npm", "pnpm-lock.yaml": "npm", "Cargo.lock": "cargo", "go.sum": "go", "poetry.lock": "python", "Gemfile.lock": "ruby"}


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped; a line that is none fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def walk(spark: SparkSession, root: str, glob: str = "*", max_bytes: int = 10 << 20) -> DataFrame:
    """Files under a folder: path (below root), size, binary (a NUL in the first 8000 bytes), content (null over max_bytes), in order of path where one sorts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    probe = F.substring("content", 1, 8000)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return raw.select(rel.alias("path"), F.col("length").alias("size"), (F.locate("00", F.regexp_replace(F.hex(probe), "(..)", "$1 ")) > 0).alias("binary"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def language(path: Column, first_line: Column | None = None) -> Column:
    """Language by the file's name, then its extension, then the interpreter of its first line; null if unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))
    out = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FILE_NAMES.items() for x in kv)), name), F.try_element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), ext))
    if first_line is None:
        return out
    # The program, or after env its first argument that is no option.
    tokens = F.split(F.trim(F.regexp_replace(F.when(F.startswith(first_line, F.lit("#!")), first_line), "^#!", "")), r"\s+")
    base = lambda t: F.element_at(F.split(t, "/"), -1)
    program = base(F.when(base(F.get(tokens, F.lit(0))) == "env", F.get(F.filter(F.slice(tokens, 2, 1 << 20), lambda t: ~F.startswith(t, F.lit("-"))), F.lit(0))).otherwise(F.get(tokens, F.lit(0))))
    by_program = F.try_element_at(F.create_map(*(F.lit(x) for kv in INTERPRETERS.items() for x in kv)), program)
    return F.coalesce(out, F.when(F.startswith(program, F.lit("python")), "python").otherwise(by_program))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old_path, status between listings (path, blob): added, deleted, modified; a deleted and an added path of one blob are renamed, each once, in order of path."""
    from pyspark.sql import Window

    j = old.select("path", F.col("blob").alias("b")).join(new.select("path", F.col("blob").alias("c")), "path", "full_outer").where(~F.col("b").eqNullSafe(F.col("c")))
    rank = lambda k: F.row_number().over(Window.partitionBy(k).orderBy("path"))
    gone = j.where("c is null").select(F.col("path").alias("old_path"), F.col("b").alias("blob"), rank("b").alias("n"))
    come = j.where("b is null").select("path", F.col("c").alias("blob"), rank("c").alias("n"))
    moved = gone.join(come, ["blob", "n"], "full_outer")
    status = F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed")
    pairs = moved.select(F.coalesce("path", "old_path").alias("path"), F.when(status == "renamed", F.col("old_path")).alias("old_path"), status.alias("status"))
    return pairs.unionByName(j.where("b is not null and c is not null").select("path", F.lit(None).cast("string").alias("old_path"), F.lit("modified").alias("status")))


def code_owners(lines: DataFrame) -> DataFrame:
    """line_no, pattern, owners from rows line_no, line; comments and blank lines go."""
    text = F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))
    return lines.withColumn("t", text).where("t <> ''").select("line_no", F.element_at(F.split("t", r"\s+"), 1).alias("pattern"), F.slice(F.split("t", r"\s+"), F.lit(2), F.size(F.split("t", r"\s+"))).alias("owners"))


def glob_regex(pattern: Column) -> Column:
    """A path pattern (*, **, ?, a folder at its end, a root at its start) as a regular expression."""
    p = F.regexp_replace(F.regexp_replace(pattern, "/+$", ""), r"([.+^$(){}|\[\]\\])", r"\\$1")
    p = F.regexp_replace(F.regexp_replace(p, r"\*\*/?", "\u0001"), r"\*", "[^/]*")
    p = F.regexp_replace(F.regexp_replace(p, r"\?", "[^/]"), "\u0001", ".*")
    rooted = F.when(F.startswith(pattern, F.lit("/")), F.concat(F.lit("^"), F.substring(p, F.lit(2), F.length(p)))).otherwise(F.concat(F.lit("(?:^|/)"), p))
    return F.concat(rooted, F.lit("(?:$|/)"))


def owners_of(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, owners of the last rule that matches; rules are one file's lines, which are counted and then sent to all."""
    r = small(rules.select("line_no", glob_regex(F.col("pattern")).alias("re"), "owners"))
    hit = paths.select("path").distinct().join(r, F.expr("path rlike re"))
    return hit.groupBy("path").agg(F.max_by("owners", "line_no").alias("owners"))


def strip_comments(text: Column) -> Column:
    """JSON without comments and trailing commas outside of strings."""
    s = F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    return F.regexp_replace(s, r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', "$1")


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    """path, name, version, dev from rows path, text of package manifests."""
    js = F.from_json(strip_comments(F.col("text")), "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    both = manifests.select("path", js.alias("j"))
    part = lambda k, dev: both.select("path", F.explode(f"j.{k}").alias("name", "version"), F.lit(dev).alias("dev"))
    return part("dependencies", False).unionByName(part("devDependencies", True))


def generated_reason(path: Column, head: Column) -> Column:
    """declared, path, marker or minified, the first that holds; null for files that people write."""
    longest = F.array_max(F.transform(F.split(head, "\n"), lambda x: F.length(x)))
    return (
        F.when(path.rlike(r"(?:^|/)(?:generated|__generated__)/|\.(?:pb|g|gen|generated)\.[a-z]+$"), "path")
        .when(F.contains(F.substring(head, 1, 1024), F.lit("@generated")) | F.contains(F.substring(head, 1, 1024), F.lit("DO NOT EDIT")) | F.contains(F.substring(head, 1, 1024), F.lit("<auto-generated")), "marker")
        .when((longest > 5000) | (F.length(head) / F.size(F.split(head, "\n")) > 500), "minified")
    )


def normalize_event(payloads: DataFrame) -> DataFrame:
    """delivery_id, kind (opened, synchronize, closed, comment, other), number, head from JSON webhook payloads."""
    g = lambda p: F.get_json_object("payload", p)
    action = g("$.action")
    kind = F.when(g("$.comment.id").isNotNull(), "comment").when(action.isin("opened", "reopened"), "opened").when(action == "synchronize", "synchronize").when(action == "closed", "closed").otherwise("other")
    return payloads.select("delivery_id", kind.alias("kind"), g("$.pull_request.number").try_cast("bigint").alias("number"), g("$.pull_request.head.sha").alias("head"))
