"""Tables, rule packs, versioned snapshots and git history as sources."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.rules import Rule


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_pack(text: str, language: str | None = None) -> list[Rule]:
    """Rules of a JSON, TOML or (where its library is installed) YAML pack: contracts with id, domain, severity, tags and rules (pattern, message, suggestion)."""
    import tomllib

    try:
        doc = json.loads(text)
    except ValueError:
        try:
            doc = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            import yaml

            doc = yaml.safe_load(text)
    contracts = doc["contracts"] if isinstance(doc, dict) else doc
    out = []
    for c in contracts:
        tags = tuple(t.lower() for t in c.get("tags", ()))
        if language and tags and language not in tags and "all" not in tags:
            continue
        for i, r in enumerate(c["rules"]):
            out.append(Rule(f"{c['id']}.{i}" if len(c["rules"]) > 1 else c["id"], r["pattern"], c.get("severity", "warning"), r.get("message", ""), domain=c.get("domain", "general"), language=c.get("language"), suggestion=r.get("suggestion"), tags=tags))
    return out


def load_pack_dir(folder: str, language: str | None = None) -> list[Rule]:
    """All packs of a folder; a file that cannot be read is an error, not a gap."""
    out = []
    for p in sorted(Path(folder).glob("*")):
        if p.suffix in (".json", ".toml", ".yaml", ".yml"):
            out += load_pack(p.read_text(), language)
    return out


def merged_rules(rules: DataFrame) -> DataFrame:
    """rules (pattern, domain, severity, rule_id, refs) with one row per pattern and domain: the most severe, with all refs."""
    from ..functions.scores import severity_rank

    return rules.groupBy("pattern", "domain").agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.min_by("rule_id", F.struct(severity_rank(F.col("severity")), "rule_id")).alias("rule_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("refs")))).alias("refs"))


def append_log(df: DataFrame, path: str, by: str = "project") -> None:
    """Rows added to a log that is partitioned by a column."""
    df.write.mode("append").partitionBy(by).parquet(path)


def ci_report(found: DataFrame, path: str, path_col: str = "path") -> None:
    """Findings in the form of code-quality reports: a line of JSON each, with a stable fingerprint."""
    rows = found.select(F.col("message").alias("description"), F.col("rule_id").alias("check_name"), F.sha2(F.concat_ws(":", path_col, "rule_id", F.col("line").cast("string")), 256).alias("fingerprint"), F.struct(F.col(path_col).alias("path"), F.struct(F.col("line").alias("begin")).alias("lines")).alias("location"), F.when(F.col("severity").isin("critical", "error"), "major").when(F.col("severity") == "warning", "minor").otherwise("info").alias("severity"))
    rows.write.mode("overwrite").json(path)


def save_version(df: DataFrame, path: str, version: int) -> None:
    """df as a version of a table; versions are folders of their own."""
    df.write.mode("overwrite").parquet(f"{path}/version={int(version)}")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version, or the newest; only its folder is read."""
    rows = spark.read.parquet(path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.filter(F.col("version") == version).drop("version")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, rows) of the versions that a table has, newest first."""
    return spark.read.parquet(path).groupBy("version").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("version").desc())


def write_store(df: DataFrame, path: str, by: str = "project") -> None:
    """Rows as lines of JSON, a folder for each project; projects that are written are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store's rows in a stated schema; a line that is no JSON ends the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_memory(text: str) -> list[dict]:
    """Entries of a memory in TOML (tables named entries), each with all fields; unknown fields are dropped."""
    import tomllib

    fields = {"id": None, "code": "", "language": "", "memory_type": "code", "errors": [], "project": None, "created_at": None, "recall_count": 0, "helpful": None}
    return [{k: e.get(k, v) for k, v in fields.items()} for e in tomllib.loads(text).get("entries", [])]


def load_settings(*texts: str) -> dict[str, str]:
    """Settings of several levels in TOML as one flat map of dotted names to JSON; later texts win."""
    import tomllib

    def flat(doc: dict, at: str = "") -> dict[str, str]:
        out: dict[str, str] = {}
        for k, v in doc.items():
            out |= flat(v, f"{at}{k}.") if isinstance(v, dict) else {f"{at}{k}": json.dumps(v, default=str)}
        return out

    merged: dict[str, str] = {}
    for t in texts:
        merged |= flat(tomllib.loads(t))
    return merged


def load_signatures(text: str) -> list[tuple[str, list[tuple[str, bool]], str | None]]:
    """(function, [(parameter, required)], returns) of a JSON or YAML knowledge base: modules of functions with params and returns."""
    try:
        doc = json.loads(text)
    except ValueError:
        import yaml

        doc = yaml.safe_load(text)
    out = []
    for module, functions in doc.items():
        for name, f in (functions or {}).items():
            out.append((f"{module}.{name}", [(p["name"], bool(p.get("required", True))) for p in f.get("params") or []], f.get("returns")))
    return out


class GitHistory(DataSource):
    """Commits of a local repository with their changed files, newest first: format("git_history").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return "commit string, ts bigint, author string, path string, status string"

    def reader(self, schema):
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("limit", 0))

    def partitions(self):
        import subprocess

        cmd = ["git", "-C", self.path, "log", "--format=%H"] + ([f"-n{self.limit}"] if self.limit else [])
        commits = subprocess.run(cmd, capture_output=True, text=True, check=True).stdout.split()
        step = max(1, len(commits) // 16 + 1)
        return [InputPartition(commits[i : i + step]) for i in range(0, len(commits), step)]

    def read(self, partition):
        import subprocess

        for c in partition.value:
            out = subprocess.run(["git", "-C", self.path, "show", "--name-status", "--format=%ct%x09%an", c], capture_output=True, text=True, check=True).stdout.splitlines()
            ts, author = out[0].split("\t", 1)
            for line in out[1:]:
                if line:
                    status, *paths = line.split("\t")
                    yield c, int(ts), author, paths[-1], status[0]
