"""Sinks (survey S9 to S12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions.scalars import sarif_level
from factloom.streaming.tables import VersionedTable, run_batches


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, ordered by place within files and by ranges of files across them."""
    findings.orderBy("file", "start_line", "start_char").write.json(path)


_OPTIONAL = ("applicability", "docs_url")


def sarif_rows(findings: DataFrame, fallback: str = "finding") -> tuple[DataFrame, DataFrame]:
    """(rule_index, rule_id, level, message, name, help_uri, properties) of each rule by its first finding, and (file, rule_id, level, json) of each result.

    Rules are numbered from 0 in the order of their first findings; their number is that of a catalog. Positions count from 1.
    """
    have = {c: F.col(c) if c in findings.columns else F.lit(None).cast("string") for c in _OPTIONAL}
    rows = findings.withColumns({"rule_id": F.coalesce("code", "topic", F.lit(fallback)), "level": sarif_level(F.col("severity")), **have})
    about = F.when(F.col("topic").isNotNull(), F.struct("topic", "confidence", "applicability"))
    first = F.struct("file", "start_line", "start_char", "message", "level", F.coalesce("topic", "rule_id").alias("name"), F.col("docs_url").alias("help_uri"), about.alias("properties"))
    rules = rows.groupBy("rule_id").agg(F.min(first).alias("_first"))
    rules = rules.withColumn("rule_index", F.row_number().over(W.orderBy("_first", "rule_id")) - 1)
    rules = rules.select("rule_index", "rule_id", *[f"_first.{c}" for c in ("level", "message", "name", "help_uri", "properties")])
    region = F.struct(*[(F.col(a) + 1).alias(b) for a, b in (("start_line", "startLine"), ("start_char", "startColumn"), ("end_line", "endLine"), ("end_char", "endColumn"))])
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.col("rule_index").alias("ruleIndex"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations"),
        about.alias("properties"),
    )
    indexed = rows.join(rules.select("rule_id", "rule_index"), "rule_id")
    return rules, indexed.select("file", "rule_id", "level", F.to_json(result).alias("json"))


def sarif_header(rules: DataFrame, tool: str = "factloom", version: str = "1", uri: str | None = None) -> DataFrame:
    """(json): the one run header: schema, version, the tool and its rules in order. Results follow beside it."""
    rule = F.struct(
        "rule_index",
        F.struct(
            F.col("rule_id").alias("id"),
            "name",
            F.struct(F.col("message").alias("text")).alias("shortDescription"),
            F.col("help_uri").alias("helpUri"),
            "properties",
        ).alias("rule"),
    )
    listed = rules.agg(F.transform(F.sort_array(F.collect_list(rule)), lambda r: r["rule"]).alias("rules"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.lit(uri).cast("string").alias("informationUri"), "rules")
    run = F.array(F.struct(F.struct(driver.alias("driver")).alias("tool")))
    return listed.select(F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), run.alias("runs"))).alias("json"))


def write_sarif(findings: DataFrame, path: str, tool: str = "factloom") -> None:
    """Results as JSON lines in ``path/results`` and one run header with the rules in ``path/run``."""
    rules, results = sarif_rows(findings)
    results.orderBy("file").select("json").write.text(f"{path}/results")
    sarif_header(rules, tool).select(F.col("json").alias("value")).write.text(f"{path}/run")


def to_report(files: DataFrame, key: str, columns: list[str], totals: dict[str, Column] | None = None) -> DataFrame:
    """(key, report): one JSON document a file with its rows in order and its totals. A key should be a file, whose rows are bounded."""
    rows = F.sort_array(F.collect_list(F.struct(*columns))).alias("rows")
    sums = F.struct(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in (totals or {}).items()]).alias("totals")
    return files.groupBy(key).agg(rows, sums).select(key, F.to_json(F.struct("rows", "totals")).alias("report"))


def stream_findings(findings: DataFrame, path: str, key: str = "file", present: str = "code") -> None:
    """Each micro-batch replaces the findings of the documents in it, in the table in ``path``; read them with ``read_stream_findings``.

    A document without findings comes as a row whose ``present`` column is null and clears what it had. Runs over all data at
    hand; a later start on the same folder goes on where this one ended.
    """
    table = VersionedTable(findings.sparkSession, f"{path}/table", [key])
    run_batches(findings, path, lambda batch, query, number: table.replace(batch, F.col(present).isNull(), query, number))


def read_stream_findings(spark: SparkSession, path: str, schema: StructType, key: str = "file") -> DataFrame:
    """The findings of each document's last batch."""
    return VersionedTable(spark, f"{path}/table", [key]).read(schema)
