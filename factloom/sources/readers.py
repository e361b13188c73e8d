"""Sources (survey S1 to S8). Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.preflight import EVIDENCE, INVOCATION

#: Bytes above which a source file is reported and not read.
MAX_SOURCE_BYTES = 512 * 1024
# Fixed values of the ELF header that S7 checks.
ELF_MAGIC, ELF_CLASS_64, ELF_LITTLE_ENDIAN, ELF_VERSION, ELF_HEADER_BYTES, ELF_MACHINES = "7F454C46", 2, 1, 1, 64, (247, 263)


def read_sources(spark: SparkSession, path: str, pattern: str = "*.rs") -> DataFrame:
    """(file, text, bytes, modified) of the files below ``path`` whose names match."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    meta = F.col("_metadata")
    return files.select(meta["file_path"].alias("file"), F.col("value").alias("text"), meta["file_size"].alias("bytes"), meta["file_modification_time"].alias("modified"))


def split_oversized(files: DataFrame, max_bytes: int = MAX_SOURCE_BYTES, size: str = "bytes") -> tuple[DataFrame, DataFrame]:
    """(files to read, files skipped); on ``read_sources`` the filter keeps the others' texts unread."""
    return files.filter(F.col(size) <= max_bytes), files.filter(F.col(size) > max_bytes)


_DISCRIMINATOR = "^[0-9A-Fa-f]{16}$"


def read_invocations(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """S3: (id, index, invocation) and rejects (id, reason) of JSON documents (id, text).

    A document holds ``invocations`` or one invocation's keys at its top; discriminators are 16 hex digits.
    """
    parsed = documents.withColumn("_p", F.from_json(text, f"invocations array<{INVOCATION}>, {EVIDENCE.replace(':', ' ', 1).replace(',accounts:', ', accounts ').replace(',reallocs:', ', reallocs ')}"))
    top = F.struct("_p.instruction", "_p.accounts", "_p.reallocs")
    single = F.col("_p.instruction").isNotNull() | (F.coalesce(F.size("_p.accounts"), F.lit(0)) > 0) | (F.coalesce(F.size("_p.reallocs"), F.lit(0)) > 0)
    listed = F.coalesce(F.size("_p.invocations"), F.lit(0)) > 0
    rows = parsed.withColumn("_all", F.when(listed, F.col("_p.invocations")).when(single, F.array(top)))
    bad_hex = lambda x: x.isNotNull() & ~x.rlike(_DISCRIMINATOR)
    bad = F.exists("_all", lambda i: F.exists(F.coalesce(i["accounts"], F.expr("array()")), lambda a: bad_hex(a["expectedDiscriminator"]) | bad_hex(a["actualDiscriminator"])))
    reason = F.when(F.try_parse_json(text).isNull(), "malformed").when(F.col("_all").isNull(), "no evidence").when(bad, "discriminator")
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason is null").select("id", F.posexplode("_all").alias("index", "invocation"))
    return good, rows.filter("reason is not null").select("id", "reason")


def load_catalog(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A catalog (constraints, errors, topics), one JSON array a file or JSON lines; Spark broadcasts it if it is small."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def manifest_facts(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, dependency) and (file, feature) of manifests (file, deps map, features array)."""
    deps = manifests.select("file", F.explode(F.map_keys("deps")).alias("dependency"))
    return deps, manifests.select("file", F.explode("features").alias("feature"))


def idl_facts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(file, name, address, format) of interface JSON; format is the first class whose mark is there, null if it is no JSON."""
    get = lambda p: F.get_json_object(text, p)
    v = F.try_parse_json(text)
    kind = F.when(v.isNull(), None).when(get("$.standard") == "codama", "codama").when(get("$.kind") == "rootNode", "codama").when(get("$.metadata.origin") == "shank", "shank").otherwise("generic")
    return documents.select(
        "file",
        F.coalesce(get("$.name"), get("$.metadata.name"), get("$.program.name")).alias("name"),
        F.coalesce(get("$.address"), get("$.metadata.address"), get("$.program.publicKey")).alias("address"),
        kind.alias("format"),
    )


def _number(content: Column, at: int, size: int) -> Column:
    """A little-endian unsigned number of ``size`` bytes at a place."""
    raw = F.hex(F.substring(content, at + 1, size))
    turned = F.concat(*[F.substring(raw, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(turned, 16, 10).cast("decimal(20,0)").cast("long")


def elf_facts(files: DataFrame, content: str = "content") -> DataFrame:
    """(file, state, reason, entry, sections) of binary files (path, content): the first failed check is the reason."""
    c = F.col(content)
    reason = (
        F.when(F.octet_length(c) < ELF_HEADER_BYTES, "too short")
        .when(F.hex(F.substring(c, 1, 4)) != ELF_MAGIC, "magic")
        .when(_number(c, 4, 1) != ELF_CLASS_64, "class")
        .when(_number(c, 5, 1) != ELF_LITTLE_ENDIAN, "endian")
        .when(_number(c, 6, 1) != ELF_VERSION, "version")
        .when(~_number(c, 18, 2).isin(*ELF_MACHINES), "machine")
    )
    known = files.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return known.select(
        F.col("path").alias("file"),
        F.when(ok, "present").otherwise("invalid").alias("state"),
        "reason",
        F.when(ok, _number(c, 24, 8)).alias("entry"),
        F.when(ok, _number(c, 60, 2)).alias("sections"),
    )


def corpus_manifest(rows: DataFrame) -> DataFrame:
    """Pinned rows (name, repo, sha, license) with their failures as an array."""
    checks = {"name": "^[A-Za-z0-9_.-]+$", "repo": "^https://", "sha": "^[0-9a-f]{40}$", "license": "\\S"}
    failed = [F.when(~F.coalesce(F.col(c).rlike(p), F.lit(False)), F.lit(c)) for c, p in checks.items()]
    return rows.withColumn("failures", F.array_compact(F.array(*failed)))
