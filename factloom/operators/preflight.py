"""Invocation preflight (survey A1, A2): evidence of calls to the errors they would raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the checks.
DISCRIMINATOR_BYTES = 8
ZERO_DISCRIMINATOR = "0000000000000000"
MAX_DATA_INCREASE = 10240

#: The input contract; every leaf may be null, and null is no evidence.
INSTRUCTION = (
    "dataLen:bigint,deserializes:boolean,discriminatorMatchesKnownInstruction:boolean,fallbackSupported:boolean,"
    "expectedProgramId:string,providedProgramId:string,expectedAccountCount:bigint,providedAccountCount:bigint"
)
ACCOUNT = (
    "dataLen:bigint,expectedDiscriminator:string,actualDiscriminator:string,expectedOwner:string,actualOwner:string,"
    "initialized:boolean,deserializes:boolean,expectedZeroDiscriminatorForInit:boolean"
)
EVIDENCE = f"instruction:struct<{INSTRUCTION}>,accounts:array<struct<{ACCOUNT}>>,reallocs:array<struct<requestedDataIncrease:bigint>>"
INVOCATION = f"struct<{EVIDENCE}>"


def _named(condition: Column, name: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(name))


def detected_errors(invocation: str = "invocation") -> Column:
    """A1: the distinct error names of one invocation, in the order of the checks."""
    i = F.col(f"{invocation}.instruction")
    short = F.coalesce(i["dataLen"] < DISCRIMINATOR_BYTES, F.lit(False))
    instruction = F.when(short, F.array(F.lit("InstructionMissing"))).otherwise(
        F.array(
            _named((~i["discriminatorMatchesKnownInstruction"]) & (~i["fallbackSupported"]), "InstructionFallbackNotFound"),
            _named(~i["deserializes"], "InstructionDidNotDeserialize"),
            _named(i["expectedProgramId"] != i["providedProgramId"], "InvalidProgramId"),
            _named(i["providedAccountCount"] < i["expectedAccountCount"], "AccountNotEnoughKeys"),
        )
    )

    def account(a: Column) -> Column:
        lost = F.coalesce(a["dataLen"] < DISCRIMINATOR_BYTES, F.lit(False)) | a["actualDiscriminator"].isNull()
        return F.array(
            _named(a["expectedZeroDiscriminatorForInit"] & (a["actualDiscriminator"] != ZERO_DISCRIMINATOR), "AccountDiscriminatorAlreadySet"),
            _named(~a["initialized"], "AccountNotInitialized"),
            _named(a["expectedOwner"] != a["actualOwner"], "AccountOwnedByWrongProgram"),
            _named(a["expectedDiscriminator"].isNotNull() & lost, "AccountDiscriminatorNotFound"),
            _named(a["expectedDiscriminator"] != a["actualDiscriminator"], "AccountDiscriminatorMismatch"),
            _named(~a["deserializes"], "AccountDidNotDeserialize"),
        )

    none = F.expr("cast(array() as array<string>)")
    accounts = F.flatten(F.transform(F.coalesce(F.col(f"{invocation}.accounts"), F.expr(f"cast(array() as array<struct<{ACCOUNT}>>)")), account))
    grown = F.coalesce(F.exists(F.col(f"{invocation}.reallocs"), lambda r: r["requestedDataIncrease"] > MAX_DATA_INCREASE), F.lit(False))
    reallocs = F.when(grown, F.array(F.lit("AccountReallocExceedsLimit"))).otherwise(none)
    return F.array_distinct(F.array_compact(F.concat(instruction, accounts, reallocs)))


def preflight(invocations: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(id, index, name) of every detected error; with ``catalog`` (name, ...) only the errors it has."""
    out = invocations.select("id", "index", F.explode(detected_errors()).alias("name"))
    return out if catalog is None else out.join(catalog, "name")


def preflight_report(detected: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A2: (keys, name, invocations, n_invocations) of each error; the indexes are distinct and sorted.

    keys: columns of one report, such as its document. A report lists all its invocations, so it should be bounded.
    """
    group = [*(keys or []), "name"]
    distinct = detected.select(*group, "index").distinct()
    return distinct.groupBy(*group).agg(F.sort_array(F.collect_list("index")).alias("invocations"), F.count(F.lit(1)).alias("n_invocations"))
