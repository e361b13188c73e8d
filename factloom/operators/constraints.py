"""Constraint rules over declared keys (survey F8 to F23).

constraints: (file, container, field, keys array<struct<key,value,has_value>>), fields as in the survey's contract.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SEEDS, MAX_SEED_BYTES = 16, 32


def has_key(keys: Column, name: str) -> Column:
    """F8: whether a key is there, as a flag or with a value."""
    return F.coalesce(F.exists(keys, lambda k: k["key"] == name), F.lit(False))


def has_flag(keys: Column, name: str) -> Column:
    """F8: whether a key is there without a value."""
    return F.coalesce(F.exists(keys, lambda k: (k["key"] == name) & ~k["has_value"]), F.lit(False))


def value_of(keys: Column, name: str) -> Column:
    return F.try_element_at(F.filter(keys, lambda k: k["key"] == name), F.lit(1))["value"]


def is_init_like(c: Column) -> Column:
    """starts with Init, Create, init or create, or is New."""
    return c.rlike("^(Init|Create|init|create)") | (c == "New")


def classify_seeds(pda: DataFrame, accounts: DataFrame, args: DataFrame) -> DataFrame:
    """(container, field, seed, kind) of seeds: static, account, argument or expression, tested in this order.

    accounts (container, name), args (container, name).
    """
    seeds = pda.select("container", "field", F.posexplode("seeds").alias("ordinal", "seed")).withColumn("seed", F.trim("seed"))
    seeds = seeds.withColumn("_id", F.regexp_extract("seed", "^[A-Za-z_][A-Za-z0-9_]*", 0))
    seeds = seeds.withColumn("_rest", F.ltrim(F.substr("seed", F.length("_id") + 1)))
    a = accounts.select("container", F.col("name").alias("_id")).distinct().withColumn("_a", F.lit(True))
    g = args.select("container", F.col("name").alias("_id")).distinct().withColumn("_g", F.lit(True))
    rows = seeds.join(a, ["container", "_id"], "left").join(g, ["container", "_id"], "left")
    path = F.col("_rest").rlike("^(\\.[A-Za-z_][A-Za-z0-9_]*)*(\\.key\\(\\)\\.as_ref(\\(\\))?|\\.as_ref\\(\\))$")
    argument = F.col("_rest").rlike("^(\\.as_ref\\(\\)|\\.as_bytes\\(\\)|\\.to_le_bytes\\(\\)\\.as_ref\\(\\))")
    kind = F.when(F.col("seed").rlike("^b[\"']"), "static").when(F.col("_a") & path, "account").when(F.col("_g") & argument, "argument").otherwise("expression")
    return rows.select("container", "field", "ordinal", "seed", kind.alias("kind"))


def pda_usage(pda: DataFrame) -> DataFrame:
    """seed count (an expression counts one), static-only and bump flags."""
    listed = F.col("seed_kind") == "list"
    static = listed & (F.size("seeds") > 0) & F.forall("seeds", lambda s: s.rlike("^b[\"']"))
    return pda.withColumns({"n_seeds": F.when(listed, F.size("seeds")).otherwise(1), "static_only": F.coalesce(static, F.lit(False)), "uses_bump": F.col("bump_kind") != "missing"})


def static_seed_hints(pda: DataFrame, fields: DataFrame, scoping: list[str]) -> DataFrame:
    """static-only addresses with the first sibling field of a scoping type, if any."""
    sibling = fields.filter(F.col("type_name").isin(*scoping)).groupBy("container").agg(F.min_by("name", "ordinal").alias("scope_field"))
    return pda_usage(pda).filter("static_only").join(sibling, "container", "left")


def seed_limits(pda: DataFrame, max_seeds: int = MAX_SEEDS, max_bytes: int = MAX_SEED_BYTES) -> DataFrame:
    """(container, field, issue, at) of too many seeds and of too long static ones."""
    many = pda.filter(F.size("seeds") > max_seeds).select("container", "field", F.lit("too_many").alias("issue"), F.lit(None).cast("int").alias("at"))
    each = pda.select("container", "field", F.posexplode("seeds").alias("at", "seed"))
    body = F.regexp_extract("seed", "(?s)^b\"(.*)\"$", 1)
    long = each.filter((F.octet_length(body) > max_bytes) & ~body.contains("\\")).select("container", "field", F.lit("too_long").alias("issue"), "at")
    return many.unionByName(long)


def missing_companions(subjects: DataFrame, catalog: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """(id, key, companion) where a key of the catalog (key, companions) is there and a companion is not; subjects (id, keys array<string>)."""
    wide = subjects.select("id", "keys", F.explode("keys").alias("key")).join(catalog, "key")
    out = wide.select("id", "key", "keys", F.explode("companions").alias("companion")).filter(~F.array_contains("keys", F.col("companion")))
    if exclusions is not None:
        out = out.join(exclusions, ["key", "companion"], "left_anti")
    return out.select("id", "key", "companion").distinct()


#: Keys that create the account.
INIT_KEYS = ("init", "init_if_needed")


def has_any(keys: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(keys, lambda k: k["key"].isin(*names)), F.lit(False))


def key_conflicts(constraints: DataFrame, conflicts: list[tuple[str, str]]) -> DataFrame:
    """(container, field, left, right) of keys that exclude each other, and of a payer that is the created field itself."""
    keys = F.col("keys")
    cases = [F.when(has_key(keys, a) & has_key(keys, b), F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"))) for a, b in conflicts]
    created = F.when(has_key(keys, "init"), "init").otherwise("init_if_needed")
    own = F.when(has_any(keys, INIT_KEYS) & (value_of(keys, "payer") == F.col("field")), F.struct(created.alias("left"), F.lit("payer").alias("right")))
    return constraints.select("container", "field", F.explode(F.array_compact(F.array(*cases, own))).alias("_")).select("container", "field", "_.*")


def invalid_keywords(values: DataFrame, allowed: list[str], value: str = "value") -> DataFrame:
    """distinct values outside the allowed list with the closest allowed one, ties by name."""
    rest = values.select(value).distinct().filter(~F.col(value).isin(*allowed))
    nearest = F.array_min(F.array(*[F.struct(F.levenshtein(F.col(value), F.lit(a)).alias("d"), F.lit(a).alias("a")) for a in allowed]))
    return rest.withColumn("closest", nearest["a"])


def family_applicability(constraints: DataFrame, families: DataFrame) -> DataFrame:
    """F16: (container, field, expected) of key families (key, expected types array) that do not fit the declared type; one row for each expected kind."""
    wide = constraints.select("container", "field", "type_name", F.explode(F.transform("keys", lambda k: k["key"])).alias("key"))
    bad = wide.join(families, "key").filter(~F.array_contains("types", F.col("type_name")))
    return bad.select("container", "field", "expected").dropDuplicates()


def lifecycle_requirements(constraints: DataFrame, fields: DataFrame, types: list[str]) -> DataFrame:
    """issues (container, field, issue): wrong type for init, realloc or close; no ``mut`` with realloc or close; payer not mutable."""
    keys = F.col("keys")
    life = has_any(keys, INIT_KEYS) | has_key(keys, "realloc") | has_key(keys, "close")
    moved = has_key(keys, "realloc") | has_key(keys, "close")
    typed = constraints.join(fields.select("container", F.col("name").alias("field"), "type_name"), ["container", "field"])
    issues = typed.select("container", "field", F.explode(F.array_compact(F.array(
        F.when(life & ~F.col("type_name").isin(*types), "type"), F.when(moved & ~has_flag(keys, "mut"), "mut")))).alias("issue"))
    payers = constraints.select("container", "field", value_of(keys, "payer").alias("_payer")).filter("_payer is not null")
    mutable = constraints.filter(has_flag(keys, "mut") | has_any(keys, INIT_KEYS)).select("container", F.col("field").alias("_payer")).distinct()
    declared = fields.select("container", F.col("name").alias("_payer")).distinct()
    fixed = payers.join(declared, ["container", "_payer"], "left_semi").join(mutable, ["container", "_payer"], "left_anti")
    return issues.unionByName(fixed.select("container", "field", F.lit("payer").alias("issue")))


def required_sibling(subjects: DataFrame, siblings: DataFrame, required: DataFrame) -> DataFrame:
    """(container, field, name, issue) of required siblings (key, name, type_name) that are missing or of another type."""
    want = subjects.select("container", "field", F.explode("keys").alias("key")).join(required, "key").withColumnRenamed("type_name", "_want")
    have = siblings.select("container", "name", F.col("type_name").alias("_have"))
    issue = F.when(F.col("_have").isNull(), "missing").when(F.col("_have") != F.col("_want"), "type")
    return want.join(have, ["container", "name"], "left").withColumn("issue", issue).filter("issue is not null").select("container", "field", "name", "issue")


def token_checks(references: DataFrame, fields: DataFrame, expected: DataFrame) -> DataFrame:
    """references (container, field, role, target) whose target has another type than its role expects (role, types array); arguments and unknown targets are silent."""
    known = references.join(fields.select("container", F.col("name").alias("target"), "type_name"), ["container", "target"]).join(expected, "role")
    return known.filter(~F.array_contains("types", F.col("type_name"))).select("container", "field", "role", "target", "type_name")


def token_targets(constraints: DataFrame, targets: DataFrame) -> DataFrame:
    """(container, field, issue) of fields (container, field, type_name, keys) with a key of a family whose target type they lack.

    targets (prefix, types array, issue): keys of a family start with its prefix; of several families the first by issue counts.
    The families are a handful and each has very many keys, so they are broadcast and no task gets a whole family.
    """
    wide = constraints.select("container", "field", "type_name", F.explode(F.transform("keys", lambda k: k["key"])).alias("key"))
    wide = wide.withColumn("prefix", F.concat(F.substring_index("key", "::", 1), F.lit("::")))
    bad = wide.filter(F.col("key").contains("::")).join(F.broadcast(targets), "prefix").filter(~F.array_contains("types", F.col("type_name")))
    return bad.groupBy("container", "field").agg(F.min("issue").alias("issue"))


def program_overrides(constraints: DataFrame, fields: DataFrame, key: str, programs: list[str]) -> DataFrame:
    """(container, field, program, type_name) where the field that ``key`` names is no token program; unknown names are silent."""
    named = constraints.select("container", "field", value_of(F.col("keys"), key).alias("program")).filter("program is not null")
    typed = named.join(fields.select("container", F.col("name").alias("program"), "type_name").distinct(), ["container", "program"])
    return typed.filter(~F.col("type_name").isin(*programs)).select("container", "field", "program", "type_name").distinct()


def argument_types(constraints: DataFrame, arguments: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """(container, field, argument, type_name) where the value of ``key`` names an instruction argument (container, name, type_name) of another type.

    Values that are no plain name, and names of no argument, are silent.
    """
    named = constraints.select("container", "field", value_of(F.col("keys"), key).alias("argument")).filter(F.col("argument").rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    typed = named.join(arguments.select("container", F.col("name").alias("argument"), "type_name").distinct(), ["container", "argument"])
    return typed.filter(~F.col("type_name").isin(*expected)).select("container", "field", "argument", "type_name").distinct()


def extension_programs(constraints: DataFrame, programs: DataFrame, prefix: str, program_keys: list[str], wrapper: str, data: list[str]) -> DataFrame:
    """(container, field, program, issue) of fields with a key of the family ``prefix``, by the token program that the first of ``program_keys`` names.

    constraints (container, field, type_name, data_type, keys); programs (container, name, extended): token programs and
    whether they take extensions. A program that does not is ``program``; else token data in the plain ``wrapper`` is
    ``wrapper``. Fields whose program is unknown are silent.
    """
    rows = constraints.filter(F.exists("keys", lambda k: k["key"].startswith(prefix)))
    named = rows.withColumn("program", F.coalesce(*[value_of(F.col("keys"), k) for k in program_keys]))
    typed = named.join(programs.select("container", F.col("name").alias("program"), "extended").distinct(), ["container", "program"])
    plain = F.coalesce((F.col("type_name") == wrapper) & F.col("data_type").isin(*data), F.lit(False))
    issue = F.when(~F.col("extended"), "program").when(plain, "wrapper")
    return typed.withColumn("issue", issue).filter("issue is not null").select("container", "field", "program", "issue").distinct()


def hook_programs(constraints: DataFrame, fields: DataFrame, key: str, programs: list[str], unchecked: list[str], guards: list[str]) -> DataFrame:
    """(container, field, target, type_name) where ``key`` names a field (container, name, type_name, keys) that is no program.

    An unchecked field with one of the ``guards`` counts as one; names of no field are silent.
    """
    named = constraints.select("container", "field", value_of(F.col("keys"), key).alias("target")).filter("target is not null")
    guarded = F.col("type_name").isin(*unchecked) & F.exists("keys", lambda k: k["key"].isin(*guards))
    typed = named.join(fields.select("container", F.col("name").alias("target"), "type_name", (F.col("type_name").isin(*programs) | guarded).alias("_ok")), ["container", "target"])
    return typed.filter(~F.coalesce("_ok", F.lit(False))).select("container", "field", "target", "type_name").distinct()


def exclusive_groups(constraints: DataFrame, groups: list[tuple[str, ...]]) -> DataFrame:
    """(container, field, families) of fields whose keys come from more than one of exclusive families (key prefixes)."""
    keys = F.transform("keys", lambda k: F.concat(F.substring_index(k["key"], "::", 1), F.lit("::")))
    held = [F.array_sort(F.array_intersect(F.array_distinct(keys), F.array(*map(F.lit, g)))) for g in groups]
    rows = constraints.select("container", "field", F.explode(F.array(*[F.array_join(h, ",") for h in held])).alias("families"))
    return rows.filter(F.col("families").contains(",")).distinct()


def unchecked_named(fields: DataFrame, names: DataFrame, types: list[str], guards: list[str]) -> DataFrame:
    """fields of unchecked types whose name is in ``names`` and that have none of the guard keys (array<string>)."""
    rows = fields.filter(F.col("type_name").isin(*types) & ~F.exists("keys", lambda k: k.isin(*guards)))
    return rows.join(names.select(F.col("name")).distinct(), "name", "left_semi")


def event_rule(body_events: DataFrame, event: str, detail: Column | None = None, except_scopes: DataFrame | None = None) -> DataFrame:
    """events of a kind, outside excepted functions (file, fn)."""
    out = body_events.filter(F.col("event") == event)
    if detail is not None:
        out = out.filter(detail)
    return out if except_scopes is None else out.join(except_scopes.select("file", "fn").distinct(), ["file", "fn"], "left_anti")


def missing_features(uses: DataFrame, packages: DataFrame, workspaces: DataFrame) -> DataFrame:
    """(package, feature) used but not declared by the package or, where it inherits, its workspace."""
    own = packages.join(workspaces.select("workspace", F.col("features").alias("_w")), "workspace", "left")
    declared = own.select("package", F.explode(F.coalesce("features", "_w")).alias("feature"))
    return uses.select("package", "feature").distinct().join(declared, ["package", "feature"], "left_anti")


def shape_checks(fields: DataFrame, functions: DataFrame, known: DataFrame, wrappers: list[str], sysvars: list[str]) -> DataFrame:
    """(scope, name, issue): a wrapper without a generic, a generic of no known type, a wrong sysvar, more than one fallback."""
    first = F.try_element_at("generics", F.lit(1))
    wrapped = fields.filter(F.col("type_name").isin(*wrappers)).withColumn("_g", first)
    bare = wrapped.filter("_g is null").select(F.col("container").alias("scope"), "name", F.lit("generic").alias("issue"))
    unknown = wrapped.filter(F.col("_g").isNotNull() & (F.col("type_name") != "Sysvar")).join(known.select(F.col("name").alias("_g")).distinct(), "_g", "left_anti")
    unknown = unknown.select(F.col("container").alias("scope"), "name", F.lit("unresolved").alias("issue"))
    sysvar = fields.filter((F.col("type_name") == "Sysvar") & ~first.isin(*sysvars)).select(F.col("container").alias("scope"), "name", F.lit("sysvar").alias("issue"))
    twice = functions.filter("is_fallback").groupBy(F.col("file").alias("scope")).agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return bare.unionByName(unknown).unionByName(sysvar).unionByName(twice.select("scope", "name", F.lit("fallback").alias("issue")))


def bad_returns(functions: DataFrame, result: str = "Result") -> DataFrame:
    """(file, name, issue) of handlers (file, name, takes_context, return_type, return_args) that do not return ``Result`` of a type.

    ``generic``: a Result without a type argument; ``return``: another type or none. Functions without a context are no handlers.
    """
    named = F.coalesce(F.col("return_type") == result, F.lit(False))
    bare = F.coalesce(F.size("return_args") < 1, F.lit(True))
    issue = F.when(~named, "return").when(bare, "generic")
    return functions.filter("takes_context").withColumn("issue", issue).filter("issue is not null").select("file", "name", "issue")
