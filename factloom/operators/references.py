"""References and declarations (survey J1 to J10, J12c, J20, J24 to J26, O1 to O7).

Rules stay silent without evidence: absence is reported only inside a scope that the caller's gate allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.scalars import pascal_case, strip_underscores
from factloom.sources.staging import staged


def missing_refs(refs: DataFrame, decls: DataFrame, scope: list[str], name: str = "name", alternatives: DataFrame | None = None) -> DataFrame:
    """References (scope, name) that no declaration (scope, name) has, by the name or its last dotted part.

    alternatives: further declarations that count for references with ``is_program``.
    """
    last = F.element_at(F.split(F.col(name), "\\."), -1)
    out = refs.join(decls.select(*scope, name).distinct(), [*scope, name], "left_anti")
    out = out.withColumn("_last", last).join(decls.select(*scope, F.col(name).alias("_last")).distinct(), [*scope, "_last"], "left_anti").drop("_last")
    if alternatives is None:
        return out
    known = out.join(alternatives.select(*scope, name).distinct(), [*scope, name], "left_semi").filter("is_program")
    return out.join(known.select(*scope, name).distinct(), [*scope, name], "left_anti")


def unknown_usages(usages: DataFrame, functions: DataFrame, fields: DataFrame) -> DataFrame:
    """(context, account) used in a context's functions but no field of it, nor of a container that one of its fields is.

    usages (fn, account), functions (fn, context), fields (container, name, type_name); functions without context are silent.
    """
    used = usages.join(functions.filter("context is not null").select("fn", "context").distinct(), "fn").select("context", "account").distinct()
    own = fields.select(F.col("container").alias("context"), F.col("name").alias("account"), "type_name").distinct()
    inner = fields.select(F.col("container").alias("type_name"), F.col("name").alias("account")).distinct()
    nested = own.select("context", "type_name").distinct().join(inner, "type_name").select("context", "account")
    return used.join(own.select("context", "account").unionByName(nested).distinct(), ["context", "account"], "left_anti")


def gated_absence(subjects: DataFrame, present: DataFrame, gate: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``keys`` of subjects that ``present`` lacks, only where ``gate`` has the key."""
    return subjects.select(*keys).distinct().join(gate.select(*keys).distinct(), keys, "left_semi").join(present.select(*keys).distinct(), keys, "left_anti")


def missing_init(fields: DataFrame, handlers: DataFrame, usages: DataFrame, gates: list[DataFrame], kinds: list[str]) -> DataFrame:
    """(container, name) of fields (container, name, type_name, is_init) of ``kinds`` that are not initialised although an init-like handler (container, handler) is there.

    Containers that one of ``gates`` (container) lacks, such as those with a payer or a system program, are silent. Where the
    handler changes some field of the container (handler, account, mutable), only such fields count.
    """
    own = handlers.select("container", "handler").distinct()
    for gate in gates:
        own = own.join(gate.select("container").distinct(), "container", "left_semi")
    changed = usages.filter("mutable").select("handler", F.col("account").alias("name")).distinct()
    changed = own.join(changed, "handler").select("container", "name").distinct().join(fields.select("container", "name").distinct(), ["container", "name"], "left_semi")
    bare = fields.filter(F.col("type_name").isin(*kinds) & ~F.coalesce("is_init", F.lit(False))).join(own, "container", "left_semi").select("container", "name").distinct()
    restricted = bare.join(changed, ["container", "name"], "left_semi")
    return restricted.unionByName(bare.join(changed.select("container").distinct(), "container", "left_anti"))


def missing_args(uses: DataFrame, args: DataFrame, handlers: DataFrame) -> DataFrame:
    """(context, name) used as an instruction argument but not declared, where the context has a handler; leading ``_`` is ignored."""
    u = uses.withColumn("_n", strip_underscores(F.col("name")))
    a = args.select("context", strip_underscores(F.col("name")).alias("_n")).distinct()
    return u.join(handlers.select("context").distinct(), "context", "left_semi").join(a, ["context", "_n"], "left_anti").drop("_n")


def missing_mut(usages: DataFrame, fields: DataFrame, types: list[str], mutability: list[str]) -> DataFrame:
    """(container, name) mutated but declared without one of the ``mutability`` keys; fields (container, name, type_name, keys)."""
    used = usages.filter("mutable").select("container", F.col("account").alias("name")).distinct()
    typed = fields.filter(F.col("type_name").isin(*types) & ~F.exists("keys", lambda k: k.isin(*mutability)))
    return typed.join(used, ["container", "name"], "left_semi").select("container", "name")


def resolve_paths(paths: DataFrame, fields: DataFrame, depth: int) -> DataFrame:
    """(id, missing_at, missing) of paths (id, container, path array) whose hop ``missing_at`` names no field; null if they resolve.

    One join a hop with fields (container, name, type_name): the field's type is the next container.
    """
    rows = paths.withColumns({"_c": F.col("container"), "missing_at": F.lit(None).cast("int")})
    f = fields.select(F.col("container").alias("_fc"), F.col("name").alias("_fn"), F.col("type_name").alias("_ft")).distinct()
    for i in range(depth):
        hop = F.try_element_at("path", F.lit(i + 1))
        rows = rows.join(f, (F.col("_c") == F.col("_fc")) & (hop == F.col("_fn")), "left")
        open_ = F.col("missing_at").isNull() & hop.isNotNull()
        rows = rows.withColumns({"missing_at": F.when(open_ & F.col("_fn").isNull(), i).otherwise(F.col("missing_at")), "_c": F.when(open_, F.col("_ft")).otherwise(F.col("_c"))}).drop("_fc", "_fn", "_ft")
    return rows.select("id", "missing_at", F.try_element_at("path", F.col("missing_at") + 1).alias("missing"))


def resolve_tiers(subjects: DataFrame, tiers: list[tuple[str, DataFrame]], key: str, otherwise: str) -> DataFrame:
    """Subjects with ``tier``, the first (name, keys) that has the key."""
    out, tier = subjects, None
    for i, (name, keys) in enumerate(tiers):
        out = out.join(keys.select(key).distinct().withColumn(f"_t{i}", F.lit(True)), key, "left")
        tier = (F if tier is None else tier).when(F.col(f"_t{i}"), name)
    return out.withColumn("tier", tier.otherwise(otherwise)).drop(*[f"_t{i}" for i in range(len(tiers))])


def classify_framework(files: DataFrame, dependencies: DataFrame, by_dependency: list[tuple[str, list[str]]], by_hint: list[tuple[str, list[str]]], otherwise: str = "unknown") -> DataFrame:
    """files (file, root, text) with ``framework``: the first id one of whose dependencies the root's manifest
    (root, dependency) names; in roots without such a dependency the first id one of whose hints the text holds.
    """
    rank = None
    for i, (_, names) in enumerate(by_dependency):
        rank = (F if rank is None else rank).when(F.col("dependency").isin(*names), i)
    ranked = dependencies.select("root", rank.alias("_r")).filter("_r is not null").groupBy("root").agg(F.min("_r").alias("_r"))
    named = None
    for i, (name, _) in enumerate(by_dependency):
        named = (F if named is None else named).when(F.col("_r") == i, name)
    for name, hints in by_hint:
        held = F.lit(False)
        for h in hints:
            held = held | F.coalesce(F.col("text").contains(h), F.lit(False))
        named = named.when(held, name)
    return files.join(ranked, "root", "left").withColumn("framework", named.otherwise(otherwise)).drop("_r")


def resolve_context(uses: DataFrame, local: DataFrame, workspace: DataFrame, structs: DataFrame, visible: Column) -> DataFrame:
    """Uses (name, ...) with ``state``: found, exists (no derive), silent (visibility unknown) or missing."""
    out = resolve_tiers(uses, [("found", local), ("found", workspace), ("exists", structs)], "name", "missing")
    return out.withColumn("state", F.when((F.col("tier") == "missing") & ~visible, "silent").otherwise(F.col("tier"))).drop("tier")


def infer_context(functions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(file, name, context) of functions without a context: the one of the Pascal-case name, else the file's only one."""
    only = contexts.groupBy("file").agg(F.count(F.lit(1)).alias("_n"), F.first("name").alias("_only"))
    f = functions.withColumn("_p", pascal_case(F.col("name"))).join(contexts.select("file", F.col("name").alias("_p"), F.lit(True).alias("_hit")), ["file", "_p"], "left").join(only, "file", "left")
    return f.select("file", "name", F.when(F.col("_hit"), F.col("_p")).when(F.col("_n") == 1, F.col("_only")).alias("context"))


def positional_mismatch(attributes: DataFrame, arguments: DataFrame) -> DataFrame:
    """Attributes (context, ordinal, name, type_name) against arguments of the same columns: the first of extra, order, type."""
    a = arguments.select("context", "ordinal", strip_underscores(F.col("name")).alias("_n"), F.col("type_name").alias("_t"))
    names = arguments.groupBy("context").agg(F.collect_set(strip_underscores(F.col("name"))).alias("_all"))
    own = strip_underscores(F.col("name"))
    kind = F.when(~F.coalesce(F.array_contains("_all", own), F.lit(False)), "extra").when(F.col("_n").isNull() | (F.col("_n") != own), "order").when(F.col("_t") != F.col("type_name"), "type")
    out = attributes.join(a, ["context", "ordinal"], "left").join(names, "context", "left").withColumn("kind", kind)
    return out.filter("kind is not null").select("context", "ordinal", "name", "kind")


def has_one_missing(constraints: DataFrame, structs: DataFrame, fields: DataFrame) -> DataFrame:
    """(container, field, target, data_type) whose target is no field of the data struct; unknown structs are silent."""
    known = constraints.join(structs.select(F.col("name").alias("data_type")).distinct(), "data_type", "left_semi")
    return known.join(fields.select(F.col("container").alias("data_type"), F.col("name").alias("target")).distinct(), ["data_type", "target"], "left_anti")


def expression_issues(tokens: DataFrame, visible: DataFrame, members: DataFrame) -> DataFrame:
    """Tokens (id, scope, name, owner_type, call) with ``issue``: identifier, member, field_as_method, method; tokens without issue are left out.

    visible (scope, name); members (owner_type, name, is_method).
    """
    v = visible.select("scope", "name").distinct().withColumn("_seen", F.lit(True))
    m = members.select("owner_type", "name", "is_method").distinct()
    rows = tokens.join(v, ["scope", "name"], "left").join(m, ["owner_type", "name"], "left")
    issue = F.when(F.col("owner_type").isNull(), F.when(F.col("_seen").isNull(), "identifier")).otherwise(
        F.when(F.col("is_method").isNull(), F.when(F.col("call"), "method").otherwise("member")).when(F.col("call") & ~F.col("is_method"), "field_as_method")
    )
    return rows.withColumn("issue", issue).filter("issue is not null").drop("_seen", "is_method")


def unresolved(uses: DataFrame, visible: DataFrame) -> DataFrame:
    """Uses (scope, name) that the scope does not see."""
    return uses.join(visible.select("scope", "name").distinct(), ["scope", "name"], "left_anti")


def lookup(symbols: DataFrame, references: DataFrame, name: str, container: str | None = None) -> DataFrame:
    """(role, file, name, kind) of a name's definitions and, only if there is one, its references; open files first."""
    own = symbols.filter(F.col("name") == name)
    if container is not None:
        own = own.filter(F.col("container") == container)
    refs = references.filter(F.col("name") == name).join(own.select("name").distinct(), "name", "left_semi")
    cols = ["file", "name", "kind", "is_open"]
    return own.select(F.lit("definition").alias("role"), *cols).unionByName(refs.select(F.lit("reference").alias("role"), *cols))


def references_of(symbols: DataFrame, references: DataFrame, names: DataFrame, kinds: list[str], container: bool = False) -> DataFrame:
    """The references of ``names`` (name, and with ``container`` also container) of some kinds, only of names that have a definition of these kinds.

    So type references, function references and references inside one container are one lookup each for many names at once.
    """
    keys = ["name", "container"] if container else ["name"]
    known = names.select(*keys).distinct().join(symbols.filter(F.col("kind").isin(*kinds)).select("name").distinct(), "name", "left_semi")
    return references.filter(F.col("kind").isin(*kinds)).join(known, keys, "left_semi")


def implementations(functions: DataFrame, contexts: DataFrame) -> DataFrame:
    """The program instructions (context, name, file, is_open) that implement ``contexts`` (context); helpers are none."""
    return functions.filter("is_program_instruction").join(contexts.select("context").distinct(), "context", "left_semi").select("context", "name", "file", "is_open")


def argument_refs(sources: list[DataFrame], context: str, name: str) -> DataFrame:
    """Distinct places (file, start_line, start_char) of an argument in several tables (context, name, file, ...), ``_`` aliases included."""
    out = None
    for s in sources:
        s = s.filter((F.col("context") == context) & (strip_underscores(F.col("name")) == name.lstrip("_"))).select("file", "start_line", "start_char")
        out = s if out is None else out.unionByName(s)
    return out.dropDuplicates()


#: Edit distances that are tried by segments before names are compared by length.
RADII = (1, 2)


def _segments(n: Column, d: int) -> list[tuple[Column, Column]]:
    """Where the d + 1 segments of a word of ``n`` characters begin (from 0) and how long they are; the last ones are the longer."""
    short, longer = F.floor(n / (d + 1)).cast("int"), (n % (d + 1)).cast("int")
    first = F.lit(d + 1) - longer  # segments of the shorter length
    return [(F.lit(i) * short + F.greatest(F.lit(i) - first, F.lit(0)), short + F.when(F.lit(i) >= first, 1).otherwise(0)) for i in range(d + 1)]


def within_distance(asked: DataFrame, candidates: DataFrame, scope: list[str], d: int) -> DataFrame:
    """(scope, name, candidate, distance) of all pairs of a scope within edit distance ``d``, of names longer than 2 d + 1.

    A candidate is cut into d + 1 segments, of which ``d`` edits leave one as it is; in a name it begins at most ``d`` places
    off. So pairs meet on scope, length, segment and place, however many names a scope has.
    """
    n = F.length("candidate")
    cut = lambda of, at, size: F.substr(F.col(of), (at + 1).cast("int"), size.cast("int"))
    own = [F.struct(n.alias("_n"), F.lit(i).alias("_i"), cut("candidate", at, size).alias("_s")) for i, (at, size) in enumerate(_segments(n, d))]
    index = candidates.select(*scope, "candidate").distinct().filter(n > d).select("*", F.inline(F.array(*own)))
    names = asked.select(*scope, "name").distinct().filter(F.length("name") > 2 * d + 1)
    parts = []
    for off in range(-d, d + 1):
        m = F.length("name") + off
        for i, (at, size) in enumerate(_segments(m, d)):
            parts += [F.when((at + by >= 0) & (at + by + size <= F.length("name")), F.struct(m.alias("_n"), F.lit(i).alias("_i"), cut("name", at + by, size).alias("_s"))) for by in range(-d, d + 1)]
    probes = names.select("*", F.inline(F.array_distinct(F.array_compact(F.array(*parts)))))
    pairs = probes.join(index, [*scope, "_n", "_i", "_s"]).select(*scope, "name", "candidate").distinct()
    return pairs.withColumn("distance", F.levenshtein("name", "candidate", d)).filter("distance >= 0")


def closest(missing: DataFrame, candidates: DataFrame, scope: list[str], k: int = 8, role: Column | None = None, kind: str | None = None) -> DataFrame:
    """O1: the ``k`` nearest candidates (scope, candidate) of each missing name (scope, name): by role rank, edit distance, name, kind.

    ``role`` is a rank by columns of a missing name and the column ``kind`` of a candidate. The nearest are looked for in each
    scope and kind, and the role ranks what is found, so roles make no further pairs. Names with ``k`` candidates within a
    small distance find them by segments; the others meet candidates of near lengths only: those of the same length first,
    whose k-th best distance bounds by how much the lengths of the others may differ.
    """
    # both are read many times below, often from long plans; their tables also have their true size
    missing, candidates = staged(missing, "missing"), staged(candidates, "candidates")
    if role is not None:
        wide = missing.join(candidates.select(*scope, kind).distinct(), scope)
        found = _nearest(wide.select(*scope, kind, "name").distinct(), candidates, [*scope, kind], k)
        rows = wide.join(found.drop("rank"), [*scope, kind, "name"])
        order = W.partitionBy(*missing.columns).orderBy(role, "distance", "candidate", kind)
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = _nearest(missing.select(*scope, "name").distinct(), candidates, scope, k)
    return missing.join(found, [*scope, "name"])


def _nearest(asked: DataFrame, candidates: DataFrame, scope: list[str], k: int) -> DataFrame:
    """(scope, name, candidate, distance, rank) of the ``k`` nearest candidates of distinct names."""
    asked, candidates = staged(asked, "asked"), staged(candidates.select(*scope, "candidate"), "candidates")
    rank = F.row_number().over(W.partitionBy(*scope, "name").orderBy("distance", "candidate"))
    done = None
    for d in RADII:
        near = within_distance(asked, candidates, scope, d).join(candidates, [*scope, "candidate"])
        ranked = staged(near.withColumn("rank", rank).filter(F.col("rank") <= k).select(*scope, "name", "candidate", "distance", "rank"), "ranked")
        whole = ranked.filter(F.col("rank") == k).select(*scope, "name")
        ranked = ranked.join(whole, [*scope, "name"], "left_semi")
        done = ranked if done is None else done.unionByName(ranked)
        asked = staged(asked.join(whole, [*scope, "name"], "left_anti"), "asked")
    return done.unionByName(_nearest_by_length(asked, candidates, scope, k))


def _nearest_by_length(asked: DataFrame, candidates: DataFrame, scope: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*scope, "name").orderBy("distance", "candidate"))
    sized = candidates.withColumn("_n", F.length("candidate"))
    asked = asked.withColumn("_n", F.length("name"))
    same = asked.join(sized, [*scope, "_n"]).withColumn("distance", F.levenshtein("name", "candidate"))
    first = same.withColumn("_r", rank).filter(F.col("_r") == k).select(*scope, "name", F.col("distance").alias("_most"))
    lengths = sized.groupBy(*scope).agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    bounded = asked.drop("_n").join(first, [*scope, "name"], "left").join(lengths, scope)
    n = F.length("name")
    low = F.greatest(F.col("_lo"), F.coalesce(n - F.col("_most"), F.col("_lo")))
    high = F.least(F.col("_hi"), F.coalesce(n + F.col("_most"), F.col("_hi")))
    wide = bounded.filter(low <= high).withColumn("_n", F.explode(F.sequence(low, high))).drop("_most", "_lo", "_hi")
    pairs = wide.join(sized, [*scope, "_n"]).drop("_n").withColumn("distance", F.levenshtein("name", "candidate"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select(*scope, "name", "candidate", "distance", "rank")


def symbol_search(symbols: DataFrame, query: str, name: str = "name") -> DataFrame:
    """O2: symbols whose name holds the query, case ignored; an empty query gives all."""
    return symbols.filter(F.lower(name).contains(query.lower())) if query else symbols


def prefix_search(keys: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """O3: keys that start with a prefix (the filter reaches a Parquet scan), shorter first."""
    return keys.filter(F.col(key).startswith(prefix)).orderBy(F.length(key), key)


def _prefixes(key: str, proper: bool) -> Column:
    n = F.length(key) - (1 if proper else 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(F.col(key), F.lit(1), i))
    return F.when(n >= 1, cut)


def longest_prefix(keys: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """(key, prefix): the longest stored key that a key starts with. Prefixes are exploded, so the join is on equality."""
    parts = keys.select(key).distinct().withColumn("prefix", F.explode(_prefixes(key, False)))
    hits = parts.join(stored.select(F.col(key).alias("prefix")).distinct(), "prefix", "left_semi")
    return hits.groupBy(key).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def module_path(file: Column) -> Column:
    """The module path of a source file below ``src``: ``crate``, folders and the file's stem, joined by ``::``; null for others."""
    inner = F.regexp_extract(file, "(?:^|/)src/(.+)\\.rs$", 1)
    stem = F.regexp_replace(inner, "(^|/)(mod|lib|main)$", "")
    return F.when(inner != "", F.concat_ws("::", F.lit("crate"), F.when(stem != "", F.replace(stem, F.lit("/"), F.lit("::")))))


def path_exists(paths: DataFrame, files: DataFrame, declarations: DataFrame) -> DataFrame:
    """The paths (root, path) such as ``crate::state::Escrow`` that are known: all segments but the last are the
    module of a file (root, file) and this file declares (root, file, name) the last. Others are unconfirmed, not absent.
    """
    parts = F.split("path", "::")
    asked = paths.select("root", "path", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "::").alias("_m"), F.element_at(parts, -1).alias("name"))
    modules = files.select("root", "file", module_path(F.col("file")).alias("_m")).filter("_m is not null").distinct()
    found = asked.filter(F.size(parts) >= 2).join(modules, ["root", "_m"]).join(declarations.select("root", "file", "name").distinct(), ["root", "file", "name"], "left_semi")
    return found.select("root", "path").distinct()


def prefix_collisions(keys: DataFrame, scope: list[str], key: str = "key") -> DataFrame:
    """(scope, prefix, key) pairs where a key is a proper prefix of a longer one of the same scope; empty and equal keys are none."""
    distinct = keys.select(*scope, key).filter(F.length(key) > 0).distinct()
    parts = distinct.withColumn("prefix", F.explode(_prefixes(key, True)))
    return parts.join(distinct.select(*scope, F.col(key).alias("prefix")), [*scope, "prefix"], "left_semi").select(*scope, "prefix", key)


def sorted_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows in key order."""
    return df.dropDuplicates(keys).orderBy(*keys)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last by ``order`` (open documents before versions)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*[c.desc() for c in order]))).filter("_n = 1").drop("_n")


def last_n(df: DataFrame, order: list[Column], n: int = 200) -> DataFrame:
    """The last ``n`` rows; a bounded top-n, so no full sort."""
    return df.orderBy(*[c.desc() for c in order]).limit(n)
