"""Fires / stays-quiet fixtures of the evidence operators, and oracles on the smallest tables."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import artifacts, constraints, drift, findings, graph, guards, preflight, references, reports, telemetry
from factloom.operators.rules import Registry
from factloom.sources import readers, sinks
from factloom.streaming import updates


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def one(spark, value, *functions, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return [df.select(f(F.col("c"))).first()[0] for f in functions]


# preflight
def invocation_document():
    first = {"instruction": {"dataLen": 7, "deserializes": False}}
    flags = {"dataLen": 8, "deserializes": False, "discriminatorMatchesKnownInstruction": False, "fallbackSupported": False}
    a = {
        "dataLen": 8, "expectedDiscriminator": "00000000000000aa", "actualDiscriminator": "00000000000000bb", "expectedOwner": "x", "actualOwner": "y",
        "initialized": False, "deserializes": False, "expectedZeroDiscriminatorForInit": True,
    }
    second = {
        "instruction": flags | {"expectedProgramId": "p", "providedProgramId": "q", "expectedAccountCount": 3, "providedAccountCount": 2},
        "accounts": [a, {"dataLen": 4, "expectedDiscriminator": "00000000000000aa"}],
        "reallocs": [{"requestedDataIncrease": 10241}],
    }
    return {"invocations": [first, second]}


def test_preflight_names_twelve_errors(spark):
    docs = spark.createDataFrame([("d", json.dumps(invocation_document()))], "id string, text string")
    good, bad = readers.read_invocations(docs)
    report = {r["name"]: r["invocations"] for r in preflight.preflight_report(preflight.preflight(good)).collect()}
    assert bad.count() == 0 and len(report) == 12
    assert report.pop("InstructionMissing") == [0] and all(v == [1] for v in report.values())


def test_invocations_single_form_and_rejects(spark):
    account = {"accounts": [{"expectedDiscriminator": "xyz"}]}
    docs = [("top", {"instruction": {"dataLen": 3}}), ("none", {}), ("hex", account)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs] + [("broken", "{")], "id string, text string")
    good, bad = readers.read_invocations(df)
    assert [r["id"] for r in good.collect()] == ["top"]
    assert {r["id"]: r["reason"] for r in bad.collect()}.keys() == {"none", "hex", "broken"}


# graph
def reach(spark, calls, source, **more):
    edges = spark.createDataFrame([(a, b) for a, c in calls.items() for b in c], "src string, dst string")
    found = graph.search(edges, spark.createDataFrame([(source, source)], "source string, name string"), **more)
    return {r["name"] for r in graph.pairs(found).collect()}, graph.truncated(found, edges).count() > 0


def test_reachability(spark):
    assert reach(spark, {"a": "b", "b": "c"}, "a") == ({"b", "c"}, False)
    assert reach(spark, {"a": "bc", "b": "d", "c": "d"}, "a") == ({"b", "c", "d"}, False)
    assert reach(spark, {"a": "b", "b": "a"}, "a") == ({"a", "b"}, False)
    assert reach(spark, {"a": "b"}, "zz") == (set(), False)
    chain = {f"f{i}": [f"f{i + 1}"] for i in range(9)}
    assert reach(spark, chain, "f0") == ({f"f{i}" for i in range(1, 9)}, True)
    defs = spark.createDataFrame([("helper", 2), ("solo", 1)], "name string, n long")
    calls = {"a": ["helper", "solo"], "helper": ["solo"]}
    assert reach(spark, calls, "a")[0] == {"helper", "solo"} and reach(spark, calls, "a", defs=defs)[0] == {"solo"}


def test_context_reachability_is_silent_without_instructions(spark):
    fns = spark.createDataFrame([("i", "C", True), ("h", "C", False), ("k", "D", False)], "name string, context string, is_program_instruction boolean")
    edges = spark.createDataFrame([("i", "h"), ("h", "k")], "src string, dst string")
    got = graph.context_reachable(fns, edges)
    assert rows(got) == [("C", "h"), ("C", "i"), ("C", "k")]
    uses = spark.createDataFrame([("h", "acc", "signer_use"), ("k", "other", "signer_use"), ("i", "own", "signer_use")], "fn string, account string, kind string")
    assert rows(graph.reachable_usages(got, uses, fns, "signer_use")) == [("C", "acc"), ("C", "own")]
    assert rows(graph.reachable_usages(got, uses, fns, "signer_use", include_start=False)) == [("C", "acc")]


# findings
FINDING = "file string, start_line int, start_char int, end_line int, end_char int, rule_seq int, emit_seq int, code string, severity string, topic string, rule string, confidence string, config_key string, message string"


def finding(line=0, seq=0, code="c", topic="t", confidence="low", rule="r", severity="warning", key=None, message="m", file="f"):
    return (file, line, 0, line, 5, seq, 0, code, severity, topic, rule, confidence, key, message)


def test_arbitration_keeps_the_most_certain(spark):
    data = [finding(seq=0, code="a", confidence="heuristic"), finding(seq=1, code="b", confidence="authoritative"), finding(seq=2, code="n", topic=None), finding(seq=3, code="m", topic=None)]
    data += [finding(1, 0, "x", confidence="medium"), finding(1, 1, "y", confidence="derived")]
    got = {r["code"]: (r["demoted"], r["related"]) for r in findings.arbitrate(spark.createDataFrame(data, FINDING)).collect()}
    assert got == {"b": (1, ["a: m"]), "n": (0, []), "m": (0, []), "x": (1, ["y: m"])}
    again = findings.arbitrate(findings.arbitrate(spark.createDataFrame(data, FINDING)).drop("related", "demoted"))
    assert {r["code"] for r in again.collect()} == set(got)


def test_dedupe_and_settings(spark):
    data = [finding(seq=1), finding(seq=0, rule="first"), finding(1, code=None), finding(2, code="build-artifact"), finding(3, key="k1"), finding(4, key="k2")]
    df = spark.createDataFrame(data, FINDING)
    assert [r["rule"] for r in findings.dedupe(df).filter("start_line = 0").collect()] == ["first"]
    levels = spark.createDataFrame([("k1", "disabled"), ("k2", "hint")], "config_key string, level string")
    got = {r["start_line"]: r["severity"] for r in findings.apply_settings(df, F.col("code").endswith("-artifact"), levels).collect()}
    assert got == {0: "warning", 1: "warning", 4: "hint"}


def test_directives_and_suppression(spark):
    text = ["// head", "// ignore-file-x", "code", "// allow: style.case r2", "next", "far", "// ignore-file-x"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)] + [("g", 0, "code"), ("g", 1, "// ignore-file-x")], "file string, line int, text string")
    comment = F.ltrim("text").startswith("//")
    d = findings.extract_directives(lines, "allow:", "allow-file:", "ignore-x", "ignore-file-x", comment, comment)
    assert rows(d) == [("f", 3, "r2"), ("f", 3, "style.case"), ("f", 4, "r2"), ("f", 4, "style.case"), ("f", None, "*")]
    only = d.filter("line is not null")
    data = [finding(3, topic="pkg.style.case"), finding(4, topic=None, rule="pack/r2"), finding(5, topic="style.case"), finding(4, 1, topic="style", rule="zz", code="q")]
    left = findings.suppress(spark.createDataFrame(data, FINDING), only)
    assert sorted(r["start_line"] for r in left.collect()) == [4, 5]
    exact = spark.createDataFrame([("f", None, "c.r")], "file string, line int, pattern string")
    assert findings.suppress(spark.createDataFrame([finding(), finding(1, code="d")], FINDING), exact).count() == 1


def test_regions_take_the_shortest(spark):
    data = spark.createDataFrame([finding(1, topic=None), finding(5), finding(9)], FINDING)
    at = lambda line: line << 20
    regions = spark.createDataFrame([("f", at(0), at(8), "outer"), ("f", at(1), at(2), "inner")], "file string, start long, end long, region string")
    got = findings.filter_by_region(data, regions, ["inner", "other"], "low", "auto", "filled")
    assert sorted((r["start_line"], r["topic"]) for r in got.collect()) == [(1, "filled"), (9, "t")]


def test_registry_orders_and_prunes(spark):
    reg = Registry()
    reg.rule("late", "security", ("x",), "t2", "low")(lambda facts: facts["f"].withColumn("code", F.lit("late")))
    reg.rule("early", "syntax", ("x", "y"), "t1", "high")(lambda facts: facts["f"].withColumn("code", F.lit("early")))
    facts = {"f": spark.createDataFrame([("f",)], "file string")}
    assert [(r["rule_seq"], r["code"], r["topic"]) for r in reg.findings(facts, "x").orderBy("rule_seq").collect()] == [(0, "early", "t1"), (1, "late", "t2")]
    assert [r.id for r in reg.applicable("x", "syntax")] == ["early"] and reg.findings(facts, "z") is None


def test_sarif_counts_from_one(spark):
    rules, results = sinks.sarif_rows(spark.createDataFrame([finding(0, code=None), finding(2, code="c", severity="hint")], FINDING))
    assert rows(rules.select("rule_id", "level")) == [("c", "note"), ("t", "warning")]
    region = json.loads(results.filter("rule_id = 'c'").first()["json"])["locations"][0]["physicalLocation"]["region"]
    assert region == {"startLine": 3, "startColumn": 1, "endLine": 3, "endColumn": 6}


def test_sinks_write(spark, tmp_path):
    df = spark.createDataFrame([finding()], FINDING)
    sinks.write_findings(df, f"{tmp_path}/f")
    sinks.write_sarif(df, f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/f").count() == 1 and spark.read.text(f"{tmp_path}/s/run").count() == 1
    assert json.loads(sinks.to_report(df, "file", ["start_line", "code"]).first()["report"]) == {"rows": [{"start_line": 0, "code": "c"}], "totals": {"rows": 1}}


# scalars
def test_scalars(spark):
    assert one(spark, "12.3 ms", scalars.duration_nanos) == [12_300_000] and one(spark, "5 µs", scalars.duration_nanos) == [5000]
    assert one(spark, "5 min", scalars.duration_nanos) == [None]
    assert one(spark, "make_HTTP__call", scalars.pascal_case) == ["MakeHTTPCall"]
    assert one(spark, "__a_b", scalars.strip_underscores) == ["a_b"]
    assert one(spark, 'b"a\\x41\\n"', scalars.byte_literal) == ["61410A"] and one(spark, 'b"a\\q"', scalars.byte_literal) == [None] and one(spark, "x", scalars.byte_literal) == [None]
    assert one(spark, ['b"ab"', "b'c'", "x.key()", 'b"d"'], scalars.literal_prefix, kind="array<string>") == ["616263"]
    assert one(spark, "r/a.b", lambda c: scalars.topic_url(c, "r", "https://x/")) == ["https://x/r-a-b.md"]
    assert one(spark, ' "my-prog" ', scalars.normal_name) == ["my_prog"]
    assert one(spark, "1" * 32, scalars.is_base58_key) == [True] and one(spark, "0" * 32, scalars.is_base58_key) == [False]
    assert one(spark, "2024-01-03T01:00:00Z", lambda c: scalars.elapsed_days(F.lit("2024-01-01T02:00:00Z"), c)) == [1]
    assert one(spark, "https://git.example/o/r", lambda c: scalars.is_proof_url(c, "git.example")) == [True]
    assert one(spark, "&mut a::Account<'info, T>", scalars.primary_type) == ["Account"]
    hits = one(spark, "ab a\nxa a.a", lambda c: scalars.word_hits(c, "a"))[0]
    assert [tuple(h) for h in hits] == [(0, 3), (1, 3), (1, 5)]


# references
def test_references(spark):
    decl = spark.createDataFrame([("s", "a"), ("s", "b")], "scope string, name string")
    refs = spark.createDataFrame([("s", "a", False), ("s", "x.b", False), ("s", "c", False), ("s", "p", True)], "scope string, name string, is_program boolean")
    alt = spark.createDataFrame([("s", "p"), ("s", "c")], "scope string, name string")
    assert rows(references.missing_refs(refs, decl, ["scope"], alternatives=alt).select("name")) == [("c",)]
    f = lambda d, s: spark.createDataFrame(d, s)
    uses, args = f([("A", "_n"), ("A", "m"), ("B", "q")], "context string, name string"), f([("A", "n")], "context string, name string")
    assert rows(references.missing_args(uses, args, f([("A",)], "context string"))) == [("A", "m")]
    ctx = references.infer_context(f([("f", "do_it"), ("g", "go"), ("h", "go")], "file string, name string"), f([("f", "DoIt"), ("f", "B"), ("g", "Only"), ("h", "X"), ("h", "Y")], "file string, name string"))
    assert rows(ctx) == [("f", "do_it", "DoIt"), ("g", "go", "Only"), ("h", "go", None)]
    s = "context string, ordinal int, name string, type_name string"
    bad = references.positional_mismatch(f([("A", 0, "x", "u8"), ("A", 1, "y", "u8"), ("A", 2, "b", "u8"), ("A", 3, "z", "u8")], s), f([("A", 0, "_x", "u8"), ("A", 1, "b", "u8"), ("A", 2, "y", "u8"), ("A", 3, "z", "u16")], s))
    assert rows(bad.select("ordinal", "kind")) == [(1, "extra"), (2, "order"), (3, "type")] or rows(bad.select("ordinal", "kind")) == [(1, "order"), (2, "order"), (3, "type")]
    tok = f([(1, "s", "a", None, False), (2, "s", "zz", None, False), (3, "s", "len", "V", True), (4, "s", "cap", "V", True), (5, "s", "no", "V", False)], "id int, scope string, name string, owner_type string, call boolean")
    got = references.expression_issues(tok, decl, f([("V", "len", False), ("V", "cap", True)], "owner_type string, name string, is_method boolean"))
    assert rows(got.select("id", "issue")) == [(2, "identifier"), (3, "field_as_method"), (5, "member")]


def test_has_one_and_mut(spark):
    f = spark.createDataFrame
    c = f([("C", "x", "owner", "Vault"), ("C", "x", "gone", "Vault"), ("C", "x", "any", "Unknown")], "container string, field string, target string, data_type string")
    assert rows(references.has_one_missing(c, f([("Vault",)], "name string"), f([("Vault", "owner")], "container string, name string")).select("target")) == [("gone",)]
    fields = f([("C", "a", "Account", []), ("C", "b", "Account", ["mut"]), ("C", "c", "Signer", [])], "container string, name string, type_name string, keys array<string>")
    uses = f([("C", "a", True), ("C", "b", True), ("C", "c", True), ("C", "a", False)], "container string, account string, mutable boolean")
    assert rows(references.missing_mut(uses, fields, ["Account"], ["mut"])) == [("C", "a")]


@pytest.mark.parametrize("keys,want", [(["a", "ab", "abc"], {("a", "ab"), ("a", "abc"), ("ab", "abc")}), (["s", "s"], set()), (["x", "y"], set()), (["", "q"], set())])
def test_prefix_collisions(spark, keys, want):
    df = spark.createDataFrame([("d", k) for k in keys], "doc string, key string")
    assert {(r["prefix"], r["key"]) for r in references.prefix_collisions(df, ["doc"]).collect()} == want


def test_contexts_resolve_by_tier(spark):
    n = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    uses = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", True), ("e", False)], "name string, sees boolean")
    got = references.resolve_context(uses, n("a"), n("b"), n("c"), F.col("sees"))
    assert rows(got.select("name", "state")) == [("a", "found"), ("b", "found"), ("c", "exists"), ("d", "missing"), ("e", "silent")]


# constraints
KEYS = "array<struct<key:string,value:string,has_value:boolean>>"


def test_constraint_rules(spark):
    f = spark.createDataFrame
    k = lambda *x: [(a, b, b is not None) for a, b in x]
    c = f([("C", "v", k(("init", None), ("payer", "v"), ("mut", None))), ("C", "w", k(("close", "p"), ("zero", None), ("mut", None))), ("C", "x", k(("realloc", "9"), ("payer", "fix")))], f"container string, field string, keys {KEYS}")
    assert rows(constraints.key_conflicts(c, [("zero", "mut")])) == [("C", "v", "init", "payer"), ("C", "w", "zero", "mut")]
    fields = f([("C", "v", "Account"), ("C", "w", "Signer"), ("C", "x", "Account"), ("C", "fix", "Signer")], "container string, name string, type_name string")
    assert rows(constraints.lifecycle_requirements(c, fields, ["Account"])) == [("C", "w", "type"), ("C", "x", "mut"), ("C", "x", "payer")]
    pda = f([("C", "p", ['b"s"', "owner.key().as_ref()", "id.to_le_bytes().as_ref()", "f()"], "list", "canonical"), ("C", "q", ['b"%s"' % ("z" * 40)], "list", "missing"), ("C", "e", None, "expr", "missing")], "container string, field string, seeds array<string>, seed_kind string, bump_kind string")
    names = lambda *x: f([("C", n) for n in x], "container string, name string")
    kinds = [r[0] for r in constraints.classify_seeds(pda.limit(1), names("owner"), names("id")).orderBy("ordinal").select("kind").collect()]
    assert kinds == ["static", "account", "argument", "expression"]
    assert rows(constraints.pda_usage(pda).select("field", "n_seeds", "static_only", "uses_bump")) == [("e", 1, False, False), ("p", 4, False, True), ("q", 1, True, False)]
    assert rows(constraints.seed_limits(pda)) == [("C", "q", "too_long", 0)]
    hint = constraints.static_seed_hints(pda, f([("C", "auth", "Signer", 1)], "container string, name string, type_name string, ordinal int"), ["Signer"])
    assert rows(hint.select("field", "scope_field")) == [("q", "auth")]
    need = f([("init", "system_program", "Program")], "key string, name string, type_name string")
    sub = f([("C", "v", ["init"]), ("D", "v", ["init"]), ("E", "v", ["init"])], "container string, field string, keys array<string>")
    have = f([("C", "system_program", "Program"), ("D", "system_program", "Account")], "container string, name string, type_name string")
    assert rows(constraints.required_sibling(sub, have, need)) == [("D", "v", "system_program", "type"), ("E", "v", "system_program", "missing")]
    fam = f([("seeds", ["Account"], "data account")], "key string, types array<string>, expected string")
    typed = f([("C", "s", "Signer", [("seeds", "x", True)]), ("C", "a", "Account", [("seeds", "x", True)])], f"container string, field string, type_name string, keys {KEYS}")
    assert rows(constraints.family_applicability(typed, fam)) == [("C", "s", "data account")]
    tok = f([("C", "t", "mint", "m"), ("C", "t", "mint", "s"), ("C", "t", "mint", "arg")], "container string, field string, role string, target string")
    roles = f([("mint", ["Mint"])], "role string, types array<string>")
    assert rows(constraints.token_checks(tok, f([("C", "m", "Mint"), ("C", "s", "Signer")], "container string, name string, type_name string"), roles).select("target")) == [("s",)]
    un = f([("C", "clock", "Unchecked", []), ("C", "rent", "Unchecked", ["address"]), ("C", "x", "Unchecked", [])], "container string, name string, type_name string, keys array<string>")
    assert rows(constraints.unchecked_named(un, f([("clock",), ("rent",)], "name string"), ["Unchecked"], ["address"]).select("name")) == [("clock",)]
    feats = constraints.missing_features(f([("p", "a"), ("p", "b"), ("q", "c")], "package string, feature string"), f([("p", "w", ["a"]), ("q", "w", None)], "package string, workspace string, features array<string>"), f([("w", ["c"])], "workspace string, features array<string>"))
    assert rows(feats) == [("p", "b")]
    shapes = f([("C", "a", "Account", []), ("C", "b", "Account", ["Known"]), ("C", "c", "Account", ["Nope"]), ("C", "d", "Sysvar", ["Zap"])], "container string, name string, type_name string, generics array<string>")
    fns = f([("f", "one", True), ("f", "two", True), ("g", "one", True)], "file string, name string, is_fallback boolean")
    got = constraints.shape_checks(shapes, fns, f([("Known",)], "name string"), ["Account", "Sysvar"], ["Clock"])
    assert rows(got) == [("C", "a", "generic"), ("C", "c", "unresolved"), ("C", "d", "sysvar"), ("f", "one", "fallback")]
    ev = f([("f", "x", "panic"), ("f", "y", "panic"), ("f", "x", "other")], "file string, fn string, event string")
    assert rows(constraints.event_rule(ev, "panic", except_scopes=f([("f", "y")], "file string, fn string")).select("fn")) == [("x",)]


# guards
def test_signer_rules(spark):
    f = spark.createDataFrame
    fields = f([("C", n, "Unchecked", k) for n, k in (("a", []), ("b", ["signer"]), ("c", []), ("d", []), ("e", []))] + [("W", "w", "Unchecked", [])], "container string, name string, type_name string, keys array<string>")
    s = "context string, account string, truncated boolean"
    uses = f([("C", "a", False), ("C", "b", False), ("C", "c", False), ("C", "d", True)], s)
    checks = f([("C", "c", True)], s)
    other = f([("W", "w", False), ("C", "e", False)], s)
    assert rows(guards.unchecked_use(uses, checks, fields, ["Unchecked"], ["signer"], other)) == [("C", "a"), ("W", "w")]
    cmp = f([("C", "account", "a", "static", "ID"), ("C", "account", "c", "account", "z")], "context string, left_kind string, left string, right_kind string, right string")
    none = f([("W",)], "context string")
    assert rows(guards.unvalidated_program(uses, cmp, fields, ["Unchecked"], ["signer"], none)) == [("C", "c")]
    ins = f([("C", True), ("D", True), ("D", None), ("E", True)], "context string, populated boolean")
    acc = f([("C", "x", True, False), ("C", "y", False, False), ("D", "x", False, False), ("E", "q", False, None)], "context string, account string, requires boolean, is_signer boolean")
    assert rows(guards.missing_signer_populated(ins, acc)) == [("C", "x"), ("E", "q")]


def test_stale_reads_respect_reloads(spark):
    ev = [("f", 1, "call", None), ("f", 2, "read", "a"), ("f", 3, "reload", "b"), ("f", 4, "read", "b"), ("g", 1, "read", "a"), ("g", 2, "call", None), ("h", 1, "reload", "a"), ("h", 2, "call", None), ("h", 3, "read", "a")]
    df = spark.createDataFrame(ev, "fn string, seq int, event string, subject string")
    is_ = lambda t: F.col("event") == t
    got = guards.sequence_violation(df, ["fn"], ["seq"], is_("call"), is_("reload"), is_("read"), ["subject"])
    assert rows(got) == [("f", "a", 1, 2)]


# artifacts
def test_artifacts(spark):
    f = spark.createDataFrame
    p = f([("r", "my-prog", "ID"), ("empty", "z", "ID")], "root string, name string, program_id string")
    a = f([("r", "my_prog", "deploy", "invalid", None, None, None), ("r", "my_prog", "keypair", "present", "OTHER", None, None), ("r", "my_prog", "idl", "present", None, "my_prog", "ID"), ("r", "my_prog", "types", "present", None, None, None), ("empty", "z", "deploy", "missing", None, None, None)],
          "root string, program string, kind string, state string, public_key string, idl_name string, idl_address string")
    assert rows(artifacts.artifact_findings(p, a)) == [("r", "my-prog", "deploy_invalid"), ("r", "my-prog", "keypair_mismatch")]
    dec = f([("p", "A", "devnet")], "program string, program_id string, provider_cluster string")
    conf = f([("p", "localnet", "A", 0), ("p", "devnet", "B", 1)], "program string, cluster string, program_id string, ordinal int")
    assert rows(artifacts.id_mismatch(dec, conf)) == [("p", "A", "B", "devnet")]
    eco = artifacts.ecosystem_status(f([("r", "t1"), ("r", "t2")], "root string, tool string"), f([("r", "t2"), ("r", "t3")], "root string, tool string"))
    assert rows(eco) == [("r", "t1", "missing_tests"), ("r", "t2", "configured"), ("r", "t3", "detected")]
    sig = f([("f", "p", ["b", "a"]), ("f", "p", ["a"]), ("g", "q", [])], "file string, program string, reasons array<string>")
    st = artifacts.compute_status(sig, f([("p", "present", 10)], "program string, state string, instructions int"))
    assert rows(st.select("file", "status", "reasons")) == [("f", "review", ["a", "b"]), ("g", "no_artifact", [])]


def test_space(spark):
    s = "container string, type_name string, optional boolean, is_enum_variant boolean, count int, max_len int"
    fields = [("A", "u64", False, False, None, None), ("A", "u8", True, False, None, None), ("A", "B", False, False, 3, None), ("B", "u8", False, False, None, 10), ("E", "u64", False, True, None, None), ("E", "u8", False, True, None, None), ("X", "what", False, False, None, None), ("R", "R", False, False, None, None)]
    got = artifacts.estimate_space(spark.createDataFrame(fields, s), spark.createDataFrame([("u8", 1), ("u64", 8)], "type_name string, bytes int"))
    assert {r["container"]: r["bytes"] for r in got.collect()} == {"A": 8 + 2 + 3 * 14, "B": 14, "E": 9, "X": None, "R": None}


def elf(machine=247, size=64):
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + b"\x03\x00" + machine.to_bytes(2, "little") + bytes(4) + (0x1234).to_bytes(8, "little") + bytes(28) + (7).to_bytes(2, "little") + bytes(2)
    return bytearray(head[:size])


def test_elf(spark):
    df = spark.createDataFrame([("ok", elf()), ("short", elf(size=20)), ("m", elf(3)), ("magic", bytearray(64))], "path string, content binary")
    got = {r["file"]: (r["state"], r["reason"], r["entry"], r["sections"]) for r in readers.elf_facts(df).collect()}
    assert got == {"ok": ("present", None, 0x1234, 7), "short": ("invalid", "too short", None, None), "m": ("invalid", "machine", None, None), "magic": ("invalid", "magic", None, None)}


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.rs").write_text("fn x() {}\n// y\n")
    (tmp_path / "b.txt").write_text("no")
    files = readers.read_sources(spark, str(tmp_path))
    small, big = readers.split_oversized(files, 5)
    assert files.count() == 1 and small.count() == 0 and big.first()["file"].endswith("a/x.rs")
    f = spark.createDataFrame
    deps, feats = readers.manifest_facts(f([("m", {"anchor": "1"}, ["idl"])], "file string, deps map<string,string>, features array<string>"))
    assert rows(deps) == [("m", "anchor")] and rows(feats) == [("m", "idl")]
    idl = readers.idl_facts(f([("a", '{"metadata":{"name":"n","address":"x","origin":"shank"}}'), ("b", '{"standard":"codama","program":{"name":"q"}}'), ("c", "{")], "file string, text string"))
    assert rows(idl) == [("a", "n", "x", "shank"), ("b", "q", None, "codama"), ("c", None, None, None)]
    pins = readers.corpus_manifest(f([("ok", "https://h/r", "a" * 40, "MIT"), ("bad name", None, "short", "")], "name string, repo string, sha string, license string"))
    assert {r["name"]: r["failures"] for r in pins.collect()} == {"ok": [], "bad name": ["name", "repo", "sha", "license"]}
    (tmp_path / "c.json").write_text('[{"name": "E1", "code": 1}]')
    assert rows(readers.load_catalog(spark, str(tmp_path / "c.json"), "name string, code int")) == [("E1", 1)]


# telemetry, drift, reports
def test_telemetry(spark):
    f = spark.createDataFrame
    v = f([("a", float(i)) for i in (3, 1, 2, 2)] + [("b", None)], "k string, v double")
    assert rows(telemetry.nearest_rank(v, ["k"], "v", 0.5)) == [("a", 4, 2.0)] and rows(telemetry.nearest_rank(v, ["k"], "v", 0.0)) == [("a", 4, 1.0)]
    hours, failures = telemetry.fuzz_rollup(f([("t", "passed", 2, 3600, 2.0), ("u", "failed", 1, 1800, 0.9)], "target string, status string, shards int, seconds_per_shard int, fuzz_hours double"))
    assert hours.first()["hours"] == 2.5 and rows(failures) == [("u", "hours"), ("u", "status")]
    assert rows(telemetry.unsorted(f([("s", 0, "b"), ("s", 1, "a"), ("s", 2, "c")], "s string, i int, name string"), ["s"], "i", "name").select("name", "previous")) == [("a", "b")]
    tree = lambda *x: telemetry.tree_digest(f(list(x), "p string, c string"), [], "p", F.col("c").cast("binary")).first()["digest"]
    assert tree(("a", "1"), ("b", "2")) == tree(("b", "2"), ("a", "1")) != tree(("a", "1"), ("b", "3"))


def test_drift(spark):
    f = spark.createDataFrame
    h, g = "a" * 64, "b" * 64
    s = "root string, file string, sha256 string"
    got = drift.lock_drift(f([("r", "same", h), ("r", "gone", h), ("r", "bad", "zz"), ("r", "diff", h)], s), f([("r", "same", h), ("r", "bad", h), ("r", "diff", g), ("r", "new", h)], s), ["root", "file"])
    assert rows(got.select("file", "drift")) == [("bad", "malformed"), ("diff", "mismatch"), ("gone", "missing"), ("new", "unexpected")]
    base, patch = f([("k", 1, 2)], "k string, a int, b int"), f([("k", None, 9), ("n", 5, None)], "k string, a int, b int")
    assert rows(drift.merge_evidence(base, patch, "k")) == [("k", 1, 9), ("n", 5, None)]


def test_reports(spark):
    f = spark.createDataFrame
    local = f([("i", "a", False), ("i", "a", True), ("i", "b", False)], "fn string, account string, mutable boolean")
    got = reports.merged_usages(local, f([("i", "a"), ("i", "c")], "fn string, account string"), ["fn"])
    assert rows(got) == [("i", "a", True), ("i", "b", False), ("i", "c", False)]
    u = f([("C", "a", True), ("C", "z", False)], "container string, account string, mutable boolean")
    d = f([("C", "a", "Account")], "container string, name string, type_name string")
    w = f([("C", "a", "c2"), ("C", "a", "c1")], "container string, account string, code string")
    assert rows(reports.focused_report(u, d, w, "C")) == [("a", True, "Account", ["c1", "c2"]), ("z", False, None, None)]


# streaming
def run_available(result, name, checkpoint, mode="append"):
    """Run a stream over all data at hand into a table in memory."""
    query = result.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    data = [("d", 1, "2024-01-01 00:00:00.0", "p1"), ("d", 2, "2024-01-01 00:00:00.5", "p2"), ("d", 3, "2024-01-01 00:00:05", "p3"), ("e", 1, "2024-01-01 00:00:01", "q"), ("x", 1, "2024-01-01 06:00:00", "end")]
    df = spark.createDataFrame(data, "doc string, version int, at string, payload string").select("doc", "version", F.to_timestamp("at").alias("ts"), "payload")
    df.write.parquet(f"{tmp_path}/in")
    want = updates.debounce(df, "doc", "ts", "payload", "version")
    stream = updates.read_updates(spark, f"{tmp_path}/in", df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    got = run_available(updates.debounce(stream, "doc", "ts", "payload", "version"), "bursts", f"{tmp_path}/cp", "complete")
    assert rows(got) == rows(want) and ("p2" in [r["payload"] for r in got.collect()])
    hot, cold = updates.lanes(stream.withColumn("phase", F.col("version")), hot=1)
    assert rows(run_available(hot.select("doc", "version"), "hot", f"{tmp_path}/cp2")) == [("d", 1), ("e", 1), ("x", 1)]


def test_typing_and_versions(spark):
    f = spark.createDataFrame
    ts = lambda df: df.withColumn("ts", F.to_timestamp("ts"))
    s = "file string, ts string, start int, end int"
    found = ts(f([("f", "2024-01-01 00:00:00.2", 0, 5), ("f", "2024-01-01 00:00:00.2", 7, 9), ("f", "2024-01-01 00:00:01", 0, 5)], s))
    changed = ts(f([("f", "2024-01-01 00:00:00", 5, 6)], s))
    assert rows(updates.suppress_recent(found, changed).select("start", F.date_format("ts", "ss"))) == [(0, "01"), (7, "00")]
    v = "k string, version int"
    assert rows(updates.drop_stale(f([("a", 1), ("a", 2), ("a", None), ("b", 1)], v), f([("a", 2)], v), "k")) == [("a", 2), ("a", None), ("b", 1)]
    idx = updates.upsert_index(f([("a", 1), ("b", 1)], v), f([("a", 2), ("a", 3), ("b", -1)], v), "k", [F.col("version")], F.col("version") < 0)
    assert rows(idx) == [("a", 3)]
    assert rows(updates.changed_only(f([("a", 1), ("b", 1)], v), f([("b", 9)], v), "k")) == [("b", 1)]


def test_stream_sink_replaces_documents(spark, tmp_path):
    schema = "file string, code string, line int"
    publish = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: sinks.stream_findings(updates.read_updates(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out")
    publish([("f", "a", 1), ("f", "b", 2), ("g", "c", 3), ("h", "d", 4)])
    run()
    publish([("f", "e", 5), ("h", None, None)])
    run()
    got = sinks.read_stream_findings(spark, f"{tmp_path}/out", spark.createDataFrame([], schema).schema)
    assert rows(got) == [("f", "e", 5), ("g", "c", 3)]


def test_module_paths(spark):
    f = spark.createDataFrame([("p/src/state/escrow.rs",), ("src/lib.rs",), ("p/src/a/mod.rs",), ("p/tests/x.rs",), ("src/main.rs",)], "file string")
    got = [r[0] for r in f.select(references.module_path(F.col("file"))).collect()]
    assert got == ["crate::state::escrow", "crate", "crate::a", None, "crate"]


def test_token_rules(spark):
    f = spark.createDataFrame
    keys = "array<struct<key:string,value:string,has_value:boolean>>"
    k = lambda **x: [(n.replace("__", "::"), v, v is not None) for n, v in x.items()]
    c = f([("C", "a", "Mint", k(token__mint="m", mint__decimals=None)), ("C", "b", "TokenAccount", k(token__token_program="p"))], f"container string, field string, type_name string, keys {keys}")
    targets = f([("token::", ["TokenAccount"], "token"), ("mint::", ["Mint"], "mint")], "prefix string, types array<string>, issue string")
    assert rows(constraints.token_targets(c, targets)) == [("C", "a", "token")]
    fields = f([("C", "p", "System")], "container string, name string, type_name string")
    assert rows(constraints.program_overrides(c, fields, "token::token_program", ["Token"])) == [("C", "b", "p", "System")]
    assert rows(constraints.exclusive_groups(c, [("token::", "mint::")])) == [("C", "a", "mint::,token::")]
