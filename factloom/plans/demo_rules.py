"""More registered queries: rules that need shaped facts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import artifacts, constraints, drift, findings, guards, references, reports, telemetry
from factloom.plans.demo import _EVENTS_SQL, _by_day, _findings_sql, _micros, _t, line_findings, lines_of, query
from factloom.sources import readers, sinks
from factloom.streaming import updates


def _keys(names, values=None):
    """An array of (key, value, has_value) structs of string columns; null names are left out."""
    one = lambda n, v: F.when(n.isNotNull(), F.struct(n.alias("key"), v.cast("string").alias("value"), v.isNotNull().alias("has_value")))
    values = values or [F.lit(None)] * len(names)
    return F.array_compact(F.array(*[one(n, v) for n, v in zip(names, values, strict=True)]))


@query("""
select page_id, case when contains(url, '/fr/') then 'fr' when contains(url, '/de/') then 'de' when contains(html, 'lang="en"') then 'en' else 'other' end as tier from pages""")
def f1_classify(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    tiers = [(n, pages.filter(c)) for n, c in (("fr", F.col("url").contains("/fr/")), ("de", F.col("url").contains("/de/")), ("en", F.col("html").contains('lang="en"')))]
    return references.resolve_tiers(pages.select("page_id"), tiers, "page_id", "other")


@query("select event_type, (event_type <> 'error')::int as phase, count(*) as n from events where event_type in ('click', 'view', 'error') group by all")
def f2_applicable(spark, sf_dir):
    rules = _t(spark, sf_dir, "events").select(
        "event_type", F.when(F.col("event_type") == "error", 0).when(F.col("event_type").isin("click", "view"), 1).otherwise(3).alias("phase"), F.array(F.lit("core")).alias("frameworks")
    )
    return findings.applicable_rules(rules, "core", "structure").groupBy("event_type", "phase").agg(F.count(F.lit(1)).alias("n"))


@query(_findings_sql() + " select file, start_line, code from f where code in ('hex', 'phone')")
def f5_severity(spark, sf_dir):
    provability = F.when(F.col("code") == "email", "proven").when(F.col("code") == "hex", "likely").when(F.col("code") == "licence", "likely").otherwise("guess")
    return findings.severity_violations(line_findings(spark, sf_dir).withColumn("provability", provability)).select("file", "start_line", "code")


@query("select o_orderkey, 'F' as \"left\", '1-URGENT' as \"right\" from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' union all select o_orderkey, 'O', '5-LOW' from orders where o_orderstatus = 'O' and o_orderpriority = '5-LOW'")
def f14_conflicts(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("container"), F.lit("order").alias("field"), _keys([F.col("o_orderstatus"), F.col("o_orderpriority")]).alias("keys"))
    out = constraints.key_conflicts(orders, [("F", "1-URGENT"), ("O", "5-LOW")])
    return out.select(F.col("container").alias("o_orderkey"), "left", "right")


@query("""
select l_orderkey, l_linenumber, l_partkey, case l_linestatus when 'O' then 'static' else case when l_returnflag = 'R' then 'account' when l_returnflag = 'A' then 'argument' else 'expression' end end as kind
from (select distinct l_orderkey, l_linenumber, l_partkey, l_linestatus, l_returnflag from lineitem)""")
def f10_seeds(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag").distinct()
    name = F.concat(F.lower("l_returnflag"), F.lit("_id"))
    tail = F.when(F.col("l_returnflag") == "R", ".key().as_ref()").otherwise(".as_bytes()")
    seed = F.when(F.col("l_linestatus") == "O", F.lit('b"open"')).otherwise(F.concat(name, tail))
    pda = lines.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag").alias("container"), F.lit("x").alias("field"), F.array(seed).alias("seeds"))
    accounts = lines.filter("l_returnflag = 'R'").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag").alias("container"), F.lit("r_id").alias("name"))
    args = lines.filter("l_returnflag = 'A'").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag").alias("container"), F.lit("a_id").alias("name"))
    return constraints.classify_seeds(pda, accounts, args).select("container.l_orderkey", "container.l_linenumber", "container.l_partkey", "kind")


@query("""
with s as (select l_orderkey as k, count(*) as n, bool_and(l_linestatus = 'O') as st from lineitem group by all)
select k as l_orderkey, n as n_seeds, st as static_only from s""")
def f11_seed_usage(spark, sf_dir):
    seed = F.when(F.col("l_linestatus") == "O", F.lit('b"open"')).otherwise(F.lit("f()"))
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(seed).alias("seeds")).withColumns({"seed_kind": F.lit("list"), "bump_kind": F.lit("missing")})
    return constraints.pda_usage(rows).select("l_orderkey", F.col("n_seeds").cast("long").alias("n_seeds"), "static_only")


@query("select c_custkey, case when o_orderstatus = 'F' then 'final' else 'open' end as expected from orders join customer on c_custkey = o_custkey where (o_orderstatus = 'F' and c_mktsegment <> 'BUILDING') or (o_orderstatus = 'O' and c_mktsegment not in ('BUILDING', 'MACHINERY')) group by all")
def f16_families(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    rows = c.select(F.col("c_custkey").alias("container"), F.lit("f").alias("field"), F.col("c_mktsegment").alias("type_name"), _keys([F.col("o_orderstatus")]).alias("keys"))
    families = spark.createDataFrame([("F", ["BUILDING"], "final"), ("O", ["BUILDING", "MACHINERY"], "open")], "key string, types array<string>, expected string")
    return constraints.family_applicability(rows, families).select(F.col("container").alias("c_custkey"), "expected")


@query("""
select o_orderkey, 'type' as issue from orders where o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' union all
select o_orderkey, 'mut' from orders where o_orderstatus = 'F' and o_totalprice < 100000 union all
select o_orderkey, 'payer' from orders where o_orderstatus = 'P' and o_totalprice < 200000""")
def f17_lifecycle(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("container", F.col("o_orderkey"))
    closing = o.filter("o_orderstatus = 'F'").select("container", F.lit("f").alias("field"), _keys([F.lit("close"), F.when(F.col("o_totalprice") >= 100000, "mut")], [F.lit("x"), F.lit(None)]).alias("keys"))
    paid = o.filter("o_orderstatus = 'P'").select("container", F.lit("p").alias("field"), _keys([F.lit("payer"), F.lit("other")], [F.lit("q"), F.lit(None)]).alias("keys"))
    payers = o.filter("o_orderstatus = 'P' and o_totalprice >= 200000").select("container", F.lit("q").alias("field"), _keys([F.lit("mut")]).alias("keys"))
    typed = o.select("container", F.lit("f").alias("name"), F.when(F.col("o_orderpriority") == "1-URGENT", "Account").otherwise("Other").alias("type_name"))
    declared = typed.unionByName(o.select("container", F.lit("q").alias("name"), F.lit("Signer").alias("type_name")))
    out = constraints.lifecycle_requirements(closing.unionByName(paid).unionByName(payers), declared, ["Account"])
    return out.select(F.col("container").alias("o_orderkey"), "issue")


@query("""
with s as (select l_orderkey, max(case when l_linenumber = 2 then l_returnflag end) as h, bool_or(l_linenumber = 1) as f from lineitem group by all)
select l_orderkey, case when h is null then 'missing' else 'type' end as issue from s where f and (h is null or h <> 'R')""")
def f18_siblings(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    subjects = lines.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("container"), F.lit("f").alias("field"), F.array(F.lit("first")).alias("keys")).distinct()
    siblings = lines.filter("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("container"), F.lit("second").alias("name")).agg(F.max("l_returnflag").alias("type_name"))
    required = spark.createDataFrame([("first", "second", "R")], "key string, name string, type_name string")
    return constraints.required_sibling(subjects, siblings, required).select(F.col("container").alias("l_orderkey"), "issue")


@query("select p_partkey from part where p_type in ('ECONOMY', 'PROMO') and p_size <= 25 and p_name in (select p_name from part where p_size = 50)")
def f20_unchecked(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    fields = part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("type_name"), F.array_compact(F.array(F.when(F.col("p_size") > 25, "address"))).alias("keys"))
    return constraints.unchecked_named(fields, part.filter("p_size = 50").select(F.col("p_name").alias("name")), ["ECONOMY", "PROMO"], ["address"]).select("p_partkey")


@query(_EVENTS_SQL + " select event_id from e where event_type = 'error' and value > 50 and not exists (select 1 from e x where x.event_type = 'signup' and x.user_id = e.user_id and x.day = e.day)")
def f21_events(spark, sf_dir):
    e = _by_day(spark, sf_dir).select("event_id", "value", F.col("user_id").alias("file"), F.col("day").alias("fn"), F.col("event_type").alias("event"))
    return constraints.event_rule(e, "error", F.col("value") > 50, e.filter("event = 'signup'")).select("event_id")


@query("""
select s_suppkey, 'generic' as issue from supplier where s_acctbal < 0 union all
select s_suppkey, 'unresolved' from supplier where s_acctbal >= 0 and s_nationkey not in (select c_nationkey from customer where c_acctbal > 9000)""")
def f23_shapes(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    generics = F.when(F.col("s_acctbal") < 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.col("s_nationkey").cast("string")))
    fields = s.select(F.lit(0).alias("container"), F.col("s_suppkey").alias("name"), F.lit("Account").alias("type_name"), generics.alias("generics"))
    functions = s.select(F.lit(0).alias("file"), F.col("s_suppkey").alias("name"), F.lit(False).alias("is_fallback"))
    known = _t(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").cast("string").alias("name"))
    return constraints.shape_checks(fields, functions, known, ["Account"], []).select(F.col("name").alias("s_suppkey"), "issue")


@query("""
with u as (select distinct l_orderkey as c, l_linenumber as n from lineitem), h as (select o_orderkey as c from orders where o_orderstatus = 'O'), a as (select l_orderkey as c, l_linenumber as n from lineitem where l_returnflag = 'R')
select c as l_orderkey, n as l_linenumber from u where c in (select c from h) and not exists (select 1 from a where a.c = u.c and a.n = u.n)""")
def j2_missing_args(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("context"), F.col("l_linenumber").cast("string").alias("name"), "l_returnflag")
    handlers = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("context"))
    args = lines.filter("l_returnflag = 'R'").select("context", F.concat(F.lit("_"), "name").alias("name"))
    out = references.missing_args(lines.select("context", "name").distinct(), args, handlers)
    return out.select(F.col("context").alias("l_orderkey"), F.col("name").cast("int").alias("l_linenumber"))


@query("select distinct o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' and o_orderkey in (select l_orderkey from lineitem where l_linestatus = 'O')")
def j4_missing_mut(spark, sf_dir):
    uses = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("container"), F.lit("order").alias("account"), (F.col("l_linestatus") == "O").alias("mutable"))
    keys = F.array_compact(F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "mut")))
    fields = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("container"), F.lit("order").alias("name"), F.col("o_orderstatus").alias("type_name"), keys.alias("keys"))
    return references.missing_mut(uses, fields, ["F"], ["mut"]).select(F.col("container").alias("o_orderkey"))


@query("""
with c as (select s_nationkey as k, count(*) as n, min(s_name) as o from supplier where s_acctbal > 8000 group by all)
select c_custkey, case when n = 1 then o end as context from customer left join c on k = c_nationkey""")
def j7_infer(spark, sf_dir):
    contexts = _t(spark, sf_dir, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("file"), F.col("s_name").alias("name"))
    functions = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), F.col("c_custkey").cast("string").alias("name"))
    return references.infer_context(functions, contexts).select(F.col("name").cast("long").alias("c_custkey"), "context")


@query("""
with a as (select l_orderkey as c, l_linenumber as o, min(l_partkey)::varchar as n, min(l_returnflag) as t from lineitem where l_linestatus = 'O' group by all),
g as (select l_orderkey as c, l_linenumber as o, min(l_partkey)::varchar as n, min(l_returnflag) as t from lineitem where l_quantity > 10 group by all),
x as (select a.c, a.o, a.n, case when not exists (select 1 from g where g.c = a.c and g.n = a.n) then 'extra' when g.n is null or g.n <> a.n then 'order' when g.t <> a.t then 'type' end as kind
  from a left join g on g.c = a.c and g.o = a.o)
select c as context, o as ordinal, n as name, kind from x where kind is not null""")
def j8_positions(spark, sf_dir):
    def side(rows):
        return rows.groupBy(F.col("l_orderkey").alias("context"), F.col("l_linenumber").alias("ordinal")).agg(F.min("l_partkey").cast("string").alias("name"), F.min("l_returnflag").alias("type_name"))

    lines = _t(spark, sf_dir, "lineitem")
    return references.positional_mismatch(side(lines.filter("l_linestatus = 'O'")), side(lines.filter("l_quantity > 10")))


@query("""
select distinct l_suppkey, l_partkey from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)
and not exists (select 1 from lineitem x where x.l_suppkey = lineitem.l_suppkey and x.l_partkey = lineitem.l_partkey and x.l_returnflag = 'R')""")
def j9_has_one(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    c = lines.select(F.col("l_suppkey").alias("data_type"), F.col("l_partkey").alias("target")).distinct()
    structs = _t(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("name"))
    fields = lines.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("container"), F.col("l_partkey").alias("name"))
    return references.has_one_missing(c, structs, fields).select(F.col("data_type").alias("l_suppkey"), F.col("target").alias("l_partkey"))


@query(_EVENTS_SQL + """, u as (select day, user_id, bool_or(event_type = 'view' and value <= 50) as used, bool_or(event_type = 'signup') as checked from e group by all)
select day, user_id from u where used and not checked and user_id % 3 <> 0""")
def j11_signers(spark, sf_dir):
    e = _by_day(spark, sf_dir).select(F.col("day").alias("context"), F.col("user_id").alias("account"), "event_type", (F.col("value") > 50).alias("truncated"))
    fields = e.select(F.col("context").alias("container"), F.col("account").alias("name")).distinct()
    fields = fields.withColumns({"type_name": F.lit("Unchecked"), "keys": F.array_compact(F.array(F.when(F.col("name") % 3 == 0, "signer")))})
    pick = lambda t: e.filter(F.col("event_type") == t).select("context", "account", "truncated")
    out = guards.unchecked_use(pick("view"), pick("signup"), fields, ["Unchecked"], ["signer"])
    return out.select(F.col("context").alias("day"), F.col("account").alias("user_id"))


@query("""
with r as (select o_custkey as c, bool_and(o_orderstatus <> 'P') as ok from orders group by all),
f as (select o_custkey as c, o_orderkey as a, o_orderpriority = '1-URGENT' as req, o_totalprice > 200000 as s from orders),
g as (select *, max(req::int) over (partition by c) = 1 as any_req from f)
select c as o_custkey, a as o_orderkey from g where c in (select c from r where ok) and (not any_req or req) and not s""")
def j15_signers_populated(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("context", F.col("o_custkey"))
    instructions = o.select("context", (F.col("o_orderstatus") != "P").alias("populated"))
    fields = o.select("context", F.col("o_orderkey").alias("account"), (F.col("o_orderpriority") == "1-URGENT").alias("requires"), (F.col("o_totalprice") > 200000).alias("is_signer"))
    return guards.missing_signer_populated(instructions, fields).select(F.col("context").alias("o_custkey"), F.col("account").alias("o_orderkey"))


@query("""
with c as (select o_custkey as p, o_orderpriority as cl, o_orderkey as id from orders),
x as (select p, cl, id, row_number() over (partition by p order by case when cl = case when p % 2 = 0 then '5-LOW' else '2-HIGH' end then 0 when cl = 'localnet' then 1 else 2 end, id) as n from c)
select p as program, p * 10 as declared_id, id as config_id, cl as cluster from x where n = 1 and id <> p * 10""")
def j16_identity(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    config = o.select(F.col("o_custkey").alias("program"), F.col("o_orderpriority").alias("cluster"), F.col("o_orderkey").alias("program_id"), F.col("o_orderkey").alias("ordinal"))
    provider = F.when(F.col("program") % 2 == 0, "5-LOW").otherwise("2-HIGH").alias("provider_cluster")
    declared = config.select("program").distinct().select("program", (F.col("program") * 10).alias("program_id"), provider)
    return artifacts.id_mismatch(declared, config)


@query("""
with d as (select p_partkey, max(l_returnflag = 'R') as dep, max(l_returnflag = 'A') as idl from part left join lineitem on l_partkey = p_partkey group by all),
s as (select p_partkey, dep is true as dep, idl is true as idl from d)
select p_partkey, 'deploy_missing' as issue from s where not dep and idl union all select p_partkey, 'idl_missing' from s where dep and not idl
union all select p_partkey, 'keypair_missing' from s where dep union all select p_partkey, 'types_missing' from s where dep or idl""")
def j17_artifacts(spark, sf_dir):
    part, lines = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "lineitem")
    key = F.col("l_partkey").cast("string")
    kind = F.when(F.col("l_returnflag") == "R", "deploy").when(F.col("l_returnflag") == "A", "idl")
    rows = lines.select(key.alias("root"), key.alias("program"), kind.alias("kind")).filter("kind is not null").distinct()
    none = {c: F.lit(None).cast("string") for c in ("public_key", "idl_name", "idl_address")}
    programs = part.select(F.col("p_partkey").cast("string").alias("root"), F.col("p_partkey").cast("string").alias("name"), F.lit("id").alias("program_id"))
    out = artifacts.artifact_findings(programs, rows.withColumn("state", F.lit("present")).withColumns(none))
    return out.select(F.col("root").cast("long").alias("p_partkey"), "issue")


@query("""
with m as (select distinct c_nationkey as k, c_mktsegment as t from customer where c_acctbal > 9000), t as (select distinct s_nationkey as k, 'BUILDING' as t from supplier)
select coalesce(m.k, t.k) as root, coalesce(m.t, t.t) as tool, case when m.k is not null and t.k is not null then 'configured' when m.k is not null then 'missing_tests' else 'detected' end as status
from m full join t on m.k = t.k and m.t = t.t""")
def j19_ecosystem(spark, sf_dir):
    markers = _t(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("root"), F.col("c_mktsegment").alias("tool"))
    tests = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("root"), F.lit("BUILDING").alias("tool"))
    return artifacts.ecosystem_status(markers, tests)


@query("select o_custkey, list_sort(list(distinct o_orderpriority))[1] as first_reason, count(distinct o_orderpriority) as n, case when o_custkey % 4 = 0 then 'no_artifact' when o_custkey % 4 = 1 then 'invalid_artifact' else 'review' end as status from orders group by o_custkey")
def a7_compute(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    signals = o.select(F.col("o_custkey").alias("file"), F.col("o_custkey").alias("program"), F.array("o_orderpriority").alias("reasons"))
    state = F.when(F.col("o_custkey") % 4 == 0, "missing").when(F.col("o_custkey") % 4 == 1, "invalid").otherwise("present")
    known = o.select("o_custkey").distinct().select(F.col("o_custkey").alias("program"), state.alias("state"), F.lit(1).alias("instructions"))
    out = artifacts.compute_status(signals, known)
    return out.select(F.col("file").alias("o_custkey"), F.element_at("reasons", 1).alias("first_reason"), F.size("reasons").cast("long").alias("n"), "status")


@query("select o_orderkey as container, case when count(l_orderkey) = count(*) and not bool_or(l_returnflag = 'N') then sum(case l_returnflag when 'R' then 8 else 4 end + case when l_linestatus = 'O' then 1 else 0 end)::bigint else -1 end as bytes from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def a17_space(spark, sf_dir):
    none = F.lit(None).cast("int")
    fields = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("container"), F.col("l_returnflag").alias("type_name"), (F.col("l_linestatus") == "O").alias("optional"), F.lit(False).alias("is_enum_variant"), none.alias("count"), none.alias("max_len")
    )
    sizes = spark.createDataFrame([("R", 8), ("A", 4)], "type_name string, bytes int")
    out = artifacts.estimate_space(fields, sizes, depth=2)
    return out.select(F.col("container").cast("long").alias("container"), F.coalesce("bytes", F.lit(-1)).alias("bytes"))


@query("""
with w as (select c_nationkey as k, c_custkey as o, c_mktsegment as n, lag(c_mktsegment) over (partition by c_nationkey order by c_custkey) as p from customer)
select k as c_nationkey, o as c_custkey, p as previous from w where p > n""")
def a18_unsorted(spark, sf_dir):
    return telemetry.unsorted(_t(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", "c_mktsegment").select("c_nationkey", "c_custkey", "previous")


@query("""
with l as (select o_custkey as k, o_orderpriority as a, bool_or(o_orderstatus = 'O') as m from orders where o_orderstatus <> 'P' group by all), r as (select distinct o_custkey as k, o_orderpriority as a from orders where o_orderstatus = 'P')
select k as o_custkey, a as account, bool_or(m) as mutable from (select * from l union all select k, a, false from r) group by all""")
def a4_merged(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("account"), "o_orderstatus")
    local = o.filter("o_orderstatus <> 'P'").withColumn("mutable", F.col("o_orderstatus") == "O")
    return reports.merged_usages(local, o.filter("o_orderstatus = 'P'"), ["o_custkey"])


@query("select doc_id, i::int as line, strpos(t, ' the ')::int as start_char from (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10))))) as i from documents) where contains(t, ' the ')")
def c14_word_hits(spark, sf_dir):
    lines = lines_of(_t(spark, sf_dir, "documents")).filter(F.col("text").contains(" the "))
    hits = lines.select(F.col("file").alias("doc_id"), "line", "text", F.explode(scalars.word_hits(F.col("text"), "the")).alias("h"))
    first = hits.filter(F.substr("text", F.col("h.start_char"), F.lit(5)) == " the ").groupBy("doc_id", "line").agg(F.min("h.start_char").alias("start_char"))
    return first.select("doc_id", "line", "start_char")


@query("select event_id as file, props->>'k' as name, case when event_type = 'error' then 'codama' when event_type = 'view' then 'shank' else 'generic' end as format from events")
def s6_idl(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    extra = F.when(F.col("event_type") == "error", '"standard":"codama",').when(F.col("event_type") == "view", '"metadata":{"origin":"shank"},').otherwise("")
    docs = e.select(F.col("event_id").alias("file"), F.concat(F.lit("{"), extra, F.lit('"name":"'), k, F.lit('"}')).alias("text"))
    return readers.idl_facts(docs).select("file", "name", "format")


@query("""
with k as (select event_id, (props->>'k')::int as k, event_type as t, event_id % 5 as m from events)
select event_id, case when k < 50 then 'InstructionMissing' else 'AccountReallocExceedsLimit' end as name from k where m <= 1 union all
select event_id, case when t = 'error' then 'reject: malformed' when t = 'view' then 'reject: no evidence' else 'reject: discriminator' end from k where m = 2 and t in ('error', 'view', 'click') union all
select event_id, 'InstructionMissing' from k where (m = 2 and t not in ('error', 'view', 'click')) or (m >= 3 and k % 13 < 8)""")
def s3_invocations(spark, sf_dir):
    from factloom.operators import preflight

    k = F.get_json_object("props", "$.k").cast("int")
    single = F.lit('{"instruction":{"dataLen":3}}')
    listed = F.lit('{"invocations":[{"reallocs":[{"requestedDataIncrease":10241}]}]}')
    # two forms of good documents, one whose length comes from the row, and three kinds that are rejected
    bad = F.when(F.col("event_type") == "error", '{"instruction":').when(F.col("event_type") == "view", '{"note":1}')
    bad = bad.when(F.col("event_type") == "click", '{"accounts":[{"expectedDiscriminator":"xyz"}]}').otherwise(single)
    length = F.concat(F.lit('{"invocations":[{"instruction":{"dataLen":'), (k % 13).cast("string"), F.lit("}}]}"))
    m = F.col("event_id") % 5
    text = F.when((m <= 1) & (k < 50), single).when(m <= 1, listed).when(m == 2, bad).otherwise(length)
    good, rejected = readers.read_invocations(_t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), text.alias("text")))
    out = preflight.preflight(good).select(F.col("id").alias("event_id"), "name")
    return out.unionByName(rejected.select(F.col("id").alias("event_id"), F.concat(F.lit("reject: "), "reason").alias("name")))


@query("""
select s_suppkey, array_to_string(list_filter([case when s_suppkey % 7 = 0 then 'name' end, case when s_nationkey % 2 = 0 then 'repo' end, case when s_suppkey % 3 <> 0 then 'sha' end,
  case when s_acctbal < 0 then 'license' end], lambda x: x is not null), ',') as failures from supplier""")
def s8_manifest(spark, sf_dir):
    sha = F.when(F.col("s_suppkey") % 3 == 0, F.substring(F.sha2(F.col("s_name"), 256), 1, 40)).when(F.col("s_suppkey") % 3 == 1, "head")
    repo = F.concat(F.when(F.col("s_nationkey") % 2 == 0, "git://").otherwise("https://"), F.lit("host/r"))
    name = F.when(F.col("s_suppkey") % 7 == 0, F.col("s_name")).otherwise(F.replace("s_name", F.lit("#"), F.lit("-")))
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"), repo.alias("repo"), sha.alias("sha"), F.when(F.col("s_acctbal") >= 0, "MIT").alias("license"))
    return readers.corpus_manifest(rows).select("s_suppkey", F.array_join("failures", ",").alias("failures"))


@query(_findings_sql() + """
select file, '{"rows":[' || string_agg('{"start_line":' || start_line || ',"code":"' || code || '"}', ',' order by start_line, code) || '],"totals":{"rows":' || count(*)
  || ',"errors":' || count(*) filter (severity = 'error') || '}}' as report from f group by file""")
def s11_report(spark, sf_dir):
    return sinks.to_report(line_findings(spark, sf_dir), "file", ["start_line", "code"], {"errors": F.col("severity") == "error"})


@query("""
select c_custkey as k, coalesce(p.o, c_mktsegment) as segment, c_acctbal as balance from customer left join (select o_custkey, max(o_orderpriority) as o from orders where o_orderstatus = 'P' group by all) p on p.o_custkey = c_custkey""")
def u6_merge(spark, sf_dir):
    base = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    patch = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderpriority").alias("segment"))
    return drift.merge_evidence(base, patch, "k")


@query("""
select event_id from events e where event_type = 'view' and not exists (select 1 from events c where c.event_type = 'click' and c.user_id = e.user_id and c.ts <= e.ts and c.ts >= e.ts - interval 2 hour and e.value <= c.value + 20 and c.value <= e.value + 20)""")
def t4_recent(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("file"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("start"), (F.col("value") + 20).alias("end"))
    return updates.suppress_recent(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ttl="2 hours").select("event_id")


@query("select l_orderkey, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'P') group by all")
def t7_changed(spark, sf_dir):
    changed = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return updates.changed_only(_t(spark, sf_dir, "lineitem"), changed, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""
with h as (select file, line, text, min((length(text) > 40)::int) over (partition by file order by line rows between unbounded preceding and 1 preceding) as m from (
  select doc_id as file, unnest(string_split(text, chr(10))) as text, unnest(range(len(string_split(text, chr(10))))) as line from documents))
select file, count(*) as n from h where coalesce(m, 1) = 1 group by file""")
def w5_header(spark, sf_dir):
    out = findings.in_header(lines_of(_t(spark, sf_dir, "documents")), F.length("text") > 40)
    return out.filter("leading").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, epoch_us(min(l_shipdate)) as first_us from lineitem group by all having max(l_quantity) > 45 and count(*) filter (l_returnflag = 'R') = 0 and min(l_shipdate) is not null")
def a10_close(spark, sf_dir):
    out = guards.close_rule(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_shipdate"), F.lit(True), F.col("l_quantity") > 45, F.col("l_returnflag") == "R")
    return out.select("l_orderkey", _micros("first_mutation").alias("first_us"))
