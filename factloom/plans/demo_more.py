"""Registered queries of the operators that the other two modules do not reach, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import artifacts, constraints, drift, findings, graph, guards, preflight, references, reports, rules, telemetry
from factloom.plans.demo import _EVENTS_SQL, _INVOCATION_SQL, _by_day, _findings_sql, _t, call_edges, invocations_of, line_findings, lines_of, query
from factloom.plans.demo_rules import _keys
from factloom.sources import readers, sinks
from factloom.sources.staging import new_path, staged
from factloom.streaming import keyed, updates


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = _t(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


# --- sources and sinks ------------------------------------------------------------------------------


@query("""
select source, count(*) as lines, sum(strlen(t) + 1)::bigint as bytes
from (select source, unnest(string_split(text, chr(10))) as t from documents where source is not null) group by source""")
def s1_sources(spark, sf_dir):
    path = new_path(spark, "sources")
    lines = lines_of(_t(spark, sf_dir, "documents")).filter("source is not null").select("source", "text")
    lines.write.partitionBy("source").option("lineSep", "\n").text(path)
    files = readers.read_sources(spark, path, "*.txt").withColumn("source", F.regexp_extract("file", "source=([^/]+)/", 1))
    each = files.select("source", "bytes", (F.size(F.split("text", "\n")) - 1).alias("lines"))
    return each.groupBy("source").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


@query("select n_name, count(c_custkey) as customers from nation left join customer on c_nationkey = n_nationkey group by n_name")
def s4_catalog(spark, sf_dir):
    path = new_path(spark, "catalog")
    _t(spark, sf_dir, "nation").write.json(path)
    catalog = readers.load_catalog(spark, path, "n_nationkey int, n_name string, n_regionkey int", lines=True)
    joined = catalog.join(_t(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


@query("""
select distinct o_custkey as file, 'dependency' as kind, o_orderpriority as name from orders
union all select distinct o_custkey, 'feature', o_orderstatus from orders""")
def s5_manifests(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file"))
    manifests = o.agg(
        F.map_from_entries(F.collect_set(F.struct("o_orderpriority", F.lit("1")))).alias("deps"), F.collect_set("o_orderstatus").alias("features")
    )
    deps, features = readers.manifest_facts(manifests)
    return deps.select("file", F.lit("dependency").alias("kind"), F.col("dependency").alias("name")).unionByName(features.select("file", F.lit("feature").alias("kind"), F.col("feature").alias("name")))


@query("""
with e as (select event_id as file, case when event_id % 10 = 0 then 'too short' when event_type = 'error' then 'magic' when event_type = 'view' and value <= 50 then 'class'
  when event_type = 'view' then 'endian' when event_type = 'signup' and value > 90 then 'version' when user_id % 3 = 0 then 'machine' end as reason, user_id % 256 as u from events)
select file, case when reason is null then 'present' else 'invalid' end as state, reason, case when reason is null then u end as entry, case when reason is null then file % 200 end as sections from e""")
def s7_elf(spark, sf_dir):
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    kind, value, zeros = F.col("event_type"), F.col("value"), lambda n: "00" * n
    text = _text(
        F.when(kind == "error", "7F454C47").otherwise("7F454C46"),
        F.when((kind == "view") & (value <= 50), "01").otherwise("02"),
        F.when(kind == "view", "02").otherwise("01"),
        F.when((kind == "signup") & (value > 90), "00").otherwise("01"),
        zeros(9), "0300", F.when(F.col("user_id") % 3 == 0, "3E00").otherwise("F700"), "01000000",
        byte(F.col("user_id") % 256), zeros(7), zeros(28), byte(F.col("event_id") % 200), zeros(3),
    )
    text = F.when(F.col("event_id") % 10 == 0, F.substring(text, 1, 60)).otherwise(text)
    files = _t(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.unhex(text).alias("content"))
    return readers.elf_facts(files)


@query(_findings_sql() + " select file, start_line, start_char, code, severity from f")
def s9_findings_sink(spark, sf_dir):
    path = new_path(spark, "findings")
    rows = line_findings(spark, sf_dir).select("file", "start_line", "start_char", "code", "severity")
    sinks.write_findings(rows, path)
    return spark.read.schema(rows.schema).json(path)


def _in_parts(df: DataFrame, part: Column, parts: int = 3):
    """A stream's folder that gets the rows of ``df`` in appends by their number ``part``; yields the stream after each."""
    path = new_path(df.sparkSession, "arriving")
    for i in range(parts):
        df.filter(part == i).write.mode("append").parquet(path)
        yield df.sparkSession.readStream.schema(df.schema).parquet(path)


def _half(ts: str, last: Column) -> Column:
    """0 for the first half of January 2024, 1 for what comes later, 2 for the rows that only end a stream."""
    return F.when(last, 2).when(F.dayofmonth(ts) <= 15, 0).otherwise(1)


def _third(number: str) -> Column:
    return F.pmod(F.floor(F.col(number) / 1000), F.lit(3))


@query("""
with e as (select *, event_id // 1000 % 3 as part from events), l as (select user_id, max(part) as part from e group by all)
select user_id as file, event_type as code, count(*) as n from e join l using (user_id, part) where event_type <> 'view' group by all""")
def s12_stream_sink(spark, sf_dir):
    """Three starts of one stream; a user's last part replaces those before, and views only clear."""
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("code"), F.col("event_id").alias("line"))
    path = new_path(spark, "stream-findings")
    for stream in _in_parts(rows, _third("line")):
        sinks.stream_findings(stream, path)
    return sinks.read_stream_findings(spark, path, rows.schema).groupBy("file", "code").agg(F.count(F.lit(1)).alias("n"))


# --- findings ---------------------------------------------------------------------------------------


@query("""
select o_orderpriority as config, case left(o_orderpriority, 1) when '1' then 'error' when '2' then 'warn' when '3' then 'warn' when '4' then 'off' end as level, count(*) as n
from orders group by all""")
def f4_levels(spark, sf_dir):
    first = F.substring("o_orderpriority", 1, 1)
    word = F.when(first == "1", "error").when(first == "2", "warning").when(first == "3", "true").when(first == "4", "disabled").otherwise("loud")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("config"), findings.level_of(word).alias("level"))
    return rows.groupBy("config", "level").agg(F.count(F.lit(1)).alias("n"))


@query(_findings_sql() + """, s as (select *, case code when 'email' then 'hint' when 'hex' then null when 'phone' then 'warning' else severity end as sev from f)
select file, start_line, code, sev as severity from s where sev is not null and code <> 'pipe'""")
def f3_settings(spark, sf_dir):
    """codes switched off by a condition and by a level, severities by configured levels."""
    rows = line_findings(spark, sf_dir).withColumn("config_key", F.concat_ws(".", "topic", "code"))
    levels = spark.createDataFrame([("pii.email", "hint"), ("pii.hex", "disabled"), ("pii.phone", "warning"), ("legal.licence", "nonsense")], "config_key string, level string")
    return findings.apply_settings(rows, F.col("code") == "pipe", levels).select("file", "start_line", "code", "severity")


@query(_findings_sql() + " select file, start_line, code from f where not (code = 'email' or topic like 'style%' and severity = 'hint' and confidence = 'low')")
def f3_classes(spark, sf_dir):
    """three classes of codes, two of them switched off."""
    classes = {"pii": F.col("code") == "email", "style": F.col("topic").startswith("style") & (F.col("confidence") == "low"), "legal": F.col("topic") == "legal"}
    off = findings.switched_off({"pii": False, "style": False, "legal": True}, classes)
    return findings.apply_settings(line_findings(spark, sf_dir), off).select("file", "start_line", "code")


@query("""
with r as (select c_nationkey as root, min(case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 end) as k from customer where c_acctbal > 9500 group by all)
select page_id as file, case k when 0 then 'first' when 1 then 'second' else case when contains(html, 'lang="de"') then 'first' when contains(html, 'lang="fr"') or contains(url, '/es/') and contains(html, '/es/') then 'third' else 'unknown' end end as framework
from pages left join r on root = page_id % 25""")
def f1_frameworks(spark, sf_dir):
    """by a root's dependencies, else by hints in the text."""
    files = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), (F.col("page_id") % 25).cast("int").alias("root"), F.concat(F.when(F.col("url").contains("/es/") & F.col("html").contains("/es/"), "spanish ").otherwise(""), "html").alias("text"))
    deps = _t(spark, sf_dir, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("root"), F.col("c_mktsegment").alias("dependency"))
    out = references.classify_framework(files, deps, [("first", ["BUILDING"]), ("second", ["MACHINERY"])], [("first", ['lang="de"']), ("third", ['lang="fr"', "spanish "])])
    return out.select("file", "framework")


_DIRECTIVES = {"click": "// allow: style.case, pii", "view": "// allow-file: legal", "error": "// ignore", "signup": "// ignore-file"}


def _comment_lines(spark, sf_dir) -> DataFrame:
    """One line an event of a user: a directive, or code for a purchase."""
    from pyspark.sql import Window as W

    text = F.lit("let x = 1;")
    for kind, line in _DIRECTIVES.items():
        text = F.when(F.col("event_type") == kind, line).otherwise(text)
    number = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("file"), number.alias("line"), text.alias("text"))


def _directives(spark, sf_dir) -> DataFrame:
    comment = F.col("text").startswith("//")
    return findings.extract_directives(_comment_lines(spark, sf_dir), "allow: ", "allow-file: ", "ignore", "ignore-file", comment, comment)


_DIRECTIVES_SQL = """
with r as (select user_id as file, (row_number() over (partition by user_id order by event_id) - 1)::int as line, event_type as t from events),
h as (select *, coalesce(bool_and(t <> 'purchase') over (partition by file order by line rows between unbounded preceding and 1 preceding), true) as header from r),
d as (select file, null::int as line, 'legal' as pattern from h where t = 'view' union select file, null, '*' from h where t = 'signup' and header
  union select file, line + k, p from h, unnest([0, 1]) as a(k), unnest(['style.case', 'pii']) as b(p) where t = 'click'
  union select file, line + k, '*' from h, unnest([0, 1]) as a(k) where t = 'error')"""


@query(_DIRECTIVES_SQL + " select file, line, pattern from d")
def f7_directives(spark, sf_dir):
    return _directives(spark, sf_dir)


@query(_DIRECTIVES_SQL + """, g as (select file, line, t, case when line % 2 = 0 then 'style.case' else 'legal' end as topic from h)
select file, line, topic from g where not exists (select 1 from d where d.file = g.file and (d.line is null or d.line = g.line)
  and (d.pattern = '*' or d.pattern = g.topic)) and not (line >= 10 and line < 20 and topic = 'legal')""")
def w6_suppressed(spark, sf_dir):
    """F7, W6, J22 and J23 together: findings on all lines against the lines' own directives and a range for each file."""
    lines = _comment_lines(spark, sf_dir)
    topic = F.when(F.col("line") % 2 == 0, "style.case").otherwise("legal")
    rows = lines.select("file", F.col("line").alias("start_line"), F.lit(0).alias("start_char"), F.col("line").alias("end_line"), F.lit(1).alias("end_char"), F.lit(0).alias("rule_seq"), F.lit(0).alias("emit_seq"), topic.alias("topic"))
    rows = rows.withColumns({"code": F.lit("c"), "rule": F.lit("lines/r")})
    packed = lambda n: F.lit(n * (1 << 20)).cast("long")
    ranges = lines.select("file").distinct().select("file", packed(10).alias("start"), (packed(20) - 1).alias("end"), F.lit("legal").alias("pattern"))
    out = findings.suppress(rows, _directives(spark, sf_dir), ranges)
    return out.select("file", F.col("start_line").alias("line"), "topic")


@query("""
with u as (select distinct o_custkey as package, o_orderpriority as feature from orders),
d as (select c_custkey as package, unnest(case when c_custkey % 3 <> 0 then ['1-URGENT', '5-LOW'] when n_regionkey = 0 then ['2-HIGH'] else ['3-MEDIUM', '5-LOW'] end) as feature
  from customer join nation on n_nationkey = c_nationkey)
select package, feature from u where not exists (select 1 from d where d.package = u.package and d.feature = u.feature)""")
def f22_features(spark, sf_dir):
    uses = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderpriority").alias("feature"))
    own = F.when(F.col("c_custkey") % 3 != 0, F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    packages = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("package"), F.col("c_nationkey").alias("workspace"), own.alias("features"))
    inherited = F.when(F.col("n_regionkey") == 0, F.array(F.lit("2-HIGH"))).otherwise(F.array(F.lit("3-MEDIUM"), F.lit("5-LOW")))
    return constraints.missing_features(uses, packages, _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("workspace"), inherited.alias("features")))


@query("select page_id, url from pages where page_id % 3 <> 1")
def f24_links(spark, sf_dir):
    branch = F.when(F.col("page_id") % 3 == 0, "main").when(F.col("page_id") % 3 == 1, "v1.2").otherwise("HEAD")
    kind = F.when(F.col("page_id") % 2 == 0, "blob").otherwise("tree")
    lines = _t(spark, sf_dir, "pages").select("page_id", "url", _text("see https://host/r/", kind, "/", branch, "/src/x.rs of ", F.col("url")).alias("text"))
    return findings.unpinned_links(lines).select("page_id", "url")


@query("""
with t as (select l_orderkey as c, l_linenumber as n, l_returnflag as f, l_linestatus as s, l_quantity as q from lineitem)
select c as l_orderkey, n as l_linenumber, case when bool_or(f = 'A') then 'mint-target-type' else 'token-target-type' end as issue from t where f <> 'N' and s = 'O' group by all""")
def f19_targets(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    key = F.when(F.col("l_returnflag") == "R", "token::authority").when(F.col("l_returnflag") == "A", "mint::decimals").otherwise("space")
    kind = F.when(F.col("l_linestatus") == "O", "Other").when(F.col("l_returnflag") == "A", "Mint").otherwise("TokenAccount")
    rows = lines.select(F.col("l_orderkey").alias("container"), F.col("l_linenumber").alias("field"), kind.alias("type_name"), _keys([key]).alias("keys"))
    targets = spark.createDataFrame([("token::", ["TokenAccount"], "token-target-type"), ("mint::", ["Mint"], "mint-target-type")], "prefix string, types array<string>, issue string")
    return constraints.token_targets(rows, targets).select(F.col("container").alias("l_orderkey"), F.col("field").alias("l_linenumber"), "issue")


@query("""
with p as (select l_orderkey as c, l_linenumber as n, max(l_returnflag) as f from lineitem group by all),
o as (select p.c, p.n, q.n as program, q.f as t from p join p q on q.c = p.c and q.n = p.n + 1 where q.f <> 'R'),
x as (select distinct l_orderkey as c, l_linenumber as n from lineitem where l_linestatus = 'O' and l_quantity > 25)
select c as l_orderkey, n as l_linenumber, 'override:' || t as issue from o union all select c, n, 'mint::,token::' from x""")
def f19_programs(spark, sf_dir):
    """a program override that names no token program, and keys of two exclusive families."""
    lines = _t(spark, sf_dir, "lineitem")
    each = lines.groupBy(F.col("l_orderkey").alias("container"), F.col("l_linenumber").alias("n")).agg(F.max("l_returnflag").alias("type_name"))
    name = lambda c: F.concat(F.lit("f"), c)
    named = each.select("container", F.col("n").alias("field"), _keys([F.lit("token::token_program")], [name(F.col("n") + 1)]).alias("keys"))
    wrong = constraints.program_overrides(named, each.select("container", name(F.col("n")).alias("name"), "type_name"), "token::token_program", ["R"])
    both = _keys([F.when(F.col("l_linestatus") == "O", "token::mint"), F.when(F.col("l_quantity") > 25, "mint::decimals")])
    mixed = constraints.exclusive_groups(lines.select(F.col("l_orderkey").alias("container"), F.col("l_linenumber").alias("field"), both.alias("keys")), [("token::", "mint::")])
    out = wrong.select("container", "field", F.concat(F.lit("override:"), "type_name").alias("issue")).unionByName(mixed.select("container", "field", F.col("families").alias("issue")))
    return out.select(F.col("container").alias("l_orderkey"), F.col("field").alias("l_linenumber"), "issue")


@query("""
select o_orderkey, case when o_orderstatus = 'F' then 'init' else 'init_if_needed' end as "left" from orders where o_custkey % 2 = 0 and o_orderstatus <> 'P'""")
def f14_self_payers(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "init").when(F.col("o_orderstatus") == "O", "init_if_needed").otherwise("mut")
    payer = F.when(F.col("o_custkey") % 2 == 0, "acct").otherwise("user")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("container"), F.lit("acct").alias("field"), _keys([kind, F.lit("payer")], [F.lit(None), payer]).alias("keys"))
    return constraints.key_conflicts(rows, []).select(F.col("container").alias("o_orderkey"), "left")


@query("""
select o_orderkey, 'type' as issue from orders where o_orderstatus = 'O' and o_orderpriority <> '1-URGENT' union all
select o_orderkey, 'payer' from orders where o_orderstatus = 'P' and o_totalprice < 200000""")
def f17_init_if_needed(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("container", F.col("o_orderkey"))
    created = o.filter("o_orderstatus = 'O'").select("container", F.lit("f").alias("field"), _keys([F.lit("init_if_needed")]).alias("keys"))
    paid = o.filter("o_orderstatus = 'P'").select("container", F.lit("p").alias("field"), _keys([F.lit("payer")], [F.lit("q")]).alias("keys"))
    payers = o.filter("o_orderstatus = 'P' and o_totalprice >= 200000").select("container", F.lit("q").alias("field"), _keys([F.lit("init_if_needed")]).alias("keys"))
    typed = o.select("container", F.lit("f").alias("name"), F.when(F.col("o_orderpriority") == "1-URGENT", "Account").otherwise("Other").alias("type_name"))
    declared = typed.unionByName(o.select("container", F.lit("q").alias("name"), F.lit("Account").alias("type_name")))
    out = constraints.lifecycle_requirements(created.unionByName(paid).unionByName(payers), declared, ["Account"])
    return out.select(F.col("container").alias("o_orderkey"), "issue")


@query("""
select n_regionkey as scope, n_name as name, 'sysvar' as issue from nation where n_nationkey % 4 = 1 union all
select s_nationkey, min(s_suppkey::varchar), 'fallback' from supplier where s_acctbal > 5000 group by s_nationkey having count(*) > 1""")
def f23_sysvars(spark, sf_dir):
    """wrong sysvar generics and more than one fallback."""
    generic = F.when(F.col("n_nationkey") % 4 == 1, "Other").otherwise("Clock")
    fields = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("container"), F.col("n_name").alias("name"), F.lit("Sysvar").alias("type_name"), F.array(generic).alias("generics"))
    functions = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").cast("string").alias("name"), (F.col("s_acctbal") > 5000).alias("is_fallback"))
    out = constraints.shape_checks(fields, functions, fields.select("name").limit(0), ["Account"], ["Clock", "Rent"])
    return out.select("scope", "name", "issue")


# --- references and guards --------------------------------------------------------------------------


@query("""
with u as (select distinct p_type as context, 'Brand#' || l_suppkey % 30 as account from lineitem join part on p_partkey = l_partkey),
f as (select distinct p_type as c, p_brand as n, case when p_size > 40 then 'STANDARD' else 'Account' end as t from part),
v as (select c, n from f union select f.c, g.n from f join f g on g.c = f.t)
select context, account from u where not exists (select 1 from v where v.c = u.context and v.n = u.account)""")
def j3_unknown_usages(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    usages = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("fn"), _text("Brand#", (F.col("l_suppkey") % 30).cast("string")).alias("account"))
    functions = part.select(F.col("p_partkey").alias("fn"), F.col("p_type").alias("context"))
    fields = part.select(F.col("p_type").alias("container"), F.col("p_brand").alias("name"), F.when(F.col("p_size") > 40, "STANDARD").otherwise("Account").alias("type_name"))
    return references.unknown_usages(usages, functions, fields)


@query("""
with r as (select distinct l_orderkey as k, 'p.' || l_partkey % 20 as name, l_quantity > 25 as is_program from lineitem),
d as (select l_orderkey as k, (l_partkey % 20)::varchar as name from lineitem where l_returnflag = 'R'),
a as (select l_orderkey as k, 'p.' || l_partkey % 20 as name from lineitem where l_linestatus = 'O')
select k as scope, name, is_program from r where not exists (select 1 from d where d.k = r.k and 'p.' || d.name = r.name)
  and not exists (select 1 from r q join a on a.k = q.k and a.name = q.name where q.is_program and q.k = r.k and q.name = r.name)""")
def j3_alternatives(spark, sf_dir):
    """J1 and J3 with dotted names and with constants or arguments that count for programs."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scope"), (F.col("l_partkey") % 20).cast("string").alias("n"), "l_quantity", "l_returnflag", "l_linestatus")
    refs = lines.select("scope", _text("p.", F.col("n")).alias("name"), (F.col("l_quantity") > 25).alias("is_program")).distinct()
    decls = lines.filter("l_returnflag = 'R'").select("scope", F.col("n").alias("name"))
    others = lines.filter("l_linestatus = 'O'").select("scope", _text("p.", F.col("n")).alias("name"))
    return references.missing_refs(refs, decls, ["scope"], alternatives=others).select("scope", "name", "is_program")


@query(_EVENTS_SQL + """, u as (select distinct day, user_id from e where event_type = 'purchase' and value <= 150),
c as (select day, user_id from e where (event_type = 'click' and value > 50) or event_type = 'signup')
select day, user_id from u where user_id % 3 <> 0 and day % 7 <> 0 and not exists (select 1 from c where c.day = u.day and c.user_id = u.user_id)""")
def j12_unvalidated(spark, sf_dir):
    e = _by_day(spark, sf_dir).select(F.col("day").alias("context"), F.col("user_id").alias("account"), "event_type", "value")
    uses = e.filter("event_type = 'purchase'").select("context", "account", (F.col("value") > 150).alias("truncated"))
    kind = lambda c: F.when(c, "static").otherwise("account")
    zero = F.lit(0).cast("long")
    clicks = e.filter("event_type = 'click'").select("context", F.col("account").alias("left"), zero.alias("right"), F.lit("account").alias("left_kind"), kind(F.col("value") > 50).alias("right_kind"))
    signups = e.filter("event_type = 'signup'").select("context", zero.alias("left"), F.col("account").alias("right"), F.lit("static").alias("left_kind"), F.lit("account").alias("right_kind"))
    fields = e.select(F.col("context").alias("container"), F.col("account").alias("name")).distinct()
    fields = fields.withColumns({"type_name": F.lit("Unchecked"), "keys": F.array_compact(F.array(F.when(F.col("name") % 3 == 0, "address")))})
    cut = e.filter("context % 7 = 0").select("context")
    out = guards.unvalidated_program(uses, clicks.unionByName(signups), fields, ["Unchecked"], ["address", "owner"], cut)
    return out.select(F.col("context").alias("day"), F.col("account").alias("user_id"))


@query("""
select distinct l_orderkey, l_suppkey from lineitem x where l_linestatus = 'O' and l_returnflag <> 'R'
and exists (select 1 from lineitem u where u.l_orderkey = x.l_orderkey and u.l_suppkey = x.l_suppkey and u.l_quantity > 25)""")
def j12b_unchecked_program(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    keys = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "owner")))
    fields = lines.select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("name"), F.when(F.col("l_linestatus") == "O", "Unchecked").otherwise("Signer").alias("type_name"), keys.alias("keys"))
    usages = lines.select(F.col("l_orderkey").alias("file"), F.col("l_suppkey").alias("account"), F.when(F.col("l_quantity") > 25, "cpi_program").otherwise("read").alias("kind"))
    out = guards.unchecked_program(fields, usages, ["Unchecked"], ["address", "owner", "executable", "constraint"])
    return out.select(F.col("file").alias("l_orderkey"), F.col("name").alias("l_suppkey")).distinct()


@query("""
with t as (select l_suppkey % 10 as scope, 'n' || l_partkey % 40 as name, case when l_returnflag <> 'N' then l_returnflag end as owner, l_linestatus = 'O' as call, l_quantity as q from lineitem),
v as (select distinct scope, name from t where q > 45), m as (select case p_size % 2 when 0 then 'R' else 'A' end as owner, 'n' || p_partkey % 40 as name, max(p_size) > 45 as is_method from part where p_size < 49 group by all),
x as (select t.scope, t.name, t.owner, t.call, case when t.owner is null then case when v.name is null then 'identifier' end
  when m.is_method is null then case when t.call then 'method' else 'member' end when t.call and not m.is_method then 'field_as_method' end as issue
  from t left join v on v.scope = t.scope and v.name = t.name left join m on m.owner = t.owner and m.name = t.name)
select scope, name, owner as owner_type, issue, count(*) as n from x where issue is not null group by all""")
def j12c_expressions(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    tokens = lines.select(
        F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 10).alias("scope"), _text("n", (F.col("l_partkey") % 40).cast("string")).alias("name"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("owner_type"), (F.col("l_linestatus") == "O").alias("call"), "l_quantity",
    )
    owner = F.when(F.col("p_size") % 2 == 0, "R").otherwise("A").alias("owner_type")
    members = _t(spark, sf_dir, "part").filter("p_size < 49").groupBy(owner, _text("n", (F.col("p_partkey") % 40).cast("string")).alias("name")).agg((F.max("p_size") > 45).alias("is_method"))
    out = references.expression_issues(tokens, tokens.filter("l_quantity > 45").select("scope", "name"), members)
    return out.groupBy("scope", "name", "owner_type", "issue").agg(F.count(F.lit(1)).alias("n"))


@query("""
select distinct user_id as file, event_id % 50 as start_line, event_id % 7 as start_char from events where event_type = 'click' and (user_id % 5 = 3 or value > 190)""")
def j25_argument_refs(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    place = [F.col("event_type").alias("context"), F.col("user_id").alias("file"), (F.col("event_id") % 50).alias("start_line"), (F.col("event_id") % 7).alias("start_char")]
    plain = e.select(_text("u", (F.col("user_id") % 5).cast("string")).alias("name"), *place)
    marked = e.select(_text("_u", (F.col("user_id") % 5).cast("string")).alias("name"), *place)
    high = e.filter("value > 190").select(F.lit("__u3").alias("name"), *place)
    return references.argument_refs([plain, marked, high], "click", "_u3")


@query("""
with f as (select n_regionkey as root, n_nationkey as k, case n_nationkey % 3 when 0 then 'crate::m' || n_nationkey when 1 then 'crate::a::m' || n_nationkey else 'crate' end as m from nation),
d as (select f.root, f.m, s_name as name from f join supplier on s_nationkey = k),
p as (select distinct n_regionkey as root, case n_nationkey % 3 when 0 then 'crate::m' || n_nationkey when 1 then 'crate::m' || n_nationkey else 'crate' end as m, s_name as name
  from nation join supplier on s_nationkey = n_nationkey or s_nationkey = n_nationkey + 1)
select root, m || '::' || name as path from p where exists (select 1 from d where d.root = p.root and d.m = p.m and d.name = p.name)""")
def j26_paths(spark, sf_dir):
    """Files of two depths and crate roots; paths that miss the folder, or name another file's symbol, are not found."""
    nation, supplier = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "supplier")
    k, third = F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 3
    file = F.when(third == 0, _text("p/src/m", k, ".rs")).when(third == 1, _text("p/src/a/m", k, "/mod.rs")).otherwise("src/lib.rs")
    files = nation.select(F.col("n_regionkey").alias("root"), "n_nationkey", file.alias("file"))
    decls = files.join(supplier, F.col("s_nationkey") == F.col("n_nationkey")).select("root", "file", F.col("s_name").alias("name"))
    module = F.when(third < 2, _text("crate::m", k)).otherwise("crate")
    near = nation.select(F.col("n_regionkey").alias("root"), module.alias("m"), F.explode(F.array(F.col("n_nationkey"), F.col("n_nationkey") + 1)).alias("s_nationkey"))
    paths = near.join(supplier, "s_nationkey").select("root", _text(F.col("m"), "::", F.col("s_name")).alias("path"))
    return references.path_exists(paths, files, decls)


@query("select distinct o_custkey, o_orderpriority from orders")
def o6_sorted_unique(spark, sf_dir):
    return references.sorted_unique(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"])


@query("""
with s as (select l_orderkey as k, bool_and(l_linestatus = 'O') as st from lineitem group by all),
f as (select l_orderkey as k, arg_min('f' || l_suppkey, (l_partkey, l_suppkey)) as scope from lineitem where l_returnflag = 'R' group by all)
select k as l_orderkey, scope as scope_field from s left join f using (k) where st""")
def f11_hints(spark, sf_dir):
    """static-only addresses with the first sibling field of a scoping type."""
    lines = _t(spark, sf_dir, "lineitem")
    seed = F.when(F.col("l_linestatus") == "O", F.lit('b"open"')).otherwise(F.lit("f()"))
    pda = lines.groupBy(F.col("l_orderkey").alias("container")).agg(F.collect_list(seed).alias("seeds")).withColumns({"seed_kind": F.lit("list"), "bump_kind": F.lit("missing")})
    fields = lines.select(F.col("l_orderkey").alias("container"), _text("f", F.col("l_suppkey").cast("string")).alias("name"), F.col("l_returnflag").alias("type_name"), F.struct("l_partkey", "l_suppkey").alias("ordinal"))
    return constraints.static_seed_hints(pda, fields, ["R"]).select(F.col("container").alias("l_orderkey"), "scope_field")


@query("""
with p as (select p_partkey as k, p_size as z, p_partkey % 7 as d, p_partkey % 5 as y, p_partkey % 4 as i from part)
select k, case when d = 0 then 'deploy_missing' when d = 1 then 'deploy_invalid' end as issue from p where d <= 1 union all
select k, case when y = 0 then 'keypair_missing' when y = 1 then 'keypair_invalid' else 'keypair_mismatch' end from p where (y = 0 and d >= 2) or y in (1, 2) union all
select k, case when i = 0 then 'idl_missing' when i = 1 then 'idl_invalid' when z > 25 then 'idl_name' else 'idl_address' end from p where i in (0, 1) or (i >= 2 and (z > 25 or i = 2)) union all
select k, 'types_missing' from p where z <= 10""")
def j17_states(spark, sf_dir):
    """Every state and mismatch of the four artifacts."""
    part = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    artifact = lambda kind, state, key, name, address: F.struct(F.lit(kind).alias("kind"), state.alias("state"), key.cast("string").alias("public_key"), name.cast("string").alias("idl_name"), address.cast("string").alias("idl_address"))
    three = lambda c: F.when(c == 0, "missing").when(c == 1, "invalid").otherwise("present")
    none = F.lit(None)
    each = F.array(
        artifact("deploy", three(k % 7), none, none, none),
        artifact("keypair", three(k % 5), F.when(k % 5 == 2, "other").otherwise("id"), none, none),
        artifact("idl", three(k % 4), none, F.when(F.col("p_size") > 25, "other").otherwise(_text(' "my-', k.cast("string"), '"')), F.when(k % 4 == 2, "other").otherwise("id")),
        artifact("types", F.when(F.col("p_size") <= 10, "missing").otherwise("present"), none, none, none),
    )
    name = _text("my_", k.cast("string"))
    rows = part.select(F.lit("r").alias("root"), name.alias("program"), F.explode(each).alias("_")).select("root", "program", "_.*")
    out = artifacts.artifact_findings(part.select(F.lit("r").alias("root"), name.alias("name"), F.lit("id").alias("program_id")), rows)
    return out.select(F.substring("name", 4, 20).cast("long").alias("k"), "issue")


@query("""
with s as (select s_suppkey as k, case s_suppkey % 5 when 0 then s_name when 1 then sha256(s_name) when 2 then upper(sha256(s_name)) else sha256(s_name) end as e,
  case when s_suppkey % 5 = 3 then sha256('x') else sha256(s_name) end as a from supplier)
select k, case when k % 9 = 7 then 'unexpected' when k % 11 = 3 then 'missing' when k % 5 in (0, 2) then 'malformed' else 'mismatch' end as drift from s
where k % 9 = 7 and k % 11 <> 3 or k % 9 <> 7 and (k % 11 = 3 or k % 5 in (0, 2, 3))""")
def u2_malformed(spark, sf_dir):
    s, k = _t(spark, sf_dir, "supplier"), F.col("s_suppkey")
    sha = F.sha2("s_name", 256)
    want = F.when(k % 5 == 0, F.col("s_name")).when(k % 5 == 2, F.upper(sha)).otherwise(sha)
    have = F.when(k % 5 == 3, F.sha2(F.lit("x"), 256)).otherwise(sha)
    return drift.lock_drift(s.filter(k % 9 != 7).select(k.alias("k"), want.alias("sha256")), s.filter(k % 11 != 3).select(k.alias("k"), have.alias("sha256")), ["k"])


@query("""
with r as (select o_orderkey as k, o_custkey % 3 as c, o_orderstatus as st from orders)
select k as review, 'signoff' as failure from r where not (st = 'F' and c <> 1) union all
select k, 'timestamp' from r where c = 2 union all select k, 'order' from r where c = 1""")
def a22_signoffs(spark, sf_dir):
    """Missing sign-offs of two roles, missing and reversed times."""
    o, c = _t(spark, sf_dir, "orders"), F.col("o_custkey") % 3
    start = F.col("o_orderdate").cast("timestamp")
    end = F.when(c == 0, start + F.expr("interval 40 days")).when(c == 1, start - F.expr("interval 3 days"))
    reviews = o.select(F.col("o_orderkey").alias("review"), start.alias("started"), end.alias("ended"), F.when(c == 0, 40).when(c == 1, -3).alias("declared_days"))
    owner = o.filter(c != 1).select(F.col("o_orderkey").alias("review"), F.lit("owner").alias("role"))
    second = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("review"), F.lit("reviewer").alias("role"))
    return telemetry.review_checks(reviews, owner.unionByName(second), ["owner", "reviewer"])


@query("""
with f as (select s_nationkey as k, sum(case s_suppkey % 3 when 0 then 8 when 1 then 1 + 4 * 3 else 4 + 10 end)::bigint as b from supplier group by all),
r as (select n_regionkey as r, count(*) as n, count(b) as m, sum(2 * b + 1)::bigint as b from nation left join f on k = n_nationkey group by all)
select 'n' || k as container, b as bytes from f union all select 'r' || r, case when n = m then b else -1 end from r union all select 'e', 9 union all select 'loop', -1""")
def a17_nested(spark, sf_dir):
    """Nested structs, arrays, vectors, options, an enum and a recursive struct."""
    kind = F.col("s_suppkey") % 3
    none = F.lit(None).cast("int")
    row = lambda container, type_name, optional=F.lit(False), enum=F.lit(False), count=none, most=none: [container.alias("container"), type_name.alias("type_name"), optional.alias("optional"), enum.alias("is_enum_variant"), count.alias("count"), most.alias("max_len")]
    own = _t(spark, sf_dir, "supplier").select(*row(_text("n", F.col("s_nationkey").cast("string")), F.when(kind == 0, "u64").when(kind == 1, "u32").otherwise("u8"), kind == 1, count=F.when(kind == 1, 3), most=F.when(kind == 2, 10)))
    outer = _t(spark, sf_dir, "nation").select(*row(_text("r", F.col("n_regionkey").cast("string")), _text("n", F.col("n_nationkey").cast("string")), F.lit(True), count=F.lit(2)))
    enum = spark.range(2).select(*row(F.lit("e"), F.when(F.col("id") == 0, "u64").otherwise("u8"), enum=F.lit(True)))
    loop = spark.range(1).select(*row(F.lit("loop"), F.lit("loop")))
    sizes = spark.createDataFrame([("u8", 1), ("u32", 4), ("u64", 8)], "type_name string, bytes int")
    out = artifacts.estimate_space(own.unionByName(outer).unionByName(enum).unionByName(loop), sizes, depth=3)
    return out.select("container", F.coalesce("bytes", F.lit(-1).cast("long")).alias("bytes"))


@query("""
with c as (select s_nationkey as k, 'MakeS' || s_suppkey % 4 as o from supplier group by all), n as (select k, count(*) as n, min(o) as o from c group by all)
select c_custkey, case when exists (select 1 from c where c.k = c_nationkey and c.o = 'MakeS' || c_custkey % 4) then 'MakeS' || c_custkey % 4 when n.n = 1 then n.o end as context
from customer left join n on n.k = c_nationkey""")
def j7_names(spark, sf_dir):
    """The context of the Pascal-case name, else the only one."""
    contexts = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), _text("MakeS", (F.col("s_suppkey") % 4).cast("string")).alias("name")).distinct()
    functions = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file"), _text("make_s", (F.col("c_custkey") % 4).cast("string")).alias("name"), "c_custkey")
    found = references.infer_context(functions.select("file", "name").distinct(), contexts)
    return functions.join(found, ["file", "name"], "left").select("c_custkey", "context")


@query(_findings_sql() + """, g as (select file, start_line, topic, code, rule_seq from f union all select file, start_line, topic, code, rule_seq + 10 from f where severity = 'error')
select file, start_line, code, min(rule_seq) as rule_seq, count(*) as n from (select *, row_number() over (partition by file, start_line, code order by rule_seq) as p from g) where p = 1 group by file, start_line, code""")
def w2_dedupe(spark, sf_dir):
    """Findings that two rules report, the first kept."""
    rows = line_findings(spark, sf_dir).withColumns({"message": F.col("code"), "start_char": F.lit(0), "end_char": F.lit(0)})
    again = rows.filter("severity = 'error'").withColumn("rule_seq", F.col("rule_seq") + 10)
    out = findings.dedupe(rows.unionByName(again))
    return out.groupBy("file", "start_line", "code").agg(F.min("rule_seq").alias("rule_seq"), F.count(F.lit(1)).alias("n"))


# --- graph ------------------------------------------------------------------------------------------

_CONTEXTS_SQL = """
with recursive e as (select distinct user_id as src, dst from (
  select user_id, lead(user_id) over (partition by epoch_us(ts) // 86400000000 order by ts, event_id) as dst from events where event_type = 'error') where dst is not null),
fn as (select distinct user_id as name, user_id % 5 as context, user_id % 4 = 0 as ins from events),
s as (select name as source from fn where ins),
r as (select source, source as name, 0 as depth from s union select r.source, e.dst, r.depth + 1 from r join e on e.src = r.name where r.depth < 3),
c as (select distinct fn.context, r.name from r join fn on fn.name = r.source and fn.ins)"""


def _functions(spark, sf_dir) -> DataFrame:
    u = _t(spark, sf_dir, "events").select(F.col("user_id").alias("name")).distinct()
    return u.select("name", (F.col("name") % 5).alias("context"), (F.col("name") % 4 == 0).alias("is_program_instruction"))


@query(_CONTEXTS_SQL + " select context, name from c")
def g4_context_reach(spark, sf_dir):
    return graph.context_reachable(_functions(spark, sf_dir), call_edges(spark, sf_dir), 3)


@query(_CONTEXTS_SQL + """, w as (select c.context, c.name, fn.ins from c join fn on fn.name = c.name and fn.context = c.context)
select distinct 'with start' as mode, w.context, event_id % 100 as account from w join events on user_id = w.name where event_type = 'click'
union all select distinct 'without', w.context, event_id % 100 from w join events on user_id = w.name where event_type = 'click' and not ins""")
def g5_reachable_usages(spark, sf_dir):
    functions = _functions(spark, sf_dir)
    reach = graph.context_reachable(functions, call_edges(spark, sf_dir), 3)
    usages = _t(spark, sf_dir, "events").select(F.col("user_id").alias("fn"), (F.col("event_id") % 100).alias("account"), F.col("event_type").alias("kind"))
    run = lambda mode, start: graph.reachable_usages(reach, usages, functions, "click", start).select(F.lit(mode).alias("mode"), "context", "account")
    return run("with start", True).unionByName(run("without", False))


# --- reports, totals, rules -------------------------------------------------------------------------


@query(_INVOCATION_SQL + """, d as (select distinct event_id // 50 as run, name, event_id from hits)
select run, name, string_agg(event_id::varchar, ',' order by event_id) as invocations, count(*) as n_invocations from d group by all""")
def a2_report(spark, sf_dir):
    """One report for every fifty invocations, so no list grows with the table."""
    detected = preflight.preflight(invocations_of(_t(spark, sf_dir, "events"))).withColumn("run", F.floor(F.col("id") / 50))
    return preflight.preflight_report(detected, ["run"]).withColumn("invocations", F.array_join("invocations", ","))


@query(_findings_sql() + """, t as (select source, topic, severity, file from f join (select distinct file, source from l) using (file))
select source, count(*) as findings, count(*) filter (severity = 'error') as errors, count(*) filter (topic = 'pii') as pii, count(*) filter (topic = 'legal') as legal,
  count(*) filter (topic like 'style%') as style, count(distinct file) as files from t group by rollup (source)""")
def a3_totals(spark, sf_dir):
    """A3: counters and counts by topic of each corpus, and of all (null)."""
    names = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "source")
    rows = line_findings(spark, sf_dir).join(names, "file")
    return telemetry.static_totals(rows, "source", {"errors": F.col("severity") == "error", "pii": F.col("topic") == "pii", "legal": F.col("topic") == "legal", "style": F.col("topic").startswith("style")})


@query("""
with u as (select o_custkey as account, bool_or(o_orderstatus = 'O') as mutable, string_agg(distinct case when o_totalprice > 200000 then o_orderstatus end, ',' order by case when o_totalprice > 200000 then o_orderstatus end) as findings
  from orders where o_orderpriority = '1-URGENT' group by all)
select account, mutable, c_mktsegment as declared_type, findings from u left join customer on c_custkey = account and c_custkey % 2 = 0""")
def a21_focused(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("container"), F.col("o_custkey").alias("account"), F.col("o_orderstatus").alias("code"), "o_totalprice")
    fields = _t(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.lit("1-URGENT").alias("container"), F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("type_name"))
    out = reports.focused_report(o.withColumn("mutable", F.col("code") == "O"), fields, o.filter("o_totalprice > 200000"), "1-URGENT")
    return out.withColumn("findings", F.array_join("findings", ","))


REGISTRY = rules.Registry()


@REGISTRY.rule("lines/shout", "semantic", ("core",), "style.case", "low")
def _shout(facts):
    return facts["lines"].filter(F.col("text").rlike("[A-Z]{6,}")).select("file", "line")


@REGISTRY.rule("lines/mail", "security", ("core", "web"), "pii", "high")
def _mail(facts):
    return facts["lines"].filter(F.col("text").contains("@")).select("file", "line")


@REGISTRY.rule("lines/long", "syntax", ("core",), "style.length", "medium")
def _long(facts):
    return facts["lines"].filter(F.length("text") > 400).select("file", "line")


@REGISTRY.rule("lines/artifact", "artifact", ("core",), "artifact", "medium")
def _artifact(facts):
    return facts["lines"].select("file", "line")


@query("""
with l as (select file, unnest(t) as text, unnest(range(len(t)))::int as line from (select doc_id as file, string_split(text, chr(10)) as t from documents))
select file, line, 0 as rule_seq, 'lines/long' as rule, 'style.length' as topic, 'medium' as confidence from l where length(text) > 400 union all
select file, line, 1, 'lines/shout', 'style.case', 'low' from l where regexp_matches(text, '[A-Z]{6,}') union all
select file, line, 2, 'lines/mail', 'pii', 'high' from l where contains(text, '@')""")
def x1_registry(spark, sf_dir):
    """Registered rules of a framework up to a phase, in order of phase, as one plan."""
    lines = lines_of(_t(spark, sf_dir, "documents"))
    return REGISTRY.findings({"lines": lines}, "core", "security").select("file", "line", "rule_seq", "rule", "topic", "confidence")


@query(_findings_sql() + " select file, start_line, code, rule_seq from f where code in ('hex', 'caps') union all select file, start_line, 'all', 7 from f where severity = 'error'")
def u3_union(spark, sf_dir):
    """Rules that share one scan of the lines, whose findings are written once."""
    rows = staged(line_findings(spark, sf_dir).filter("code in ('hex', 'caps') or severity = 'error'").select("file", "start_line", "code", "severity"), "scan")
    own = lambda code: rows.filter(F.col("code") == code).select("file", "start_line", "code")
    errors = rows.filter("severity = 'error'").select("file", "start_line", F.lit("all").alias("code"))
    none = rows.limit(0).select("file", "start_line", "code")
    out = findings.collect_findings([none, own("hex"), none, none, own("caps"), none, none, errors])
    return out.select("file", "start_line", "code", "rule_seq")


@query("""
with s as (select distinct 'p/' || (page_id % 3) || '/q/' || (page_id % 40) as path from pages),
r as (select distinct 'p/' || (doc_id % 3) || '/q/' || (doc_id % 23) as path from documents where doc_id % 3 <> 1 union all select 'p/1/*' union all select 'x/*')
select path from s where not exists (select 1 from r where r.path = s.path or (right(r.path, 2) = '/*' and starts_with(s.path, left(r.path, -1))))""")
def a20_coverage(spark, sf_dir):
    """Sources that no row covers, by its path or a wildcard above it."""
    path = lambda c, n: _text("p/", (F.col(c) % 3).cast("string"), "/q/", (F.col(c) % n).cast("string")).alias("path")
    rows = _t(spark, sf_dir, "documents").filter("doc_id % 3 <> 1").select(path("doc_id", 23))
    wild = spark.createDataFrame([("p/1/*",), ("x/*",)], "path string")
    return telemetry.source_coverage(rows.unionByName(wild), _t(spark, sf_dir, "pages").select(path("page_id", 40)))


@query("""
select l_orderkey as target, round(sum(l_linenumber * (l_quantity::int * 60)) / 3600.0, 2) as hours, count(*) filter (l_returnflag = 'N') as failed, count(*) filter (l_linestatus = 'O') as off from lineitem group by all""")
def a15_fuzz(spark, sf_dir):
    """Hours and failures of each target's runs."""
    lines, hours = _t(spark, sf_dir, "lineitem"), F.col("shards") * F.col("seconds_per_shard") / 3600
    runs = lines.select(
        F.col("l_orderkey").alias("target"), F.when(F.col("l_returnflag") == "N", "failed").otherwise("passed").alias("status"), F.col("l_linenumber").alias("shards"),
        (F.col("l_quantity").cast("int") * 60).alias("seconds_per_shard"), F.col("l_linestatus").alias("s"),
    )
    runs = runs.withColumn("fuzz_hours", F.when(F.col("s") == "O", hours + 1).otherwise(hours))
    _, failures = telemetry.fuzz_rollup(runs)
    each = runs.groupBy("target").agg(F.round(F.sum(F.col("shards") * F.col("seconds_per_shard")) / 3600, 2).alias("hours"))
    counted = failures.groupBy("target").agg(F.count_if(F.col("failure") == "status").alias("failed"), F.count_if(F.col("failure") == "hours").alias("off"))
    return each.join(counted, "target", "left").select("target", "hours", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("off", F.lit(0)).alias("off"))


# --- column functions -------------------------------------------------------------------------------


@query("""
select event_id, floor((event_id + 0.5) * case event_type when 'click' then 1 when 'view' then 1000 when 'error' then 1000000 when 'signup' then 1000000000 end + 0.5)::bigint as nanos from events""")
def c1_durations(spark, sf_dir):
    kind = F.col("event_type")
    unit = F.when(kind == "click", "ns").when(kind == "view", "µs").when(kind == "error", " ms").when(kind == "signup", "s").otherwise("h")
    return _t(spark, sf_dir, "events").select("event_id", scalars.duration_nanos(_text(F.col("event_id").cast("string"), ".5", unit)).alias("nanos"))


@query("""
select event_id, case event_type when 'click' then hex('k' || event_id) when 'view' then '610A' || hex(event_id::varchar) when 'error' then '7F22' || hex(event_id::varchar) end as bytes,
  case event_type when 'click' then hex('k' || event_id) || '2D' when 'view' then '610A' || hex(event_id::varchar) || '2D' when 'error' then '7F22' || hex(event_id::varchar) || '2D' else '' end as prefix from events""")
def c4_literals(spark, sf_dir):
    """Escapes, opaque literals, and the prefix up to the first of these."""
    n, kind = F.col("event_id").cast("string"), F.col("event_type")
    literal = F.when(kind == "click", _text('b"k', n, '"')).when(kind == "view", _text('b"a\\n', n, '"')).when(kind == "error", _text('b"\\x7f\\"', n, '"')).when(kind == "signup", _text('b"\\q', n, '"')).otherwise(_text('"', n, '"'))
    seeds = F.array(literal, F.lit("b'-'"), F.lit("seed()"), F.lit('b"never"'))
    return _t(spark, sf_dir, "events").select("event_id", scalars.byte_literal(literal).alias("bytes"), scalars.literal_prefix(seeds).alias("prefix"))


@query("""
with k as (select event_id, rpad('K' || replace(event_id::varchar, '0', case when event_id % 3 = 0 then '0' else 'z' end), (20 + event_id % 40)::int, 'a') as key from events)
select event_id, regexp_full_match(key, '[1-9A-HJ-NP-Za-km-z]{32,44}') as is_key from k""")
def c9_base58(spark, sf_dir):
    mark = F.when(F.col("event_id") % 3 == 0, "0").otherwise("z")
    key = F.rpad(F.concat(F.lit("K"), F.replace(F.col("event_id").cast("string"), F.lit("0"), mark)), (20 + F.col("event_id") % 40).cast("int"), F.lit("a"))
    return _t(spark, sf_dir, "events").select("event_id", scalars.is_base58_key(key).alias("is_key"))


@query("""
with s as (select o_orderkey, o_orderstatus, o_orderdate as a, max(l_shipdate) + interval 7 hour as b from orders join lineitem on l_orderkey = o_orderkey group by all)
select o_orderkey, case when o_orderstatus <> 'P' then floor((epoch_us(b) - epoch_us(a)) / 86400000000)::bigint end as days, case when o_orderstatus <> 'P' then (epoch_us(b) - epoch_us(a)) / 3600000000 end as hours from s""")
def c10_elapsed(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    each = o.groupBy("o_orderkey", "o_orderstatus", "o_orderdate").agg(F.max("l_shipdate").alias("b"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    a, b = iso(F.col("o_orderdate")), F.when(F.col("o_orderstatus") == "P", "soon").otherwise(iso(F.col("b") + F.expr("interval 7 hours")))
    return each.select("o_orderkey", scalars.elapsed_days(a, b).alias("days"), scalars.elapsed_hours(a, b).alias("hours"))


@query("select page_id, page_id % 4 <> 0 and page_id % 3 <> 0 and page_id % 7 <> 0 as proof from pages")
def c11_urls(spark, sf_dir):
    n = F.col("page_id")
    scheme, host = F.when(n % 4 == 0, "http").otherwise("https"), F.when(n % 7 == 0, "host-example").otherwise("host.example")
    url = _text(scheme, "://", host, "/a", n.cast("string"), F.when(n % 3 == 0, "").otherwise("/runs/1"), F.when(n % 2 == 0, "/#top").otherwise(""))
    return _t(spark, sf_dir, "pages").select("page_id", scalars.is_proof_url(url, "host.example").alias("proof"))


@query("select p_partkey, case p_size % 3 when 0 then 'Box' when 1 then p_type else 'T' || p_size end as type_name from part")
def c12_types(spark, sf_dir):
    size = F.col("p_size")
    text = F.when(size % 3 == 0, _text(" Box<", F.col("p_type"), ">")).when(size % 3 == 1, _text("&mut crate::m::", F.col("p_type"), "<'info, x::Y>")).otherwise(_text("&a::T", size.cast("string")))
    return _t(spark, sf_dir, "part").select("p_partkey", scalars.primary_type(text).alias("type_name"))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(len(string_split(text, chr(10)))))::int as line from documents),
w as (select doc_id, line, len(list_filter(string_split(t, ' '), lambda x: x = 'the')) as n from l)
select doc_id, line, n from w where n > 0""")
def c14_spaced(spark, sf_dir):
    """C14: hits of a word with a space (or the line's border) on both sides, all of a line's."""
    lines = lines_of(_t(spark, sf_dir, "documents")).select(F.col("file").alias("doc_id"), "line", F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"))
    hits = lines.select("doc_id", "line", "text", F.explode(scalars.word_hits(F.col("text"), "the")).alias("h"))
    inside = F.substr("text", F.col("h.start_char"), F.lit(5)) == " the "
    return hits.filter(inside).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


# --- references, tokens and shapes by every branch --------------------------------------------------


@query("""
with o as (select distinct o_custkey as k, o_orderstatus as s from orders)
select c_custkey as name, case when c_custkey in (select k from o where s = 'P') then 'found' when c_custkey in (select k from o where s = 'F') and c_nationkey % 5 = 0 then 'found'
  when c_custkey in (select k from o) then 'exists' when c_nationkey % 2 = 1 then 'silent' else 'missing' end as state from customer""")
def j6_context(spark, sf_dir):
    """A context that is found here or in the workspace, exists underived, may be elsewhere, or is missing."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), "o_orderstatus")
    uses = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), (F.col("c_nationkey") % 2 == 0).alias("sees"), "c_nationkey")
    near = o.filter("o_orderstatus = 'F'").join(uses.filter("c_nationkey % 5 = 0").select("name"), "name", "left_semi")
    local = o.filter("o_orderstatus = 'P'")
    return references.resolve_context(uses, local.select("name").distinct(), near.select("name").distinct(), o.select("name").distinct(), F.col("sees")).select("name", "state")


@query("""
with f as (select user_id as container, event_id % 20 as name, case when bool_or(event_type = 'view') then 'Account' else 'Signer' end as type_name, bool_or(event_id % 7 = 0) as is_init from events where event_type in ('view', 'click') group by all),
h as (select distinct user_id as container from events where user_id % 2 = 0 and user_id % 3 <> 0 and user_id in (select user_id from events where event_type = 'signup' and value > 5)),
u as (select distinct user_id as container, event_id % 20 as name from events where event_type = 'error' and value > 60 and user_id % 4 = 0),
m as (select container, name from u semi join f using (container, name) where container in (select container from h)),
b as (select distinct container, name from f where type_name = 'Account' and not is_init and container in (select container from h))
select container, name from b where (container, name) in (select (container, name) from m) or container not in (select container from m)""")
def j10_missing_init(spark, sf_dir):
    """Two gates, and only the changed fields where a handler changes any."""
    e = _t(spark, sf_dir, "events").withColumns({"container": F.col("user_id"), "name": F.col("event_id") % 20})
    fields = e.filter("event_type in ('view', 'click')").groupBy("container", "name").agg(
        F.when(F.bool_or(F.col("event_type") == "view"), "Account").otherwise("Signer").alias("type_name"), F.bool_or(F.col("event_id") % 7 == 0).alias("is_init")
    )
    handlers = e.filter("user_id % 2 = 0").select("container", F.col("container").alias("handler")).distinct()
    gates = [e.filter("user_id % 3 <> 0"), e.filter("event_type = 'signup' and value > 5")]
    usages = e.filter("event_type = 'error'").select(F.col("user_id").alias("handler"), F.col("name").alias("account"), ((F.col("value") > 60) & (F.col("user_id") % 4 == 0)).alias("mutable"))
    return references.missing_init(fields, handlers, usages, gates, ["Account"])


@query("""
with r as (select l_orderkey as file, p_name as name, case when l_linenumber % 2 = 1 then 'struct' else 'function' end as kind, l_returnflag as container from lineitem join part on p_partkey = l_partkey),
d as (select p_name as name, case when p_size % 3 = 0 then 'struct' else 'function' end as kind from part where p_size > 20)
select 'type' as role, name, count(*) as n from r where kind = 'struct' and name in (select name from d where kind = 'struct') and name like 'red%' group by name
union all select 'inside', name, count(*) from r where kind = 'function' and container = 'A' and name in (select name from d where kind = 'function') and name like 'red%' group by name
union all select 'implementation', (user_id % 5)::varchar, count(*) from events where event_type = 'purchase' and user_id % 5 in (1, 3) group by all""")
def j24_lookups(spark, sf_dir):
    """Type references, references inside a container, and implementations of contexts."""
    part = _t(spark, sf_dir, "part")
    symbols = part.filter("p_size > 20").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "struct").otherwise("function").alias("kind"))
    lines = _t(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    refs = lines.select(F.col("l_orderkey").alias("file"), F.col("p_name").alias("name"), F.when(F.col("l_linenumber") % 2 == 1, "struct").otherwise("function").alias("kind"), F.col("l_returnflag").alias("container"))
    asked = part.filter("p_name like 'red%'").select(F.col("p_name").alias("name"), F.lit("A").alias("container"))
    functions = _t(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("context"), F.col("event_id").alias("name"), F.col("user_id").alias("file"), F.lit(False).alias("is_open"), (F.col("event_type") == "purchase").alias("is_program_instruction"))
    contexts = spark.createDataFrame([(1,), (3,)], "context long")
    count = lambda df, role, name: df.groupBy(name.cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(role).alias("role"), "name", "n")
    types = count(references.references_of(symbols, refs, asked, ["struct"]), "type", F.col("name"))
    inside = count(references.references_of(symbols, refs, asked, ["function"], container=True), "inside", F.col("name"))
    return types.unionByName(inside).unionByName(count(references.implementations(functions, contexts), "implementation", F.col("context")))


@query("""
with c as (select l_orderkey as container, l_linenumber as field, case l_returnflag when 'A' then 'n' when 'R' then '9' else 'other' end as v from lineitem)
select distinct container, field, v as argument, o_orderpriority as type_name from c join orders on o_orderkey = container where v = 'n' and o_orderpriority <> '1-URGENT'""")
def f19_decimals(spark, sf_dir):
    """a value that names an argument of another type; literals and unknown names are silent."""
    value = F.when(F.col("l_returnflag") == "A", "n").when(F.col("l_returnflag") == "R", "9").otherwise("other")
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("container"), F.col("l_linenumber").alias("field"), _keys([F.lit("mint::decimals")], [value]).alias("keys"))
    arguments = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("container"), F.lit("n").alias("name"), F.col("o_orderpriority").alias("type_name"))
    return constraints.argument_types(rows, arguments, "mint::decimals", ["1-URGENT"])


@query("""
with c as (select l_orderkey as container, l_linenumber as field, case when l_quantity > 25 then 'Account' else 'Interface' end as type_name, case l_linestatus when 'O' then 'Mint' else 'Other' end as data_type,
  'p' || l_linenumber % 3 as program from lineitem where l_returnflag = 'A'),
p as (select o_orderkey as container, 'p' || (o_orderkey % 3) as name, o_orderstatus <> 'F' as extended from orders)
select distinct container, field, program, case when not extended then 'program' else 'wrapper' end as issue from c join p using (container) where program = name and (not extended or type_name = 'Account' and data_type = 'Mint')""")
def f19_extensions(spark, sf_dir):
    """extensions with a program that takes none, or token data in the plain wrapper."""
    lines = _t(spark, sf_dir, "lineitem")
    keys = _keys([F.when(F.col("l_returnflag") == "A", "extensions::close_authority").otherwise("mint::decimals"), F.lit("token::token_program")], [F.lit("x"), F.concat(F.lit("p"), (F.col("l_linenumber") % 3).cast("string"))])
    kind, data = F.when(F.col("l_quantity") > 25, "Account").otherwise("Interface"), F.when(F.col("l_linestatus") == "O", "Mint").otherwise("Other")
    rows = lines.select(F.col("l_orderkey").alias("container"), F.col("l_linenumber").alias("field"), kind.alias("type_name"), data.alias("data_type"), keys.alias("keys"))
    programs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("container"), F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")).alias("name"), (F.col("o_orderstatus") != "F").alias("extended"))
    return constraints.extension_programs(rows, programs, "extensions::", ["mint::token_program", "token::token_program"], "Account", ["Mint", "TokenAccount"])


@query("""
select distinct l_orderkey as container, l_linenumber as field, 'h' as target, o_orderpriority as type_name from lineitem join orders on o_orderkey = l_orderkey
where l_returnflag = 'R' and o_orderpriority <> '1-URGENT' and not (o_orderpriority = '2-HIGH' and o_orderstatus = 'F')""")
def f19_hooks(spark, sf_dir):
    """a hook that names a field that is no program; guarded unchecked fields pass."""
    name = F.when(F.col("l_returnflag") == "R", "h").when(F.col("l_returnflag") == "A", "unknown")
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("container"), F.col("l_linenumber").alias("field"), _keys([F.lit("hook")], [name]).alias("keys"))
    fields = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("container"), F.lit("h").alias("name"), F.col("o_orderpriority").alias("type_name"), _keys([F.when(F.col("o_orderstatus") == "F", "executable").otherwise("mut")]).alias("keys"))
    return constraints.hook_programs(rows, fields, "hook", ["1-URGENT"], ["2-HIGH"], ["executable", "address"])


@query("""
select user_id as file, event_id as name, case when event_type in ('view', 'click') then 'generic' else 'return' end as issue from events
where event_id % 3 <> 0 and not (event_type = 'view' and value > 50) and not (event_type = 'click' and value > 90)""")
def f23_returns(spark, sf_dir):
    """handlers whose return is another type, none, or a Result without a type; functions without a context pass."""
    kind = F.col("event_type")
    args = F.when((kind == "view") & (F.col("value") > 50), F.array(F.lit("()"))).when((kind == "click") & (F.col("value") > 90), F.array(F.lit("T"))).when(kind == "view", F.array().cast("array<string>"))
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("name"), (F.col("event_id") % 3 != 0).alias("takes_context"), F.when(kind.isin("view", "click"), "Result").when(kind == "error", "u64").alias("return_type"), args.alias("return_args"))
    return constraints.bad_returns(rows)


@query(_findings_sql() + """, r as (select code, min((file::varchar, start_line, start_char)) as p, arg_min(topic, (file::varchar, start_line, start_char)) as topic, arg_min(confidence, (file::varchar, start_line, start_char)) as confidence from f group by code)
select '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"factloom","version":"2","informationUri":"https://tool.example","rules":['
  || string_agg('{"id":"' || code || '","name":"' || topic || '","shortDescription":{"text":"' || code || '"},"helpUri":"https://docs.example/' || topic || '","properties":{"topic":"' || topic || '","confidence":"' || confidence || '","applicability":"review"}}', ',' order by p, code)
  || ']}}}]}' as json from r""")
def s10_header(spark, sf_dir):
    """The header of a run, its rules in the order of their first findings."""
    more = {"message": F.col("code"), "file": F.col("file").cast("string"), "docs_url": F.concat(F.lit("https://docs.example/"), "topic"), "applicability": F.lit("review")}
    rules, _ = sinks.sarif_rows(line_findings(spark, sf_dir).withColumns(more))
    return sinks.sarif_header(rules, "factloom", "2", "https://tool.example")


@query("""
with c as (select distinct p_brand, p_name as candidate, p_size % 4 as kind from part where p_size <= 25),
m as (select distinct p_brand, p_name as name, p_size % 4 as wanted from part where p_size > 40),
n as (select m.*, candidate, kind, levenshtein(name, candidate) as distance, case when wanted = 0 then 0 when kind = wanted then 0 when kind > wanted then 1 else 2 end as r from m join c using (p_brand))
select p_brand, name, wanted, candidate, kind, distance::int as distance, rank from (
  select *, row_number() over (partition by p_brand, name, wanted order by r, distance, candidate, kind)::int as rank from n) where rank <= 4""")
def o1_roles(spark, sf_dir):
    """O1: the nearest candidates by how well their kind fits, then by edit distance."""
    part = _t(spark, sf_dir, "part").withColumn("size4", F.col("p_size") % 4)
    candidates = part.filter("p_size <= 25").select("p_brand", F.col("p_name").alias("candidate"), F.col("size4").alias("kind")).distinct()
    missing = part.filter("p_size > 40").select("p_brand", F.col("p_name").alias("name"), F.col("size4").alias("wanted")).distinct()
    role = F.when((F.col("wanted") == 0) | (F.col("kind") == F.col("wanted")), 0).when(F.col("kind") > F.col("wanted"), 1).otherwise(2)
    out = references.closest(missing, candidates, ["p_brand"], 4, role, "kind")
    return out.select("p_brand", "name", "wanted", "candidate", "kind", "distance", "rank")


# --- streams ----------------------------------------------------------------------------------------


@query("""
with e as (select *, event_id // 1000 % 3 as part from events), l as (select user_id, max(part) as part from e group by all)
select user_id, max(event_id) as event_id from e join l using (user_id, part) group by user_id having arg_max(event_type, event_id) <> 'error'""")
def t1_stream_upsert(spark, sf_dir):
    """Three starts of one stream on one table; the latest row of a user's last part stays, unless it removes the user."""
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    path = new_path(spark, "index")
    for stream in _in_parts(rows, _third("event_id")):
        out = updates.run_upserts(spark, stream, path, "user_id", [F.col("event_id")], F.col("event_type") == "error")
    return out.select("user_id", "event_id")


@query("""
with v as (select user_id, max(event_id) as v from events where event_type = 'click' group by all)
select event_id from events left join v using (user_id) where event_type <> 'click' and (v is null or event_id >= v)""")
def t2_stream_drop_stale(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    current = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("version"))
    stream = _stream(spark, sf_dir, "events").filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("version"))
    return updates.run_files(updates.drop_stale(stream, current, "user_id"), new_path(spark, "fresh")).select(F.col("version").alias("event_id"))


@query("""
with e as (select event_id, user_id, event_type = 'click' as announces, case when event_id % 11 > 0 then (event_id * 7 + user_id) % 40 + event_id // 500 end as version from events),
m as (select *, max(case when announces then version end) over (partition by user_id order by event_id rows unbounded preceding) as newest from e)
select event_id, version from m where not announces and (version is null or newest is null or version >= newest)""")
def t2_stream_guard(spark, sf_dir):
    """Announcements and results in one stream; what an earlier batch announced drops results of later ones."""
    e = _t(spark, sf_dir, "events")
    version = F.when(F.col("event_id") % 11 > 0, (F.col("event_id") * 7 + F.col("user_id")) % 40 + F.floor(F.col("event_id") / 500))
    rows = e.select(F.col("user_id").alias("key"), F.timestamp_seconds(F.col("event_id") + 1_700_000_000).alias("ts"), F.col("event_id").alias("seq"), version.alias("version"), (F.col("event_type") != "click").alias("is_result"))
    top = e.agg(F.max("event_id")).first()[0]
    path = new_path(spark, "guarded")
    for stream in _in_parts(rows, F.floor(F.col("seq") * 3 / (top + 1))):
        out = updates.run_files(keyed.guard_versions(stream), path)
    return out.select(F.col("seq").alias("event_id"), "version")


@query("""
with e as (select user_id as key, epoch_us(ts) // 1000 as t, event_id as seq, case event_type when 'error' then 'cancel' when 'signup' then 'flush' else 'schedule' end as kind from events),
n as (select *, lead(t) over w as next_t, lead(kind) over w as next_kind, lag(t) over w as last_t, lag(kind) over w as last_kind from e window w as (partition by key order by t, seq)),
b as (select *, sum(case when last_kind = 'schedule' and t < last_t + 21600000 then 0 else 1 end) over (partition by key order by t, seq rows unbounded preceding) as burst from n),
g as (select key, burst, min(t) as first, count(*) as n, max(t) as t, arg_max(seq, [t, seq]) as seq, arg_max(coalesce(next_t, 9000000000000000), [t, seq]) as next_t, arg_max(coalesce(next_kind, 'end'), [t, seq]) as next_kind from b where kind = 'schedule' group by all)
select key as user_id, first, case when next_t < t + 21600000 then next_t else t + 21600000 end as fired, seq::varchar as payload, n
from g where next_t >= t + 21600000 or next_kind = 'flush'""")
def t3_stream_debounce(spark, sf_dir):
    """Bursts of schedules that fire six hours after their last, at once on a flush, and not after a cancel."""
    kind = F.when(F.col("event_type") == "error", "cancel").when(F.col("event_type") == "signup", "flush").otherwise("schedule")
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").cast("string").alias("payload"))
    end = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.timestamp_seconds(F.lit(4102444800)).alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit("cancel").alias("kind"), F.lit(None).cast("string").alias("payload"))
    path = new_path(spark, "bursts")
    for stream in _in_parts(rows.unionByName(end), _half("ts", F.col("key") == -1)):
        out = updates.run_files(keyed.debounce_commands(stream, 6 * 3_600_000), path)
    return out.withColumnRenamed("key", "user_id")


@query("""
select event_id from events e where event_type = 'view' and not exists (select 1 from events c where c.event_type = 'click' and c.user_id = e.user_id and c.ts <= e.ts and c.ts >= e.ts - interval 2 hour and e.value <= c.value + 20 and c.value <= e.value + 20)""")
def t4_stream_recent(spark, sf_dir):
    """T4 as two streams: findings that no recent change touches come out when both watermarks have passed them."""
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").alias("file"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("start"), (F.col("value") + 20).alias("end"))
    end = spark.range(2).select(F.lit(-1).cast("long").alias("event_id"), F.when(F.col("id") == 0, "view").otherwise("click").alias("event_type"), F.lit(-1).cast("long").alias("file"), F.timestamp_seconds(F.lit(4102444800)).alias("ts"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"))
    rows = e.unionByName(end)
    path = new_path(spark, "touched")
    part = _half("ts", F.col("file") == -1)
    for found, changed in zip(_in_parts(rows.filter("event_type = 'view'"), part), _in_parts(rows.filter("event_type = 'click'"), part), strict=True):
        out = updates.run_files(updates.suppress_recent(found, changed, ttl="2 hours"), path)
    return out.filter("event_id >= 0").select("event_id")


@query("select 'hot' as lane, event_id from events where event_id % 4 <= 1 union all select 'cold', event_id from events")
def t5_lanes(spark, sf_dir):
    stream = _stream(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("phase"))
    each = [updates.run_files(lane, new_path(spark, name)).select(F.lit(name).alias("lane"), "event_id") for name, lane in zip(("hot", "cold"), updates.lanes(stream), strict=True)]
    return each[0].unionByName(each[1])
