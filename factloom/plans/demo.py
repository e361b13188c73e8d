"""The registered queries of the evidence operators: facts shaped from the given tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import artifacts, constraints, drift, findings, graph, guards, preflight, references, reports, telemetry
from factloom.sources import readers, sinks
from factloom.sources.staging import new_path
from factloom.streaming import updates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name with the SQL that gives the same rows."""

    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


# --- facts shaped from the tables -------------------------------------------------------------------


def invocations_of(events: DataFrame) -> DataFrame:
    """One invocation an event."""
    e = F.col("event_id")
    third = F.when(e % 3 == 1, "0000000000000000").when(e % 3 == 2, "00000000000000a1")
    null = lambda t: F.lit(None).cast(t)
    instruction = F.struct(
        (e % 12).alias("dataLen"),
        (F.col("event_type") != "error").alias("deserializes"),
        (F.col("event_type") != "view").alias("discriminatorMatchesKnownInstruction"),
        (F.col("value") > 50).alias("fallbackSupported"),
        F.concat(F.lit("p"), F.col("user_id") % 7).alias("expectedProgramId"),
        F.concat(F.lit("p"), F.col("user_id") % 5).alias("providedProgramId"),
        (e % 4).alias("expectedAccountCount"),
        (F.col("user_id") % 4).alias("providedAccountCount"),
    )

    def account(length, expected, actual, owner, holder, initialized, reads, zero):
        names = ("dataLen", "expectedDiscriminator", "actualDiscriminator", "expectedOwner", "actualOwner", "initialized", "deserializes", "expectedZeroDiscriminatorForInit")
        return F.struct(*[c.alias(n) for n, c in zip(names, (length, expected, actual, owner, holder, initialized, reads, zero), strict=True)])

    first = account(
        F.floor("value") % 16, F.lit("00000000000000a1"), third, F.lit("o1"), F.concat(F.lit("o"), F.col("user_id") % 2),
        e % 5 != 0, F.when(e % 2 == 1, F.col("event_type") != "signup"), e % 6 == 0,
    )
    second = account(F.lit(8).cast("long"), null("string"), null("string"), null("string"), null("string"), F.when(e % 11 == 0, F.lit(False)), null("boolean"), null("boolean"))
    grown = F.array(F.struct(((e * 37) % 12000).alias("requestedDataIncrease")))
    rows = events.select("ts", e.alias("id"), e.alias("index"), F.struct(instruction.alias("instruction"), F.array(first, second).alias("accounts"), grown.alias("reallocs")).alias("invocation"))
    return rows


_INVOCATION_SQL = """
with e as (select *, event_id % 3 as m, case event_id % 3 when 1 then '0000000000000000' when 2 then '00000000000000a1' end as act,
  floor(value)::bigint % 16 as al from events),
hits as (
  select event_id, ts, 'InstructionMissing' as name from e where event_id % 12 < 8
  union all select event_id, ts, 'InstructionFallbackNotFound' from e where event_id % 12 >= 8 and event_type = 'view' and not value > 50
  union all select event_id, ts, 'InstructionDidNotDeserialize' from e where event_id % 12 >= 8 and event_type = 'error'
  union all select event_id, ts, 'InvalidProgramId' from e where event_id % 12 >= 8 and user_id % 7 <> user_id % 5
  union all select event_id, ts, 'AccountNotEnoughKeys' from e where event_id % 12 >= 8 and user_id % 4 < event_id % 4
  union all select event_id, ts, 'AccountDiscriminatorAlreadySet' from e where event_id % 6 = 0 and act <> '0000000000000000'
  union all select event_id, ts, 'AccountNotInitialized' from e where event_id % 5 = 0 or event_id % 11 = 0
  union all select event_id, ts, 'AccountOwnedByWrongProgram' from e where user_id % 2 <> 1
  union all select event_id, ts, 'AccountDiscriminatorNotFound' from e where al < 8 or act is null
  union all select event_id, ts, 'AccountDiscriminatorMismatch' from e where act <> '00000000000000a1'
  union all select event_id, ts, 'AccountDidNotDeserialize' from e where event_id % 2 = 1 and event_type = 'signup'
  union all select event_id, ts, 'AccountReallocExceedsLimit' from e where (event_id * 37) % 12000 > 10240
)"""

#: Line patterns, in a form that Java and RE2 read alike.
PATTERNS = [
    {"code": "email", "regex": "[A-Za-z0-9._]+@[A-Za-z0-9.]+", "topic": "pii", "confidence": "high", "severity": "error"},
    {"code": "hex", "regex": "[0-9a-f]{32}", "topic": "pii", "confidence": "medium", "severity": "error"},
    {"code": "phone", "regex": "[+(]?[0-9][0-9 ()-]{8,}[0-9]", "topic": "pii", "confidence": "low", "severity": "warning"},
    {"code": "licence", "regex": "(?i)licen[cs]e|copyright", "topic": "legal", "confidence": "medium", "severity": "information"},
    {"code": "caps", "regex": "[A-Z]{6,}", "topic": "style.case", "confidence": "low", "severity": "hint"},
    {"code": "pipe", "regex": " [|] ", "topic": "style.table", "confidence": "medium", "severity": "hint"},
]


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("file"), "source", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.pattern_scan(lines_of(_t(spark, sf_dir, "documents")), PATTERNS)


def _findings_sql() -> str:
    parts = []
    for seq, p in enumerate(PATTERNS):
        values = ", ".join(f"'{p[k]}' as {k}" for k in ("code", "topic", "confidence", "severity"))
        parts.append(
            f"select file, line as start_line, strpos(text, m) - 1 as start_char, line as end_line, strpos(text, m) - 1 + length(m) as end_char, {seq} as rule_seq, {values} "
            f"from (select *, regexp_extract(text, '{p['regex']}') as m from l where regexp_matches(text, '{p['regex']}'))"
        )
    return (
        "with d as (select doc_id as file, source, string_split(text, chr(10)) as t from documents), "
        "l as (select file, source, unnest(t) as text, unnest(range(len(t)))::int as line from d), f as (" + " union all ".join(parts) + ")"
    )


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("at", _micros("ts"))
    return e.withColumn("day", F.floor(F.col("at") / 86_400_000_000).cast("long"))


_EVENTS_SQL = "with e as (select *, epoch_us(ts) as us, epoch_us(ts) // 86400000000 as day from events)"


# --- preflight --------------------------------------------------------------------------------------


@query(_INVOCATION_SQL + " select name, count(distinct event_id) as n_invocations, min(event_id) as first_index from hits group by name")
def d1_preflight(spark, sf_dir):
    detected = preflight.preflight(invocations_of(_t(spark, sf_dir, "events")))
    # counts alone: the list of all invocations of an error grows with the input
    return detected.groupBy("name").agg(F.count(F.lit(1)).alias("n_invocations"), F.min("index").alias("first_index"))


@query(_INVOCATION_SQL + " select epoch_us(ts) // 3600000000 as hour, name, count(distinct event_id) as n from hits group by all")
def d1_stream_preflight(spark, sf_dir):
    schema = _t(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = invocations_of(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    out = updates.stream_preflight(rows)
    out = out.select(F.floor(F.unix_micros("start") / 3_600_000_000).cast("long").alias("hour"), "name", "n")
    return updates.run_latest(out, new_path(spark, "preflight"), ["hour", "name"])


# --- findings ---------------------------------------------------------------------------------------


@query(_findings_sql() + " select file, start_line, start_char, end_char, code, topic, confidence, severity from f")
def d2_line_findings(spark, sf_dir):
    return line_findings(spark, sf_dir).select("file", "start_line", "start_char", "end_char", "code", "topic", "confidence", "severity")


def _whole_lines(spark, sf_dir) -> DataFrame:
    """Findings that cover their whole line, so that rules of one topic meet."""
    rows = line_findings(spark, sf_dir).withColumns({"start_char": F.lit(0), "end_char": F.lit(0), "message": F.col("code")})
    return rows.withColumn("topic", F.substring_index("topic", ".", 1))


_ARBITRATE_SQL = """, g as (select file, start_line, code, split_part(topic, '.', 1) as topic, rule_seq, severity,
  case confidence when 'high' then 3 when 'medium' then 2 else 1 end as c from f where code <> 'pipe'),
w as (select *, row_number() over p as n, count(*) over (partition by file, start_line, topic) - 1 as demoted from g
  window p as (partition by file, start_line, topic order by c desc, rule_seq))"""


@query(_findings_sql() + _ARBITRATE_SQL + " select file, start_line, topic, code, demoted::int as demoted from w where n = 1")
def d3_arbitrate(spark, sf_dir):
    rows = findings.apply_settings(_whole_lines(spark, sf_dir), F.col("code") == "pipe")
    out = findings.dedupe(findings.arbitrate(rows))
    return out.select("file", "start_line", "topic", "code", "demoted")


@query(
    _findings_sql()
    + """, s as (select file, line from l where text like '% | %' union select file, line + 1 from l where text like '% | %')
select file, start_line, code from f where not (topic like 'style%' and exists (select 1 from s where s.file = f.file and s.line = f.start_line))
  and file not in (select doc_id from documents where source = 'src3')"""
)
def d4_suppress(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    rows = line_findings(spark, sf_dir).withColumn("rule", F.concat(F.lit("lines/"), "code"))
    marked = lines_of(docs).filter(F.col("text").contains(" | ")).select("file", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"))
    allow = F.explode(F.array(F.lit("style.case"), F.lit("style.table")))
    files = docs.filter("source = 'src3'").select(F.col("doc_id").alias("file"))
    out = findings.suppress(rows, marked.distinct().select("file", "line", allow.alias("pattern")), files=files)
    return out.select("file", "start_line", "code")


@query(
    _findings_sql()
    + """ select source as corpus, count(*) filter (severity = 'error' and code <> 'hex') as errors,
  count(*) filter (severity = 'error' and code <> 'hex') = 0 as passed
from f join (select distinct file, source from l) using (file) where code <> 'hex' group by source"""
)
def d4_corpus_gate(spark, sf_dir):
    names = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("corpus"))
    rows = line_findings(spark, sf_dir).join(names, "file").withColumn("file", F.concat_ws("/", "code", "file"))
    return telemetry.corpus_gate(rows, ["hex/"])


@query(
    _findings_sql()
    + """, r as (select *, case severity when 'error' then 'error' when 'information' then 'note' when 'hint' then 'note' else 'warning' end as level from f),
x as (select code, row_number() over (order by min((file::varchar, start_line, start_char)), code) - 1 as i from r group by code)
select file, code as rule_id, level, '{"ruleId":"' || code || '","ruleIndex":' || i || ',"level":"' || level || '","message":{"text":"' || code
  || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || file || '"},"region":{"startLine":' || (start_line + 1) || ',"startColumn":' || (start_char + 1)
  || ',"endLine":' || (end_line + 1) || ',"endColumn":' || (end_char + 1) || '}}}],"properties":{"topic":"' || topic || '","confidence":"' || confidence || '"}}' as json from r join x using (code)"""
)
def d21_sarif(spark, sf_dir):
    rows = line_findings(spark, sf_dir).withColumns({"message": F.col("code"), "file": F.col("file").cast("string")})
    _, results = sinks.sarif_rows(rows)
    return results.withColumn("file", F.col("file").cast("long"))


@query(
    _findings_sql()
    + """, x as (select topic, 'catalog-' || replace(replace(topic, '.', '-'), '/', '-') as slug, code, min(file) as first_file, count(*) as n from f group by all)
select code, topic, 'https://docs.example/' || slug || '.md' as url, n, first_file,
  case code when 'email' then 'proven' when 'hex' then 'proven' when 'caps' then 'likely' end as provability from x"""
)
def d21_enrich(spark, sf_dir):
    kinds = spark.createDataFrame([("email", "proven"), ("hex", "proven"), ("caps", "likely")], "kind string, provability string")
    rows = findings.enrich(line_findings(spark, sf_dir).withColumn("kind", F.col("code")), kinds)
    grouped = rows.groupBy("code", "topic", "provability").agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("first_file"))
    url = scalars.topic_url(F.concat(F.lit("catalog/"), "topic"), "catalog", "https://docs.example")
    return grouped.select("code", "topic", url.alias("url"), "n", "first_file", "provability")


@query(
    _findings_sql()
    + """, p as (select file, line * 1048576 as a, (line + 3 + 4 * (line % 4)) * 1048576 as b, case line % 2 when 0 then 'even' else 'odd' end as region from l where line % 3 = 0),
q as (select f.file, f.start_line, f.start_char, f.code, arg_min(region, [b - a, (region = 'odd')::int]) as region from f join p on p.file = f.file and f.start_line * 1048576 + f.start_char >= a and f.start_line * 1048576 + f.start_char < b group by all)
select file, start_line, code from q where region = 'even'"""
)
def d6_regions(spark, sf_dir):
    """regions of several lengths that overlap; the shortest around a finding decides."""
    rows = line_findings(spark, sf_dir)
    starts = lines_of(_t(spark, sf_dir, "documents")).filter("line % 3 = 0")
    packed = lambda n: (F.col("line") + n).cast("long") * (1 << 20)
    length = F.lit(3) + 4 * (F.col("line") % 4)
    regions = starts.select("file", packed(0).alias("start"), packed(length).alias("end"), F.when(F.col("line") % 2 == 0, "even").otherwise("odd").alias("region"))
    out = findings.filter_by_region(rows, regions, ["even"], "low", "review", "none")
    return out.select("file", "start_line", "code")


# --- references -------------------------------------------------------------------------------------


@query("""
with d as (select p_partkey, p_name, p_brand from part where p_size <= 25),
r as (select distinct l_partkey from lineitem),
m as (select distinct p.p_brand, p.p_name from r join part p on p.p_partkey = r.l_partkey where not exists (select 1 from d where d.p_partkey = r.l_partkey)),
n as (select m.p_brand, m.p_name as name, c.p_name as candidate, levenshtein(m.p_name, c.p_name) as distance
  from m join (select distinct p_brand, p_name from d) c on c.p_brand = m.p_brand)
select p_brand, name, candidate, distance::int as distance, rank from (
  select *, row_number() over (partition by p_brand, name order by distance, candidate)::int as rank from n) where rank <= 3""")
def d5_missing_refs(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    declared = part.filter("p_size <= 25")
    refs = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("name")).distinct()
    missing = references.missing_refs(refs, declared.select(F.col("p_partkey").cast("string").alias("name")), [])
    named = missing.join(part.select(F.col("p_partkey").cast("string").alias("name"), "p_name", "p_brand"), "name")
    names = named.select("p_brand", F.col("p_name").alias("name")).distinct()
    candidates = declared.select("p_brand", F.col("p_name").alias("candidate")).distinct()
    return references.closest(names, candidates, ["p_brand"], 3).select("p_brand", "name", "candidate", "distance", "rank")


@query(_EVENTS_SQL + """, k as (select user_id, day, bool_or(event_type = 'purchase') p, bool_or(event_type = 'signup') s, bool_or(event_type = 'error') g, max(value) > 90 as high from e group by all)
select user_id, day, high from k where p and not s and g""")
def d6_gated_absence(spark, sf_dir):
    e = _by_day(spark, sf_dir)
    of = lambda t: e.filter(F.col("event_type") == t)
    out = references.gated_absence(of("purchase"), of("signup"), of("error"), ["user_id", "day"])
    high = e.groupBy("user_id", "day").agg((F.max("value") > 90).alias("high"))
    return out.join(high, ["user_id", "day"])


@query("""
with a as (select distinct o_custkey from orders where year(o_orderdate) = 2000), u as (select distinct o_custkey from orders where o_orderpriority = '1-URGENT'),
o as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by case o_orderpriority when '1-URGENT' then 0 when '3-MEDIUM' then 1 else 2 end, o_orderkey) as n from orders)
select c_custkey, case when c_custkey in (select o_custkey from a) then 'year' when c_custkey in (select o_custkey from u) then 'urgent' else 'none' end as tier, o_orderkey
from customer left join (select * from o where n = 1) p on p.o_custkey = c_custkey""")
def d7_tiers(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    tiers = [("year", orders.filter("year(o_orderdate) = 2000")), ("urgent", orders.filter("o_orderpriority = '1-URGENT'"))]
    out = references.resolve_tiers(_t(spark, sf_dir, "customer"), tiers, "c_custkey", "none")
    best = artifacts.preferred(orders, ["c_custkey"], F.col("o_orderpriority"), ["1-URGENT", "3-MEDIUM"], [F.col("o_orderkey")])
    return out.join(best.select("c_custkey", "o_orderkey"), "c_custkey", "left").select("c_custkey", "tier", "o_orderkey")


@query("""
with n as (select l_orderkey, l_partkey, l_shipdate, row_number() over (partition by l_orderkey order by l_shipdate desc, l_partkey desc) as r from lineitem)
select o_orderkey, l_partkey as newest_input, epoch_us(l_shipdate) as newest_us from orders join n on l_orderkey = o_orderkey and r = 1 where l_shipdate > o_orderdate""")
def d8_stale(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("modified"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("modified"), F.col("l_partkey").alias("path"))
    out = artifacts.stale(orders, lines, ["o_orderkey"])
    return out.select("o_orderkey", "newest_input", _micros("newest_modified").alias("newest_us"))


@query("""
select c_custkey, case when r_name <> 'ASIA' then 1 else -1 end as missing_at, case when r_name <> 'ASIA' then 'ASIA' end as missing
from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""")
def d17_paths(spark, sf_dir):
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    both = nation.join(region, nation.n_regionkey == region.r_regionkey)
    fields = nation.select(F.lit("root").alias("container"), F.col("n_name").alias("name"), F.col("n_name").alias("type_name")).unionByName(
        both.select(F.col("n_name").alias("container"), F.col("r_name").alias("name"), F.lit("leaf").alias("type_name"))
    )
    customers = _t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    paths = customers.select(F.col("c_custkey").alias("id"), F.lit("root").alias("container"), F.array("n_name", F.lit("ASIA")).alias("path"))
    out = references.resolve_paths(paths, fields, 2)
    return out.select(F.col("id").alias("c_custkey"), F.coalesce("missing_at", F.lit(-1)).alias("missing_at"), "missing")


@query("""
with w as (select distinct lang as scope, unnest(string_split(lower(text), ' ')) as name from documents), b as (select distinct unnest(string_split(lower(text), ' ')) as name from benchmark)
select scope, count(*) as n from w where name not in (select name from b) group by scope""")
def d20_unresolved(spark, sf_dir):
    words = lambda df: F.explode(F.split(F.lower(df["text"]), " "))
    docs, bench = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark")
    uses = docs.select(F.col("lang").alias("scope"), words(docs).alias("name")).distinct()
    known = bench.select(words(bench).alias("name")).distinct()
    visible = uses.join(known, "name", "left_semi")  # every scope sees the benchmark's words
    return references.unresolved(uses, visible).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("select 'definition' as role, p_partkey as file, p_name as name from part where p_name = 'red widget' union all select 'reference', l_partkey, p_name from lineitem join part on p_partkey = l_partkey where p_name = 'red widget'")
def d24_lookup(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("name"), F.lit("part").alias("kind"), F.lit(False).alias("is_open"), F.col("p_brand").alias("container"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file")).join(part, "file")
    return references.lookup(part, lines, "red widget").select("role", "file", "name")


@query("select p_partkey, p_name from part where lower(p_name) like '%ring%'")
def d20_symbol_search(spark, sf_dir):
    return references.symbol_search(_t(spark, sf_dir, "part"), "RING", "p_name").select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where starts_with(p_name, 'red')")
def d20_prefix_search(spark, sf_dir):
    return references.prefix_search(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), "red", "p_name")


@query("""
with k as (select distinct p_brand as doc, p_partkey::varchar as key from part)
select a.doc, b.key as prefix, a.key from k a join k b on a.doc = b.doc and a.key <> b.key and starts_with(a.key, b.key)""")
def d12_prefix_collisions(spark, sf_dir):
    keys = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").cast("string").alias("key"))
    return references.prefix_collisions(keys, ["doc"])


@query("""
with s as (select p_partkey::varchar as p from part where p_size <= 10), k as (select distinct o_orderkey::varchar as key from orders),
x as (select key, substr(key, 1, i) as p, i from k, unnest(range(1, length(key) + 1)) u(i))
select key, arg_max(p, i) as prefix from x where p in (select p from s) group by key""")
def d12_longest_prefix(spark, sf_dir):
    keys = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"))
    return references.longest_prefix(keys, _t(spark, sf_dir, "part").filter("p_size <= 10").select(F.col("p_partkey").cast("string").alias("key")))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def d19_latest(spark, sf_dir):
    out = references.latest(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return out.select("o_custkey", "o_orderkey")


@query("select event_id, epoch_us(ts) as at from events order by ts desc, event_id desc limit 200")
def d19_last_events(spark, sf_dir):
    return references.last_n(_t(spark, sf_dir, "events"), [F.col("ts"), F.col("event_id")]).select("event_id", _micros("ts").alias("at"))


# --- ordered scans and guards -----------------------------------------------------------------------


@query(_EVENTS_SQL + """, w as (select *, min(case when event_type = 'error' then us end) over p as t, max((event_type = 'signup')::int) over p as c from e
  window p as (partition by user_id, day order by us, event_id rows between unbounded preceding and 1 preceding))
select user_id, day, min(t) as first_trigger, min(us) as first_read from w where event_type = 'view' and t is not null and coalesce(c, 0) = 0 group by all""")
def d9_stale_reads(spark, sf_dir):
    is_ = lambda t: F.col("event_type") == t
    return guards.sequence_violation(_by_day(spark, sf_dir), ["user_id", "day"], ["at", "event_id"], is_("error"), is_("signup"), is_("view"))


@query(_EVENTS_SQL + """ select user_id, day, count(*) as n from e where event_type = 'view' and not exists (select 1 from e g where g.event_type = 'signup' and g.user_id = e.user_id and g.day = e.day)
  and not exists (select 1 from e o where o.event_type = 'error' and o.user_id = e.user_id and o.day = e.day) group by all""")
def d9_unguarded(spark, sf_dir):
    is_ = lambda t: F.col("event_type") == t
    out = guards.unguarded(_by_day(spark, sf_dir), ["day"], is_("view"), is_("signup"), by=("user_id",))
    quiet = _by_day(spark, sf_dir).filter(is_("error")).select("user_id", "day").distinct()
    return out.join(quiet, ["user_id", "day"], "left_anti").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))


@query(_EVENTS_SQL + " select user_id, day, min(us) filter (event_type = 'purchase') as first_access from e group by all having count(*) filter (event_type = 'purchase') > 0 and not bool_or(event_type = 'view')")
def d9_first_unvalidated(spark, sf_dir):
    return guards.first_unvalidated(_by_day(spark, sf_dir), ["user_id", "day"], F.col("at"), F.col("event_type") == "purchase", F.col("event_type") == "view")


@query(_EVENTS_SQL + """ select user_id, day, min(us) filter (event_type = 'purchase') as first_mutation, min(us) filter (event_type = 'click') as first_action from e group by all
having count(*) filter (event_type = 'purchase') > 0 and count(*) filter (event_type = 'click') > 0 and not bool_or(event_type = 'signup')""")
def d9_close_rule(spark, sf_dir):
    is_ = lambda t: F.col("event_type") == t
    return guards.close_rule(_by_day(spark, sf_dir), ["user_id", "day"], F.col("at"), is_("purchase"), is_("click"), is_("signup"))


@query(_EVENTS_SQL + " select user_id, event_type, count(*) filter (value > 95) as reads from e group by all having count(*) filter (value > 95) > 0 and count(*) filter (value < 1) = 0")
def d9_raw_risk(spark, sf_dir):
    return guards.raw_risk(_by_day(spark, sf_dir), ["user_id", "event_type"], F.col("value") > 95, F.col("value") < 1)


@query("select l_orderkey, count(*) filter (l_linestatus = 'O') as n_one, count(*) filter (l_linestatus = 'F') as n_other from lineitem group by l_orderkey having count(*) filter (l_linestatus = 'O') > 0 and count(*) filter (l_linestatus = 'F') > 0")
def d10_mixed(spark, sf_dir):
    return guards.mixed_groups(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linestatus") == "O", F.col("l_linestatus") == "F")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def d10_duplicates(spark, sf_dir):
    return telemetry.duplicates(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select p_name as name, count(*) as n, count(*) = 1 as unambiguous from part group by p_name")
def d10_definition_counts(spark, sf_dir):
    return graph.definition_counts(_t(spark, sf_dir, "part"), "p_name")


# --- graph ------------------------------------------------------------------------------------------


def call_edges(spark, sf_dir) -> DataFrame:
    """Consecutive users of error events within a day."""
    from pyspark.sql import Window as W

    e = _by_day(spark, sf_dir).filter("event_type = 'error'")
    following = F.lead("user_id").over(W.partitionBy("day").orderBy("at", "event_id"))
    return e.select(F.col("user_id").alias("src"), following.alias("dst")).filter("dst is not null").distinct()


_EDGES_SQL = """
with recursive e as (select distinct user_id as src, dst from (
  select user_id, lead(user_id) over (partition by epoch_us(ts) // 86400000000 order by ts, event_id) as dst from events where event_type = 'error') where dst is not null),
s as (select distinct src as source from e),
r as (select source, source as name, 0 as depth from s union select r.source, e.dst, r.depth + 1 from r join e on e.src = r.name where r.depth < {depth}),
m as (select source, name, min(depth) as depth from r where depth > 0 group by all)"""


@query(_EDGES_SQL.format(depth=8) + " select source, name, depth from m")
def d11_reachable(spark, sf_dir):
    edges = call_edges(spark, sf_dir)
    return graph.reachable(edges, _all_sources(edges))


@query(_EDGES_SQL.format(depth=2) + " select distinct source from m where depth = 2 and name in (select src from e)")
def d11_truncated(spark, sf_dir):
    edges = call_edges(spark, sf_dir)
    return _truncated(edges)


@query("""
with recursive e0 as (select distinct user_id as src, dst from (
  select user_id, lead(user_id) over (partition by epoch_us(ts) // 86400000000 order by ts, event_id) as dst from events where event_type = 'error') where dst is not null),
u as (select dst from e0 group by dst having count(*) <= 12), e as (select * from e0 where dst in (select dst from u)),
s as (select distinct src as source from e0),
r as (select source, source as name, 0 as depth from s union select r.source, e.dst, r.depth + 1 from r join e on e.src = r.name where r.depth < 8)
select source, name, min(depth) as depth from r where depth > 0 group by all""")
def d11_unambiguous(spark, sf_dir):
    edges = call_edges(spark, sf_dir)
    defs = edges.groupBy(F.col("dst").alias("name")).agg(F.when(F.count(F.lit(1)) <= 12, 1).otherwise(2).alias("n"))
    return graph.reachable(edges, _all_sources(edges), defs=defs)



def _truncated(edges) -> DataFrame:
    starts = _all_sources(edges)
    return graph.truncated(graph.search(edges, starts.withColumn("name", F.col("source")), depth=2), edges, depth=2)


def _all_sources(edges) -> DataFrame:
    return edges.select(F.col("src").alias("source")).distinct()


@query()
def d11_reachable_all(spark, sf_dir):
    edges = call_edges(spark, sf_dir)
    return graph.reachable(edges, _all_sources(edges))


@query()
def d11_truncated_all(spark, sf_dir):
    edges = call_edges(spark, sf_dir)
    return _truncated(edges)


@query()
def d11_unambiguous_all(spark, sf_dir):
    edges = call_edges(spark, sf_dir)
    defs = edges.groupBy(F.col("dst").alias("name")).agg(F.when(F.count(F.lit(1)) <= 12, 1).otherwise(2).alias("n"))
    return graph.reachable(edges, _all_sources(edges), defs=defs)

# --- constraints ------------------------------------------------------------------------------------


@query("""
with w as (select doc_id, string_split(text, ' ') as t from documents)
select doc_id, 'too_many' as issue, -1 as at from w where len(t) > 400
union all select doc_id, 'too_long', i::int from (select doc_id, unnest(t) as x, unnest(range(len(t))) as i from w) where strlen(x) > 32 and not contains(x, chr(92)) and not contains(x, '"')""")
def d22_seed_limits(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    quoted = F.transform(F.split("text", " "), lambda x: F.when(x.contains('"'), x).otherwise(F.concat(F.lit('b"'), x, F.lit('"'))))
    out = constraints.seed_limits(docs.select(F.col("doc_id").alias("container"), F.lit("text").alias("field"), quoted.alias("seeds")), max_seeds=400)
    return out.select(F.col("container").alias("doc_id"), "issue", F.coalesce("at", F.lit(-1)).alias("at"))


@query(_EVENTS_SQL + """, k as (select user_id, day, list_sort(list(distinct event_type)) as keys from e group by all)
select user_id, day, 'purchase' as key, 'signup' as companion from k where list_contains(keys, 'purchase') and not list_contains(keys, 'signup')
union all select user_id, day, 'purchase', 'view' from k where list_contains(keys, 'purchase') and not list_contains(keys, 'view')
union all select user_id, day, 'error', 'click' from k where list_contains(keys, 'error') and not list_contains(keys, 'click')""")
def d22_companions(spark, sf_dir):
    catalog = spark.createDataFrame([("purchase", ["signup", "view"]), ("error", ["click", "signup"])], "key string, companions array<string>")
    excluded = spark.createDataFrame([("error", "signup")], "key string, companion string")
    rows = _by_day(spark, sf_dir).groupBy(F.struct("user_id", "day").alias("id")).agg(F.collect_set("event_type").alias("keys"))
    return constraints.missing_companions(rows, catalog, excluded).select("id.user_id", "id.day", "key", "companion")


@query("""
with v as (select distinct o_orderpriority as value from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM'))
select value, arg_min(a, printf('%04d', levenshtein(value, a)) || a) as closest from v, (values ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) t(a) group by value""")
def d22_keywords(spark, sf_dir):
    return constraints.invalid_keywords(_t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")), ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("select p_partkey, p_name similar to 'red.*|small.*' as init_like, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') as pascal, replace(trim(p_brand), '#', '_') as name from part")
def d23_scalars(spark, sf_dir):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    marked = F.when(F.col("p_name").rlike("^(red|small)"), F.concat(F.lit("init"), "p_name")).otherwise(F.col("p_name"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", constraints.is_init_like(marked).alias("init_like"), scalars.pascal_case(name).alias("pascal"), scalars.normal_name(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("name")
    )


# --- telemetry, drift and reports -------------------------------------------------------------------


@query("""
with r as (select event_type as name, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events),
m as (select name, n, value from r where i = greatest(ceil(0.99 * n), 1)),
b(name, budget) as (values ('click', 50.0::double), ('view', 1000.0::double), ('purchase', 99.0::double), ('refund', 10.0::double))
select name, budget, coalesce(n, 0) as n, value, case when value is null then 'missing' when value > budget then 'exceeded' else 'ok' end as status from b left join m using (name)""")
def d13_budgets(spark, sf_dir):
    measures = telemetry.nearest_rank(_t(spark, sf_dir, "events").withColumnRenamed("event_type", "name"), ["name"], "value", 0.99)
    budgets = spark.createDataFrame([("click", 50.0), ("view", 1000.0), ("purchase", 99.0), ("refund", 10.0)], "name string, budget double")
    return telemetry.budget_check(measures, budgets).withColumn("n", F.coalesce("n", F.lit(0)))


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers and a later state of them: some gone, some renamed, some new."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.col("c_name").alias("content"))
    later = c.filter("path % 100 <> 7").withColumn("content", F.when(F.col("path") % 50 == 3, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    later = later.unionByName(c.filter("path % 200 = 1").withColumn("path", F.col("path") + 1_000_000_000))
    digest = lambda df: df.withColumn("sha256", F.sha2("content", 256))
    return digest(c), digest(later)


_SNAPSHOTS_SQL = """
with a as (select c_custkey as path, c_name as content from customer),
b as (select path, case when path % 50 = 3 then content || 'x' else content end as content from a where path % 100 <> 7 union all select path + 1000000000, content from a where path % 200 = 1)"""


@query(_SNAPSHOTS_SQL + " select coalesce(a.path, b.path) as path, case when b.path is null then 'missing' else 'stale' end as drift from a full join b on a.path = b.path where a.path is null or b.path is null")
def d14_set_drift(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    return drift.set_drift(a, b, "path")


@query(_SNAPSHOTS_SQL + """ select coalesce(a.path, b.path) as path, case when a.path is null then 'unexpected' when b.path is null then 'missing' else 'mismatch' end as drift
from a full join b on a.path = b.path where a.path is null or b.path is null or sha256(a.content) <> sha256(b.content)""")
def d14_lock_drift(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    return drift.lock_drift(a, b, ["path"])


@query(_SNAPSHOTS_SQL + " select a.path, case when b.path is null then 'new' when sha256(a.content) = sha256(b.content) then 'unchanged' else 'conflict' end as action from a left join b on a.path = b.path")
def d14_sync_plan(spark, sf_dir):
    a, b = _snapshots(spark, sf_dir)
    return drift.sync_plan(a, b)


@query("""
with l as (select source, substr(sha256(doc_id::varchar), 1, 4) as s, doc_id || '|' || sha256(text) as l from documents),
d as (select source, substr(s, 1, 2) as s, s || ':' || sha256(string_agg(l, chr(10) order by l)) as d from l group by source, l.s),
e as (select source, s || ':' || sha256(string_agg(d, chr(10) order by d)) as d from d group by source, s)
select source, sha256(string_agg(d, chr(10) order by d)) as digest from e group by source""")
def d14_tree_digest(spark, sf_dir):
    return telemetry.tree_digest(_t(spark, sf_dir, "documents"), ["source"], "doc_id", F.col("text").cast("binary"))


@query("""
with s as (select 'customer' as s, c_nationkey as k from customer where c_acctbal > 9900 union select 'supplier', s_nationkey from supplier union select 'nation', n_nationkey from nation)
select k, array_to_string(list_sort(list_filter(['customer', 'nation', 'supplier'], lambda x: not list_contains(h, x))), ',') as absent from (select k, list(s) as h from s group by k) where len(h) < 3""")
def d14_parity(spark, sf_dir):
    sets = {
        "customer": _t(spark, sf_dir, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")),
        "supplier": _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")),
        "nation": _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")),
    }
    return drift.parity(sets, "k").withColumn("absent", F.array_join("absent", ","))


@query("select k, min_by(o, i) as origin from (select c_custkey as k, 'customer' as o, 0 as i from customer union all select o_custkey, 'orders', 1 from orders union all select user_id, 'events', 2 from events) group by k")
def d14_bridge(spark, sf_dir):
    of = lambda t, k: _t(spark, sf_dir, t).select(F.col(k).alias("k"), F.lit(t).alias("origin"))
    return drift.bridge_symbols([of("customer", "c_custkey"), of("orders", "o_custkey"), of("events", "user_id")], ["k"])


@query("select l_orderkey, i::int as l_linenumber from (select l_orderkey, unnest(range(1, max(l_linenumber) + 1)) as i from lineitem group by l_orderkey) g where not exists (select 1 from lineitem l where l.l_orderkey = g.l_orderkey and l.l_linenumber = g.i)")
def d15_gaps(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    groups = lines.groupBy("l_orderkey").agg(F.lit(1).alias("first"), F.max("l_linenumber").alias("last"))
    return drift.coverage_gaps(groups, lines, ["l_orderkey"], "first", "last", "l_linenumber")


@query("select r_name, n_name, count(*) as n, sum(c_acctbal::decimal(18,2))::double as total from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by rollup (r_name, n_name)")
def d16_rollup(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return telemetry.rollup_totals(c, ["r_name", "n_name"], {"n": F.count(F.lit(1)), "total": F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double")})


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def d16_coverage(spark, sf_dir):
    return telemetry.coverage_summary(_t(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("select c_nationkey, count(*) filter (c_mktsegment = 'BUILDING') as \"BUILDING\", count(*) filter (c_mktsegment = 'MACHINERY') as \"MACHINERY\" from customer group by c_nationkey")
def d16_pivot(spark, sf_dir):
    return telemetry.catalog_summary(_t(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("""
with u as (select o_custkey, array_to_string(list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'O')), ',') as account,
  array_to_string(list_sort(list(distinct o_orderpriority) filter (o_orderstatus = 'F')), ',') as signer_use, max(o_totalprice) > 450000 as big from orders group by o_custkey)
select o_custkey, coalesce(account, '') as account, coalesce(signer_use, '') as signer_use,
  array_to_string(list_filter([case when account is null or account = '' then 'no_open' end, case when signer_use is null or signer_use = '' then 'no_final' end], lambda x: x is not null), ',') as review from u""")
def d17_report(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "account").when(F.col("o_orderstatus") == "F", "signer_use").otherwise("other")
    usages = orders.select("o_custkey", kind.alias("kind"), F.col("o_orderpriority").alias("account"))
    reasons = [("no_open", F.size("account") == 0), ("no_final", F.size("signer_use") == 0)]
    out = reports.instruction_report(usages, orders.select("o_custkey", F.col("o_orderstatus").alias("callee")), ["o_custkey"], reasons)
    return out.select("o_custkey", *[F.array_join(c, ",").alias(c) for c in ("account", "signer_use", "review")])


@query("""
with f as (select s_nationkey as k, count(*) as n from supplier group by all), u as (select c_nationkey as k, list_sort(list(distinct c_mktsegment)) as u from customer group by all)
select n_nationkey as name, coalesce(n, 0) as n_fields, array_to_string(coalesce(u, []), ',') as used_by from nation left join f on f.k = n_nationkey left join u on u.k = n_nationkey""")
def d17_contexts(spark, sf_dir):
    contexts = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"))
    fields = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("container"))
    functions = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("context"), F.col("c_mktsegment").alias("name"))
    return reports.context_report(contexts, fields, functions).withColumn("used_by", F.array_join("used_by", ","))


@query("""
with p as (select l_orderkey as k, sum(l_extendedprice::decimal(18,2)) as computed from lineitem group by all)
select o_orderkey as k, o_totalprice::decimal(18,2)::double as declared, computed::double as computed from orders join p on p.k = o_orderkey where abs(o_totalprice::decimal(18,2) - computed) > 100000""")
def d18_consistency(spark, sf_dir):
    parts = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("computed"))
    totals = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("declared"))
    out = telemetry.consistency(parts, totals, ["k"], 100000)
    return out.select("k", F.col("declared").cast("double").alias("declared"), F.col("computed").cast("double").alias("computed"))


@query("""
with s as (select o_orderkey as review, o_orderdate as a, max(l_shipdate) as b, o_custkey % 400 as declared from orders join lineitem on l_orderkey = o_orderkey group by all),
d as (select *, floor((epoch_us(b) - epoch_us(a)) / 86400000000.0)::bigint as d from s)
select review, case when d < 0 then 'order' else 'window' end as failure from d where d < 30 union all select review, 'declared' from d where d <> declared""")
def d18_reviews(spark, sf_dir):
    last = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ended"))
    o = _t(spark, sf_dir, "orders").join(last, F.col("l_orderkey") == F.col("o_orderkey"))
    ts = lambda c: F.col(c).cast("timestamp")
    reviews = o.select(F.col("o_orderkey").alias("review"), ts("o_orderdate").alias("started"), ts("ended").alias("ended"), (F.col("o_custkey") % 400).alias("declared_days"))
    return telemetry.review_checks(reviews, o.select(F.col("o_orderkey").alias("review"), F.lit("owner").alias("role")), ["owner"])


@query("""
with l as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as b from events),
s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as g from l)
select user_id, epoch_us(min(ts)) as start_us, arg_max(event_id, event_id) as payload, count(*) as n from s group by user_id, g""")
def d19_debounce(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = updates.debounce(e, "user_id", "ts", "event_id", "event_id", gap="6 hours")
    return out.select("user_id", _micros("start").alias("start_us"), "payload", "n")


@query("""
with now as (select o_custkey as k, max(o_orderdate) as v from orders where o_orderstatus = 'F' group by all)
select o_orderkey from orders left join now on k = o_custkey where v is null or o_orderdate >= v""")
def d19_drop_stale(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return updates.drop_stale(orders, orders.filter("o_orderstatus = 'F'"), "o_custkey", "o_orderdate").select("o_orderkey")


@query("""
with b as (select * from orders where o_orderstatus = 'P'), f as (select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from b) where n = 1),
i as (select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderstatus <> 'P') where n = 1)
select * from i where o_custkey not in (select o_custkey from f) union all select * from f""")
def d19_upsert(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    index = references.latest(orders.filter("o_orderstatus <> 'P'"), ["o_custkey"], order)
    return updates.upsert_index(index, orders.filter("o_orderstatus = 'P'"), "o_custkey", order).select("o_custkey", "o_orderkey")


@query("""
with u as (select doc_id, strlen(text) as b, len(string_split(text, chr(10))) as n from documents)
select doc_id, 'bytes' as issue, b as amount from u where b > 4000 union all select doc_id, 'lines', n from u where n > 12""")
def d2_oversized(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text", F.octet_length("text").cast("long").alias("bytes"))
    _, big = readers.split_oversized(docs, 4000)
    long = findings.oversized_sources(docs, ["generated/"], 12)
    rows = big.select("file", F.lit("bytes").alias("issue"), F.col("bytes").alias("amount")).unionByName(long.select("file", F.lit("lines").alias("issue"), F.col("lines").cast("long").alias("amount")))
    return rows.select(F.col("file").cast("long").alias("doc_id"), "issue", "amount")


@query("select url as path from pages where starts_with(url, '/') or regexp_matches(url, '(^|/)[.][.](/|$)') or not starts_with(url, 'https://')")
def d2_unsafe_paths(spark, sf_dir):
    return findings.unsafe_paths(_t(spark, sf_dir, "pages").select(F.col("url").alias("path")), "https://")


@query("""
select doc_id, 'uncovered' as failure from documents where doc_id not in (select doc_id from labels)
union all select distinct doc_id, 'unknown' from labels where doc_id not in (select doc_id from documents) union all select distinct doc_id, 'vague' from labels where quality = 0""")
def d20_audit(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").withColumn("note", F.when(F.col("quality") == 0, "todo").otherwise("checked"))
    return telemetry.audit_failures(rows, _t(spark, sf_dir, "documents"), "doc_id", "note", "^(todo|tbd)$")


@query("""
with w as (select o_custkey as k, o_orderkey, 1704067200000000 + (o_orderkey % 30) * 86400000000 as a from orders)
select event_id, o_orderkey from events join w on k = user_id and epoch_us(ts) >= a and epoch_us(ts) < a + 3600000000""")
def d21_in_range(spark, sf_dir):
    start = F.lit(1704067200000000) + (F.col("o_orderkey") % 30) * 86400000000
    spans = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", start.alias("start")).withColumn("end", F.col("start") + 3600000000)
    points = _t(spark, sf_dir, "events").select("event_id", "user_id", _micros("ts").alias("at"))
    return findings.in_range(points, spans, "user_id").select("event_id", "o_orderkey")
