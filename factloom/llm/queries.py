"""The registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, chat, collocations, media, mixing, quality, simhash, suffix_dedup, token_counts, token_store, topk, toxicity, whitening
from factloom.llm.common import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return token_store.checksums(token_store.read(spark, path))


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("v")).filter("v is not null")
    return topk.top_k(vectors.filter("vec_id % 20 = 0"), vectors)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(simhash.fingerprints(table(spark, sf_dir, "documents"), words=3), radius=2)
    text = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return out.select("doc_id", text.alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_column(media.mux_column(table(spark, sf_dir, "documents")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    out = chat.format_conversations(rows.unionByName(more))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    whole = counts.select("doc_id", "n_bytes", "n_chars", token_counts.count_at(F.col("n_chars")).alias("n_tokens"))
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "n_chars")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    text = "t"
    for old, new in [(chat.LEAD, chat.LEAD + "0"), *chat._codes(chat.CONTROLS, ord("1"))]:
        text = f"replace({text}, '{old}', '{new}')"
    cases = " ".join(f"when '{r}' then '{a}' || e || '{b}'" for r, (a, b) in chat.TEMPLATE.items())
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (select *, {text} as e from c),
f as (select *, case r {cases} else '<<ROLE ' || r || '>>' || e || '<</ROLE>>' end as f from e)
select conv_id, count(*) as n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) as turns_sha256,
  coalesce(sum(case when r = 'assistant' then length(t) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when r = 'assistant' then t end, '' order by turn nulls first, r, t), '')) as loss_sha256,
  sum(length(f))::bigint as formatted_chars
from f group by conv_id"""


OP5_SQL = r"""
with d as (
  select doc_id, source, md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as o,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as size
  from documents
), s0 as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as source_no
  from d group by source
), s1 as (select *, source_no % 3 + 1 as weight, source_size * 3 as most from s0),
s2 as (
  select *, sum(source_size) over () as total, sum(weight) over () as weights,
    coalesce(sum(most) over p, 0) as most_before, coalesce(sum(weight) over p, 0) as weight_before
  from s1 window p as (order by most / weight, source_no rows between unbounded preceding and 1 preceding)
), s3 as (
  select *, most <= (total - most_before)::double * weight / (weights - weight_before) as capped from s2
), s4 as (
  select *, coalesce(sum(most) filter (capped) over (), 0) as spent,
    coalesce(sum(weight) filter (capped) over (), 0) as spent_weight from s3
), s5 as (
  select source, source_no, source_size, round(total / 8)::bigint as seats,
    case when capped then most::double
      else (total - spent)::double * weight / (weights - spent_weight) end as target from s4
), q1 as (
  select *, floor(target * seats / sum(target) over () + 0.5)::bigint as r from s5
), q2 as (select *, seats - sum(r) over () as d from q1),
q3 as (
  select source_no, sign(d) as g, row_number() over (order by -sign(d) * target / (2 * s + 1), sign(d) * source_no, sign(d) * s) as b, d
  from (select *, case when d > 0 then r + k - 1 else r - k end as s
        from q2, unnest(range(1, abs(d)::bigint + 1)) as u(k)) where s >= 0
), q4 as (
  select q2.*, r + coalesce((select sum(g) from q3 where q3.source_no = q2.source_no and b <= abs(q3.d)), 0)::bigint as quota
  from q2
), p as (
  select d.*, q4.source_no, q4.source_size, q4.target, q4.quota,
    ('0x' || substr(o, 1, 8))::bigint % (1 + source_size // 131072) as shard
  from d join q4 on d.source is not distinct from q4.source
), h1 as (
  select source_no, shard, sum(size)::bigint as shard_size, min(quota) as seats from p group by all
), h2 as (
  select *, case when sum(shard_size) over w > 0
      then floor(shard_size::double * seats / sum(shard_size) over w + 0.5) else 0 end::bigint as r,
    sum(shard_size) over w as v
  from h1 window w as (partition by source_no)
), h3 as (select *, case when v > 0 then seats - sum(r) over (partition by source_no) else 0 end as d from h2),
h4 as (
  select source_no, shard, sign(d) as g, d, row_number() over (partition by source_no
    order by -sign(d) * shard_size::double / (2 * s + 1), sign(d) * shard, sign(d) * s) as b
  from (select *, case when d > 0 then r + k - 1 else r - k end as s
        from h3, unnest(range(1, abs(d)::bigint + 1)) as u(k)) where s >= 0
), h5 as (
  select h3.source_no, h3.shard, h3.shard_size, 8 * (r + coalesce((select sum(g) from h4
    where h4.source_no = h3.source_no and h4.shard = h3.shard and b <= abs(h4.d)), 0))::bigint as words
  from h3
), l as (
  select p.*, h5.shard_size, h5.words, case when shard_size > 0 then words // shard_size else 0 end as passes,
    sum(size) over (partition by p.source_no, p.shard order by o, doc_id, size rows unbounded preceding) as e
  from p join h5 on p.source_no = h5.source_no and p.shard = h5.shard
)
select doc_id, size::bigint as size, source_size, target,
  least(passes * size + greatest(0, least(e, words - passes * shard_size) - (e - size)), 3 * size)::bigint as taken
from l"""

QUERIES = {"op1_token_files": op1_token_files, "op2_maxscore": op2_maxscore, "op3_simhash": op3_simhash, "op4_suffix_dedup": op4_suffix_dedup, "op6_matroska": op6_matroska, "op7_toxicity": op7_toxicity, "op10_quality": op10_quality, "op9_bpe": op9_bpe, "op5_mixing": op5_mixing, "op8_chat": op8_chat, "op11_token_counts": op11_token_counts, "op12_whitening": op12_whitening, "op13_collocations": op13_collocations}
OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify rank <= 20"""

ORACLES = {"op2_maxscore": OP2_SQL, "op5_mixing": OP5_SQL, "op8_chat": _op8_sql()}
