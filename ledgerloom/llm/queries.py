"""The registered queries: each applies one operator, with its production settings, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    aliases, alignment, bpe, decontaminate, line_dedup, nbsvm, negatives, parity_join, ppm, pseudonyms, repeats, reshard, secrets,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


#: Shards of the layout that op10 starts from (files are dealt to them by name) and ends with.
OLD_SHARDS, NEW_SHARDS = 6, 8


@query("op10_reshard")
def op10_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    old = F.crc32(F.col("__name")) % OLD_SHARDS
    rows, _ = reshard.reshard(documents.select("doc_id", "text"), old, "text", NEW_SHARDS)
    return rows.select(
        "doc_id", reshard.text_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op7_decontaminate", sql="""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from documents
), i as (
  select item_id::varchar as item, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from benchmark where text is not null and item_id is not null
), p as (
  select distinct item, least(10, len(w)) as m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') as win
  from i, unnest(range(1, greatest(2, len(w) - 8))) as r(k) where len(w) > 0
), lengths as (
  select distinct m from p
), o as (
  select doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') as win
  from d, lengths, unnest(range(1, len(w) - m + 2)) as r(k)
), hits as (
  select doc_id, k, m, item from o join p using (m, win)
), words_hit as (
  select doc_id, count(distinct k + j) as n_hit from hits, unnest(range(0, m)) as r(j) group by doc_id
), found as (
  select doc_id, count(distinct item) as n_items,
    sha256(string_agg(distinct item, ',' order by item)) as items_sha256
  from hits group by doc_id
)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join words_hit using (doc_id) left join found using (doc_id)
""")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(documents, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The vocabulary file that op8 and the pipeline encode with.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _hash_mod(key: str, n: int) -> Column:
    """The remainder by which rows are held out: of the CRC-32 of the id as text."""
    return F.crc32(F.col(key).cast("string")) % n


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = ppm.Model.fit(documents.where(_hash_mod("doc_id", 3) != 1), "lang", "text", "doc_id")
    found = ppm.predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (_hash_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op5_parity_join", sql="""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents where text is not null
), s as (
  select distinct doc_id, array_to_string(w[k : k + 2], ' ') as sh
  from w, unnest(range(1, greatest(2, len(w) - 1))) as r(k) where len(w) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2
), e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)
), both_ways as (
  select a, b from e union all select b, a from e
), reach as (
  select doc_id as a, doc_id as b from documents
  union
  select reach.a, both_ways.b from reach join both_ways on both_ways.a = reach.b
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id
from documents d left join n using (doc_id)
join (select a as doc_id, min(b) as component_id from reach group by a) c using (doc_id)
""")
def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity_join.link_components(_table(spark, sf_dir, "documents"), size=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op1_line_dedup", sql="""
with l as (
  select doc_id, k as line, x as content, list_filter(regexp_split_to_array(
    translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
  from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k
    from documents)
), s as (
  select distinct doc_id, line, array_to_string(w[k : k + 4], ' ') as sh
  from l, unnest(range(1, greatest(2, len(w) - 3))) as r(k) where len(w) > 0
), n as (
  select doc_id, line, count(*) as n from s group by all
), p as (
  select a.doc_id, a.line, b.doc_id as by_doc, b.line as by_line, count(*) as c
  from s a join s b on a.sh = b.sh and (b.doc_id, b.line) < (a.doc_id, a.line) group by all
), m as (
  select distinct p.doc_id, p.line from p join n x on (x.doc_id, x.line) = (p.doc_id, p.line)
  join n y on (y.doc_id, y.line) = (by_doc, by_line) where 10 * c >= 8 * (x.n + y.n - c)
)
select l.doc_id, count(*)::bigint as n_lines, count(m.line)::bigint as n_removed,
  coalesce(string_agg(case when m.line is null then content end, chr(10) order by l.line), '') as text
from l left join m on m.doc_id = l.doc_id and m.line = l.line group by l.doc_id
""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_matched_lines(documents).select("doc_id", "n_lines", "n_removed", "text")


@query("op2_repeats")
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repeats.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_repeats", "longest_repeat", "covered_chars",
    )


#: Verdict, host and path of each rule.
RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query("op3_redirects")
def op3_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = aliases.judge_pages(_table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("aliases_linked", sql="""
with u as (
  select page_id, url, lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')) as host,
    regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages
), v as (
  select *, case when (host = 'net' or host like '%.net') and (starts_with(path, '/es/') or starts_with(path, '/fr/')) then 'block'
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'allow'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'block'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'allow' end as own,
    case when contains(url, '://') then regexp_replace(regexp_replace(host, ':(80|443)?$', ''), '^(www|m)\\.', '')
      || case when path = '' then '/' else path end || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
        string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'),
        lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&'), ''), '') end as node
  from u
), e as (
  select a.node as a, b.node as b from v a join v b on b.page_id = a.page_id - a.page_id % 7
  where a.node is not null and b.node is not null
), c as (
  select node, node as root from (select distinct node from v where node is not null)
), both_ways as (
  select a, b from e union select b, a from e
), reach as (
  with recursive r as (
    select node as a, node as b from c union select r.a, both_ways.b from r join both_ways on both_ways.a = r.b
  ) select a as node, min(b) as class from r group by a
), decided as (
  select class, bool_or(own = 'allow') as allows, bool_or(own = 'block') as blocks from v join reach using (node) group by class
)
select page_id, coalesce(own, case when blocks and not coalesce(allows, false) then 'block' end, 'allow') as verdict,
  class as alias_class
from v left join reach using (node) left join decided using (class)
""")
def aliases_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts through a table of redirects: each page leads to the one whose id is the next smaller multiple of seven."""
    pages = _table(spark, sf_dir, "pages")
    target = pages.select(F.col("page_id").alias("__to"), F.col("url").alias("to_url"))
    links = pages.join(target, F.col("__to") == F.col("page_id") - F.col("page_id") % 7).select(
        F.col("url").alias("from_url"), "to_url"
    )
    judged = aliases.judge_pages(pages, RULES, links=links)
    return judged.select("page_id", "verdict", "alias_class")


#: Stands for a secret that a user passes in.
PSEUDONYM_KEY = "example key"


@query("op4_pseudonyms")
def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(documents, PSEUDONYM_KEY).select("doc_id", "n_pseudonyms", "text")


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(_hash_mod("doc_id", 5) != 0)
    scored = nbsvm.predict(documents, nbsvm.fit(documents, labels, "quality"))
    return scored.select(
        "doc_id", (_hash_mod("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op11_secrets")
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = F.filter("secrets", lambda s: s["layers"] == "")
    number = lambda kind: F.size(F.filter(shown, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(number, secrets.KINDS), F.sha2(secrets.written(shown), 256).alias("base_sha256"),
        secrets.written(F.col("secrets")).alias("spans"), "n_layers", "n_unread",
    )


@query("op12_hard_negatives", sql="""
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), u as (
  select vec_id, label, v from r group by all
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
    list_inner_product(a.v::double[], b.v::double[])::bigint as score
  from u a join u b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::int as rank,
  id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 3
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(
        _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 50 == 0
    )


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align(documents, TOKENIZER, public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return aligned.with_counts().select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )
