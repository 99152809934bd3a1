"""The registered queries of the corpus operators: each applies one to its whole table and digests the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .jaccard import jaccard_components
from .language import held_out, identify, learn
from .packing import pack_documents
from .phrases import collocations
from .secrets import named, secrets
from .sharding import documents, minimax_shards
from .simple8b import read_tokens, write_tokens
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .topk import quantized, top_k
from .trie import ordered, prefix_trie, rebuilt
from .url_rules import judge


def op1_suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return suffix_dedup(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_suffix_dedup_digest(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_simple8b_digest(docs: DataFrame, path: str) -> DataFrame:
    return read_tokens(write_tokens(docs, path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_simple8b_digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_packing_rows(docs: DataFrame, path: str) -> DataFrame:
    return pack_documents(docs, path)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_packing_rows(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_topk_rows(vectors: DataFrame) -> DataFrame:
    return top_k(vectors.select("vec_id", quantized("embedding").alias("v")), F.col("vec_id") % 20 == 0)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_topk_rows(table(spark, sf_dir, "embeddings"))


def op3_language_rows(docs: DataFrame) -> DataFrame:
    found = identify(docs.select("doc_id", "text"), learn(docs, F.col("doc_id").isNotNull() & ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_language_rows(table(spark, sf_dir, "documents"))


def op8_decontaminate_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_decontaminate_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_rows(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_jaccard_rows(table(spark, sf_dir, "documents"))


def op5_sharding_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    placed = minimax_shards(documents(docs), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_sharding_rows(table(spark, sf_dir, "documents"))


#: The query's rules.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op7_secrets_rows(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return secrets(docs).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_secrets_rows(table(spark, sf_dir, "documents"))


def op11_collocations_rows(docs: DataFrame) -> DataFrame:
    return collocations(docs)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_collocations_rows(table(spark, sf_dir, "documents"))


def op12_token_counts_rows(docs: DataFrame) -> DataFrame:
    return token_counts(docs, tokenizer("byte_bpe_50k.json"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_token_counts_rows(table(spark, sf_dir, "documents"))


def op13_prefix_trie_rows(conversations: DataFrame, bits: int = 61) -> DataFrame:
    conv = F.col("conv").cast("long")
    rows = ordered(conversations, bits)
    convs, turns = rebuilt(rows, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5)
    return prefix_trie(convs, turns, rows)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_prefix_trie_rows(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_topk": op2_topk,
    "op3_language": op3_language,
    "op4_simple8b": op4_simple8b,
    "op5_sharding": op5_sharding,
    "op6_url_rules": op6_url_rules,
    "op7_secrets": op7_secrets,
    "op8_decontaminate": op8_decontaminate,
    "op9_jaccard": op9_jaccard,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_token_counts": op12_token_counts,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op8_decontaminate": """
with t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents
), b as (
  select cast(item_id as varchar) as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark where item_id is not null
), bw as materialized (
  select distinct item, least(13, len(w)) as k, array_to_string(w[i.i : i.i + least(13, len(w)) - 1], ' ') as p
  from b, unnest(range(1, greatest(cast(len(w) as bigint) - 12, 1) + 1)) as i(i) where len(w) > 0
), k as (
  select distinct k from bw
), dw as (
  select doc_id, k.k, i.i, array_to_string(w[i.i : i.i + k.k - 1], ' ') as p
  from t, k, unnest(range(1, cast(len(w) as bigint) - k.k + 2)) as i(i) where len(w) >= k.k
), h as materialized (
  select doc_id, dw.k, i, item from dw join bw on bw.k = dw.k and bw.p = dw.p
), hit as (
  select doc_id, count(distinct u) as n from (select doc_id, unnest(range(i, i + k)) as u from h) group by doc_id
), named as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id
)
select t.doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) as contaminated
from t left join hit using (doc_id) left join named using (doc_id)
""",
    "op9_jaccard": """
with recursive t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), s as materialized (
  select distinct doc_id, array_to_string(w[i.i : i.i + 2], ' ') as p from t, unnest(range(1, greatest(cast(len(w) as bigint) - 2, 1) + 1)) as i(i) where len(w) > 0
), n as materialized (
  select doc_id, count(*) as n from s group by doc_id
), e as materialized (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.p = b.p and a.doc_id < b.doc_id
  group by 1, 2 having 100 * count(*) >= 90 * ((select n from n where doc_id = a.doc_id) + (select n from n where doc_id = b.doc_id) - count(*))
), l as materialized (
  select a, b from e union all select b, a from e
), r as (
  select doc_id as d, doc_id as o from n union select r.d, l.b from r join l on l.a = r.o
)
select t.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.o, t.doc_id) as component_id
from t left join n using (doc_id) left join (select d as doc_id, min(o) as o from r group by d) m using (doc_id)
""",
    "op11_collocations": """
with t as (
  select coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents where text is not null
), p as (
  select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from t
), w as (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p
), g as (
  select lang, m.m as words, array_to_string(w[i.i : i.i + m.m - 1], ' ') as phrase
  from w, unnest(range(1, 5)) as m(m), unnest(range(1, cast(len(w) as bigint) - m.m + 2)) as i(i)
), f as materialized (
  select lang, words, phrase, cast(count(*) as bigint) as f from g group by all
), totals as (
  select lang, cast(sum(f) as bigint) as n from f where words = 1 group by lang
), c as materialized (
  select *, string_split(phrase, ' ') as w from f where words > 1 and f >= 30
), parts as materialized (
  select c.lang, c.phrase, c.f, k.k, array_to_string(w[1 : k.k], ' ') as head, array_to_string(w[k.k + 1 : words], ' ') as rest
  from c, unnest(range(1, 4)) as k(k) where k.k < c.words
), cuts as (
  select p.lang, p.phrase, p.f as a, p.k, x.f as l, y.f as r, (2000000 * cast(p.f as hugeint)) // (cast(x.f as hugeint) + y.f) as score
  from parts p join f x on x.lang = p.lang and x.phrase = p.head join f y on y.lang = p.lang and y.phrase = p.rest
), best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
  select c.lang, array_to_string(c.w[i.i : i.i + m.m - 1], ' ') as phrase, max(c.f) as longer
  from c, unnest(range(2, 4)) as m(m), unnest(range(1, 4)) as i(i) where m.m < c.words and i.i + m.m - 1 <= c.words group by 1, 2
), kept as (
  select b.lang, b.phrase, a, l, r, cast(score as bigint) as score from best b
  left join inside i on i.lang = b.lang and i.phrase = b.phrase where longer is null or 100 * cast(longer as hugeint) < 80 * cast(a as hugeint)
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
""",
    "op13_prefix_trie": """
with o as (
  select cast(conv_id as bigint) as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} as x
  from conversations where conv_id is not null
), own as (
  select c, list(x order by i) as turns from o group by c
), shared as (
  select *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, cast(len(cast(c as varchar)) as bigint) + 1), lambda p:
    list_prepend(cast(256 + ascii(substr(cast(c as varchar), cast(p as int), 1)) as bigint), list_transform(range(8), lambda z: cast(0 as bigint)))))),
    lambda s, b: case when b >= 256 then xor(s, b - 256) else xor(s >> 1, (s & 1) * 3988292384) end), 4294967295) % 6 as h from own
), built as (
  select s.c, list_concat(case when h > 0 and b.c is not null then b.turns[1 : h] else [] end, case when len(s.turns) > h then s.turns[h + 1 : len(s.turns)] else [] end) as turns
  from shared s left join own b on b.c = s.c - s.c % 100
), members as (
  select c, d.d, coalesce(turns[1 : d.d], []) as path, len(turns) as size from built, unnest(range(0, cast(len(turns) as bigint) + 1)) as d(d)
), nodes as (
  select path, d, min(c) as conv_id, count(*) as n, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where size = d), '') as ends
  from members group by path, d
), kids as (
  select k.*, p.conv_id as parent from nodes k left join nodes p on k.d > 0 and p.d = k.d - 1 and p.path = k.path[1 : k.d - 1]
), born as (
  select conv_id, d, cast(0 as bigint) + (select count(*) from kids x where x.d = n.d + 1 and x.parent = n.conv_id) as children,
    case when d = 0 then 0 else (n - 1) * length(path[d]['t']) end as mine, path, n, ends from nodes n
), below as (
  select b.path[1 : a.a] as top, a.a as depth, sum(case when children = 0 then 1 else 0 end) as leaves, sum(mine) as saved
  from born b, unnest(range(0, b.d + 1)) as a(a) group by 1, 2
)
select k.conv_id, cast(k.d as bigint) as depth, k.parent as parent_conv_id, cast(k.n as bigint) as n_convs, cast(b.children as bigint) as n_children,
  cast(s.leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(k.ends) as ends_sha256
from kids k join born b on b.conv_id = k.conv_id and b.d = k.d join below s on s.depth = k.d and coalesce(s.top, []) = k.path
""",
    "op2_topk": """
with v as (
  select vec_id, list_transform(embedding, x -> cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, x -> x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.e, c.e), p -> p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 20
""",
    "op6_url_rules": """
with u as (
  select page_id, coalesce(url, '') as url, position('://' in coalesce(url, '')) as p from pages
), h as (
  select page_id, case when p = 0 then '' else regexp_extract(substr(url, p + 3), '^([^/?#]*)([^?#]*)', 1) end as raw,
    case when p = 0 then '' else regexp_extract(substr(url, p + 3), '^([^/?#]*)([^?#]*)', 2) end as path from u
), j as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from h
), f as (
  select *, host = 'org' or ends_with(host, '.org') as org, host = 'com' or ends_with(host, '.com') as com,
    host = 'example.org' or ends_with(host, '.example.org') as example from j
), r as (
  select page_id, host, path, case
    when example and starts_with(path, '/en/1') then 'example.org/en/1' when example and starts_with(path, '/es/') then 'example.org/es/'
    when org and starts_with(path, '/') then 'org/' when com and starts_with(path, '/fr/') then 'com/fr/'
    when com and starts_with(path, '/de/') then 'com/de/' end as rule from f
)
select page_id, host, path, rule, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end as verdict from r
""",
}
