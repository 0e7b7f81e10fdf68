"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripletframe.llm import bpe, packing
from tripletframe.llm.common import table
from tripletframe.llm.exact_dedup import exact_dedup
from tripletframe.llm.lexical_search import lexical_search
from tripletframe.llm.line_dedup import line_dedup
from tripletframe.llm.lm import lm_scores
from tripletframe.llm.merkle import tampered_manifest
from tripletframe.llm.simhash import simhash_dedup
from tripletframe.llm.substring_dedup import substring_dedup
from tripletframe.llm.token_counts import token_counts
from tripletframe.llm.topk import integer_vectors, top_inner_products
from tripletframe.llm.toxicity import toxicity
from tripletframe.llm.warc import header_lines, resolve_revisits

#: Vocabularies: encoding and packing; language model; unigram counts.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text")


OP1_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       row_number() over (same order by doc_id desc) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"), width=4, distance=4)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), PIECES)


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records derived from ``pages``: of every page a full response and, later, a not-modified revisit.

    Times, validators and headers follow from page_id and html alone. The
    revisit comes under another spelling of the URL; one in seven carries a
    foreign entity tag, one in five none.
    """
    i, mark = F.col("page_id"), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16)
    day = F.concat(F.lit("day-"), (i % 365).cast("string"))
    tag = F.concat(F.lit('"'), mark, F.lit('"'))
    first = F.create_map(
        F.lit("cache-control"), F.lit("max-age=60"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Content-Type"), F.lit("text/html"),
        F.lit("date"), F.concat(F.lit("t"), i.cast("string")), F.lit("ETag"), F.when(i % 11 != 0, tag), F.lit("last-modified"), day)
    again = F.create_map(
        F.lit("Cache-Control"), F.lit("max-age=3600"), F.lit("content-length"), F.lit("0"), F.lit("date"), F.concat(F.lit("r"), i.cast("string")),
        F.lit("etag"), F.when(i % 7 == 0, F.lit('"foreign"')).when(i % 5 != 0, F.concat(F.lit("W/"), tag)), F.lit("last-modified"), F.when(i % 3 == 0, day), F.lit("x-cache"), F.lit("revalidated"))
    real = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    page = pages.select(i.cast("long").alias("page_id"), "url", "html")
    full = page.select((i * 2).alias("record_id"), "url", at(i * 60).alias("ts"), F.lit("response").alias("kind"), real(first).alias("headers"), F.sha2(F.col("html").cast("binary"), 256).alias("payload_sha256"))
    other = F.regexp_replace(F.regexp_replace(F.col("url"), "^https?://", "HTTP://WWW."), r"/?$", "")
    late = page.select((i * 2 + 1).alias("record_id"), other.alias("url"), at(i * 60 + (i % 13 - 1) * 86_400).alias("ts"), F.lit("revisit").alias("kind"), real(again).alias("headers"), F.lit(None).cast("string").alias("payload_sha256"))
    return full.unionByName(late)


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    return found.select("record_id", "url_key", "refers_to", "status", header_lines(F.col("headers")).alias("headers"), "payload_sha256")


OP7_SQL = r"""
with p as (
  select page_id, url, html, page_id * 60 as t, page_id * 60 + (page_id % 13 - 1) * 86400 as rt,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' as tag, 'day-' || (page_id % 365) as day,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', 'HTTP://WWW.'), '/?$', ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rbare
  from pages),
q as (
  select *, {key_full} as url_key, {key_late} as rurl_key,
    case when page_id % 11 <> 0 then tag end as etag,
    case when page_id % 7 = 0 then '"foreign"' when page_id % 5 <> 0 then 'W/' || tag end as retag,
    case when page_id % 3 = 0 then day end as rday
  from p),
m as (
  select r.*, f.page_id as f_id, f.etag as f_etag, f.day as f_day, f.html as f_html, f.t as f_t
  from q r asof left join (select * from q qualify row_number() over (partition by url_key, t order by page_id desc) = 1) f on r.rurl_key = f.url_key and r.rt > f.t),
s as (
  select *, case when f_id is null then 'unresolved'
      when retag is not null and f_etag is not null then case when replace(retag, 'W/', '') = f_etag then 'resolved' else 'mismatch' end
      when rday is not null then case when rday = f_day then 'resolved' else 'mismatch' end
      when retag is null and rday is null then 'unchecked' else 'mismatch' end as status
  from m)
select page_id * 2 + 1 as record_id, rurl_key as url_key, f_id * 2 as refers_to, status,
  case when status in ('resolved', 'unchecked') then concat_ws(chr(10), 'cache-control: max-age=3600', 'content-length: ' || strlen(f_html), 'content-type: text/html',
      'date: r' || page_id, 'etag: ' || f_etag, 'last-modified: ' || coalesce(rday, f_day), 'x-cache: revalidated')
    else concat_ws(chr(10), 'cache-control: max-age=3600', 'content-length: 0', 'date: r' || page_id, 'etag: ' || retag, 'last-modified: ' || rday, 'x-cache: revalidated') end as headers,
  case when status in ('resolved', 'unchecked') then sha256(f_html) end as payload_sha256
from s
"""


def _key_sql(bare: str) -> str:
    """Canonical URL of a bare URL (no scheme, no fragment) in DuckDB."""
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({bare}, '^([^/?]*)', 1)), '^([^@]*@)?(www\\.)?', ''), ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    kept = (f"list_sort(list_filter(string_split(regexp_extract({bare}, '\\?(.*)$', 1), '&'), "
            "lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=&]*|ref|fbclid|gclid|sessionid)(=|$)')))")
    return f"{host} || {path} || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end"


OP7_SQL = OP7_SQL.replace("{key_full}", _key_sql("bare")).replace("{key_late}", _key_sql("rbare"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(integer_vectors(table(spark, sf_dir, "embeddings")), k=5, query_step=50)


OP9_SQL = """
with w as (select greatest(1, max(len(embedding))) as width from embeddings),
v as (
  select row_number() over () as rid, vec_id, list_resize(list_transform(embedding, lambda x: floor(256 * cast(x as double))), width, 0) as e from embeddings, w
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.rid, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.rid <> c.rid where q.vec_id % 50 = 0)
select query_id, cast(row_number() over (partition by rid order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 5
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048, end_id=0, digest=True), capacity=2048)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(table(spark, sf_dir, "documents"))


OP11_SQL = """
with recursive table32 as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
docs as (
  select row_number() over () as rid, doc_id, source, lang, n_chars, text,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda k: cast(ascii(substr(cast(doc_id as varchar), k, 1)) as bigint))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 as hit
  from documents, table32),
hashed as (
  select rid, doc_id, lang, sha256({head} || {chars} || {tail}) as leaf, sha256({head} || {more} || {tail}) as other, coalesce(hit, false) as hit from docs),
groups as (select lang, count(*) as n, row_number() over (order by lang nulls first) - 1 as tree from hashed group by lang),
leaves as (
  select h.*, g.tree, g.n, row_number() over (partition by g.tree order by doc_id nulls last, leaf) - 1 as pos
  from hashed h join groups g on h.lang is not distinct from g.lang),
nodes as (
  select tree, 0 as level, pos, n, leaf as d from leaves
  union all
  select tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' order by pos)) from nodes where n > 1 group by tree, level, pos // 2, n),
subroots as (select tree, level as height, d as subroot from nodes where n = 1),
over as (
  select 0 as level, tree as pos, (select count(*) from groups) as n, subroot as d from subroots
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' order by pos)) from over where n > 1 group by level, pos // 2, n),
steps as (
  select l.rid, r.level as step, l.pos >> r.level as spot, s.d
  from leaves l join subroots u using (tree) join (select distinct level from nodes) r on r.level < u.height
  left join nodes s on s.tree = l.tree and s.level = r.level and s.pos = xor(l.pos >> r.level, 1)
  union all
  select l.rid, 1000 + r.level, l.tree >> r.level, s.d
  from leaves l join (select distinct level from over where n > 1) r on true
  left join over s on s.level = r.level and s.pos = xor(l.tree >> r.level, 1)),
proofs as (
  select rid, sha256(coalesce(string_agg(d, '' order by step), '')) as proof_sha256,
    list(case when d is null then '-' when spot & 1 = 1 then 'L' || d else 'R' || d end order by step) as path
  from steps group by rid)
select l.doc_id, l.leaf, u.subroot, o.d as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256,
  list_reduce(list_prepend(case when l.hit then l.other else l.leaf end, coalesce(p.path, [])),
    lambda d, e: case e[1] when 'L' then sha256(e[2:] || d) when 'R' then sha256(d || e[2:]) else sha256(d) end) as folded_root,
  folded_root = root as verified
from leaves l join subroots u using (tree) join over o on o.n = 1 left join proofs p using (rid)
"""


def _field_sql(value: str) -> str:
    return f"case when {value} is null then '-' else strlen(cast({value} as varchar)) || ':' || {value} end"


OP11_SQL = (OP11_SQL.replace("{head}", " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang"))).replace("{chars}", _field_sql("n_chars"))
            .replace("{more}", _field_sql("(cast(n_chars as hugeint) + 1)")).replace("{tail}", _field_sql("text")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=50)


OP12_SQL = r"""
with words as (
  select rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select *, row_number() over () as rid from documents)),
lengths as (select rid, any_value(doc_id) as doc_id, count(*) as n from words group by rid),
total as (select count(*) as n_docs, sum(n) as n_terms from lengths),
counts as (select rid, term, count(*) as tf from words group by rid, term),
weights as (
  select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from counts, total group by term, n_docs),
asked as (
  select distinct number, item_id, term from (
    select number, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select *, row_number() over () as number from benchmark))),
scores as (
  select number, a.item_id, l.rid, l.doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (cast(50 as hugeint) * n * n_docs) // n_terms)))) as bigint) as score
  from asked a join weights using (term) join counts using (term) join lengths l using (rid), total group by all)
select item_id, cast(row_number() over (partition by number order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
from scores where score > 0 qualify rank <= 50
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = """
with lines as (
  select rid, doc_id, generate_subscripts(parts, 1) as nr, unnest(parts) as line
  from (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
often as (select key, max(doc_id) as top from keyed where length(key) >= 40 group by key having count(distinct rid) >= 5),
marked as (select k.*, coalesce(o.top is not null and k.doc_id is distinct from o.top, false) as gone from keyed k left join often o using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by nr) filter (where not gone), '')) as kept_sha256
from marked group by rid
"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_lm_scores": op4_lm_scores,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_toxicity": op8_toxicity,
    "op9_exact_topk": op9_exact_topk,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op7_warc_revisits": OP7_SQL, "op9_exact_topk": OP9_SQL,
           "op11_merkle_manifest": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_line_dedup": OP13_SQL}
