"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winaudit.functions.scratch import scratch_path
from winaudit.llm import bpe, embeddings, exact_dedup, jaccard, license_scan, maxent, mixing, negatives, periodic, quality, topk, url_filter, warc

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.known_licenses(spark))
    return out.select(F.col("id").alias("doc_id"), "digest", "license", F.array_join("notices", ",").alias("notices"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(warc.record_types(_table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    out = warc.read_pages(index, folder)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.with_ids(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern, decoded="decoded")
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = quality.judged(docs, _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return out.select(F.col("id").alias("doc_id"), "p_text", "host_mean", "path_mean", "p_quality", "keep")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic end in a tenth of the documents, told by their ids' CRC-32; a null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (3 + (n - a) // p))[: n - a]


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.with_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=with_period)
    top = periodic.strongest(F.col("runs"))
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return out.select("id", "n_words", "runs", "collapsed", top.alias("top")).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10, 1024)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label, 256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": license_scans,
    "op2_warc": warc_archives,
    "op3_byte_bpe": byte_bpe,
    "op4_exact_dedup": exact_duplicates,
    "op5_ngram_jaccard": ngram_jaccard,
    "op6_mixing": mixing_weights,
    "op7_url_filters": url_filters,
    "op8_embedding_near_dedup": embedding_near_dedup,
    "op9_quality_classifier": quality_classifier,
    "op10_lm_scoring": lm_scoring,
    "op11_periodic_runs": periodic_runs,
    "op12_exact_top_k": exact_top_k,
    "op13_hard_negatives": mined_negatives,
}


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_AZ = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"
#: Of rows of a table with unique ids: those whose vectors take part, and the inner product of two of them.
_SOUND = "embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
_INNER = "cast(list_sum(list_transform(list_zip(a.v, b.v), lambda t: t[1] * t[2])) as bigint)"


def _license_sql() -> str:
    at = lambda pattern, x: pattern.replace("@", x)
    values = ",\n".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in license_scan.KNOWN)
    spelled = "replace(' ' || @ || ' ', ' ', '  ')"
    for a, b in license_scan.SPELLINGS:
        spelled = f"replace({spelled}, '{license_scan.spaced(a)}', '{license_scan.spaced(b)}')"
    spelled = f"trim(replace({spelled}, '  ', ' '))"
    copyright = "(regexp_matches(x, '" + license_scan.COPYRIGHT + "') and not regexp_matches(x, '" + license_scan.ABOUT_COPYRIGHT + "'))"
    clean = "list_filter(list_transform(@, lambda x: trim(regexp_replace(x, '[^\\p{L}\\p{N}]+', ' ', 'g'))), lambda x: x <> '')"
    words = at(clean, f"list_filter(string_split(lower(@), chr(10)), lambda x: not {copyright})")
    paragraphs = f"list_transform(regexp_split_to_array(lower(@), '{license_scan.PARAGRAPH}'), lambda p: string_split(p, chr(10)))"
    begins = f"list_position(list_transform(q, lambda x: {copyright}), true)"
    bare = at(clean, f"flatten(list_transform({paragraphs}, lambda q: case when coalesce({begins}, 0) > 0 then q[:{begins} - 1] else q end))")
    return f"""
with known(license, body) as (values {values}),
kd as (select sha256(form) as digest, min(license) as license from
  (select license, {at(spelled, f"array_to_string({at(words, 'body')}, ' ')")} as form from known union all select license, {at(spelled, f"array_to_string({at(bare, 'body')}, ' ')")} from known) where form <> '' group by 1),
d as (select doc_id, {at(words, "coalesce(text, '')")} as words, {at(bare, "coalesce(text, '')")} as bare from documents),
whole as (select doc_id, sha256({at(spelled, "array_to_string(words, ' ')")}) as digest, sha256({at(spelled, "array_to_string(bare, ' ')")}) as bare from d),
lines as (select distinct doc_id, license from (select doc_id, sha256({at(spelled, "line")}) as digest from (select doc_id, unnest(words) as line from d)) join kd using (digest)),
n as (select doc_id, string_agg(license, ',' order by license) as notices from lines group by 1)
select w.doc_id, w.digest, least(kd.license, ks.license) as license, coalesce(n.notices, '') as notices
from whole w left join kd using (digest) left join kd ks on ks.digest = w.bare left join n on n.doc_id = w.doc_id"""


ORACLES: dict[str, str] = {
    "op1_license_scans": _license_sql(),
    # DuckDB has no base32; SHA-1's hex digits are taken five at a time, 20 bits, four letters.
    "op2_warc": f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
g as (select html, max(page_id) as first from p group by html),
d as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((('0x' || substr(h, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31 as bigint), 1), '' order by i) as digest
  from (select distinct h from p), range(32) r(i) group by h)
select page_id, cast(strlen(p.html) as bigint) as payload_bytes, d.digest as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from p join g on p.html = g.html join d on p.h = d.h""",
    "op4_exact_dedup": f"""
with d as (select doc_id, translate(coalesce(text, ''), {_AZ}) as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)""",
    "op5_ngram_jaccard": rf"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') as ws from documents),
d as materialized (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as shingles from w),
s as materialized (select doc_id, unnest(shingles) as shingle from d),
n as materialized (select doc_id, len(shingles) as n from d),
b as (select x.doc_id as a, y.doc_id as b, count(*) as n from s x join s y using (shingle) where x.doc_id <> y.doc_id group by all),
l as materialized (select b.a, b.b from b join n x on x.doc_id = b.a join n y on y.doc_id = b.b where 100 * b.n >= {jaccard.PERCENT} * (x.n + y.n - b.n)),
r(doc_id, reached) as (select doc_id, doc_id from n union select r.doc_id, l.b from r join l on l.a = r.reached)
select doc_id, cast(any_value(n.n) as bigint) as n_shingles, min(reached) as component_id from n join r using (doc_id) group by doc_id""",
    "op7_url_filters": f"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {_AZ}) as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(rhost, rpath, verdict) as (values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
f as (select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
  from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join f using (page_id)""",
    "op8_embedding_near_dedup": f"""
with recursive e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where {_SOUND} and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as materialized (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as l from e),
k as materialized (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id where {_INNER.replace("as bigint", "as double")} >= 0.9e0 * a.l * b.l),
r(vec_id, reached) as (select vec_id, vec_id from n union select r.vec_id, k.b from r join k on k.a = r.reached),
c as (select vec_id, min(reached) as component_id from r group by vec_id), d as (select a as vec_id, count(*) as n_links from k group by a)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept from embeddings left join c using (vec_id) left join d using (vec_id)""",
    "op12_exact_top_k": f"""
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings where {_SOUND}),
s as (select a.vec_id as query_id, b.vec_id, {_INNER} as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""",
    "op13_hard_negatives": f"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings where label is not null and {_SOUND}),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike, {_INNER} as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where alike qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from p join s using (anchor_id) where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
}
