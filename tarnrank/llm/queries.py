"""The queries of the operators: thin digests over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup as op

    return op.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id as op

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    prototypes = op.learn(docs.where(~op.held_out()))
    found = op.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", op.held_out().alias("held_out"), "lang_pred", "score")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii as op

    return op.digest(op.detect(documents(spark, sf_dir)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe as op

    return op.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan as op

    return op.digest(op.findings(documents(spark, sf_dir).select("doc_id", "text")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash as op

    found = op.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_count as op

    return op.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup as op

    return op.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination as op

    found = op.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), distance=op.WINDOW)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.size("near").cast("long").alias("n_near"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan as op

    licenses = F.array_sort(F.array_distinct(F.transform("found", lambda m: m["license"])))
    return op.scan(documents(spark, sf_dir)).select(
        "doc_id",
        F.size(licenses).cast("long").alias("n_licenses"),
        F.array_join(licenses, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["containment"])), F.lit(0.0)).alias("containment"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    import public_tokenizers

    from . import oracles

    return {
        "op5_secret_scan": oracles.secrets(),
        "op7_token_count": oracles.token_counts(public_tokenizers.path("byte_bpe_50k.tiktoken")),
        "op10_license_scan": oracles.licenses(),
        "op1_embedding_dedup": """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and list_bool_and([x is not null and isfinite(x) for x in embedding])),
n as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as norm from v where list_inner_product(e, e) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id
  where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a as vec_id, min(b) as low from reach group by a),
k as (select a as vec_id, count(*) as n_links from links group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id,
  least(vec_id, coalesce(low, vec_id)) = vec_id as kept
from embeddings left join c using (vec_id) left join k using (vec_id)
""",
        "op9_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
bw as (
  select item_id, w, array_to_string(list_slice(words, s, s + w - 1), ' ') as k
  from (select item_id, words, least(13, len(words)) as w, unnest(range(1, len(words) - least(13, len(words)) + 2)) as s from b where len(words) > 0)),
dw as (
  select doc_id, w, s, array_to_string(list_slice(words, s, s + w - 1), ' ') as k
  from (select doc_id, words, w, unnest(range(1, len(words) - w + 2)) as s from d, (select distinct w from bw) where len(words) >= w)),
hits as (select distinct doc_id, s, w, item_id from dw join bw using (w, k)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + w)) as p from hits) group by doc_id),
ids as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id),
dp as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from d),
counts as (select word, count(*) as f from dp group by word),
bt as (select item_id, word, coalesce(f, 0) as f from (select distinct item_id, unnest(words) as word from b) left join counts using (word)),
rare as (select item_id, word, row_number() over (partition by item_id order by f, word) as r from bt),
pairs as (select x.item_id, x.word as a, y.word as b from rare x join rare y on x.item_id = y.item_id and x.r = 1 and y.r = 2),
near as (
  select doc_id, count(distinct item_id) as n_near from pairs join dp x on x.word = a join dp y using (doc_id)
  where y.word = b and abs(x.p - y.p) <= 13 group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated,
  cast(coalesce(n_near, 0) as bigint) as n_near
from d left join places using (doc_id) left join ids using (doc_id) left join near using (doc_id)
""",
        "op8_substring_dedup": r"""
with w as (
  select doc_id, case when len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) > 0
    then regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') else [] end as words
  from documents),
win as (
  select doc_id, s, md5(array_to_string(list_slice(words, s, s + 49), ' ')) as h
  from (select doc_id, words, unnest(range(1, len(words) - 48)) as s from w where len(words) >= 50)),
firsts as (select h, min(doc_id) as m from win group by h having min(doc_id) < max(doc_id)),
gone as (
  select distinct doc_id, p from (
    select win.doc_id, unnest(range(s, s + 50)) as p from win join firsts using (h) where win.doc_id > m)),
kept as (
  select doc_id, string_agg(word, ' ' order by p) as kept
  from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from w) t
  where not exists (select 1 from gone g where g.doc_id = t.doc_id and g.p = t.p) group by doc_id),
counts as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id) left join counts using (doc_id)
""",
    }
