"""The registered queries of this subpackage, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import bpe, hnsw, knn, langid, minhash, mixing, negatives, quality, substring, suffix, survival, unigram, warc
from trialweave.llm.shared import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_mix_sources")
def op9(spark, sf_dir):
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", taken)


@query("op4_bpe_codec")
def op4(spark, sf_dir):
    import public_tokenizers as vocabularies

    path = vocabularies.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path, vocabularies.PATTERN, with_ids=False)


@query(
    "op2_warc_archives",
    """
    with p as (select page_id, coalesce(html, '') as h from pages),
    d as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(h) as payload_digest from p),
    m as (select *, max(page_id) over (partition by payload_digest) as top from d)
    select page_id, payload_bytes, payload_digest,
      case when payload_bytes >= 1000 and page_id is distinct from top then 'revisit' else 'response' end as record_type,
      case when payload_bytes >= 1000 and page_id is distinct from top then top end as refers_to, true as digest_ok
    from m""",
)
def op2(spark, sf_dir):
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(archives, with_payload=False)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


@query("op7_token_counts")
def op7(spark, sf_dir):
    import public_tokenizers as vocabularies

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.count_tokens(docs, vocabularies.path("piece_bpe_32k.model"))


@query("op6_quality")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op8_language")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs)
    return langid.predict(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query(
    "op5_exact_top_k",
    """
    with v as (
      select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
      where vec_id is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (
      select q.vec_id as query_id, d.vec_id, cast(list_inner_product(q.e, d.e) as bigint) as score
      from v q join v d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id)
    select query_id, cast(rank as integer) as rank, vec_id, score from (
      select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    where rank <= 5""",
)
def op5(spark, sf_dir):
    return knn.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


@query("op10_nearest_neighbours")
def op10(spark, sf_dir):
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_near_duplicates",
    rf"""
    with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
    s as (
      select doc_id, unnest(list_distinct(case when len(w) < 2 then w else
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as s from w),
    n as (select doc_id, count(*) as n from s group by doc_id),
    links as (
      select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by all) p
      join n m on a = m.doc_id join n k on b = k.doc_id where 100 * shared >= 80 * (m.n + k.n - shared)),
    edges as (select a, b from links union all select b, a from links),
    reach as (select doc_id as x, doc_id as y from w union select r.x, e.b from reach r join edges e on r.y = e.a)
    select x as doc_id, coalesce(any_value(n), 0) as n_shingles, min(y) as component_id, min(y) = x as kept
    from reach left join n on x = n.doc_id group by x""",
)
def op1(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query(
    "op3_repeated_passages",
    r"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    windows as (
      select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h
      from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
    late as (select doc_id, i from (select *, min(doc_id) over (partition by h) as first from windows) where first < doc_id),
    gone as (select distinct doc_id, i + k as i from late, range(50) r(k)),
    words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
    kept as (select doc_id, string_agg(word, ' ' order by i) as t, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
    select doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from d left join kept using (doc_id)""",
)
def op3(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


@query(
    "op11_repeated_bytes",
    """
    with d as (select doc_id, coalesce(text, '') as t, hex(coalesce(text, '')) as h from documents),
    starts as (
      select doc_id, i, md5(substring(h, cast(2 * i - 1 as bigint), 200)) as w
      from (select doc_id, h, unnest(range(1, cast(length(h) // 2 as bigint) - 98)) as i from d where length(h) >= 200)),
    late as (select doc_id, i from starts qualify row_number() over (partition by w order by doc_id, i) > 1),
    runs as (
      select doc_id, min(i) as a, max(i) + 99 as b from (
        select *, sum(new) over (partition by doc_id order by i) as run from (
          select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as new from late))
      group by doc_id, run),
    ends as (select doc_id, a, b from runs union all select doc_id, length(h) // 2 + 1, length(h) // 2 from d),
    gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as last from ends),
    left_over as (
      select doc_id, cast(count(*) - 1 as bigint) as n_spans, cast(sum(b - a + 1) as bigint) as n_removed,
        string_agg(substring(h, cast(2 * last + 1 as bigint), cast(2 * (a - last - 1) as bigint)), '' order by a) as kept
      from gaps join d using (doc_id) group by doc_id)
    select doc_id, cast(length(h) // 2 as bigint) as n_bytes, n_removed, n_spans, sha256(unhex(kept)) as kept_sha256
    from d join left_over using (doc_id)""",
)
def op11(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), output="")


@query(
    "op13_filter_interactions",
    r"""
    with d as (
      select coalesce(lang, '') as part, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
        coalesce(min(doc_id) over (partition by coalesce(text, '')) < doc_id, false) as copy from documents),
    l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
    f as (
      select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, (len(w) < 200)::int
        + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * copy::int as mask from d left join l using (doc_id)),
    g as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
    letters as (select chr(65 + i::int) as letter, (1 << i)::int as bit from range(5) r(i)),
    orders as (
      select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
      from letters a, letters b, letters c, letters d, letters e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
    steps as (select filter_order, i::int as step, bits[i] as bit, coalesce(list_sum(bits[1:i - 1]), 0)::int as gone from orders, range(1, 6) r(i)),
    counts as (
      select part, filter_order, step, any_value(bit) as bit, coalesce(sum(n) filter (mask & (gone | bit) = 0), 0)::bigint as kept,
        coalesce(sum(n) filter (mask & gone = 0 and mask & bit > 0), 0)::bigint as removed,
        coalesce(sum(n) filter (mask & gone > 0 and mask & bit > 0), 0)::bigint as redundant,
        coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (mask & gone = 0 and mask & bit > 0), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (mask & gone = 0 and mask & bit > 0), 0)::bigint as toxic_lost
      from g, steps group by part, filter_order, step)
    select * exclude (bit), sum(removed) over (partition by part, bit)::bigint as shapley from counts""",
)
def op13(spark, sf_dir):
    return survival.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op12_hard_negatives",
    """
    with v as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
      where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (
      select q.vec_id as anchor_id, d.vec_id, q.label = d.label as same, cast(list_inner_product(q.e, d.e) as bigint) as score
      from v q join v d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id),
    p as (
      select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
    n as (
      select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
        cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank
      from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
    select * from n where rank <= 3""",
)
def op12(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), lambda i: i % 50 == 0)
