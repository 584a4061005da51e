"""The queries of the text operators: name -> function of (spark, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .dedup_exact import exact_groups

    return exact_groups(table(spark, folder, "documents")).drop("locator")


def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    from .html_main import main_text

    return main_text(table(spark, folder, "pages"))


def op3_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    from .chat import rotate

    return rotate(table(spark, folder, "conversations"))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from .jaccard import jaccard_groups

    return jaccard_groups(table(spark, folder, "documents"))


def op7_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


def fold(modulus: int):
    """crc32 of the identifier as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from .common import slim_join
    from .toxicity import fit, score, text_key

    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    texts = docs.filter(fold(3) != 1).select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    train = slim_join(texts, labels.select("doc_id", "toxic").filter("toxic is not null"), "doc_id", "inner")
    out = score(docs, fit(train, key_col="text_key"))
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    from .language import fit, predict

    docs = table(spark, folder, "documents")
    out = predict(docs, fit(docs.filter(fold(4) != 2)))
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from .mixing import mix_plan

    return mix_plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_main_text, op2_toxicity, op3_perspectives, op4_pattern_packing, op5_language, op6_ngram_jaccard, op7_near_vectors, op8_mixing, op9_token_counts, op10_exact_dedup)}

SQL = {
    # the generated pages mark their article; main_text itself tells it by what recurs on a host
    "op1_main_text": r"""
        with a as (select page_id, url, regexp_split_to_array(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>|</?b>', ' ', 'g'), '</?(p|h1)>') blocks from pages),
        d as (select page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) blocks from a),
        t as (select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as text from d)
        select page_id, url, text, cast(length(text) as bigint) n_chars from t
    """,
    "op3_perspectives": r"""
        with t as (select conv_id, turn, coalesce(role, 'unknown') speaker, coalesce(text, '') text from conversations),
        o as (select *, row_number() over (partition by conv_id order by turn nulls last, speaker, text) - 1 as position from t),
        p as (select distinct conv_id c, speaker perspective from t where speaker <> 'system'),
        r as (select conv_id, perspective, position, turn, speaker, text,
                     case when speaker = 'system' then speaker when speaker = perspective then 'assistant' else 'user:' || speaker end as label
              from o join p on conv_id is not distinct from c),
        s as (select *, '<|' || label || '|>' || chr(10) || text || '<|end|>' || chr(10) as rendered from r),
        e as (select *, sum(length(rendered)) over (partition by conv_id, perspective order by position) as ends from s)
        select conv_id, perspective, cast(position as bigint) as position, turn, speaker, label, rendered,
               cast(ends - length(rendered) as bigint) as start, cast(ends as bigint) as "end",
               cast(case when speaker = perspective then ends - length(text) - 8 else -1 end as bigint) as mask_start,
               cast(case when speaker = perspective then ends else -1 end as bigint) as mask_end, speaker = perspective as target
        from e
    """,
    "op6_ngram_jaccard": r"""
        with recursive t as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from t where len(w) > 0)),
        n as (select doc_id, count(*) n from s group by doc_id),
        p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
        e as (select x, y from l union all select y, x from l),
        r as (select doc_id i, doc_id j from documents union select r.i, e.y from r join e on r.j = e.x),
        c as (select i, min(j) c from r group by i)
        select documents.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, c component_id from documents left join n on n.doc_id = documents.doc_id join c on i = documents.doc_id
    """,
    "op7_near_vectors": """
        with recursive v as (
            select vec_id, label, embedding::double[] e from embeddings
            where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
              and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
              where list_cosine_similarity(a.e, b.e) >= 0.98),
        r as (select vec_id i, vec_id j from embeddings union select r.i, l.b from r join l on r.j = l.a),
        c as (select i, min(j) c from r group by i),
        n as (select a, count(*) n from l group by a)
        select vec_id, cast(coalesce(n, 0) as bigint) n_links, c component_id, vec_id = c kept
        from embeddings left join n on a = vec_id join c on i = vec_id
    """,
    "op10_exact_dedup": r"""
        with t as (select doc_id, length(coalesce(text, '')) n,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents),
             g as (select doc_id, norm, first_value(doc_id) over (partition by norm order by n desc, doc_id) keep_id,
                          count(*) over (partition by norm) group_size from t)
        select doc_id, keep_id, cast(group_size as bigint) group_size, doc_id = keep_id kept, sha256(norm) text_sha256 from g
    """,
}
