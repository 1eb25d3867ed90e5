"""The queries opN_<name> of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clusters, source_mix, whitening
from .chat_format import chat_format, digest
from .compression_bands import compression_bands
from .decontaminate import decontaminate
from .hilbert_shards import hilbert_shards
from .ngram_join import ngram_join
from .ordinal_quality import ordinal_quality
from .packing import best_fit_packing
from .pii import personal_data
from .shared import documents
from .token_rollup import token_rollup
from .training_order import training_order


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(documents(spark, sf_dir))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = dict(turns.dtypes)
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    added = [
        spark.range(1).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.lit(turn).cast(kinds["turn"]).alias("turn"), F.lit(role).alias("role"), said)
        for turn, role in enumerate(("user", "assistant"))
    ]
    return digest(chat_format(turns.unionByName(added[0]).unionByName(added[1])))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken_words(source_mix.source_mix(documents(spark, sf_dir)))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.digest(*centroid_clusters.centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return own | {"pipeline": corpus_pipeline.run}


_OP7 = """
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), runs as (
    select *, coalesce(lag(role) over (partition by conv_id order by turn, role, text) = role, false) as same,
        row_number() over (partition by conv_id order by turn, role, text) as k
    from turns
), escaped as (
    select *, regexp_replace(text, '([<\\[])(\u200b*)(/s>|/?INST\\]|PART\\])', '\\1\u200b\\2\\3', 'g') as e from runs
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(length(e) + case when same then 6 else 19 + length(role) end)::bigint as formatted_chars
from escaped group by conv_id
""".replace("\\u200b", "\u200b")


_OP11 = """
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
        substr(sha256('mix:' || coalesce(doc_id::varchar, '')), 1, 15) as h
    from documents
), totals as (
    select source, sum(size)::bigint as source_size,
        ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
    from sized group by source
), levels as (
    select *, row_number() over w as place, sum(weight) over (w rows between current row and unbounded following) as rest,
        (sum(source_size) over () - coalesce(sum(3 * source_size) over (w rows between unbounded preceding and 1 preceding), 0))::double as room
    from totals window w as (order by source_size / weight, source nulls last)
), goals as (
    select source, source_size, coalesce(least(
        (min_by(room / rest, place) filter (where room * weight <= 3.0 * source_size * rest) over ()) * weight, 3.0 * source_size), 0)::double as target
    from levels
), placed as (
    select s.*, g.source_size, g.target, floor(g.target)::bigint as need,
        (sum(size) over (partition by s.source order by h, doc_id, size rows unbounded preceding) - size)::bigint as start
    from sized s join goals g on s.source is not distinct from g.source
)
select doc_id, size, source_size, target, case when size = 0 then 0 else
    (need // source_size) * size + greatest(0, least(start + size, need % source_size) - start) end::bigint as taken
from placed
"""


def _op12() -> str:
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    out = """
with vectors as materialized (
    select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q
    from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), c0 as materialized (
    select row_number() over (order by sha256('1:' || vec_id), q) - 1 as cluster, q from vectors qualify cluster < 16
)"""
    for r in range(4):
        out += f""", a{r} as materialized (
    select v.n, v.vec_id, v.q, c.cluster, {distance} as distance from vectors v, c{r} c
    qualify row_number() over (partition by v.n order by {distance}, c.cluster) = 1
)"""
        if r < 3:
            out += f""", s{r} as (
    select cluster, i, sum(x) as s, count(*) as k from (select cluster, unnest(q) as x, generate_subscripts(q, 1) as i from a{r}) group by all
), m{r} as (
    select cluster, list(((s - ((s % k) + k) % k) // k)::bigint order by i) as q from s{r} group by cluster
), c{r + 1} as materialized (
    select cluster, coalesce(m.q, c.q) as q from c{r} c left join m{r} m using (cluster)
)"""
    return out + """
select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia,
    sha256(array_to_string(c3.q, ',')) as centroid_sha256
from a3 join c3 using (cluster)"""


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_format": _OP7, "op11_source_mix": _OP11, "op12_centroid_clusters": _op12()}
