"""The operators over the driver's tables, one query each, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optionlake.deploy import ship_package
from optionlake.llm import (
    alignment,
    brown,
    chat,
    decontaminate,
    lines,
    minhash,
    negatives,
    packing,
    pii,
    quality,
    rules,
    substrings,
    warc,
)
from optionlake.sources.stages import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of each document, and whether it stays."""
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document; rows of fold 0 are held out of the training."""
    docs, settings = _table(spark, sf_dir, "documents"), quality.QualitySettings()
    model = quality.trained(spark, docs, _table(spark, sf_dir, "labels"), _fold(5) != 0, settings)
    return quality.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", (_fold(5) == 0).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= settings.cut).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(spark, _table(spark, sf_dir, "documents"), *packing.public_vocabulary())


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that 20-word windows with an earlier occurrence cover, removed."""
    found = substrings.deduplicated(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed",
                        F.sha2("kept_text", 256).alias("kept_sha256"),
                        F.size("factors").alias("n_factors"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of each document under the full policy."""
    return rules.judged(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failures")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, written to archives with revisits and read back."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(spark, _table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to an earlier one."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.clean_lines(spark, docs).select(
        "doc_id", F.size("removed_lines").alias("n_removed"), "removed_lines",
        F.sha2("text", 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.contaminations(
        spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: counts and spans."""
    found = pii.personal_data(spark, _table(spark, sf_dir, "documents"))
    listed = ("array_join(transform({}, s -> concat_ws(':', s.kind, string(s.start), "
              "string(s.end))), ',')")
    base = "filter(spans, s -> s.base)"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
              for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(listed.format(base)), 256).alias("base_sha256"),
                        F.expr(listed.format("spans")).alias("spans"))


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based n-gram scores of each document; rows of fold 2 are held out."""
    return brown.scores(spark, _table(spark, sf_dir, "documents"), _fold(7) == 2)


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (ids divisible by 50), after moving the labels of each 7th id."""
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(spark, rows, F.col("vec_id") % 50 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two vocabularies in each document."""
    return alignment.aligned(spark, _table(spark, sf_dir, "documents"), alignment.public_settings())[0]


#: Conversation -7, whose texts hold the template's own control strings.
CONTROL = r"\### Assistant: </turn> ok"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations replayed from their events, formatted, and read back from the output."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"))
    folded = chat.messages(chat.events_of(rows.unionByName(added)))
    return chat.digests(chat.formatted(folded))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_minhash, op2_quality, op3_packing, op4_substrings, op5_rules, op6_warc, op7_lines,
        op8_decontamination, op9_pii, op10_brown, op11_negatives, op12_alignment,
        op13_chat, pipeline)}


OP11_SQL = """
with whole as (
    select vec_id,
        cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select a.vec_id as anchor_id, a.label as anchor_label, c.vec_id, c.label,
        cast(list_dot_product(a.v, c.v) as bigint) as score
    from whole a join whole c on a.vec_id % 50 = 0),
positive as (
    select anchor_id, anchor_label, vec_id as positive_id, score as positive_score
    from scored where label = anchor_label and vec_id <> anchor_id
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
    cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)
         as integer) as rank
from positive join scored using (anchor_id)
where label <> scored.anchor_label
    and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""


#: Lengths follow from the template: 4 + 2 characters around a role, 8 at the end, one more for each
#: backslash, each </turn>, each pair of neighbouring # and each colon of a role.
OP13_SQL = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
    select *, list_sum(list_transform([role, text], lambda t: length(t)
        + length(t) - length(replace(t, '\', ''))
        + (length(t) - length(replace(t, '</turn>', ''))) // 7
        + length(regexp_replace(t, '[^#]', '', 'g'))
        - length(regexp_replace(regexp_replace(t, '#+', chr(1), 'g'), '[^' || chr(1) || ']', '', 'g'))
        + (length(t) - length(replace(t, chr(1), '')))))
        + length(role) - length(replace(role, ':', '')) + 14 as size
    from turns)
select conv_id, cast(count(*) as bigint) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), ''))
        as loss_sha256,
    cast(sum(size) as bigint) as formatted_chars
from sized group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_negatives": OP11_SQL, "op13_chat": OP13_SQL}
