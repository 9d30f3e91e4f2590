"""Queries of the operators in this subpackage: key -> fn(spark, sf_dir), and their SQL twins.

Each query applies its operator with production parameters to its whole table.
A key without SQL is tested against a brute-force version in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rejoinder.llm import byte_bpe, chat_format, decontaminate, jaccard_join, lexical_search, quality, secret_scan, substring_dedup, token_alignment, token_records, toxicity, unigram_count, warc
from rejoinder.llm.common import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str):
    def keep(fn):
        QUERIES[name] = fn
        return fn
    return keep


@register("op1_byte_bpe")
def op1_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@register("op3_token_records")
def op3_token_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_records.write_and_read(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


@register("op6_warc")
def op6_warc(spark, sf_dir):
    return warc.write_and_read(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"))


ORACLE["op6_warc"] = warc.ORACLE


@register("op8_chat_format")
def op8_chat_format(spark, sf_dir):
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.read_back(chat_format.render(turns)).drop("formatted_sha256")


ORACLE["op8_chat_format"] = chat_format.ORACLE


@register("op7_quality")
def op7_quality(spark, sf_dir):
    # counts are a few numbers per document: written once, read for the estimate and for the verdicts
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    voted = cut(quality.votes(quality.features(docs).drop("text")), "quality-votes")
    return quality.judge(voted, quality.fit(voted))


@register("op4_decontaminate")
def op4_decontaminate(spark, sf_dir):
    return decontaminate.judge(table(spark, sf_dir, "documents", "doc_id", "text"),
                               table(spark, sf_dir, "benchmark", "item_id", "text"))


@register("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~out))
    return (toxicity.score(docs, model).withColumn("held_out", out)
            .select("doc_id", "held_out", "score", F.when(F.col("score") >= toxicity.CUT, 1).otherwise(0).alias("predicted")))


@register("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return unigram_count.count(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@register("op5_jaccard_join")
def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents", "doc_id", "text"), size=3, similarity=0.9)


@register("op10_substring_dedup")
def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op13_secret_scan")
def op13_secret_scan(spark, sf_dir):
    return secret_scan.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op11_lexical_search")
def op11_lexical_search(spark, sf_dir):
    return lexical_search.rank(table(spark, sf_dir, "documents", "doc_id", "text"),
                               table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE["op11_lexical_search"] = lexical_search.ORACLE


@register("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_alignment.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
