"""Derived fixtures: the evaluation data model expressed over the driver tables.

Each fixture has a twin SQL definition in ``oracle.py`` (DuckDB) — keep both in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rejoinder.sources.tables import read_table


def responses(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, message_id, model, theme, response): three models answer each message."""
    return read_table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.expr("doc_id div 3").alias("message_id"),
        F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"),
        F.col("lang").alias("theme"),
        F.col("text").alias("response"),
    )


def dialogue(spark: SparkSession, d: str) -> DataFrame:
    """User turns whose next turn is the assistant's: (conv_id, turn, message, response).

    The window is partitioned by conversation (small groups), so it scales with
    the number of conversations.
    """
    c = read_table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (c.select("conv_id", "turn", "role", "text",
                     F.lead("role").over(w).alias("next_role"),
                     F.lead("text").over(w).alias("next_text"))
            .where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
            .select("conv_id", "turn", F.col("text").alias("message"), F.col("next_text").alias("response")))


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs with the counter speech between two tags for two of three rows."""
    return read_table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"),
        F.col("lang").alias("theme"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("pre<XXX>"), F.col("text"), F.lit("<XXX>post")))
        .otherwise(F.col("text")).alias("model_output"),
    )


def decorated(spark: SparkSession, d: str) -> DataFrame:
    """Responses with a hashtag, a URL and (one in three) an emoji appended."""
    return read_table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.expr("doc_id div 3").alias("message_id"),
        F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"),
        F.col("lang").alias("theme"),
        F.concat(F.col("text"), F.lit(" #"), F.col("source"), F.lit(" https://x.org/"),
                 F.col("doc_id").cast("string"),
                 F.when(F.col("doc_id") % 3 == 0, F.lit(" \U0001F600")).otherwise(F.lit("?"))).alias("response"),
    )


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Decorated responses with message_id and message: the first 200 characters of the message's first document."""
    doc = read_table(spark, d, "documents").select("doc_id", "text")
    said = doc.where(F.col("doc_id") % 3 == 0).select(F.expr("doc_id div 3").alias("message_id"), F.substring("text", 1, 200).alias("message"))
    return decorated(spark, d).join(said, "message_id", "left").select("row_id", "message_id", "theme", "model", "response", "message")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal panel (subject, model, score): score = count % 6, 0 = missing."""
    e = read_table(spark, d, "events")
    return (e.groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("model"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("subject", "model",
                    F.expr("cast(nullif(n % 6, 0) as double)").alias("score")))


def raters(spark: SparkSession, d: str) -> DataFrame:
    """Two raters per unit: rater r1 = quality, rater r2 = long-document flag. Long form."""
    lab = read_table(spark, d, "labels").select("doc_id", "quality")
    doc = read_table(spark, d, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select(
        F.col("doc_id").alias("unit_id"),
        F.explode(F.array(
            F.struct(F.lit("r1").alias("rater"), F.col("quality").cast("string").alias("value")),
            F.struct(F.lit("r2").alias("rater"),
                     F.when(F.col("n_chars") > 500, F.lit("1")).otherwise(F.lit("0")).alias("value")),
        )).alias("rv"),
    ).select("unit_id", "rv.rater", "rv.value")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, model, y_true, y_pred): model k flips the truth where doc_id % (k+5) = 0. Long form."""
    lab = read_table(spark, d, "labels").select("doc_id", "toxic")
    return lab.select(
        F.col("doc_id").alias("row_id"),
        F.col("toxic").cast("double").alias("y_true"),
        F.explode(F.array(*[
            F.struct(F.lit(f"m{k}").alias("model"),
                     F.when(F.col("doc_id") % (k + 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
                     .cast("double").alias("y_pred"))
            for k in range(3)])).alias("p"),
    ).select("row_id", "p.model", "y_true", "p.y_pred")


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Strategy flags 1 / -1 / null and annotated strategy scores per response."""
    doc = read_table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    cols = [F.col("doc_id").alias("row_id"),
            F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"),
            F.col("lang").alias("theme")]
    for i in range(1, 5):
        cols.append(F.when(F.col("doc_id") % 10 == i, F.lit(None).cast("int"))
                    .when(F.expr(f"(doc_id div {i}) % 3 = 0"), F.lit(-1)).otherwise(F.lit(1))
                    .alias(f"strategy_{i}"))
    # annotated strategy scores: 0 = not applied (missing), else a 1..4 score
    for i, name in enumerate(["factual", "alternative", "narrative", "critical_thinking"], start=1):
        cols.append(F.expr(f"cast((doc_id div {i + 1}) % 5 as string)").alias(name))
    cols.append(F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("int"))
                .otherwise((F.col("doc_id") % 2).cast("int")).alias("step_2"))
    return doc.select(*cols)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, message_id, model, theme, embedding) from the embeddings table."""
    e = read_table(spark, d, "embeddings")
    return e.select(
        "vec_id",
        F.expr("vec_id div 3").alias("message_id"),
        F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")).alias("model"),
        F.col("label").alias("theme"),
        "embedding",
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]   # event_type values of the events table


def panel_long(spark: SparkSession, d: str) -> DataFrame:
    """(category, subject, model, score): two ordinal categories per (user, event type), 0 = missing.

    c_count = count % 6, c_value = sum(floor(value)) % 5 — integers, so every
    statistic is exact in both engines.
    """
    e = read_table(spark, d, "events")
    g = e.groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).cast("long").alias("v"))
    return g.select("subject", "model", F.explode(F.array(
        F.struct(F.lit("c_count").alias("category"), F.expr("cast(nullif(n % 6, 0) as double)").alias("score")),
        F.struct(F.lit("c_value").alias("category"), F.expr("cast(nullif(v % 5, 0) as double)").alias("score")),
    )).alias("x")).select("x.category", "subject", "model", "x.score")


def annotated_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Parsed model outputs with hand-corrected versions, strategy flags and annotated strategy scores."""
    from rejoinder.functions.normalize import parse_tagged
    t = tagged(spark, d)
    cs, rest = parse_tagged("model_output")
    f = flags(spark, d).drop("model", "theme")
    o = t.select("row_id", "model", "theme", "model_output", cs.alias("model_counter_speech"),
                 rest.alias("model_strategies"))
    o = o.select("row_id", "model", "theme", "model_output", "model_counter_speech", "model_strategies",
                 F.when(F.col("row_id") % 5 == 0, F.concat(F.col("model_counter_speech"), F.lit(" edited")))
                 .otherwise(F.col("model_counter_speech")).alias("model_counter_speech_corrected"),
                 F.when(F.col("row_id") % 4 == 0, F.lit(None).cast("string"))
                 .when(F.col("row_id") % 4 == 1, F.lit('  "'))
                 .otherwise(F.col("model_strategies")).alias("model_strategies_corrected"))
    return o.join(f, "row_id")


def overlay_base(spark: SparkSession, d: str) -> DataFrame:
    """Base table for the overlay merge: every document, quality pre-filled as '0' for even ids."""
    doc = read_table(spark, d, "documents")
    return doc.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("theme"),
                      F.when(F.col("doc_id") % 2 == 0, F.lit("0")).alias("quality"))


def overlays(spark: SparkSession, d: str) -> list[DataFrame]:
    """Three annotation slices of labels in apply order: sample, annotator 2, annotator 1 (last wins)."""
    lab = read_table(spark, d, "labels")
    base = lab.select(F.col("doc_id").alias("row_id"),
                      F.col("quality").cast("string").alias("quality"),
                      F.col("toxic").cast("string").alias("toxic"),
                      F.concat(F.col("quality").cast("string"), F.lit("-"), F.col("toxic").cast("string"))
                      .alias("hate_speech_id"))
    sample = base.where(F.col("row_id") % 7 == 0).withColumn(
        "toxic", F.when(F.col("row_id") % 2 == 0, F.lit(None)).otherwise(F.col("toxic")))
    ann2 = base.where(F.col("row_id") % 7 <= 3).where(F.col("row_id") % 7 >= 1).withColumn(
        "quality", F.when(F.col("row_id") % 5 == 0, F.lit(None)).otherwise(F.col("quality")))
    ann1 = base.where((F.col("row_id") % 7 >= 4) | ((F.col("row_id") % 7 == 0) & (F.col("row_id") % 3 == 0))) \
        .withColumn("hate_speech_id", F.when(F.col("row_id") % 4 == 0, F.lit(None))
                    .otherwise(F.col("hate_speech_id")))
    return [sample, ann2, ann1]


def entity_items(spark: SparkSession, d: str) -> DataFrame:
    """Message/response items from the dialogue pairs: (row_id, model, message, response)."""
    dl = dialogue(spark, d)
    # collision-free item key whatever the number of turns
    return dl.select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("row_id"),
                     F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("model"),
                     "message", "response")


def gazetteer(spark: SparkSession, d: str) -> DataFrame:
    """(kind, alias): every capitalised word of the documents, and the first two and first three words
    of every conversation turn; even length = person, odd = organisation."""
    from rejoinder.functions.text import simple_tokens
    doc = read_table(spark, d, "documents")
    one = doc.select(F.explode(simple_tokens("text")).alias("alias")).where(F.col("alias").rlike(r"^\p{Lu}\p{Ll}+$"))
    t = read_table(spark, d, "conversations").select(simple_tokens("text").alias("t"))
    more = [t.where(F.size("t") >= n).select(F.array_join(F.slice("t", 1, n), " ").alias("alias")) for n in (2, 3)]
    w = one.union(more[0]).union(more[1]).distinct()
    return w.select(F.when(F.length("alias") % 2 == 0, F.lit("person")).otherwise(F.lit("organization"))
                    .alias("kind"), "alias")


def alias_dim(spark: SparkSession, d: str) -> DataFrame:
    """(kind, alias, canonical): normalisation dictionary; a null canonical means 'drop'."""
    g = gazetteer(spark, d).where(F.length("alias") % 3 != 0)
    canon = (F.when(F.length("alias") % 5 == 0, F.lit(None).cast("string"))
             .when(F.length("alias") % 5 == 1, F.upper("alias")).otherwise(F.lower("alias")))
    return g.select("kind", "alias", canon.alias("canonical"))
