"""Registered queries: key -> fn(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or fixtures Spark derives from them) in
full, so its work grows with the data.  The DuckDB twin of each key lives in
``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rejoinder.operators import corpus as C
from rejoinder.operators import diversity as D
from rejoinder.plans import fixtures as X
from rejoinder.sources.tables import read_table  # noqa: F401

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

G = ("theme", "model")


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


def _corpus(spark, d, group_cols=G, with_random=True):
    return C.corpora(X.responses(spark, d), group_cols=group_cols, with_random=with_random)


# --- corpus diversity -------------------------------------------------------

@register("distinct_ngrams")
def q_distinct_ngrams(spark, d):
    return D.distinct_ngrams(_corpus(spark, d), group_cols=G, orders=(1, 2))


@register("response_distinct2")
def q_response_distinct2(spark, d):
    return D.response_distinct_n(_corpus(spark, d), group_cols=G, n=2)


@register("text_length")
def q_text_length(spark, d):
    return D.text_length(_corpus(spark, d), group_cols=G)


@register("sentence_starts")
def q_sentence_starts(spark, d):
    st = D.sentence_starts(_corpus(spark, d, with_random=False), group_cols=G, num_words=3)
    return st.select(*G, "row_id", "sent_no", F.array_join("start", " ").alias("start_text"))


@register("distinct_sentence_starts")
def q_distinct_sentence_starts(spark, d):
    return D.distinct_sentence_starts(_corpus(spark, d), group_cols=G, num_words=3, orders=(2, 3))


@register("top_sentence_starts")
def q_top_sentence_starts(spark, d):
    return D.top_sentence_starts(_corpus(spark, d), group_cols=G, num_words=3)


@register("top_sentences")
def q_top_sentences(spark, d):
    return D.top_sentence_starts(_corpus(spark, d), group_cols=G, num_words=None)


@register("sentence_shape")
def q_sentence_shape(spark, d):
    return D.sentence_shape(_corpus(spark, d), group_cols=G)


# --- pairwise diversity -----------------------------------------------------
from rejoinder.operators import pairs as P  # noqa: E402
from rejoinder.operators import selfbleu as SB  # noqa: E402


@register("self_bleu")
def q_self_bleu(spark, d):
    return SB.self_bleu(_corpus(spark, d), group_cols=G)


@register("jaccard_diversity")
def q_jaccard_diversity(spark, d):
    return P.jaccard_diversity(_corpus(spark, d), group_cols=G)


# --- shaping, sampling, guards ---------------------------------------------
from rejoinder.constants import ANNOTATION_COL_MAPPING, ANNOTATOR_2_COL_MAPPING, SAMPLE_SIZE  # noqa: E402
from rejoinder.functions import normalize as N  # noqa: E402
from rejoinder.functions.text import strip_ws, trim_chars  # noqa: E402
from rejoinder.operators import sampling as SA  # noqa: E402
from rejoinder.operators import shape as SH  # noqa: E402


@register("parse_tagged_output")
def q_parse_tagged_output(spark, d):
    return SH.parse_tagged_output(X.tagged(spark, d)).select("row_id", "model_counter_speech", "model_strategies")


@register("union_models")
def q_union_models(spark, d):
    t = X.tagged(spark, d)
    frames = {f"m{k}": t.where(F.col("row_id") % 3 == k)
              .select("row_id", "theme", F.col("model_output").alias(f"counter_speech_m{k}"))
              for k in range(3)}
    return SH.union_models(frames).select("row_id", "model", "theme", "model_output")


@register("overlay_merge")
def q_overlay_merge(spark, d):
    merged = SH.overlay_merge(X.overlay_base(spark, d), X.overlays(spark, d))
    merged = merged.withColumn("quality", F.coalesce(F.col("quality"), F.lit("0")))
    return SH.split_compound_label(merged, "hate_speech_id")


@register("check_disjoint")
def q_check_disjoint(spark, d):
    sample, ann2, ann1 = X.overlays(spark, d)
    return SH.overlapping_keys(sample, ann1)


@register("check_coverage")
def q_check_coverage(spark, d):
    parts = SA.split_for_annotation(X.responses(spark, d))
    return SH.coverage(X.responses(spark, d),
                       [parts.where(F.col("part") == p) for p in ("sample", "part_1", "part_2")])


@register("split_for_annotation")
def q_split_for_annotation(spark, d):
    return SA.split_for_annotation(X.responses(spark, d)).select("row_id", "part")


@register("sample_n")
def q_sample_n(spark, d):
    s = SA.sample_n(X.responses(spark, d), SAMPLE_SIZE).select("row_id", "model", "response")
    return SH.add_empty_columns(s, list(ANNOTATION_COL_MAPPING.values()))


@register("random_corpus")
def q_random_corpus(spark, d):
    return C.random_corpus(X.responses(spark, d), by=["theme"]).select("theme", "message_id", "row_id")


@register("extract_corpus")
def q_extract_corpus(spark, d):
    return C.extract_corpus(X.responses(spark, d), model="m1", theme="de").select("row_id", "response")


@register("trim_charset")
def q_trim_charset(spark, d):
    doc = read_table(spark, d, "documents")
    raw = F.concat(F.lit(' "'), F.col("source"), F.lit('" \n'))
    return doc.select(F.col("doc_id").alias("row_id"), trim_chars(raw, ' "').alias("trimmed"),
                      strip_ws(raw).alias("stripped"))


@register("split_compound_label")
def q_split_compound_label(spark, d):
    lab = read_table(spark, d, "labels")
    lbl = F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.col("quality").cast("string"), F.lit("-"), F.col("toxic").cast("string")))
    return SH.split_compound_label(lab.select(F.col("doc_id").alias("row_id"), lbl.alias("label")), "label") \
        .select("row_id", "label_message", "label_response")


def _raw_scores(spark, d):
    lab = read_table(spark, d, "labels")
    raw = (F.when(F.col("doc_id") % 6 == 0, F.lit("n/a")).when(F.col("doc_id") % 6 == 1, F.lit(None))
           .when(F.col("doc_id") % 6 == 2, F.lit("")).otherwise((F.col("quality") + F.col("toxic")).cast("string")))
    return lab.select(F.col("doc_id").alias("row_id"), raw.alias("raw"))


@register("normalize_scores")
def q_normalize_scores(spark, d):
    r = _raw_scores(spark, d)
    return r.select("row_id", N.ordinal("raw").alias("ordinal"), N.nominal("raw").alias("nominal"),
                    N.binary("raw").alias("binary"), N.sign("raw").alias("sign"),
                    N.empty_to_null("raw").alias("raw_or_null"))


@register("rename_map")
def q_rename_map(spark, d):
    """Both annotators' files, all columns, brought to the short names."""
    lab = read_table(spark, d, "labels")
    out = None
    for annotator, names in (("1", ANNOTATION_COL_MAPPING), ("2", ANNOTATOR_2_COL_MAPPING)):
        wide = lab.select(F.col("doc_id").alias("row_id"), F.lit(annotator).alias("annotator"),
                          *[((F.col("quality") + F.col("toxic") * 2 + k) % 4).cast("int").alias(n) for k, n in enumerate(names)])
        own = SH.rename_map(wide, names)
        out = own if out is None else out.unionByName(own)
    return out


@register("publish_projection")
def q_publish_projection(spark, d):
    """The main export (every row, with its own model and theme) and that of the one-model experiment."""
    o = X.annotated_outputs(spark, d)
    cols = ("row_id", "model_output", "model_strategies", "model_counter_speech")
    main = o.select(F.lit("main").alias("export"), *cols, "model", "theme")
    one = o.where(F.col("model") == "m2").select(F.lit("experiment").alias("export"), *cols, F.lit("gpt4o").alias("model"),
                                                 F.lit("2").alias("theme"))
    return main.unionByName(one)


@register("distinct_messages")
def q_distinct_messages(spark, d):
    doc = read_table(spark, d, "documents").select(F.col("lang").alias("theme"), F.col("text").alias("message"))
    per_theme = doc.dropDuplicates(["theme", "message"]).groupBy("theme").agg(
        F.count(F.lit(1)).alias("n_distinct_messages"))
    overall = doc.dropDuplicates(["message"]).agg(F.count(F.lit(1)).alias("n_distinct_messages")) \
        .select(F.lit("all").alias("theme"), "n_distinct_messages")
    return per_theme.unionByName(overall)


# --- conformance -------------------------------------------------------------
from rejoinder.operators import conformance as CF  # noqa: E402


@register("schema_report")
def q_schema_report(spark, d):
    return CF.schema_report(X.annotated_outputs(spark, d))


@register("strategy_counts")
def q_strategy_counts(spark, d):
    return CF.strategy_counts(X.annotated_outputs(spark, d))


@register("top_strategy_combos")
def q_top_strategy_combos(spark, d):
    return CF.top_strategy_combos(X.annotated_outputs(spark, d))


@register("strategy_agreement")
def q_strategy_agreement(spark, d):
    r = CF.strategy_agreement_rows(X.annotated_outputs(spark, d))
    return r.groupBy("model").agg(F.count(F.lit(1)).alias("n_complete"),
                                  F.round(F.avg(F.when(F.col("agrees"), 100.0).otherwise(0.0)), 6)
                                  .alias("agreement_pct"))


@register("notnull_share")
def q_notnull_share(spark, d):
    return CF.notnull_share(X.annotated_outputs(spark, d), ["strategy_1", "strategy_2", "strategy_3",
                                                             "strategy_4", "step_2"], group_cols=["model"])


# --- descriptive statistics -------------------------------------------------------
from rejoinder.operators import stats as ST  # noqa: E402


@register("group_mean_median")
def q_group_mean_median(spark, d):
    return ST.mean_median(X.panel_long(spark, d))


@register("ordinal_stats")
def q_ordinal_stats(spark, d):
    return ST.describe_scores(X.panel_long(spark, d))


@register("ordinal_stats_global")
def q_ordinal_stats_global(spark, d):
    return ST.describe_scores(X.panel_long(spark, d), group_cols=["category"])


@register("nominal_counts")
def q_nominal_counts(spark, d):
    lab = read_table(spark, d, "labels")
    wide = lab.select(F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"),
                      F.col("quality").cast("string").alias("quality"),
                      F.when(F.col("doc_id") % 9 == 0, F.lit("n/a")).otherwise(F.col("toxic").cast("string"))
                      .alias("toxic"))
    long = wide.unpivot(["model"], ["quality", "toxic"], "column", "raw") \
        .select("model", "column", N.nominal("raw").alias("value"))
    return ST.value_counts(long)


@register("pivot_scores")
def q_pivot_scores(spark, d):
    """Every category's scores, one column a model."""
    return ST.pivot_scores(X.panel_long(spark, d), X.EVENT_TYPES)


# --- significance and classification ------------------------------------------
from rejoinder.operators import significance as SG  # noqa: E402


def _rounded(df, *columns):
    """Reported figures have six decimals; operators do not round."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("friedman")
def q_friedman(spark, d):
    return _rounded(SG.friedman(X.panel_long(spark, d)), "statistic", "p_value", "kendall_w")


@register("wilcoxon_pairs")
def q_wilcoxon_pairs(spark, d):
    return _rounded(SG.wilcoxon_pairs(X.panel_long(spark, d)), "w_stat", "z_stat", "z_corrected", "p_value", "p_bonferroni", "effect_size")


@register("significance_report")
def q_significance_report(spark, d):
    return _rounded(SG.significance_report(X.panel_long(spark, d)), "statistic", "p_value", "effect_size")


@register("bonferroni")
def q_bonferroni(spark, d):
    w = SG.wilcoxon_pairs(X.panel_long(spark, d)).select("category", "comparison", "p_value")
    out = SG.bonferroni(w, family=("category",)).withColumnRenamed("p_value_bonferroni", "p_adjusted")
    return _rounded(out, "p_value", "p_adjusted")


@register("paired_predictions")
def q_paired_predictions(spark, d):
    return SG.paired_predictions(X.predictions(spark, d), ["m0", "m1", "m2"])


@register("contingency_pairs")
def q_contingency_pairs(spark, d):
    return SG.contingency_pairs(X.predictions(spark, d))


@register("mcnemar_pairs")
def q_mcnemar_pairs(spark, d):
    return _rounded(SG.mcnemar_pairs(X.predictions(spark, d)), "p_value", "p_bonferroni")


@register("binary_prf")
def q_binary_prf(spark, d):
    return SG.binary_prf(X.predictions(spark, d))


@register("classification_report")
def q_classification_report(spark, d):
    return SG.classification_report(X.predictions(spark, d))


# --- agreement ---------------------------------------------------------------
from rejoinder.operators import agreement as AG  # noqa: E402


def _ordinal_raters(spark, d):
    p = X.panel_long(spark, d)
    return p.select("category", F.col("subject").alias("unit"), F.col("model").alias("rater"),
                    N.ordinal("score").alias("value"))


@register("alpha_ordinal")
def q_alpha_ordinal(spark, d):
    return AG.alpha(_ordinal_raters(spark, d), level="ordinal")


@register("alpha_nominal")
def q_alpha_nominal(spark, d):
    r = X.raters(spark, d)
    return AG.alpha(r.select(F.lit("quality").alias("category"), F.col("unit_id").alias("unit"), "rater",
                             N.nominal("value").alias("value")), level="nominal")


@register("alpha_binary")
def q_alpha_binary(spark, d):
    p = X.panel_long(spark, d)
    return AG.alpha(p.select("category", F.col("subject").alias("unit"), F.col("model").alias("rater"),
                             N.binary("score").alias("value")), level="nominal")


@register("alpha_missing_category")
def q_alpha_missing_category(spark, d):
    """A missing label as a category of its own, beside the same ratings with missing ones ignored."""
    r = X.raters(spark, d).select(
        F.col("unit_id").alias("unit"), "rater",
        F.when((F.col("rater") == "r1") | (F.col("unit_id") % 4 != 0), F.col("value")).alias("value"))
    out = None
    for missing in ("category", "ignore"):
        one = AG.alpha(r.withColumn("category", F.lit(f"missing: {missing}")), level="nominal", missing=missing).drop("values")
        out = one if out is None else out.unionByName(one)
    return out


@register("value_domain")
def q_value_domain(spark, d):
    return AG.value_domain(_ordinal_raters(spark, d))


@register("alpha_report")
def q_alpha_report(spark, d):
    parts = [q_alpha_ordinal(spark, d).withColumn("level", F.lit("ordinal")),
             q_alpha_nominal(spark, d).withColumn("level", F.lit("nominal")),
             q_alpha_binary(spark, d).withColumn("level", F.lit("binary"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- extraction, tokens ------------------------------------------------------------
from rejoinder.functions import text as T  # noqa: E402
from rejoinder.operators import extraction as EX  # noqa: E402


def _decorated(spark, d):
    return C.corpora(X.decorated(spark, d), group_cols=G, with_random=True)


@register("emoji_stats")
def q_emoji_stats(spark, d):
    return EX.emoji_stats(_decorated(spark, d))


@register("hashtag_stats")
def q_hashtag_stats(spark, d):
    return EX.hashtag_stats(_decorated(spark, d))


@register("url_stats")
def q_url_stats(spark, d):
    return EX.url_stats(_decorated(spark, d))


@register("hashtag_bag")
def q_hashtag_bag(spark, d):
    return EX.item_bag(_decorated(spark, d), T.hashtags)


@register("emoji_bag")
def q_emoji_bag(spark, d):
    """The emojis of each group with their multiplicity; its items are the group's emoji set."""
    return EX.item_bag(_decorated(spark, d), T.emojis)


@register("url_bag")
def q_url_bag(spark, d):
    """The URLs of each group with their multiplicity; its items are the group's URL set."""
    return EX.item_bag(_decorated(spark, d), T.urls)


@register("page_urls")
def q_page_urls(spark, d):
    p = read_table(spark, d, "pages")
    u, h = T.urls("url"), T.hashtags("url")
    return p.select("page_id", F.size(u).alias("n_urls"), F.array_join(u, " ").alias("urls"),
                    F.size(h).alias("n_hashtags"), F.array_join(h, " ").alias("hashtags"))


def _whole(c):
    """Fingerprint of all elements of a string array, in order."""
    return F.md5(F.array_join(c, chr(1)))


@register("ngrams")
def q_ngrams(spark, d):
    doc = read_table(spark, d, "documents").select("doc_id", T.ws_tokens("text").alias("tok"))
    b, t = T.ngrams("tok", 2), T.ngrams("tok", 3)
    return doc.select(F.col("doc_id").alias("row_id"), F.size(b).alias("n_bigrams"),
                      F.size(F.array_distinct(b)).alias("n_distinct_bigrams"), F.size(t).alias("n_trigrams"),
                      F.get(t, 0).alias("first_trigram"), _whole(b).alias("bigrams_md5"), _whole(t).alias("trigrams_md5"))


@register("simple_tokens")
def q_simple_tokens(spark, d):
    doc = read_table(spark, d, "documents").select("doc_id", T.simple_tokens("text").alias("w"))
    return doc.select(F.col("doc_id").alias("row_id"), F.size("w").alias("n_tokens"),
                      F.get("w", 0).alias("first_token"), F.try_element_at("w", F.lit(-1)).alias("last_token"),
                      _whole("w").alias("tokens_md5"))


@register("sentences")
def q_sentences(spark, d):
    doc = read_table(spark, d, "documents").select("doc_id", T.sentences("text").alias("s"))
    return doc.select(F.col("doc_id").alias("row_id"), F.size("s").alias("n_sentences"),
                      F.aggregate("s", F.lit(0), lambda a, x: F.greatest(a, F.length(x))).alias("max_sentence_chars"),
                      _whole("s").alias("sentences_md5"))


@register("jaccard_pairs")
def q_jaccard_pairs(spark, d):
    dl = X.dialogue(spark, d)
    a, b = F.array_distinct(T.ws_tokens("message")), F.array_distinct(T.ws_tokens("response"))
    return dl.select("conv_id", "turn", F.round(P.jaccard_pairs(a, b), 6).alias("jaccard"))


# --- embeddings ------------------------------------------------------------
from rejoinder.operators import stats as ST2  # noqa: E402
from rejoinder.operators import vectors as V  # noqa: E402

MODELS3 = ["m0", "m1", "m2"]


@register("semantic_max")
def q_semantic_max(spark, d):
    m = V.semantic_max(X.vectors(spark, d))
    return m.select("theme", "model", "vec_id", F.round("max_sim", 6).alias("max_sim"))


@register("semantic_max_stats")
def q_semantic_max_stats(spark, d):
    return V.semantic_max_stats(X.vectors(spark, d))


@register("semantic_baseline")
def q_semantic_baseline(spark, d):
    v = X.vectors(spark, d)
    scoped = v.select(F.lit("all").alias("scope"), "vec_id", "embedding").unionByName(
        v.select(F.concat(F.lit("theme="), F.col("theme").cast("string")).alias("scope"), "vec_id", "embedding"))
    scoped = scoped.dropDuplicates(["scope", "embedding"])      # distinct messages of each scope
    return V.semantic_max_stats(scoped, group_cols=["scope"])


@register("pair_similarity")
def q_pair_similarity(spark, d):
    return V.pair_similarity(X.vectors(spark, d), MODELS3)


@register("pair_similarity_describe")
def q_pair_similarity_describe(spark, d):
    long = V.pair_similarity_long(X.vectors(spark, d))
    return ST2.describe_columns(long.select("pair", F.col("similarity").alias("value")))


@register("embed_text")
def q_embed_text(spark, d):
    """Every entry of every document's vector, one a row."""
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    e = V.embed_text(docs, num_features=1 << 12).select("row_id", F.explode("embedding").alias("e"))
    return e.select("row_id", "e.i", F.round("e.x", 5).alias("x"))


# --- entities and sentiment --------------------------------------------------------
from rejoinder.operators import entities as EN  # noqa: E402
from rejoinder.operators import sentiment as SE  # noqa: E402


def _mentions(spark, d):
    return EN.extract_entities(X.entity_items(spark, d), X.gazetteer(spark, d))


def _norm(spark, d):
    return EN.normalize_entities(_mentions(spark, d), X.alias_dim(spark, d))


@register("entity_extract")
def q_entity_extract(spark, d):
    return _mentions(spark, d)


@register("entity_counts")
def q_entity_counts(spark, d):
    return EN.entity_counts(X.entity_items(spark, d), _mentions(spark, d))


@register("entity_normalize")
def q_entity_normalize(spark, d):
    return _norm(spark, d)


@register("strip_article")
def q_strip_article(spark, d):
    m = _mentions(spark, d).where(F.col("kind") == "organization").select("entity").distinct()
    return m.select("entity", EN.strip_article("entity").alias("stripped"),
                    EN.strip_article("entity", compat=True).alias("stripped_compat"))


@register("entity_diff_item")
def q_entity_diff_item(spark, d):
    return EN.diff_itemwise(_norm(spark, d))


@register("entity_bag")
def q_entity_bag(spark, d):
    return EN.entity_bag(_norm(spark, d))


@register("entity_diff_group")
def q_entity_diff_group(spark, d):
    return EN.diff_groupwise(_norm(spark, d))


@register("entity_frequency")
def q_entity_frequency(spark, d):
    return EN.entity_frequency(EN.diff_itemwise(_norm(spark, d)), models=MODELS3)


@register("entity_universe")
def q_entity_universe(spark, d):
    return EN.entity_universe(_norm(spark, d))


@register("sentiment_counts")
def q_sentiment_counts(spark, d):
    docs = read_table(spark, d, "documents").select("text")
    lex = SE.frequent_word_lexicon(docs, k=40)            # bounded: 40 rows
    return SE.sentiment_counts(_corpus(spark, d), lex, broadcast_lexicon=True)


# --- generation ---------------------------------------------------------------
from rejoinder.operators import generate as GE  # noqa: E402

SYSTEM_PROMPT = "Write a short counter speech."


@register("build_prompts")
def q_build_prompts(spark, d):
    items = X.dialogue(spark, d)
    out = None
    for layout in GE.LAYOUTS:
        p = GE.build_prompts(items, system_prompt=SYSTEM_PROMPT, layout=layout, user_template="Message: %s",
                             assistant_prefix="Counter speech:").select(
            "conv_id", "turn", F.lit(layout).alias("layout"), F.size("prompt").alias("n_messages"),
            F.array_join(F.transform("prompt", lambda m: m["role"]), ",").alias("roles"),
            F.array_join(F.transform("prompt", lambda m: m["content"]), "|").alias("content"))
        out = p if out is None else out.unionByName(p)
    return out


@register("batch_generate")
def q_batch_generate(spark, d):
    items = GE.build_prompts(X.dialogue(spark, d), system_prompt=SYSTEM_PROMPT, layout="system_user")
    return GE.batch_generate(items).select("conv_id", "turn", "model_output")


# --- sources and sinks -----------------------------------------------------------
from rejoinder.sources import files as FS  # noqa: E402

RESP_SCHEMA = "row_id BIGINT, model STRING, theme STRING, response STRING"


def _csv_roundtrip(spark, d, sep):
    r = X.responses(spark, d).select("row_id", "model", "theme", "response")
    path = FS.scratch_path(spark, "csv")
    FS.write_csv(r, path, sep=sep)
    return FS.read_csv(spark, path, RESP_SCHEMA, sep=sep, multi_line=True)


@register("io_csv_roundtrip")
def q_io_csv_roundtrip(spark, d):
    return _csv_roundtrip(spark, d, ",")


@register("io_csv_semicolon")
def q_io_csv_semicolon(spark, d):
    return _csv_roundtrip(spark, d, ";")


@register("sink_by_theme")
def q_sink_by_theme(spark, d):
    path = FS.scratch_path(spark, "by-theme")
    FS.write_by_theme(X.responses(spark, d).select("row_id", "model", "theme", "response"), path)
    themes = [r[0] for r in spark.read.parquet(path).select("theme").distinct().collect()]     # partition folders
    out = None
    for theme in sorted(themes):
        one = FS.read_theme(spark, path, theme).select("row_id", "model", "theme", "response")
        out = one if out is None else out.unionByName(one)
    return out


@register("report_sink")
def q_report_sink(spark, d):
    path = FS.scratch_path(spark, "report")
    FS.write_report(q_strategy_counts(spark, d), path, "json")
    return spark.read.schema("model STRING, strategy STRING, applied BIGINT, not_applied BIGINT, unknown BIGINT, "
                             "applied_rel_pct DOUBLE").json(path)


@register("parse_nested_list")
def q_parse_nested_list(spark, d):
    doc = read_table(spark, d, "documents")
    s = F.concat(F.lit("[['"), F.col("source"), F.lit("', '"), F.col("lang"), F.lit("'], [], ['"),
                 F.col("doc_id").cast("string"), F.lit("', None]]"))
    x = doc.select(F.col("doc_id").alias("row_id"), FS.parse_nested_list(s).alias("v"))
    return x.select("row_id", F.size("v").alias("n_items"), F.size(F.flatten("v")).alias("n_total"),
                    F.get(F.get("v", 0), 1).alias("second"),
                    F.array_join(F.transform("v", lambda e: F.array_join(e, ",", "<null>")), ";").alias("cells"))


@register("model_from_path")
def q_model_from_path(spark, d):
    t = X.tagged(spark, d)
    base = FS.scratch_path(spark, "by-model")
    for k, name in enumerate(["gpt4o", "llama3", "mistral"]):
        t.where(F.col("row_id") % 3 == k).select("row_id").write.mode("overwrite").parquet(
            f"{base}/ct_counter_speech_{name}.parquet")
    r = spark.read.parquet(f"{base}/*.parquet")
    return r.select("row_id", FS.model_from_path().alias("model_label"))


# --- flagship: the per-(theme, model) diversity report ---------------------------

from rejoinder.operators import report as RP  # noqa: E402


def _report(spark, d, pooled):
    lexicon = SE.frequent_word_lexicon(read_table(spark, d, "documents").select("text"), k=40)      # bounded: 40 rows
    rows = RP.shared_corpus(X.report_rows(spark, d), pooled=pooled)
    return RP.diversity_report(rows, lexicon=lexicon, broadcast_lexicon=True, gazetteer=X.gazetteer(spark, d))


@register("diversity_report")
def q_diversity_report(spark, d):
    """All metrics, one row per (theme, model) incl. the random pseudo-model."""
    return _report(spark, d, pooled=False)


@register("diversity_report_by_model")
def q_diversity_report_by_model(spark, d):
    """All metrics, themes pooled: one row per model incl. the random pseudo-model."""
    return _report(spark, d, pooled=True).drop("theme")


# --- grouping flag, previews, text-embedding similarity ---------------------------

@register("distinct_ngrams_by_model")
def q_distinct_ngrams_by_model(spark, d):
    """Same metric with the corpus keyed by model only (themes pooled)."""
    corpus = C.corpora(X.responses(spark, d), group_cols=("model",), with_random=True)
    return D.distinct_ngrams(corpus, group_cols=("model",), orders=(1, 2))


@register("entity_diff_preview")
def q_entity_diff_preview(spark, d):
    """Item-wise entity differences of the first 10 items (by row id) of one model."""
    from pyspark.sql import Window
    items = X.entity_items(spark, d).where(F.col("model") == "m0").select("row_id")
    first = items.orderBy("row_id").limit(10)                      # TakeOrdered: a preview is the feature
    diff = EN.diff_itemwise(_norm(spark, d)).join(first, "row_id", "left_semi")
    w = Window.partitionBy("row_id").orderBy("kind", "entity")
    return diff.select("row_id", "kind", "entity", F.row_number().over(w).alias("k"))


@register("semantic_max_text")
def q_semantic_max_text(spark, d):
    """Max cosine of each response to any other of its (theme, model) group, on built-in text embeddings."""
    vectors, weights = V.embed_text(_corpus(spark, d, with_random=False), id_cols=[*G, "row_id"], num_features=1 << 14, apart=True)
    return V.semantic_max_stats(vectors.withColumnRenamed("row_id", "vec_id"), weights=weights)


@register("split_exact_half")
def q_split_exact_half(spark, d):
    return SA.split_for_annotation_exact(X.responses(spark, d)).select("row_id", "part")
