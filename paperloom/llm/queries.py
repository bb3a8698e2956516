"""The queries opN_<name>: each applies its operator to its whole table and derives the columns that are asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import chat as CH
from . import decontaminate as DC
from . import exact_dedup as ED
from . import fingerprints as FP
from . import jaccard as JC
from . import language as LG
from . import mixing as MX
from . import oracles as O
from . import periodic_runs as PR
from . import pii as PI
from . import prefix_trie as PT
from . import quality as QU
from . import token_counts as TC
from . import toxicity as TX
from .common import held_out, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_decontaminate", O.OP2)
def op2_decontaminate(spark, sf_dir):
    hits = DC.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("nth"),
    ).drop("nth")


@query("op3_mix_sources", O.OP3)
def op3_mix_sources(spark, sf_dir):
    return MX.mix_sources(table(spark, sf_dir, "documents")).select("row.*", "copy", "n_copies", "shuffle_key")


@query("op4_exact_dedup", O.OP4)
def op4_exact_dedup(spark, sf_dir):
    decisions = ED.dedup_decisions(table(spark, sf_dir, "documents"))
    return decisions.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


PIECES = "piece_bpe_32k.model"
#: The key of the registered query; a deployment passes its own secret.
PII_KEY = "example key of the registered query"


@query("op1_pseudonymise")
def op1_pseudonymise(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return PI.pseudonymise(docs, PII_KEY).select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), "pii")


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = TC.count_tokens(docs, public_tokenizers.path(PIECES))
    return counted.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TC.TOKEN_LIMIT).alias("over_limit")
    )


@query("op9_chat_format", O.OP9)
def op9_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    path = public_tokenizers.path(PIECES)
    read = CH.read_back(CH.chat_segments(turns.unionByName(added), path), path)
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = TX.score_toxicity(docs, TX.train_toxicity(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id", TX.FOLDS, TX.HELD_OUT).alias("held_out"), "toxicity.score",
        (F.col("toxicity.score") >= TX.TOXIC_FROM).cast("int").alias("predicted"), F.col("toxicity.sentences").alias("sentences"),
    )


@query("op8_language")
def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = LG.identify_languages(docs.select("doc_id", "text"), LG.train_languages(docs))
    return found.select(
        "doc_id", held_out("doc_id", LG.FOLDS, LG.HELD_OUT).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        "language.score", F.col("language.shares").alias("shares"),
    )


@query("op10_quality")
def op10_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = QU.score_quality(docs, QU.train_quality(docs, labels))
    return scored.select(
        "doc_id", held_out("doc_id", QU.FOLDS, QU.HELD_OUT).alias("held_out"), "quality.score",
        (F.col("quality.score") >= QU.GOOD_FROM).cast("int").alias("predicted"), F.col("quality.passages").alias("passages"),
    )


@query("op5_ngram_jaccard", O.OP5)
def op5_ngram_jaccard(spark, sf_dir):
    membership, _ = JC.jaccard_components(table(spark, sf_dir, "documents"))
    return JC.component_ids(membership).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", PR.rotated_text(F.col("doc_id"), F.col("text")).alias("text"))
    found = PR.periodic_runs(docs.select("doc_id", "text"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    most = found.withColumn("most", PR.greatest_run(F.col("runs")))
    return most.select(
        F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period",
        F.floor(F.col("most.length") * 1000 / F.col("most.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op12_fingerprints", O.OP12)
def op12_fingerprints(spark, sf_dir):
    rows = FP.edited_fingerprints(table(spark, sf_dir, "documents"))
    following = rows.select(F.col("k1").alias("next_k1"), F.col("k2").alias("next_k2"), F.col("fingerprint").alias("next_fingerprint"))
    rows_by = rows.join(following, ["next_k1", "next_k2"])
    # the search: every document with an id divisible by 50 against all documents
    index = rows.groupBy("fingerprint").agg(F.sum("n_rows").alias("n"))
    asked = rows.filter(F.col("id") % 50 == 0)
    found = FP.near_fingerprints(asked, index).join(index.withColumnRenamed("fingerprint", "near"), "near")
    near = found.groupBy("fingerprint").agg(F.sum("n").alias("n_near"), F.sum(F.when(F.col("bits") == 0, F.col("n"))).alias("n_equal"))
    out = rows_by.join(near, "fingerprint", "left").withColumn("is_query", F.coalesce(F.col("id") % 50 == 0, F.lit(False)))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        FP.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        FP.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        *(F.when(F.col("is_query"), F.col(c)).alias(c) for c in ("n_near", "n_equal")),
        F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))).alias("nth"),
    ).drop("nth")


@query("op11_prefix_trie", O.OP11)
def op11_prefix_trie(spark, sf_dir):
    turns = PT.numbered_turns(table(spark, sf_dir, "conversations"))
    return PT.prefix_trie(*PT.with_shared_starts(turns))
