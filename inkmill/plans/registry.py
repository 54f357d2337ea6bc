"""Registered queries of the document-to-quiz operators. Each runs over whole tables and whole texts, or over inline fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx
from inkmill.operators import answers, chunking, clean, distractors, filters, paragraphs, providers, quiz, rewrite

from . import fixtures, oracle, pipeline

FLAGSHIP = "pipeline_chunks"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")


def spread(rows: DataFrame, key: str, least: int = 32 << 20) -> DataFrame:
    """rows dealt over all cores where their files are so small that a core has under `least` bytes: these hold fewer row groups than there are
    cores, and the text expressions cost far more than the shuffle. Larger inputs stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores, key) if size < least * cores else rows


def clean_blocks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", clean.clean_text(F.col("text")).alias("cleaned"))


def _paras(spark, sf_dir):
    cleaned = clean_blocks(spark, sf_dir)
    return cleaned.select("doc_id", F.posexplode(paragraphs.paragraphs(F.col("cleaned"))).alias("para_no", "text"))


def paragraph_classes(spark, sf_dir):
    rows = _paras(spark, sf_dir).withColumn("i", paragraphs.info(F.col("text")))
    return rows.select("doc_id", "para_no", "i.type", "i.has_bullet", "i.has_numbered", "i.word_count")


def noise_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", filters.is_noise_unit(F.col("text")).alias("is_noise"))


def block_filters(spark, sf_dir):
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", filters.is_toc_block(c).alias("is_toc"), filters.is_educational(c).alias("is_educational"), filters.is_content_unit(c).alias("is_content"))


def task_block_filter(spark, sf_dir):
    return paragraphs.drop_task_blocks(fixtures.frame(spark, "fx_paras"), "doc_id", "para_no", "text")


def merge_short_paragraphs(spark, sf_dir):
    cleaned = clean_blocks(spark, sf_dir)
    return cleaned.select("doc_id", F.posexplode(paragraphs.merge_short(paragraphs.paragraphs(F.col("cleaned")))).alias("para_no", "text"))


def _sents(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_no", "sentence"))
    return rows.withColumn("n_words", tx.n_words(F.col("sentence")))


def sentence_split(spark, sf_dir):
    rows = _sents(spark, sf_dir)
    return rows.withColumns({"n_tokens": chunking.tokens_of(F.col("n_words")), "n_marks": chunking.marks(F.col("sentence"))})


def sentence_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", filters.keep_sentences(F.col("text")).alias("text"))


def answer_scores(spark, sf_dir):
    return _sents(spark, sf_dir).select("doc_id", "sent_no", answers.score(F.col("sentence")).alias("score"))


def _answers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "text", tx.once(answers.pick(F.col("text"))).alias("answer"))


def pick_answer(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", "answer")


def focused_context(spark, sf_dir):
    rows = _answers(spark, sf_dir).where("answer IS NOT NULL")
    return rows.select("doc_id", answers.focused(F.col("text"), F.col("answer")).alias("context"))


def distractors_by_overlap(spark, sf_dir):
    rows = _answers(spark, sf_dir).where("answer IS NOT NULL")
    found = F.slice(F.array_distinct(distractors.by_overlap(F.col("answer"), F.col("text"))), 1, 3)
    # The outer form: else the optimiser computes the list in a filter, too.
    return rows.select("doc_id", F.posexplode_outer(found).alias("rank", "distractor")).where("distractor IS NOT NULL")


def acronym_candidates(spark, sf_dir):
    """Over all documents, with Unicode's word boundaries, for which DuckDB has no pattern."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(rewrite.acronyms(F.col("text"), lx.ACRONYM_ALL)).alias("pos", "abbr"))


def sentence_chunks(spark, sf_dir):
    return chunking.sentence_chunks(_docs(spark, sf_dir), "text").drop("method")


def split_large(spark, sf_dir):
    return _docs(spark, sf_dir).where(tx.n_words(F.col("text")) > 0).select("doc_id", F.posexplode(chunking.split_large(F.col("text"), 100)).alias("part", "text"))


def semantic_breaks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = chunking.semantic_breaks(rows, "label", "vec_id", "embedding")
    return found.select("label", "vec_id", F.round("distance", 6).alias("distance"), "segment")


def semantic_chunks(spark, sf_dir):
    """Conversation turns stand in for the nodes of a semantic splitter."""
    return chunking.semantic_chunks(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "text")


def section_context(spark, sf_dir):
    return chunking.section_context(fixtures.frame(spark, "fx_chunks"), "doc_id")


def slang_normalise(spark, sf_dir):
    return fixtures.frame(spark, "fx_slang").select("id", rewrite.expand_slang(F.col("text")).alias("text"))


def list_reconstruction(spark, sf_dir):
    c = F.col("text")
    return fixtures.frame(spark, "fx_lists").select("id", paragraphs.numbered(c).alias("numbered"), paragraphs.bulleted(c).alias("bulleted"), paragraphs.heading_sentence(c).alias("heading"), paragraphs.reconstructed(c).alias("text"))


def punctuation_restore(spark, sf_dir):
    return fixtures.frame(spark, "fx_punct").select("id", rewrite.restore_punctuation(F.col("text")).alias("text"))


def acronym_expand(spark, sf_dir):
    return rewrite.expand_acronyms(fixtures.frame(spark, "fx_acronyms"), "text", fixtures.frame(spark, "fx_titles"))


def definition_distractors(spark, sf_dir):
    c = fixtures.frame(spark, "fx_defs")
    return c.select("id", answers.definition(F.col("correct")).alias("parts"), distractors.misleading(F.col("correct"), F.col("text")).alias("distractors"))


def question_normalise(spark, sf_dir):
    return fixtures.frame(spark, "fx_questions").select("id", quiz.question_key(F.col("text")).alias("key"))


def question_prompts(spark, sf_dir):
    rows = fixtures.frame(spark, "fx_defs")
    return rows.select("id", quiz.template_kind(F.col("correct")).alias("kind"), quiz.prompt(F.col("correct"), F.col("text"), F.col("id")).alias("prompt"))


def llm_json_parse(spark, sf_dir):
    rows = fixtures.frame(spark, "fx_llm")
    return rows.select("id", quiz.llm_answer(F.col("raw")).alias("answer"), quiz.llm_distractors(F.col("raw")).alias("distractors"))


def quiz_score(spark, sf_dir):
    return quiz.session_scores(fixtures.frame(spark, "fx_submit"), fixtures.frame(spark, "fx_quiz"))


def quiz_recap(spark, sf_dir):
    return quiz.recap(fixtures.frame(spark, "fx_submit"), fixtures.frame(spark, "fx_quiz"))


def choices_shuffled(spark, sf_dir):
    rows = fixtures.frame(spark, "fx_options")
    o = distractors.options(F.col("answer"), F.array().cast("array<string>"), F.col("pool"), F.col("id").cast("string"))
    return rows.withColumn("o", o).select("id", *[F.get("o.options", F.lit(i)).alias(f"option_{n}") for i, n in enumerate("abcd")], "o.correct_idx")


def language_statistics(spark, sf_dir):
    """An extension: what the corpus holds by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    joined = docs.join(labels, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.count("toxic").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"))


def pipeline_chunks(spark, sf_dir):
    return pipeline.chunks(pipeline.stages(_docs(spark, sf_dir)))


def stage_trace(spark, sf_dir):
    staged = pipeline.stages(_docs(spark, sf_dir))
    return pipeline.trace(staged, pipeline.chunks(staged))


def quiz_questions(spark, sf_dir):
    return pipeline.questions(pipeline_chunks(spark, sf_dir))


def quiz_choices(spark, sf_dir):
    return pipeline.choices(quiz_questions(spark, sf_dir))


def quiz_by_model(spark, sf_dir):
    """Questions, answers and distractors by a provider; the stand-in that repeats its prompt, as no model is at hand."""
    model = providers.EchoModel()
    return pipeline.choices(pipeline.questions(pipeline_chunks(spark, sf_dir), provider=model), seed="1", provider=model)


def quiz_shortfall(spark, sf_dir):
    return quiz.shortfall(quiz_questions(spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet"))


def choices_retried(spark, sf_dir):
    """choices_shuffled with another seed."""
    rows = fixtures.frame(spark, "fx_options")
    o = distractors.options(F.col("answer"), F.array().cast("array<string>"), F.col("pool"), F.concat(F.lit("1|"), F.col("id").cast("string")))
    return rows.withColumn("o", o).select("id", "o.options", "o.correct_idx")


def model_replies(spark, sf_dir):
    return fixtures.frame(spark, "fx_replies").withColumn("m", providers.modelled(F.col("reply_a"), F.col("reply_b"))).select("id", "m.answer", "m.three")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pipeline_chunks, clean_blocks, paragraph_classes, noise_documents, block_filters, task_block_filter, merge_short_paragraphs, sentence_split, sentence_filter, answer_scores, pick_answer,
        focused_context, distractors_by_overlap, acronym_candidates, sentence_chunks, split_large, semantic_breaks, semantic_chunks, section_context, slang_normalise, list_reconstruction,
        punctuation_restore, acronym_expand, definition_distractors, question_normalise, question_prompts, llm_json_parse, quiz_score, quiz_recap, choices_shuffled, language_statistics,
        stage_trace, quiz_questions, quiz_choices, quiz_by_model, quiz_shortfall, choices_retried, model_replies,
    )
}
ORACLE: dict[str, str] = oracle.SQL
