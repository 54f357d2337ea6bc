"""The whole way from raw text to chunks, and to quiz items (one row per document, chunk or question)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx
from inkmill.operators import answers, chunking, clean, distractors, filters, paragraphs, providers, quiz, rewrite


def rebuilt(cleaned: Column) -> Column:
    """Educational paragraphs, merged, rebuilt by class, without short sentences, informal abbreviations spelled out."""
    paras = paragraphs.merge_short(paragraphs.educational_paragraphs(paragraphs.paragraphs(cleaned)))
    text = F.array_join(F.transform(paras, paragraphs.reconstructed), "\n\n")
    kept = F.filter(F.transform(F.filter(F.transform(F.split(text, "\n\n"), tx.strip), lambda p: p != ""), filters.keep_sentences), lambda p: tx.strip(p) != "")
    return rewrite.expand_slang(F.array_join(kept, "\n\n"))


def stages(docs: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """doc_id with raw, cleaned, reconstructed, expanded and restored text. Each step is a projection; only a title look-up joins."""
    rows = docs.select("doc_id", F.col("text").alias("raw"))
    rows = rows.withColumn("cleaned", clean.clean_text(F.col("raw")))
    rows = rows.withColumn("reconstructed", rebuilt(F.col("cleaned")))
    rows = rewrite.expand_acronyms(rows.withColumn("expanded", F.col("reconstructed")), "expanded", titles)
    return rows.withColumn("restored", rewrite.restore_punctuation(F.col("expanded")))


def chunks(staged: DataFrame, tails: bool = True) -> DataFrame:
    """Chunks of the restored text by sentences (no embedding model is at hand), with section context, without noise. Numbers keep their gaps."""
    # Dealt by document once: the walk over sentences starts from a column, and the windows below need no other shuffle.
    texts = staged.select("doc_id", F.col("restored").alias("text")).repartition("doc_id")
    rows = chunking.sentence_chunks(texts, "text", tails=tails)
    return chunking.section_context(rows, "doc_id").where(filters.is_clean_chunk(F.col("text")))


def trace(staged: DataFrame, chunked: DataFrame) -> DataFrame:
    """Seven (stage, text) rows a document; the third and fourth show the same text, the last the chunks' method."""
    method = chunked.groupBy(F.col("doc_id").alias("_doc")).agg(F.min_by("method", "chunk_id").alias("_method"))
    rows = staged.join(method, staged["doc_id"].eqNullSafe(method["_doc"]), "left")
    parts = [("1. Raw Input", "raw"), ("2. Cleaned", "cleaned"), ("3. Reconstructed", "reconstructed"), ("4. Informal Abbr Norm.", "reconstructed"), ("5. Abbreviation Expanded", "expanded"), ("6. Punct. Restored", "restored")]
    steps = [F.struct(F.lit(n).alias("stage"), F.col(c).alias("text")) for n, c in parts]
    steps.append(F.struct(F.lit("7. Chunking Method").alias("stage"), F.coalesce("_method", F.lit("no chunks")).alias("text")))
    return rows.select("doc_id", F.posexplode(F.array(*steps)).alias("stage_no", "_s")).select("doc_id", "stage_no", "_s.stage", "_s.text")


def questions(chunked: DataFrame, most: int = 8, provider=None) -> DataFrame:
    """Accepted questions: doc_id, chunk_id, question, context, pseudo_answer, provider. A provider with load() is asked (providers.py), else its column is taken."""
    provider = provider or quiz.TemplateQuestions()
    rows = chunked.select("doc_id", "chunk_id", F.col("text").alias("context"), tx.once(answers.answer_gate(F.col("text"))).alias("pseudo_answer")).where("pseudo_answer IS NOT NULL")
    answer, context = F.col("pseudo_answer"), F.col("context")
    rows = rows.withColumn("answer_key", quiz.question_key(F.substring("pseudo_answer", 1, 60)))
    if hasattr(provider, "load"):
        asked = rows.withColumn("prompts", quiz.prompts(answer, answers.focused(context, answer)))
        kept = providers.ask_in_order(asked, "doc_id", "chunk_id", provider, most)
    else:
        asked = rows.withColumn("question", quiz.tidy_question(provider.column(answer, context)))
        kept = quiz.accept_questions(asked.withColumn("question_key", quiz.question_key(F.col("question"))), "doc_id", "chunk_id", most)
    return kept.select("doc_id", "chunk_id", "question", "context", "pseudo_answer", F.lit(provider.name).alias("provider"))


def choices(asked: DataFrame, seed: str = "0", provider=None) -> DataFrame:
    """Four options each (Q6); another seed deals them anew.

    A provider is asked for the answer, then for distractors. Without one, or where a reply is of no use, rules choose: misleading sentences of
    the chunk, then other answers of the document's quiz (at most 20), then fixed ones.
    """
    own = Window.partitionBy("doc_id")
    anchor, question, context = F.col("_anchor"), F.col("question"), F.col("context")
    rows = asked.withColumn("_anchor", tx.strip(F.col("pseudo_answer")))
    # Before any provider is asked: its workers then don't stand beside those that asked for questions, and replies aren't shuffled.
    rows = rows.withColumn("_pool", F.collect_set(F.when(filters.is_clean_option(F.col("pseudo_answer")), anchor)).over(own))
    model = F.lit(None).cast("struct<answer:string,three:array<string>>")
    if provider:
        rows = providers.replies(rows.withColumn("_prompt", providers.answer_prompt(question, anchor, context)), "_prompt", "_first", provider, lx.ANSWER_TOKENS)
        rows = rows.withColumn("_prompt", providers.distractor_prompt(question, quiz.llm_answer(F.col("_first")), context))
        rows = providers.replies(rows, "_prompt", "_second", provider, lx.DISTRACTOR_TOKENS)
        model = providers.modelled(F.col("_first"), F.col("_second"))
    rows = rows.withColumn("_model", model)
    rows = rows.select("*", tx.once(F.coalesce(F.col("_model.three"), distractors.misleading(anchor, context))).alias("_found"))
    key = F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("chunk_id").cast("string"))
    rows = rows.withColumn("_o", distractors.options(F.coalesce(F.col("_model.answer"), anchor), F.col("_found"), F.col("_pool"), key))
    by = F.when(F.col("_model").isNotNull(), provider.name if provider else None).otherwise("rules")
    return rows.select("doc_id", "chunk_id", "question", "_o.options", "_o.correct_idx", by.alias("chosen_by"))
