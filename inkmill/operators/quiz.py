"""Questions and quizzes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx

from .answers import is_kind


def question_key(q: Column) -> Column:
    """X20."""
    out = tx.strip(F.lower(q))
    for pattern, by in lx.QUESTION_FORMS:
        out = tx.replaced(out, pattern, by)
    return tx.strip(tx.replaced(out, r"\s+", " "))


def tidy_question(q: Column) -> Column:
    """F12's first half: no space before punctuation, a capital at the start."""
    out = tx.strip(tx.replaced(q, r"\s+([?.!,])", "$1"))
    return tx.upper_first(out)


def template_kind(answer: Column) -> Column:
    def by(low: Column) -> Column:
        out = F.lit("general")
        for kind in ("process", "function", "definition"):
            out = F.when(is_kind(answer, kind, low), kind).otherwise(out)
        return out

    return tx.let(F.lower(answer), by)


def prompt(answer: Column, context: Column, call: Column) -> Column:
    """The template of the answer's kind whose turn it is at call number `call` (from 0), filled in."""
    chosen = _templates(answer)
    return _filled(F.get(chosen, F.pmod(call, F.size(chosen)).cast("int")), tx.strip(answer), tx.strip(context))


def prompts(answer: Column, context: Column) -> Column:
    """The prompts of all templates of the answer's kind, in order of their turns."""
    return tx.let(tx.strip(answer), lambda a: tx.let(tx.strip(context), lambda c: F.transform(_templates(answer), lambda text: _filled(text, a, c))))


def _templates(answer: Column) -> Column:
    table = F.create_map(*[x for k, v in lx.TEMPLATES.items() for x in (F.lit(k), tx.listed(v))])
    return table[template_kind(answer)]


def _filled(text: Column, answer: Column, context: Column) -> Column:
    before, after = F.split_part(text, F.lit("{answer}"), F.lit(1)), F.split_part(text, F.lit("{answer}"), F.lit(2))
    return F.concat(before, answer, F.replace(after, F.lit("{context}"), context))


def parse_json(raw: Column, schema: str) -> Column:
    """Code fences and thinking removed, then JSON; null on any error, also for an array."""
    bare = tx.strip(F.regexp_replace(raw, r"```(?:json)?|```", ""))
    return F.from_json(tx.strip(F.regexp_replace(bare, r"(?s)<think>.*?</think>", "")), schema)


def _as_text(x: Column) -> Column:
    """A JSON string's text; null for any other value."""
    return F.when(F.schema_of_variant(x) == "STRING", tx.strip(F.try_variant_get(x, "$", "string")))


def llm_answer(raw: Column) -> Column:
    return F.nullif(_as_text(parse_json(raw, "answer variant")["answer"]), F.lit(""))


def llm_distractors(raw: Column) -> Column:
    """The first three strings of the list, without blank ones; null if none is left. Numbers don't count as strings."""
    items = parse_json(raw, "distractors array<variant>")["distractors"]
    kept = F.filter(F.transform(items, _as_text), lambda x: x != "")
    return tx.let(kept, lambda k: F.when(F.size(k) > 0, F.slice(k, 1, 3)))


def accept_questions(candidates: DataFrame, doc: str, order: str, most: int = 8) -> DataFrame:
    """Q5: walks a document's candidates (answer_key, question, question_key) in order until `most` are accepted.

    An answer's key is taken only once its question is accepted, so this is no pair of duplicate removals; it runs per document.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        seen_q, seen_a, keep = set(), set(), []
        rows = rows.sort_values(order, kind="stable")
        for i, a, q in zip(rows.index, rows["answer_key"], rows["question_key"], strict=True):
            if len(keep) >= most:
                break
            if a is None or q is None or a in seen_a or q in seen_q or len(q) < 8 or q.startswith("[error"):
                continue
            seen_q.add(q)
            seen_a.add(a)
            keep.append(i)
        return rows.loc[keep]

    return candidates.groupBy(doc).applyInPandas(walk, candidates.schema)


def graded(correct: Column, total: Column) -> Column:
    """Struct of percent (half to even) and grade."""
    percent = F.when(total > 0, F.bround(correct / total * 100)).otherwise(0.0).cast("int")
    return F.struct(percent.alias("percent"), F.when(percent >= 85, "A").when(percent >= 70, "B").when(percent >= 55, "C").otherwise("D").alias("grade"))


def session_scores(submissions: DataFrame, questions: DataFrame, compat: bool = True) -> DataFrame:
    """Per session correct, total, percent, grade. compat counts each correct submission; otherwise the latest per question."""
    s = submissions
    if not compat:
        last = Window.partitionBy("session", "q_no").orderBy(F.desc("seq"))
        s = s.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    total = questions.groupBy("session").agg(F.countDistinct("q_no").cast("int").alias("total"))
    right = s.groupBy("session").agg(F.count_if(F.col("selected") == F.col("correct")).cast("int").alias("correct"))
    joined = total.join(right, "session", "left").withColumn("correct", F.coalesce("correct", F.lit(0)))
    return joined.withColumn("_g", graded(F.col("correct"), F.col("total"))).select("session", "correct", "total", "_g.percent", "_g.grade")


def recap(submissions: DataFrame, questions: DataFrame) -> DataFrame:
    """Z3: each question with its latest answer; a missing one counts as wrong with the selection '-'."""
    latest = submissions.groupBy("session", "q_no").agg(F.max_by("selected", "seq").alias("selected"))
    return questions.join(latest, ["session", "q_no"], "left").select("session", "q_no", "correct", F.coalesce("selected", F.lit("-")).alias("selected"), F.coalesce(F.col("selected") == F.col("correct"), F.lit(False)).alias("is_correct"))


class TemplateQuestions:
    """M1's stand-in without a model: a question from the answer itself. It bears its name in `provider`."""

    name = "template"

    def column(self, answer: Column, context: Column) -> Column:
        from .answers import definition

        d = definition(answer)
        return F.when(d.isNotNull(), F.concat(F.lit("Apa yang dimaksud dengan "), d["subj"], F.lit("?"))).otherwise(F.concat(F.lit("Apa yang dijelaskan oleh pernyataan berikut: "), tx.first_words(answer, 8), F.lit("?")))


def shortfall(asked: DataFrame, docs: DataFrame, most: int = 8) -> DataFrame:
    """Per document how many questions it has, and whether that is fewer than asked for. Documents without questions count, too."""
    n = asked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_questions"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n_questions", F.lit(0)).alias("n_questions"), (F.coalesce("n_questions", F.lit(0)) < most).alias("short"))
