"""Model providers (S7, M1 to M3, X18): one interface for questions, answers and distractors.

A provider has a name and load(), called once per worker; it gives a callable (prompts, tokens) -> replies, of the same length, each at
most `tokens` long. Prompts go in batches. A call that fails has no reply, and rules take its place. A task that runs again asks again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx

from . import quiz

Model = Callable[[list[str], int], list[str | None]]

_loaded: dict[str, Model] = {}


def loaded(provider) -> Model:
    if provider.name not in _loaded:
        _loaded[provider.name] = provider.load()
    return _loaded[provider.name]


def answered(model: Model, prompts: list[str | None], tokens: int) -> list[str | None]:
    """A reply for each prompt that isn't null. Where a batch fails, each prompt is asked alone, and only failing ones have no reply."""
    wanted = [p for p in prompts if p is not None]
    try:
        got = list(model(wanted, tokens)) if wanted else []
    except Exception:  # whatever a model raises means that it has no reply
        got = [answered(model, [p], tokens)[0] for p in wanted] if len(wanted) > 1 else [None] * len(wanted)
    if len(got) != len(wanted):
        raise ValueError(f"{len(got)} replies to {len(wanted)} prompts")
    rest = iter(got)
    return [None if p is None else next(rest) for p in prompts]


def replies(rows: DataFrame, prompt: str, out: str, provider, tokens: int) -> DataFrame:
    """rows with the reply to the column `prompt` as `out`; a null prompt isn't asked."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(provider)
        for batch in batches:
            got = answered(model, batch.column(prompt).to_pylist(), tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, out])

    return rows.mapInArrow(ask, StructType([*rows.schema.fields, StructField(out, StringType())]))


def _question(reply: str | None) -> tuple[str, str]:
    """quiz.tidy_question and quiz.question_key of a reply. No reply gives a question that is never accepted."""
    text = re.sub(r"\s+(?=[?.!,])", "", "[error]" if reply is None else reply.strip() or lx.NO_QUESTION).strip()
    key = text.lower()
    for pattern, by in (*lx.QUESTION_FORMS, (r"\s+", " ")):
        key = re.sub(pattern, by, key.strip())
    return text[:1].upper() + text[1:], key.strip()


def ask_in_order(candidates: DataFrame, doc: str, order: str, provider, most: int = 8) -> DataFrame:
    """M1, X18 and Q5 together: the accepted candidates with their `question`. Candidates have answer_key and prompts, one for each template; other columns stay.

    Within a document each call takes the next template, and calls count even if their question is rejected. An answer that an accepted
    question has used isn't asked again; after `most` questions nothing is. A document's candidates come as one row, so that a batch holds many
    documents and nothing before is computed twice for a join.
    """
    own = [c for c in candidates.columns if c != doc]
    kept = [c for c in own if c not in ("answer_key", "prompts")]

    def accepted(model: Model, at: list[int], keys: list, prompts: pa.Array) -> Iterator[tuple[int, str]]:
        calls, questions, answers = 0, set(), set()
        for i in at:
            if keys[i] in answers:
                continue
            turns = prompts[i]
            text, key = _question(answered(model, [turns[calls % len(turns)].as_py()], lx.QUESTION_TOKENS)[0])
            calls += 1
            if key not in questions and len(key) >= 8 and not key.startswith("[error"):
                questions.add(key)
                answers.add(keys[i])
                yield i, text
                if len(questions) == most:
                    return

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(provider)
        for batch in batches:
            lists = batch.column("_rows")
            bounds, items = lists.offsets.to_pylist(), lists.values
            keys, places, prompts = items.field("answer_key").to_pylist(), items.field(order).to_pylist(), items.field("prompts")
            found = [(d, *x) for d, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) for x in accepted(model, sorted(range(a, b), key=places.__getitem__), keys, prompts)]
            parents, at = pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(doc).take(parents), *(items.field(c).take(at) for c in kept), pa.array([x[2] for x in found], pa.string())], names=[doc, *kept, "question"])

    rows = candidates.groupBy(doc).agg(F.collect_list(F.struct(*own)).alias("_rows"))
    return rows.mapInArrow(walk, StructType([candidates.schema[doc], *(candidates.schema[c] for c in kept), StructField("question", StringType())]))


def _filled(template: str, **values: Column) -> Column:
    """The template with values in place of {name}; braces in values stay as they are."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def answer_prompt(question: Column, anchor: Column, context: Column) -> Column:
    return _filled(lx.ANSWER_PROMPT, context=F.substring(context, 1, 500), question=question, anchor=F.substring(anchor, 1, 150))


def distractor_prompt(question: Column, correct: Column, context: Column) -> Column:
    """Null where no answer is known."""
    return F.when(correct.isNotNull(), _filled(lx.DISTRACTOR_PROMPT, context=F.substring(context, 1, 500), question=question, correct=correct))


def modelled(answer_reply: Column, distractor_reply: Column) -> Column:
    """struct(answer, three): the model's answer and distractors, filled up to three by the fixed option whose turn it is; null if either reply is of no use."""
    rest = tx.listed(lx.FALLBACK_OPTIONS)

    def filled(answer: Column, found: Column) -> Column:
        three = F.concat(found, F.slice(rest, F.size(found) + 1, F.lit(3) - F.size(found)))
        return F.when(answer.isNotNull() & found.isNotNull(), F.struct(answer.alias("answer"), three.alias("three")))

    return tx.let(quiz.llm_answer(answer_reply), lambda a: tx.let(quiz.llm_distractors(distractor_reply), lambda d: filled(a, d)))


class EchoModel:
    """A deterministic stand-in for tests and offline runs, no language model: it repeats words of its prompt.

    Questions repeat the answer's start; answers the hint's first 20 words; distractors are words of the question, in fives. Prompts without
    words to repeat have no reply.
    """

    name = "echo"

    def load(self) -> Model:
        return lambda prompts, tokens: [_echo(p) for p in prompts]


def _echo(prompt: str) -> str | None:
    import json

    if found := re.search(r"Petunjuk topik: (.*)", prompt):
        return json.dumps({"answer": " ".join(found[1].split()[:20])}, ensure_ascii=False)
    if "Jawaban benar: " in prompt:
        words = re.search(r"Pertanyaan: (.*)", prompt)[1].split()
        return "```json\n" + json.dumps({"distractors": [" ".join(words[i : i + 5]) for i in range(0, len(words), 5)]}, ensure_ascii=False) + "\n```"
    found = re.search(r"answer: (.*?) context: ", prompt, re.DOTALL)
    return f"apakah arti {' '.join(found[1].split()[:6])} ?" if found else None
