"""Model providers: prompts, failing calls, turns of templates, and the rules that take over."""

from pyspark.sql import functions as F

from inkmill.functions import lexicon as lx
from inkmill.functions import text as tx
from inkmill.operators import providers, quiz, rewrite
from inkmill.plans import pipeline, registry


def models():
    """Classes of their own, so that workers needn't import this module."""

    class Failing:
        """Fails on a batch that holds "bad", and has no reply to it alone."""

        name = "failing"

        def load(self):
            def model(prompts, tokens):
                if "bad" in prompts:
                    raise RuntimeError("no")
                return [p.upper() for p in prompts]

            return model

    class Turns:
        """Replies with the template's type; the same question for the first two calls."""

        name = "turns"

        def load(self):
            return lambda prompts, tokens: ["pertanyaan yang sama ?" if "type: definition" in p or "generate question: answer: Dua" in p else p[:40] for p in prompts]

    class Mute:
        name = "mute"

        def load(self):
            def model(prompts, tokens):
                raise RuntimeError("no")

            return model

    return Failing(), Turns(), Mute()


FAILING, TURNS, MUTE = models()


def test_replies(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "b")], "id int, p string").coalesce(1)
    got = {r["id"]: r["r"] for r in providers.replies(rows, "p", "r", FAILING, 9).collect()}
    assert got == {1: "A", 2: None, 3: None, 4: "B"}
    assert providers.replies(rows.where("id > 9"), "p", "r", FAILING, 9).count() == 0


def test_prompts(spark):
    rows = spark.createDataFrame([("Q {anchor}?", "A" * 200, "C" * 600)], "q string, a string, c string")
    first, second, none = rows.select(
        providers.answer_prompt(F.col("q"), F.col("a"), F.col("c")), providers.distractor_prompt(F.col("q"), F.col("a"), F.col("c")), providers.distractor_prompt(F.col("q"), F.lit(None).cast("string"), F.col("c"))
    ).first()
    assert first == lx.ANSWER_PROMPT.replace("{anchor}", "A" * 150).replace("{context}", "C" * 500).replace("{question}", "Q {anchor}?")
    assert second == lx.DISTRACTOR_PROMPT.replace("{context}", "C" * 500).replace("{question}", "Q {anchor}?").replace("{correct}", "A" * 200)
    assert none is None


def test_turns_count_rejected_calls(spark):
    answers = [(1, 0, "Satu hal adalah sesuatu yang sangat penting sekali."), (1, 1, "Dua hal adalah sesuatu yang sangat penting sekali."), (1, 2, "Tiga hal adalah sesuatu yang sangat penting sekali."), (2, 0, "Dua hal adalah sesuatu yang sangat penting sekali.")]
    rows = spark.createDataFrame(answers, "doc_id int, chunk_id int, a string").select("doc_id", "chunk_id", F.lower("a").alias("answer_key"), quiz.prompts(F.col("a"), F.lit("k")).alias("prompts"))
    got = {(r["doc_id"], r["chunk_id"]): r["question"] for r in providers.ask_in_order(rows, "doc_id", "chunk_id", TURNS).collect()}
    # The second call repeats the first question and is rejected, yet the third call takes the third template.
    assert got == {(1, 0): "Pertanyaan yang sama?", (1, 2): "Generate question type: what is answer: "[:40].rstrip(), (2, 0): "Pertanyaan yang sama?"}


ASKED = [(1, 0, "Apa arti memori kerja utama?", "Memori adalah tempat data. Layar adalah alat keluaran dari komputer.", "Memori adalah tempat data.")]


def test_choices(spark):
    asked = spark.createDataFrame(ASKED, "doc_id int, chunk_id int, question string, context string, pseudo_answer string")
    row = pipeline.choices(asked, provider=providers.EchoModel()).first()
    # One distractor, then the fixed options whose turns are the second and the third.
    assert row["chosen_by"] == "echo" and row["options"][row["correct_idx"]] == "Memori adalah tempat data."
    assert sorted(row["options"]) == sorted(["Memori adalah tempat data.", "Apa arti memori kerja utama?", *lx.FALLBACK_OPTIONS[1:]])
    mute, rules = pipeline.choices(asked, provider=MUTE).first(), pipeline.choices(asked).first()
    assert mute == rules and rules["chosen_by"] == "rules"


def test_shortfall(spark, data):
    short = {r["doc_id"]: (r["n_questions"], r["short"]) for r in quiz.shortfall(spark.createDataFrame([(1,), (1,), (2,)], "doc_id long"), spark.range(1, 4).withColumnRenamed("id", "doc_id"), most=2).collect()}
    assert short == {1: (2, False), 2: (1, True), 3: (0, True)}


def test_replies_by_hand(spark):
    got = {r["id"]: (r["answer"], r["three"]) for r in registry.model_replies(spark, "").collect()}
    assert got[1] == ("Otak", ["a", "b", "c"]) and got[2] == ("x", ["satu", *lx.FALLBACK_OPTIONS[1:]]) and got[3] == ("x", ["a", "b", lx.FALLBACK_OPTIONS[2]])
    assert all(got[i] == (None, None) for i in (4, 5, 6, 7))


def test_quiz_by_model_reads_each_document_once(spark, data):
    """Questions are accepted without a second pass over the chunks, and documents that share an id keep one row per question."""
    rows = registry.quiz_by_model(spark, data)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 1
    text = "Memori kerja adalah tempat data yang sedang dipakai oleh program komputer."
    chunked = spark.createDataFrame([(1, 0, text), (1, 0, "Layar datar merupakan alat keluaran yang menampilkan hasil kerja program."), (None, 0, text)], "doc_id long, chunk_id int, text string")
    asked = pipeline.questions(chunked, provider=providers.EchoModel()).collect()
    assert sorted((r["doc_id"] or 0, r["context"][:6]) for r in asked) == [(0, "Memori"), (1, "Layar "), (1, "Memori")]


def test_slang_in_any_case(spark):
    """Texts without a key aren't split, texts with one in any case, script or place are."""
    texts = ["", "tanpa singkatan", "yg", "(Dgn) x_yg", "tdK\u0301", "\u212al\u200d ini", "sdh\u2003blm", "\u212al", "aYG", "\u017fdh", "\u017f sdh"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(rewrite.expand_slang(F.col("t"))).collect()]
    keys = {k.lower(): v for k, v in lx.SLANG.items()}
    pieces = rows.select(F.split("t", r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)").alias("p")).collect()
    assert got == ["".join(keys.get(x.lower(), x) for x in r["p"]) for r in pieces] and got[2] == "yang" and got[7] == "kalau"


def test_word_limits(spark):
    texts = [None, "", " \n", "a", " a b ", "a b c", "  a b c d", "a b c d e\n", "a\tb\tc d e f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 3, 4):
        want = rows.select((tx.n_words(F.col("t")) <= n).alias("a"), F.array_join(F.slice(tx.words(F.col("t")), 1, n), " ").alias("b")).collect()
        assert rows.select(tx.at_most(F.col("t"), n).alias("a"), tx.first_words(F.col("t"), n).alias("b")).collect() == want


def test_sentence_ends(spark):
    texts = [None, "", " \n", ".", " . . a", "　a.  b!\x85c? ", "a.b. \n\t c \xa0", "?!  x", " a . b "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = rows.select(F.filter(F.transform(F.split("t", f"(?<=[.!?]){tx.SPACES}"), tx.strip), lambda x: x != "")).collect()
    assert rows.select(tx.sentences(F.col("t"))).collect() == want
