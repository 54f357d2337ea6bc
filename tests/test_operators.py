"""Rows with results worked out by hand, quirks, and properties."""

import io
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmill.operators import answers, chunking, clean, distractors, filters, paragraphs, quiz, rewrite
from inkmill.plans import fixtures, registry
from inkmill.sources import documents


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("pem-\nrograman", "pemrograman"), ("a- \nb", "a- b"), ("x.....9", "x 9"), ("12\nTeks.\nivx", "Teks."), ("Satu.\nDua.", "Satu.\n\nDua."), ("satu\nDan dua", "satu Dan dua"),
        ("judul:\nisi", "judul:\nisi"), ("", ""), (None, ""), ("ﬁle x", "file x"), ("a\fb", "a b"),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, clean.clean_text(F.col("t")), t=raw) == want


def test_lists(spark):
    rows = {r["id"]: r for r in registry.list_reconstruction(spark, "").collect()}
    assert rows[1]["numbered"] == "Pertama, input data. Kedua, proses data lanjutan. Poin 10, keluaran."
    assert rows[2]["bulleted"] == "Jenis perangkat Hal-hal tersebut meliputi: Papan ketik, Tetikus, dan Layar."
    assert rows[3]["bulleted"] == "Terdapat beberapa hal, yaitu: satu dan dua."
    assert rows[4]["bulleted"] == "Terdapat beberapa hal, yaitu: tunggal."
    assert rows[5]["heading"] == "Berikut adalah penjelasan tentang Pendahuluan Materi."


def test_punctuation(spark):
    rows = {r["id"]: r["text"] for r in registry.punctuation_restore(spark, "").collect()}
    assert rows == {1: "satu, dua tiga. Empat", 2: "Baris A\nBaris B\nlanjut c.", 3: "a b c d e f.", 4: "selesai. Berikut ini", 5: "  "}


def test_acronyms(spark):
    rows = {r["doc_id"]: r["text"] for r in registry.acronym_expand(spark, "").collect()}
    assert rows[1] == "Central Processing Unit (Central Processing Unit (CPU)) cepat. CPU itu inti."
    assert rows[2] == "Random Access Memory (RAM) (Random Access Memory) dan I/O serta Natural language processing (NLP)."
    assert rows[3] == "tanpa apa pun"


def test_lookups_end_after_twenty(spark):
    names = [f"A{chr(65 + i)}" for i in range(22)]
    docs = spark.createDataFrame([(1, " ".join(names))], "doc_id int, text string")
    titles = spark.createDataFrame([(n, [f"Kata {n} lain"]) for n in names], "abbr string, titles array<string>")
    text = rewrite.expand_acronyms(docs, "text", titles).first()["text"]
    assert text.count("Kata") == 20 and text.endswith("AU AV")


def test_definition_and_distractors(spark):
    rows = {r["id"]: r for r in registry.definition_distractors(spark, "").collect()}
    assert tuple(rows[1]["parts"]) == ("CPU utama", "adalah", "otak dari sebuah komputer.")
    assert rows[1]["distractors"][:2] == ["CPU utama adalah tempat menyimpan data sementara.", "CPU utama adalah alat keluaran visual komputer."]
    assert rows[2]["parts"] is None and rows[2]["distractors"] == ["Berkas disimpan di dalam folder.", "Folder disimpan di cakram."]


def test_llm_json(spark):
    rows = {r["id"]: (r["answer"], r["distractors"]) for r in registry.llm_json_parse(spark, "").collect()}
    assert rows == {1: ("Otak komputer", None), 2: (None, ["a", "b", "c"]), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


@pytest.mark.parametrize(
    ("s", "want"),
    [("a b c d e", -1.0), ("Prosesor a b c d e f.", -1.0), ("Kata a b c d e.", 1.0), ("Ilmu komputer adalah bidang yang mempelajari komputasi dan data.", 11.0 - 0.0), ("Nilai f(x) = y untuk semua x di sini.", -1.0), ("Mesin (CPU) a b c d e f g h.", 4.0)],
)
def test_scores(spark, s, want):
    assert one(spark, answers.score(F.col("s")), s=s) == want


def test_clean_option_quirk(spark):
    assert one(spark, filters.is_clean_option(F.col("s")), s="Isi bagian ini penting sekali") is False


def test_sequential_acceptance(spark):
    rows = [(1, 0, "a", "q one long", "q one long"), (1, 1, "b", "q one long", "q one long"), (1, 2, "b", "q two long", "q two long"), (1, 3, "c", "short", "short"), (1, 4, "a", "q three long", "q three long")]
    df = spark.createDataFrame(rows, "doc_id int, chunk_id int, answer_key string, question string, question_key string")
    assert sorted(r["chunk_id"] for r in quiz.accept_questions(df, "doc_id", "chunk_id").collect()) == [0, 2]


def test_scores_of_sessions(spark):
    a, b = fixtures.frame(spark, "fx_submit"), fixtures.frame(spark, "fx_quiz")
    assert {r["session"]: (r["correct"], r["total"], r["percent"]) for r in quiz.session_scores(a, b).collect()} == {"a": (3, 3, 100), "b": (0, 2, 0), "c": (0, 1, 0)}
    assert {r["session"]: r["correct"] for r in quiz.session_scores(a, b, compat=False).collect()} == {"a": 2, "b": 0, "c": 0}


def test_tail_suffixes():
    assert chunking.spans([20] * 5, 100, 30, True) == [(0, 4), (3, 4), (4, 4)]
    assert chunking.spans([20] * 5, 100, 30, False) == [(0, 4)]


@given(st.lists(st.integers(0, 60), max_size=40), st.integers(1, 100), st.integers(1, 50))
def test_spans_cover_all(sizes, most, overlap):
    found = chunking.spans(sizes, most, overlap, False)
    assert {i for a, b in found for i in range(a, b + 1)} == set(range(len(sizes)))
    assert all(a == b or sum(sizes[a : b + 1]) <= most for a, b in found)


def test_block_rules_agree(spark):
    rows = fixtures.frame(spark, "fx_paras")
    by_window = sorted((r["doc_id"], r["text"]) for r in paragraphs.drop_task_blocks(rows, "doc_id", "para_no", "text").collect())
    arrays = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda s: s["text"]).alias("p"))
    by_fold = sorted((r["doc_id"], t) for r in arrays.select("doc_id", paragraphs.educational_paragraphs(F.col("p")).alias("p")).collect() for t in r["p"])
    assert by_window == by_fold


def test_options_hold_the_answer(spark):
    rows = fixtures.frame(spark, "fx_options")
    o = distractors.options(F.col("answer"), F.array().cast("array<string>"), F.col("pool"), F.col("id").cast("string"))
    for r in rows.withColumn("o", o).collect():
        assert len(r["o"]["options"]) == 4 and r["o"]["options"][r["o"]["correct_idx"]] == r["answer"]


def _docx(paras):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paras)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    prose = " ".join(f"kata{i}" for i in range(20))
    (tmp_path / "a.docx").write_bytes(_docx([("Heading1", "Bab satu"), ("", prose), ("Heading2", "Kata Pengantar"), ("", prose)]))
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    shape = '<p:sp><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    with zipfile.ZipFile(tmp_path / "b.PPTX", "w") as z:
        z.writestr("ppt/slides/slide1.xml", f'<p:sld xmlns:a="{a}" xmlns:p="{p}">{shape.format(y=9, t="akhir")}{shape.format(y=1, t=prose)}</p:sld>')
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.txt").write_text("x")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.docx", "b.PPTX", "c.docx"}
    assert rows["a.docx"]["text"] == f"Bab satu\n{prose}" and rows["b.PPTX"]["text"] == f"{prose}\nakhir" and "BadZipFile" in rows["c.docx"]["error"]


def test_stream(spark, tmp_path):
    from inkmill.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(_docx([("", "Kalimat pertama ini cukup panjang untuk disimpan di sini. " * 8)]))
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1


def test_partitions_dont_matter(spark, data):
    def rows():
        return sorted(map(str, registry.pipeline_chunks(spark, data).collect()))

    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
