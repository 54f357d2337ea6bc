"""Inline rows for operators that no driver table exercises; the same rows feed Spark and the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "fx_paras": ("doc_id int, para_no int, text string", [
        (1, 0, "Pengolahan data adalah proses mengubah data mentah menjadi informasi yang berguna bagi pengguna."),
        (1, 1, "Tugas kelompok minggu ini"), (1, 2, "- buat ringkasan"), (1, 3, "1. baca bab dua"),
        (1, 4, "Perangkat keras terdiri dari komponen fisik komputer."), (1, 5, "- papan ketik dan tetikus"),
        (2, 0, "- butir tanpa tugas"), (2, 1, "Tembilahan, 2020"), (2, 2, "* butir setelah kolofon"), (2, 3, "tugas: tetap dihitung sebagai isi"),
        (2, 4, "Soal latihan dan tugas"), (2, 5, "buatlah ringkasan"), (3, 0, "kata pengantar ini panjang"), (3, 1, "Isi biasa saja."),
    ]),
    "fx_slang": ("id int, text string", [(1, "Data yg diolah dgn komputer."), (2, "Yg lain dll, tdk ada."), (3, "kpdx tetap, yga juga"), (4, ""), (5, "utk sm-sama & DR")]),
    "fx_chunks": ("doc_id int, chunk_id int, text string", [
        (1, 0, "Prosa sebelum judul apa pun."), (1, 1, "Bab Satu Pendahuluan"), (1, 2, "Kalimat pertama dalam bab ini."), (1, 3, "Bab Satu Pendahuluan lanjut di sini."),
        (1, 4, "Bab Dua"), (1, 5, "Bab Tiga"), (1, 6, "Isi bab tiga."), (2, 0, "a b c d e f g h i j k l"), (2, 1, "a b c d e f g h i j k l m"),
    ]),
    "fx_questions": ("id int, text string", [(1, "Apakah itu  CPU?"), (2, "Bagaimanakah yang di maksud?"), (3, "Di manakah  dan di  mana"), (4, " Kapankah  berapakah "), (5, "")]),
    "fx_submit": ("session string, seq int, q_no int, selected string, correct string", [
        ("a", 1, 1, "x", "x"), ("a", 2, 2, "y", "z"), ("a", 3, 1, "x", "x"), ("a", 4, 2, "z", "z"), ("b", 1, 1, "q", "x"),
    ]),
    "fx_quiz": ("session string, q_no int, correct string", [("a", 1, "x"), ("a", 2, "z"), ("a", 3, "w"), ("b", 1, "x"), ("b", 2, "x"), ("c", 1, "k")]),
    "fx_options": ("id int, answer string, pool array<string>", [
        (1, "Jawaban satu yang benar", ["Pilihan lain yang pertama", "jawaban satu yang benar", "Pilihan lain yang kedua", "Pilihan ketiga", "Pilihan keempat"]), (2, "Hanya jawaban ini", []),
    ]),
    "fx_lists": ("id int, text string", [
        (1, "1. Input data.\n2. Proses data\nlanjutan\n10. Keluaran"), (2, "Jenis perangkat\n- Papan ketik.\n- Tetikus\n- Layar"), (3, "- satu\n- dua"), (4, "- tunggal..."),
        (5, "1. Pendahuluan materi"), (6, "Kalimat biasa tanpa daftar."), (7, "• satu\nb\nc\nd"),
    ]),
    "fx_punct": ("id int, text string", [(1, "satu,dua tiga .empat"), (2, "Baris A\nBaris B\nlanjut c"), (3, "a b c d e f"), (4, "selesai. berikut ini"), (5, "  ")]),
    "fx_acronyms": ("doc_id int, text string", [(1, "Central Processing Unit (CPU) cepat. CPU itu inti."), (2, "RAM (Random Access Memory) dan I/O serta NLP."), (3, "tanpa apa pun")]),
    "fx_titles": ("abbr string, titles array<string>", [("NLP", ["Bahasa", "Natural language processing"]), ("I/O", ["Masukan"])]),
    "fx_defs": ("id int, correct string, text string", [
        (1, "CPU utama adalah otak dari sebuah komputer.", "CPU utama adalah otak dari sebuah komputer. Memori kerja adalah tempat menyimpan data sementara. Monitor merupakan alat keluaran visual komputer."),
        (2, "Data disimpan di dalam berkas.", "Data disimpan di dalam berkas. Berkas disimpan di dalam folder. Folder disimpan di cakram."),
    ]),
    "fx_llm": ("id int, raw string", [(1, '```json\n{"answer": " Otak komputer "}\n```'), (2, '<think>x</think>{"distractors": ["a", 5, " b ", "c", "d"]}'), (3, "[1, 2]"), (4, "oops"), (5, '{"answer": ""}'), (6, None)]),
    "fx_replies": ("id int, reply_a string, reply_b string", [
        (1, '{"answer": " Otak "}', '{"distractors": [" a ", "b", "c", "d"]}'), (2, '```json\n{"answer": "x"}\n```', '{"distractors": ["satu"]}'), (3, '{"answer": "x"}', '{"distractors": ["a", "b"]}'),
        (4, None, '{"distractors": ["a"]}'), (5, '{"answer": "x"}', '{"distractors": []}'), (6, '{"answer": 5}', '{"distractors": ["a"]}'), (7, '{"answer": "x"}', "oops"),
    ]),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]::VARCHAR[]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(name: str) -> str:
    """The table for the SQL side, as a subquery."""
    schema, rows = TABLES[name]
    columns = ", ".join(c.split()[0] for c in schema.split(", "))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns}))"
