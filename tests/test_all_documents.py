"""Queries over all documents, against brute force."""

import re

import pytest

from inkmill.plans import registry

ODD = [(1, "É CPU dan GPU, CPU"), (2, "naïve API/IO: ÉCPU CPUé I/O."), (3, "漢字RAM 漢字 RAM"), (4, None), (5, ""), (6, "TOOLONGNAME A AB"), (7, "RAM_1 NLP² — BIOS…"), (8, "AB/c CD/ EF//é XÝ ́GH ‿JK‿")]


def brute(texts):
    found = {i: dict.fromkeys(re.findall(r"\b([A-Z][A-Z/]{1,5})\b", t or "")) for i, t in texts}
    return sorted((i, k, a) for i, names in found.items() for k, a in enumerate(names))


@pytest.mark.parametrize("given", [False, True])
def test_acronyms_of_all_documents(spark, data, tmp_path, given):
    if not given:
        spark.createDataFrame(ODD, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = data if given else str(tmp_path)
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["pos"], r["abbr"]) for r in registry.acronym_candidates(spark, folder).collect())
    assert got == brute(texts)
    assert {i for i, _, _ in got} & {i for i, t in texts if not (t or "").isascii()}
