import re
import time

import pytest

from roaskit.llm import substring_dedup as m


def plain(rows, least):
    """The removed texts of each (id, text), one document after another, by looking whole passages up."""
    first, out = {}, {}
    for d, text in sorted({(r.doc_id, r.text) for r in rows if r.doc_id is not None and r.text is not None}):
        units = [u.strip() for line in text.split("\n") for u in re.split(r"(?<=[.!?])\s+", line) if u.strip()]
        size = [len(u.split()) for u in units]
        keys = [" ".join(u.lower().split()).strip(m.SIGNS) for u in units]
        found = set()
        for i in range(len(units)):
            for j in range(i + 1, len(units) + 1):
                if sum(size[i:j]) >= least:
                    found.add((i, j))
                    break
            for h in range(i, -1, -1):
                if sum(size[h:i + 1]) >= least:
                    found.add((h, i + 1))
                    break
        gone = set()
        for i, j in sorted(found):
            if first.setdefault(tuple(keys[i:j]), (d, text, i)) != (d, text, i):
                gone |= {(k, k + 1 < j) for k in range(i, j)}
        runs, run = [], []
        for k, u in enumerate(units):
            if {(k, True), (k, False)} & gone:
                run.append(u)
                if (k, True) not in gone and not any((k + 1, x) in gone for x in (True, False)):
                    runs.append(run)
                    run = []
        out[d, text] = [" ".join(" ".join(r).split()) for r in runs]
    return out


@pytest.mark.parametrize("least", [1, 10, m.MIN_WORDS])
def test_removed_runs_equal_brute_force(spark, documents, least):
    rows = documents.collect()
    want, text_of = plain(rows, least), {r.doc_id: r.text for r in rows}
    got = m.without_copies(documents, min_words=least).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) > 20
    for r in got:
        text = text_of[r.doc_id]
        assert [" ".join(text[s.start:s.end].split()) for s in r.removed] == want[r.doc_id, text]
        assert r.text == "".join(text[s.start:s.end] for s in r.kept)
        assert all(k <= r.doc_id for s in r.removed for k in s.keep_ids)
        assert r.removed_chars == len(text) - len(r.text)


PASSAGE = " ".join(f"Word{i} goes on and on here." for i in range(20))


def test_passages_inside_lines_and_clean_documents(spark):
    rows = [(1, f"Own beginning {PASSAGE} own end.", 0), (2, f"Another start that runs into it. {PASSAGE}\nThe end of two.", 0),
            (3, "Quite another text. Short one.\nIt has its own words only.", 0), (4, "Other words stand here. Short one.\nAll of them different.", 0)]
    got = {r.doc_id: r for r in m.without_copies(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()}
    assert got[1].n_removed == got[3].n_removed == got[4].n_removed == 0 and got[3].text == rows[2][1]
    assert got[2].n_removed == 1 and got[2].text == "Another start that runs into it. Word0 goes on and on here. \nThe end of two."


def test_sentences_of_several_documents_are_no_passage(spark):
    """Each sentence of the last document has occurred, but nowhere one after another."""
    said = [f"Sentence {i} tells of matter {i} in seven words." for i in range(24)]
    rows = [(i, f"Preface {i}. {s} Afterword {i}.") for i, s in enumerate(said)] + [(99, " ".join(said))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in m.without_copies(docs).collect()}
    assert got[99].n_removed == 0 and got[99].text == rows[-1][1]
    assert {r.doc_id: r for r in m.without_copies(docs, min_words=1).collect()}[99].text.strip() == ""


def test_odd_rows(spark):
    line = "these are ten words or more that stand in one line only"
    rows = [(None, line, 1), (1, None, 2), (2, "", 3), (3, " \n\n ", 4), (4, line, None), (5, f"{line}\n{line.upper()}", 5), (5, f"{line}\n{line.upper()}", 5),
            (5, "another text of the same id with words enough\n" + line, 6), (6, (line + ".\n") * 20_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed int")
    got = m.without_copies(docs, min_words=10).collect()
    left = sorted(((r.doc_id, (r.text or "").strip()) for r in got), key=repr)
    assert left == sorted([(None, line), (1, ""), (2, ""), (3, ""), (4, line), (5, ""), (5, ""), (5, "another text of the same id with words enough"),
                           (6, "")], key=repr)
    assert {r.doc_id: r.text for r in got}[1] is None
    assert m.without_copies(docs.limit(0)).count() == 0


def test_signs_without_end_take_linear_time():
    start = time.time()
    assert m.units_of("." * 1_000_000 + "x") == [(0, 1_000_001)]
    assert len(m.units_of("a. " * 300_000)) == 300_000
    assert time.time() - start < 10
