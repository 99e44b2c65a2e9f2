"""Every stage of the pipeline on awkward rows: without ids, repeated, empty, long, with clashing columns, and on none."""

import os

import pytest

import corpus_pipeline
from sievework.llm import shared

SCHEMA = "doc_id long, text string, lang string, source string"


def kept(spark, stage, rows):
    d = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], SCHEMA)
    out = stage(spark, d, "")
    assert out.columns == d.columns
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.source) for r in out.collect())


def text(k, change=None):
    w = [f"w{k}_{i}" for i in range(40)]
    if change is not None:
        w[change] = "x"
    return " ".join(w)


def test_exact_copies_leave_one_row(spark):
    rows = [(None, "a", ""), (None, "a", ""), (4, "b", ""), (4, "b", ""), (3, "b", ""), (None, "b", ""), (4, "c", ""), (5, None, ""), (5, "", "")]
    got = kept(spark, corpus_pipeline.exact_copies, rows)
    assert [r[:2] for r in got if r[1]] == [(-1, "a"), (4, "b"), (4, "c")] and len(got) == 4


def test_near_copies_leave_one_row(spark):
    rows = [(None, text(0), "a"), (7, text(0, 3), "b"), (8, text(0, 9), "c")]  # one without an id
    rows += [(1, text(1), "d"), (1, text(1), "d"), (2, text(1, 5), "e")]  # a repeated row with the smallest id
    rows += [(2, text(2), "f"), (9, text(3), "g"), (None, text(4), "h")]  # alone; 2 is also the id of a copy
    got = kept(spark, corpus_pipeline.near_copies, rows)
    assert [(i, s) for i, _, s in got] == [(-1, "a"), (-1, "h"), (1, "d"), (2, "f"), (9, "g")]


def test_dedup_stages_on_no_rows(spark):
    assert kept(spark, corpus_pipeline.exact_copies, []) == kept(spark, corpus_pipeline.near_copies, []) == []


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, held_out boolean, _sha string, _row long, id string, grp string, keep_id long, _lang_score string"
EN, DE = "the thing of words and that is with it ", "der hund und die katze ist nicht auf dem haus "
ALONE = "ganz andere worte stehen in dieser zeile und sonst nirgends"


def awkward(spark):
    texts = [(k, (EN if k % 2 else DE) + f"word{'abcdefghij'[k % 10]} " * (1 + k % 3), "en" if k % 2 else "de") for k in range(60)]
    texts += [(100, None, None), (101, "", "en"), (None, EN + "mail me at joe@ex.org now", None), (102, " \n\t ", None), (103, EN * 6000, "en"), (104, ALONE, None), (104, ALONE, None), (105, "12 !?", "en")]
    rows = [(i, t, lang, "s", None if t is None else len(t), 0.125, "xx", None, "sha", 7, "id", "grp", -1, "kept") for i, t, lang in texts]
    return spark.createDataFrame(rows, CLASH)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_that_clash_keep_their_values(spark, stage):
    d = awkward(spark)
    out = stage(spark, d, "")
    assert out.schema.names == d.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in d.schema]
    own = ("score", "lang_pred", "held_out", "_sha", "_row", "id", "grp", "keep_id", "_lang_score", "source")
    rows = out.collect()
    assert rows and {tuple(r[c] for c in own) for r in rows} == {(0.125, "xx", None, "sha", 7, "id", "grp", -1, "kept", "s")}
    none = stage(spark, d.limit(0), "")
    assert none.count() == 0 and none.columns == d.columns


def test_each_stage_does_its_work(spark):
    d = awkward(spark)
    n = d.count()
    by = lambda df: {(r.doc_id, r.text): r for r in df.collect()}
    got = by(corpus_pipeline.language_id(spark, d, ""))
    assert not {100, 101, 102, 105} & {i for i, _ in got} and len(got) == n - 4 - 1 and all(r.lang in ("en", "de") for r in got.values())
    got = corpus_pipeline.exact_copies(spark, d, "").collect()
    assert sum(r.doc_id == 104 for r in got) == 1 and sum(not r.text for r in got) == 1 and any(r.doc_id == 103 and r.text == EN * 6000 for r in got)
    got = corpus_pipeline.near_copies(spark, d, "").collect()
    assert sum(r.doc_id == 104 for r in got) == 1 and sum(not (r.text or "").strip() for r in got) == 3
    got = corpus_pipeline.personal_data(spark, d, "").collect()
    (mail,) = [r for r in got if r.doc_id is None]
    assert mail.text == EN + "mail me at [EMAIL] now" and mail.n_chars == len(mail.text) and len(got) == n and sum(r.text is None for r in got) == 1
    got = corpus_pipeline.packing(spark, d, "").collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in d.collect()} and sum(r.piece == 0 for r in got) == n


def test_run_leaves_no_folders_of_its_stages(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    begun = shared.made()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and sorted(r.piece for r in rows)[0] == 0
    left = [p.removeprefix("file:") for p in shared._MADE.at[begun:]]
    assert len(left) == 2 and all(os.path.isdir(p) for p in left)  # what packing reads and what the result reads
    shared.clear(spark, begun)
    assert not any(os.path.isdir(p) for p in left) and shared.made() == begun
