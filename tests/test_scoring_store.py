"""Scoring over a store: each distinct chunk once, a restarted job only what is missing."""

from collections import Counter

import pytest

from maskloom.operators import ner, scoring


def _calls(folder):
    """Chunks the model was called with, from the files its calls left."""
    return Counter(p.read_text() for p in folder.iterdir())


def _model(folder, fails=()):
    def model(chunk):
        import uuid

        (folder / uuid.uuid4().hex).write_text(repr(chunk))
        if chunk in fails:
            raise ValueError("down")
        return f"[{chunk}]"

    return model


@pytest.fixture
def chunks(spark):
    rows = [(1, 0, "a", 0), (1, 1, "b", 1), (2, 0, "a", 0), (2, 1, None, 1), (3, 0, "", 0), (3, 0, "", 0), (None, None, "c", None), (4, 0, None, 0)]
    hot = [(i, 0, "a", 0) for i in range(10, 60)]
    return spark.createDataFrame(rows + hot, "doc_id long, chunk_idx int, chunk string, offset int")


def test_equal_to_plain_scoring_and_one_call_a_chunk(spark, chunks, tmp_path):
    (tmp_path / "calls").mkdir(), (tmp_path / "plain").mkdir()
    keys, store = ["doc_id", "chunk_idx"], str(tmp_path / "store")
    got = scoring.score_chunks_stored(chunks, _model(tmp_path / "calls"), keys, store, "m1")
    want = ner.score_chunks(chunks, _model(tmp_path / "plain"), keys)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert _calls(tmp_path / "calls") == Counter(["'a'", "'b'", "None", "''", "'c'"])
    # nothing is missing now; another model has results of its own
    assert scoring.score_missing(chunks, _model(tmp_path / "calls"), store, "m1") == 0
    assert scoring.score_missing(chunks.where("chunk = 'a'"), _model(tmp_path / "calls"), store, "m2") == 1
    none = scoring.score_chunks_stored(chunks.limit(0), _model(tmp_path / "calls"), keys, store, "m3")
    assert none.count() == 0 and none.columns == want.columns
    with pytest.raises(ValueError):
        scoring.read_scores(spark, store, "../m")


def test_restart_scores_what_is_missing(chunks, tmp_path, monkeypatch):
    calls, keys, store = tmp_path / "calls", ["doc_id", "chunk_idx"], str(tmp_path / "store")
    calls.mkdir()
    with monkeypatch.context() as m:  # the job ends after half of its parts
        m.setattr(scoring, "PARTS", scoring.PARTS[:8])
        scoring.score_missing(chunks, _model(calls), store, "m")
    first = _calls(calls)
    assert 0 < len(first) < 5
    got = scoring.score_chunks_stored(chunks, _model(calls), keys, store, "m")
    assert set(_calls(calls).values()) == {1} and len(_calls(calls)) == 5 and got.count() == chunks.count()


def test_failed_chunks_are_scored_again(chunks, tmp_path):
    calls, keys, store = tmp_path / "calls", ["doc_id", "chunk_idx"], str(tmp_path / "store")
    calls.mkdir()
    bad = scoring.score_chunks_stored(chunks, _model(calls, fails=("b",)), keys, store, "m").where("chunk = 'b'").collect()
    assert [(r.response, r.error) for r in bad] == [(None, "ValueError: down")]
    good = scoring.score_chunks_stored(chunks, _model(calls), keys, store, "m").where("chunk = 'b'").collect()
    assert [(r.response, r.error) for r in good] == [("[b]", None)]
    assert _calls(calls)["'b'"] == 2 and sum(_calls(calls).values()) == 6
