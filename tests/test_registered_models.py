"""Registered classifier queries fit whole models."""

from agorasift.operators import model as M
from agorasift.plans import scoring


def test_classifier_queries_take_the_defaults(monkeypatch):
    assert scoring.boosted_classifier() == M.BoostedClassifier()
    assert scoring.boosted_classifier().rounds == 250

    class Stop(Exception):
        pass

    def folds(*given, **more):
        assert given[2] is scoring.boosted_classifier and len(given) == 3 and more.get("folds", 5) == 5
        raise Stop

    monkeypatch.setattr(M, "cross_validate", folds)
    monkeypatch.setattr(scoring, "training_rows", lambda t: [None, type("Rows", (), {"join": lambda *a: None})(), type(
        "Rows", (), {"join": lambda *a: None})(), None])
    try:
        scoring.cross_validation(None)
    except Stop:
        return
    raise AssertionError("no folds were fitted")
