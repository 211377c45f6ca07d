"""The registered model queries fit forests as large as their operators do."""

import inspect

import pytest

import checks.learning as registered
from moneytrail.operators import feedback, learning

FOREST = {"trees": 200, "depth": 12}


def arguments(fn, args, named):
    bound = inspect.signature(fn).bind(*args, **named)
    bound.apply_defaults()
    return bound.arguments


@pytest.fixture()
def ten_rows(spark, monkeypatch):
    rows = spark.range(10)
    monkeypatch.setattr(registered, "labelled", lambda spark, d: rows)
    monkeypatch.setattr(learning, "training_set", lambda df, columns, *rest: df)
    return rows


def test_retrain_fits_and_cross_validates_whole_forests(spark, ten_rows, monkeypatch):
    fits = []
    for name in ("train_classifier", "cross_validate"):
        def fake(*args, _name=name, _fn=getattr(learning, name), **named):
            fits.append((_name, arguments(_fn, args, named)))
        monkeypatch.setattr(learning, name, fake)
    registered.retrain(spark, "")
    assert [name for name, _ in fits] == ["train_classifier", "cross_validate"]
    assert all({k: a[k] for k in FOREST} == FOREST for _, a in fits)


def test_train_ensemble_fits_its_whole_members(spark, ten_rows, monkeypatch):
    fits, fn = [], learning.train_ensemble

    def fake(*args, **named):
        fits.append(arguments(fn, args, named))
        raise InterruptedError
    monkeypatch.setattr(learning, "train_ensemble", fake)
    with pytest.raises(InterruptedError):
        registered.train_ensemble(spark, "")
    assert {k: fits[0][k] for k in (*FOREST, "rounds")} == {**FOREST, "rounds": 50}


def test_retrain_defaults_are_those_of_the_classifier():
    whole = inspect.signature(learning.train_classifier).parameters
    assert {k: p.default for k, p in inspect.signature(feedback.retrain).parameters.items() if k in FOREST} == {
        k: whole[k].default for k in FOREST}
