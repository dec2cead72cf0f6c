"""Experiments as text and back."""

import json

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, MaxAbsScaler

from foldmeter.operators import classifiers, evolve, extractors, network, selection
from foldmeter.plans import saved
from foldmeter.plans.config import Experiment, KFold, LeaveOneOut, PreparedSets


def full():
    return Experiment(
        label="lang",
        attributes={"text": extractors.Tfidf(max_features=9, norm="l1"), "n": extractors.Pass(), "img": extractors.Hog(9, 4, 4, 2, 2, "L1")},
        validator=KFold(3, True, 7),
        selectors=[selection.VarianceSelector(0.1), selection.TreeSelector("mean")],
        classifiers=[
            classifiers.SVM(normalizer=classifiers.MinMax(-1, 1), kernel="rbf"),
            classifiers.ANN(network=network.NeuralNetwork([network.Layer(8, "relu")], 3, epochs=2, learning_rate=0.1)),
            classifiers.Prototypes(evolution=evolve.EvolvedPrototypes(generations=2, population=6, random_seed=2)),
        ],
        quotas={"en": 10, "de": 5},
        inactive=["fr"],
    )


def test_round_trip(spark, tmp_path):
    saved.save_experiment(spark, full(), str(tmp_path / "e"))
    assert saved.load_experiment(spark, str(tmp_path / "e")) == full()


def test_pyspark_ml_stages(spark):
    model = classifiers.MLClassifier(LogisticRegression(maxIter=7), "Logistic", "LR", normalizer=classifiers.MLNormalizer(MaxAbsScaler()))
    stages = extractors.MLStages([CountVectorizer(vocabSize=12)], tokens=True)
    back = saved.decode(json.loads(json.dumps(saved.encode([model, stages, LeaveOneOut()]))))
    assert back[0].estimator.getMaxIter() == 7 and isinstance(back[0].normalizer.stage, MaxAbsScaler)
    assert back[1].stages[0].getVocabSize() == 12 and back[2] == LeaveOneOut()


def test_what_cannot_be_read_back(spark, tmp_path):
    with pytest.raises(TypeError, match="function"):
        saved.encode(PreparedSets(assign=lambda df: df))
    for bad in ({"kind": "Popen", "fields": {}}, {"stage": "os:system", "params": {}}):
        with pytest.raises(ValueError, match="unknown"):
            saved.decode(bad)
    spark.createDataFrame([('{"version": 0, "experiment": null}',)], "experiment string").write.json(str(tmp_path / "old"))
    with pytest.raises(ValueError, match="version 0"):
        saved.load_experiment(spark, str(tmp_path / "old"))
