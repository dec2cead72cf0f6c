import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, MaxAbsScaler, UnivariateFeatureSelector, VarianceThresholdSelector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from foldmeter.operators import bayes, classifiers, evolve, extractors, labels, network, prototypes, selection, splits, text
from foldmeter.operators.machines import LinearMachines
from foldmeter.plans.config import Experiment, LeaveOneOut, PreparedFolds, PreparedSets, StratifiedKFold
from foldmeter.plans.experiment import run_experiment
from foldmeter.plans.profile import profile
from foldmeter.sources import results

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def two_class(spark):
    """Label and four small integers; class 1 has the larger A."""
    rows = [
        (i, str(i % 2), str(5 + i if i % 2 else i % 3), str(i % 5 + 6 * (i % 2)), str(i % 4), str(i % 3))
        for i in range(32)
    ]
    return spark.createDataFrame(rows, "row_id bigint, label string, A string, B string, C string, D string").persist()


def config(models, **kw):
    kw.setdefault("validator", StratifiedKFold(2))
    kw.setdefault("attributes", {a: extractors.Pass() for a in "ABCD"})
    return Experiment(label="label", classifiers=models, **kw)


def test_all_classifiers_learn_two_classes(spark, two_class):
    models = [
        classifiers.SVM(show_imp_features=2, max_iter=5),
        classifiers.KNN(normalizer=classifiers.Standard()),
        classifiers.NaiveBayes(),
        classifiers.NaiveBayes(type_v="multinomial", name="MNB"),
        classifiers.DecisionTree(random_seed=1),
        classifiers.Prototypes(evolution=evolve.EvolvedPrototypes(generations=2, population=6, random_seed=2)),
        classifiers.MLClassifier(LogisticRegression(maxIter=10), "Logistic", "LR", normalizer=classifiers.MinMax()),
        classifiers.ANN(network=network.NeuralNetwork([network.Layer(8, "relu")], 3, epochs=10, learning_rate=0.1)),
    ]
    result = run_experiment(two_class, config(models, selectors=[selection.VarianceSelector(0.0)]))
    accuracy = {r["classifier"]: r["accuracy"] for r in result.scores().collect()}
    assert set(accuracy) == {m.name for m in models}
    assert all(a >= 0.75 for a in accuracy.values()), accuracy
    summary = result.summary()
    assert len(summary.columns) == 19
    assert [r["name"] for r in summary.collect()] == [m.name for m in models]
    top = result.predictions.filter(F.col("classifier") == models[0].name).first()["top"]
    assert len(top) == 2 and top[0]["name"] in set("ABCD") and top[0]["importance"] >= top[1]["importance"]
    assert {r["n_features"] for r in result.step_stats.collect()} == {4}
    assert result.epoch_log.count() == 2 * 10
    assert result.cross_table("Logistic").filter("real = 'All' and predicted = 'All'").first()["n"] == 32
    assert result.confusion_matrix("Logistic").count() == 2
    assert result.timings.select("metric").distinct().count() == 12


def test_kernels(spark, two_class):
    models = [classifiers.SVM(kernel=k, name=k, max_iter=5, landmarks=12) for k in ("poly", "rbf", "sigmoid")]
    result = run_experiment(two_class, config(models))
    accuracy = {r["classifier"]: r["accuracy"] for r in result.scores().collect()}
    assert accuracy["rbf"] >= 0.75 and accuracy["poly"] >= 0.75 and len(accuracy) == 3


def test_validators(spark, two_class):
    df = two_class.withColumn("part", (F.col("row_id") % 6 % 3).cast("string")).withColumn(
        "marks", F.concat((F.col("row_id") % 2 + 1).cast("string"), F.when(F.col("row_id") % 8 < 4, "t").otherwise(""))
    )
    models = [classifiers.KNN(neighbors=1)]
    by_part = run_experiment(df, config(models, validator=PreparedFolds("part")))
    assert by_part.predictions.select("step").distinct().count() == 3 and by_part.predictions.count() == 32
    by_mark = run_experiment(df, config(models, validator=PreparedSets("marks")))
    assert by_mark.predictions.count() == 16
    own = PreparedSets(assign=lambda d: d.select(F.lit(0).alias("step"), "row_id", F.when(F.col("row_id") < 8, "test").otherwise("train").alias("role")))
    assert run_experiment(df, config(models, validator=own)).predictions.count() == 8


def test_leave_one_out_closed_form_equals_loop(spark, two_class):
    few = two_class.filter("row_id < 5")
    closed = run_experiment(few, config([classifiers.KNN(neighbors=1), classifiers.NaiveBayes()], validator=LeaveOneOut()))
    looped = run_experiment(
        few,
        config(
            [classifiers.KNN(neighbors=1), classifiers.NaiveBayes()],
            validator=LeaveOneOut(),
            selectors=[selection.VarianceSelector(0.0)],
        ),
    )
    columns = ["step", "classifier", "row_id", "real", "predicted"]
    assert sorted(map(tuple, closed.predictions.select(columns).collect())) == sorted(
        map(tuple, looped.predictions.select(columns).collect())
    )
    with pytest.raises(ValueError, match="at most 4"):
        run_experiment(few, config([classifiers.DecisionTree()], validator=LeaveOneOut(4)))


def test_language_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("row_id"), F.col("lang").alias("label"), "text")
    coded = splits.stratified_k_fold(labels.encode(docs, labels.label_map(docs)), 5).persist()
    counts = text.hashed_features(coded, n_features=512, non_negative=True, norm=None, keep=("fold", "label_ix"))
    rows = coded.select("row_id", "fold", "label_ix")
    scored = rows.join(bayes.multinomial_cross_validated(rows, counts, 5, 512), "row_id")
    assert scored.agg(F.avg((F.col("label_ix") == F.col("predicted_ix")).cast("int"))).first()[0] >= 0.85


def test_text_experiment_and_saved_results(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "row_id")
    conf = Experiment(
        "lang", {"text": extractors.Tfidf(max_features=300), "n_chars": extractors.Pass()}, StratifiedKFold(2),
        [classifiers.DecisionTree(max_depth=8, max_bins=32)],
    )
    result = run_experiment(docs, conf)
    assert result.scores().first()["accuracy"] > 0.8
    results.save_results(result.tables(), conf, str(tmp_path / "saved"))
    back, saved = results.load_results(spark, str(tmp_path / "saved"), ["predictions", "timings", "step_stats", "label_map"])
    assert back["predictions"].count() == 200 and saved["label"] == "lang"


def test_quotas_inactive_classes_and_profile(spark, two_class):
    conf = config([], quotas={"0": 3, "1": 100}, inactive=())
    p = profile(two_class, conf)
    assert sorted(tuple(r) for r in p.class_stats.collect()) == [("0", 3, 16, True), ("1", 16, 16, True)]
    assert p.attribute_stats.count() == 4
    only = profile(two_class, config([], inactive=["1"]))
    assert sorted(tuple(r) for r in only.class_stats.collect()) == [("0", 16, 16, True), ("1", 0, 16, False)]
    with pytest.raises(ValueError, match="no rows"):
        profile(two_class, config([], inactive=["0", "1"]))


def test_same_seed_same_result(spark, two_class):
    coded = labels.encode(two_class, labels.label_map(two_class)).withColumn(
        "features", F.array(*[F.col(c).cast("double") for c in "ABCD"])
    )
    net = network.NeuralNetwork([network.Layer(4, "sigmoid"), network.Layer(3, "softmax")], 5, epochs=2, out_activation="sigmoid")
    a, b = net.fit(coded), net.fit(coded)
    assert a.history == b.history
    evo = evolve.EvolvedPrototypes(
        3, population=4, selection_method="RULETE", random_seed=9, max_crossovers=2, test_set_size=0.5, change_test_set=True
    )
    assert evo.fit(coded).score == evo.fit(coded).score


def test_network_gradient(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 3)), rng.integers(0, 3, 6)
    for out in network.ACTIVATIONS[1:]:
        net = network._Net([3, 4, 4, 3], ["sigmoid", "softmax", out])
        w = net.start(1)
        g = net.gradient(w, x, y)[0]
        for i in range(0, len(w), 7):
            step = np.zeros_like(w)
            step[i] = 1e-6
            slope = (net.gradient(w + step, x, y)[1] - net.gradient(w - step, x, y)[1]) / 2e-6 / len(y)
            assert abs(slope - g[i]) < 1e-6


def test_parameter_bounds():
    for bad in (
        lambda: classifiers.KNN(neighbors=0),
        lambda: classifiers.SVM(kernel="cosine"),
        lambda: classifiers.SVM(kernel="rbf", show_imp_features=3),
        lambda: evolve.EvolvedPrototypes(crossover_prob=1.5),
        lambda: network.Layer(0),
        lambda: extractors.Hashing(n_features=0),
        lambda: extractors.Tfidf(norm="l3"),
        lambda: selection.TreeSelector("max"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_prototype_table_round_trip(spark, two_class):
    import numpy as np

    population = [{0: prototypes.ClassFunction("nearest", np.array([1.0, -1.0]), np.eye(2)), 1: prototypes.ClassFunction("2+2", np.array([1.0]), np.ones((1, 2)))}]
    back = prototypes.population_of(prototypes.gene_table(spark, population))
    assert back[0][0].fun == "nearest" and back[0][1].vectors.tolist() == [[1.0, 1.0]]


def test_negative_values_stop_the_multinomial_model(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "row_id bigint, fold int, label_ix int")
    feats = rows.withColumn("feature_ix", F.lit(0)).withColumn("value", F.lit(-1.0))
    with pytest.raises(Exception, match="negative feature value"):
        bayes.multinomial_cross_validated(rows, feats, 2, 1).collect()


@pytest.mark.parametrize(("n_classes", "folds", "as_vectors"), [(2, None, True), (3, 4, False), (3, None, True)])
def test_linear_machines_reach_the_optimum(spark, n_classes, folds, as_vectors):
    """The gradient of the squared hinge loss vanishes; every machine leaves its own fold out."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((240, 6)) < 0.4, 0.0, rng.normal(size=(240, 6)))
    label = rng.integers(0, n_classes, 240)
    x[np.arange(240), label] += 2.0
    vec = (lambda r: Vectors.sparse(6, {j: float(v) for j, v in enumerate(r) if v})) if as_vectors else (lambda r: [float(v) for v in r])
    rows = [(i, int(label[i]), i % 4, vec(r) if i % 3 or not as_vectors else Vectors.dense(r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["row_id", "label_ix", "fold", "features"])
    model = LinearMachines.fit(df, n_classes, folds, tol=1e-6, max_passes=300)
    full = np.c_[x, np.ones(240)]
    for k in range(folds or 1):
        inside = np.arange(240) % 4 != k if folds else np.ones(240, bool)
        for c in range(1 if n_classes == 2 else n_classes):
            w = model.weights[k, c]
            y = np.where(label[inside] == (1 if n_classes == 2 else c), 1.0, -1.0)
            part = full[inside]
            short = np.maximum(0.0, 1.0 - y * (part @ w))
            assert np.linalg.norm(w - 2 * part.T @ (y * short)) < 1e-4 * np.linalg.norm(2 * part.T @ y)
    got = {r.row_id: r.predicted_ix for r in model.predict(df, own_fold=bool(folds)).collect()}
    margins = [full[i] @ model.weights[i % 4 if folds else 0].T for i in range(240)]
    assert got == {i: int(m[0] > 0) if len(m) == 1 else int(m.argmax()) for i, m in enumerate(margins)}
    assert np.mean([got[i] == label[i] for i in range(240)]) > 0.8


def test_all_folds_give_what_single_steps_give(spark, two_class):
    models = [classifiers.SVM(normalizer=None), classifiers.NaiveBayes(), classifiers.NaiveBayes(type_v="multinomial", name="MNB")]
    once = run_experiment(two_class, config(models))
    looped = run_experiment(two_class, config(models, selectors=[selection.VarianceSelector(0.0)]))
    table = lambda r: sorted((x.step, x.classifier, x.row_id, x.real, x.predicted) for x in r.predictions.collect())
    assert table(once) == table(looped)
    stats = lambda r: sorted(tuple(x) for x in r.step_stats.collect())
    assert stats(once) == stats(looped)
    assert once.timings.groupBy("step", "classifier").count().filter("count <> 12").count() == 0


def test_pyspark_ml_stages_in_every_slot(spark):
    """Extractor, selector, normalizer and classifier are all ``pyspark.ml`` stages."""
    rows = [(i, "ab"[i % 2], f"{'red blue' if i % 2 else 'green blue'} w{i % 3} w{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, label string, text string")
    model = classifiers.MLClassifier(LogisticRegression(maxIter=20), "Logistic", "LR", normalizer=classifiers.MLNormalizer(MaxAbsScaler()))
    chosen = selection.MLSelector(UnivariateFeatureSelector(selectionMode="numTopFeatures").setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(2))
    stages = extractors.MLStages([CountVectorizer(), IDF()], tokens=True)
    result = run_experiment(df, Experiment(label="label", attributes={"text": stages}, selectors=[chosen], classifiers=[model], validator=StratifiedKFold(4)))
    assert result.scores().first()["accuracy"] == 1.0
    assert {r.n_features for r in result.step_stats.collect()} == {2}
    fitted = stages.fit(df, "text")
    assert fitted.width == 8 and "text : blue" in fitted.names
    counted = extractors.MLStages([CountVectorizer()], tokens=True).fit(df, "text")
    assert counted.long(df).agg(F.sum("value")).first()[0] == 160


@pytest.mark.parametrize("options", [{}, {"minDF": 2.0}, {"maxDF": 0.5, "minTF": 0.2}, {"vocabSize": 8, "binary": True}])
def test_wide_counts_are_those_of_the_stage(spark, monkeypatch, options):
    """A vocabulary too wide for the driver gives the stage's counts, for repeated and null row ids and empty texts too."""
    rows = [(i if i % 7 else None, " ".join(f"W{j}" for j in range(i % 9) for _ in range(1 + j * i % 3))) for i in range(40)]
    df = spark.createDataFrame([*rows, rows[5], (99, None)], "row_id long, text string")
    stages = extractors.MLStages([CountVectorizer(**{"vocabSize": 1 << 30} | options)], tokens=True)
    chosen = selection.MLSelector(VarianceThresholdSelector(varianceThreshold=0.1))

    def found():
        fitted = stages.fit(df, "text")
        names, out = list(fitted.names), []
        for frame in (df, df.filter("row_id > 3")):
            vectors = fitted.vector(frame, "features")
            assert vectors.columns == ["row_id", "text", "features"]
            out.append(sorted(str((r.row_id, r.text, sorted((names[i], v) for i, v in zip(r.features.indices, r.features.values)))) for r in vectors.collect()))
        selector = chosen.fit(fitted.vector(df, "features"))
        return fitted, (sorted(names), fitted.width, out, sorted(selector.names(fitted.names)))

    plain, want = found()
    monkeypatch.setattr(extractors, "BROADCAST_TERMS", 3)
    monkeypatch.setattr(selection, "WIDE", 3)
    wide, got = found()
    assert got == want
    assert isinstance(plain.names, list) and not isinstance(wide.names, list)  # no list of all terms
    assert wide.names[1] == list(wide.names)[1] and list(wide.names[1:3]) == list(wide.names)[1:3]


def test_wide_counts_come_before_other_stages(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a b{i % 3} c{i % 5}") for i in range(30)], "row_id long, text string")
    stages = extractors.MLStages([CountVectorizer(), IDF()], tokens=True)
    table = lambda f: sorted((r.row_id, f.names[r.feature_ix], round(r.value, 9)) for r in f.long(df).collect())
    plain = stages.fit(df, "text")
    want = table(plain)
    monkeypatch.setattr(extractors, "BROADCAST_TERMS", 3)
    wide = stages.fit(df, "text")
    assert wide.width == plain.width == 9
    names = list(wide.names)
    assert sorted((r.row_id, names[r.feature_ix], round(r.value, 9)) for r in wide.long(df).collect()) == want


def test_steps_run_side_by_side_on_their_share_of_the_cores(spark, monkeypatch):
    import threading

    from checks import models
    from foldmeter import session

    df = spark.range(0, 90, 1, 12).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("fold"), F.lit(0).alias("label_ix")).persist()
    together = threading.Barrier(3)

    def predict(train, test):
        together.wait(60)  # breaks if one step waits for another
        n = train.rdd.getNumPartitions()
        return test.select("row_id", (F.lit(1000 * n) + F.col("fold")).alias("predicted_ix"))

    def got():
        return sorted((r.row_id, r.fold, r.predicted_ix) for r in models._per_fold(df, 3, predict).collect())

    cores = spark.sparkContext.defaultParallelism
    assert got() == [(i, i % 3, 1000 * -(-cores // 3) + i % 3) for i in range(90)]
    monkeypatch.setattr(session, "SHARED_ROWS", 10)  # 60 training rows
    assert got() == [(i, i % 3, 1000 * max(6, -(-cores // 3)) + i % 3) for i in range(90)]


def test_multinomial_leave_one_out_by_brute_force(spark):
    rng = np.random.default_rng(6)
    x, label = rng.integers(0, 4, (30, 5)), rng.integers(0, 3, 30)
    x[0], label[0] = 0, 1
    x[1], label[1], label[2:][label[2:] == 2] = 3, 2, 0  # class 2 has one row only
    df = spark.createDataFrame([(i, int(label[i]), Vectors.dense(r.astype(float))) for i, r in enumerate(x)], ["row_id", "label_ix", "features"])
    got = {r.row_id: r.predicted_ix for r in classifiers.NaiveBayes(type_v="multinomial").left_out(df).collect()}
    for i in range(30):
        rest = np.arange(30) != i
        scores = []
        for c in range(3):
            mine = rest & (label == c)
            s = x[mine].sum(0) + 1.0
            scores.append(np.log(mine.sum() / 29) + x[i] @ np.log(s / s.sum()) if mine.any() else -np.inf)
        assert got[i] == int(np.argmax(scores)), i


def test_stateless_attributes_are_extracted_once_for_trees_of_all_steps(spark, two_class, monkeypatch):
    from foldmeter.plans import experiment

    models = [classifiers.NaiveBayes(type_v="multinomial", name="MNB"), classifiers.DecisionTree(random_seed=1)]
    calls, extract = [], experiment._extract
    monkeypatch.setattr(experiment, "_extract", lambda *a: calls.append(1) or extract(*a))

    def found():
        result = run_experiment(two_class, config(models))
        timed = result.timings.groupBy("step", "classifier").agg(F.count("*").alias("n"), F.countDistinct("metric").alias("kinds")).collect()
        assert len(timed) == 4 and {(r.n, r.kinds) for r in timed} == {(12, 12)}
        table = sorted((r.step, r.classifier, r.row_id, r.real, r.predicted, r.top) for r in result.predictions.collect())
        return table, sorted(map(tuple, result.step_stats.collect()))

    got = found()
    assert len(calls) == 1 and len(got[0]) == 2 * 32
    monkeypatch.setattr(classifiers.DecisionTree, "side_by_side", False)
    assert got == found()


@pytest.mark.parametrize("copies", [1, 2])
def test_packed_sums_and_scores_are_those_of_long_entries(spark, monkeypatch, copies):
    """Sums and scores of naive Bayes used to need every entry outside its chunk, once for training and once for testing."""
    from foldmeter.operators import packed

    monkeypatch.setattr(packed, "CHUNK_ENTRIES", 7)
    rng = np.random.default_rng(11)
    rows = [(i, i % 4 if i < 36 else 1, int(rng.integers(0, 3)), " ".join(f"w{j}" for j in rng.integers(0, 9, i % 5)) + " " * (i % 2) + f" own{i}") for i in range(40)]
    rows += [(50, 0, 1, ""), (51, 2, 0, None)] + rows[:3] * (copies - 1)
    df = spark.createDataFrame(rows, "row_id long, fold int, label_ix int, text string").coalesce(2)
    found = extractors.Tfidf().fit_folds(df, "text", 4)
    assert (found.packed is None) == (copies == 2)  # rows of one row_id are normed together
    long = extractors.FoldFeatures(found.train, found.test, found.widths)
    keys = df.select("row_id", "fold", "label_ix")
    other = extractors.Pass().fit_folds(df.withColumn("text", F.col("row_id") % 3), "text", 4)
    for parts, plain in (([found], [long]), ([found, other], [long, other])):
        widths = [sum(p.widths[s] for p in parts) for s in range(4)]
        got, want = (sorted(map(tuple, classifiers.NaiveBayes(type_v="multinomial").all_folds(keys, p, 4, widths, 3).collect())) for p in (parts, plain))
        assert got == want and len(got) >= 42
    if copies == 1:
        add = lambda p: sorted(tuple(round(float(x), 9) for x in r) for r in p.sums(3).groupBy("label_ix", "feature").sum(*[f"{k}{s}" for k in "sw" for s in range(4)]).collect())
        assert add(found) == add(long)
        assert found.sums(3).count() < found.train().count()


def test_models_are_dropped_with_their_step_and_as_many_train_as_the_driver_holds(spark, monkeypatch):
    """All steps' trees used to be on the driver together, and again in the task of one union of their predictions."""
    import threading

    from checks import models

    df = spark.range(0, 90, 1, 12).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("fold"), F.lit(0).alias("label_ix")).persist()
    running, most, lock = [0], [0], threading.Lock()

    def predict(train, test):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        train.count()
        with lock:
            running[0] -= 1
        return test.select("row_id", (F.xxhash64("row_id") % 7).cast("int").alias("predicted_ix"))

    heap = spark._jvm.java.lang.Runtime.getRuntime().maxMemory()
    want = sorted((r.row_id, r.fold) for r in df.collect())
    for bytes_, at_once in ((heap, 1), (heap // 2 // 60 // 2, 2), (800, 3)):
        monkeypatch.setattr(models, "DRIVER_ROW_BYTES", bytes_)
        most[0] = 0
        assert models._at_once(df, 3) == at_once
        out = models._per_fold(df, 3, predict)
        assert sorted((r.row_id, r.fold) for r in out.collect()) == want and most[0] <= at_once
        assert "xxhash64" not in out._jdf.queryExecution().toString()
