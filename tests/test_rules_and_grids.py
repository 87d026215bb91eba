import pytest

from flowspark.operators import grid, rules, select

FEATURE_SETS, MODELS = ["Full Features", "GA Features", "RFE Features"], [f"m{i}" for i in range(7)]


@pytest.fixture(scope="module")
def vocabulary():
    return rules.Vocabulary(
        {"feature_set": {"Full Features": ["full"], "PCA Components": ["pca"]},
         "classifier": {"Random Forest": ["random_forest", "rf"], "StackingClassifier": ["stacking"]},
         "hyperparameters": {"Default Hyperparameters": ["default"], "Optimized Hyperparameters": ["optimized"]}},
        {"model": "classifier", "augmentation": "augmentation_ratio"}, ["augmentation_ratio"])


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame([
        (1, "Full Features", "Default Hyperparameters", 0, "Random Forest"), (2, "Full Features", "Optimized Hyperparameters", 50, "Random Forest"),
        (3, "PCA Components", "Optimized Hyperparameters", 50, "StackingClassifier"), (4, "PCA Components", "Default Hyperparameters", 0, "StackingClassifier")],
        "id int, feature_set string, hyperparameters string, augmentation_ratio int, classifier string")


def ids(df):
    return [r["id"] for r in df.orderBy("id").collect()]


def test_allow_is_a_union_then_deny(plan, vocabulary):
    allow = [vocabulary.rule("full&random_forest&default&0"), vocabulary.rule("pca&stacking&optimized&50")]
    assert ids(rules.apply_rules(plan, allow)) == [1, 3]
    assert ids(rules.apply_rules(plan, allow, [vocabulary.rule("model=rf")])) == [3]
    assert ids(rules.apply_rules(plan)) == [1, 2, 3, 4]
    assert ids(rules.apply_rules(plan, (), [vocabulary.rule("pca || augmentation=50")])) == [1]


@pytest.mark.parametrize("text", ["a", "full & pca", "(full)", "!full", "full && rf", "full | rf", "full ||", "& full", "101", "planet=x", "model=full", "augmentation=x"])
def test_bad_rules(vocabulary, text):
    with pytest.raises(ValueError):
        vocabulary.rule(text)


def test_ambiguous_term():
    v = rules.Vocabulary({"a": {"x": []}, "b": {"x": []}})
    with pytest.raises(ValueError, match="ambiguous"):
        v.rule("x")
    assert v.rule("b=x").clauses == ((("b", "x"),),)


def test_rule_table_agrees_with_predicate(plan, vocabulary):
    made = [vocabulary.rule("full & 50 || stacking & default"), vocabulary.rule("optimized")]
    hits = rules.match_rule_table(plan, "id", list(plan.columns[1:]), rules.rule_table(made, plan))
    want = {(i, n + 1) for n, r in enumerate(made) for i in ids(plan.filter(r.column))}
    assert {(r["id"], r["rule"]) for r in hits.collect()} == want
    assert [r["matches"] for r in rules.rule_matches(plan, made).orderBy("rule").collect()] == [2, 2]


@pytest.mark.parametrize("sets,models,modes,ratios,size", [
    (3, 7, 2, 5, 240), (4, 7, 2, 5, 320), (4, 6, 2, 5, 280), (4, 7, 2, 4, 256), (3, 7, 2, 5, 240)])
def test_plan_sizes(spark, sets, models, modes, ratios, size):
    kinds = [None, 0.25, 0.5, 0.75, 1.0][:ratios]
    plan = grid.evaluation_plan(spark, (FEATURE_SETS + ["PCA Components"])[:sets], [False, True][:modes], kinds, MODELS[:models], stacking=True)
    rows = plan.orderBy("id").collect()
    assert len(rows) == size and [r["id"] for r in rows] == list(range(1, size + 1))
    assert len({tuple(r)[1:] for r in rows}) == size
    first = sets * modes * (models + 1)
    assert all(r["augmentation_ratio"] is None for r in rows[:first]) and rows[first]["augmentation_ratio"] == 0.25


def test_stacking_only_keeps_ids(spark):
    plan = grid.evaluation_plan(spark, ["f"], [True], [None], ["a", "b"], stacking=True, stacking_only=True)
    assert [(r["id"], r["classifier"]) for r in plan.collect()] == [(3, "StackingClassifier")]


def test_parameter_grid(spark):
    counts = {r["model"]: r["count"] for r in grid.parameter_grid(spark).groupBy("model").count().collect()}
    assert counts["Random Forest"] == 3 * 4 * 3 * 3 * 3
    assert counts["SVM"] == 6 * (2 * 6 + 1)
    assert counts["Nearest Centroid"] == 10
    # lbfgs: l2 and none; saga: l1, l2, none, each at ratio 0; elasticnet with saga at all three ratios
    assert counts["Logistic Regression"] == 6 * (2 + 3 + 3)


def test_params_key_is_sorted(spark):
    row = grid.parameter_grid(spark, {"KNN": {"p": [1], "metric": ["euclidean"]}}).first()
    assert row["params_json"] == '{"metric": "euclidean", "p": 1}'


def test_skip_cached_treats_nulls_as_equal(spark):
    todo = spark.createDataFrame([("a", None), ("a", 1), ("b", None)], "d string, v int")
    left = grid.skip_cached(todo, todo.limit(1), ["d", "v"])
    assert sorted(left.collect(), key=str) == sorted(todo.collect()[1:], key=str)


def test_scaffold_fills_gaps(spark):
    facts = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), (None, 1, 5)], "k string, v int, n int")
    full = grid.scaffold(facts, ["k", "v"])
    assert full.count() == 6 and full.filter("n is not null").count() == 3
    assert grid.scaffold(facts.limit(0), ["k", "v"]).count() == 0


def test_best_configuration_ties(spark):
    rows = spark.createDataFrame([("m", 0.9, 5.0, "x"), ("m", 0.9, 3.0, "z"), ("m", 0.9, 3.0, "y"), ("m", 0.1, 0.1, "w")], "model string, f1 double, s double, p string")
    assert grid.best_configuration(rows, ["model"], "f1", "s", "p").first()["p"] == "y"


def test_complete_files(spark):
    done = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f1", "b"), ("f2", "a"), ("f2", "zzz")], "file string, model string")
    assert [r["file"] for r in grid.complete_files(done, "file", "model", ["a", "b"]).collect()] == ["f1"]
    files = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "file string")
    assert sorted(r["file"] for r in grid.pending_files(files, done, "file", "model", ["a", "b"]).collect()) == ["f2", "f3"]


def test_pareto_front_brute_force(spark):
    pts = [(i, (i * 7 % 11) / 10, i * 3 % 6) for i in range(40)] + [(99, 1.0, 0), (98, 1.0, 0)]
    df = spark.createDataFrame(pts, "id int, f double, n int")
    better = lambda a, b: a[1] >= b[1] and a[2] <= b[2] and (a[1] > b[1] or a[2] < b[2])
    want = {p[0] for p in pts if not any(better(q, p) for q in pts)}
    assert {r["id"] for r in select.pareto_front(df, "f", "n").collect()} == want
    assert select.pareto_front(df.limit(0), "f", "n").count() == 0


def test_hypervolume_modes(spark):
    df = spark.createDataFrame([(0.5, 10), (0.9, 30), (0.4, 50)], "f double, n int")
    assert select.hypervolume(df, "f", "n").first()[0] == pytest.approx(0.9 * 70)
    assert select.hypervolume(df, "f", "n", mode="staircase").first()[0] == pytest.approx(0.5 * 90 + 0.4 * 70)


def test_convergence_of_flat_and_negative_runs(spark):
    rows = [("neg", i, -1.0) for i in range(4)] + [("flat", i, 0.5) for i in range(3)] + [("late", i, v) for i, v in enumerate([0.1, 0.96, 1.0])]
    df = spark.createDataFrame(rows, "run string, gen int, f1 double")
    got = {r["run"]: r["convergence_generation"] for r in select.convergence_generation(df, "run", "gen", "f1").collect()}
    assert got == {"neg": 4, "flat": 1, "late": 2}


def test_streak(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([0.5, 0.5, 0.6, 0.1, 0.6, 0.7])], "run string, gen int, f1 double")
    rows = select.improvement_streak(df, "run", "gen", "f1", 2).orderBy("gen").collect()
    assert [r["streak"] for r in rows] == [0, 1, 0, 1, 2, 0] and [r["stop"] for r in rows][4]


def test_diversity_pairs(spark):
    masks = [[0, 1, 1], [1, 1, 0], [0, 0, 0], [1]]
    df = spark.createDataFrame([(m,) for m in masks], "mask array<int>")
    pairs = [sum(x != y for x, y in zip(a, b)) for i, a in enumerate(masks[:3]) for b in masks[i + 1:3]]
    assert select.population_diversity(df, "mask").first()[0] == pytest.approx(sum(pairs) / 3)
    assert select.population_diversity(df.limit(1), "mask").first()[0] == 0.0


def test_importance_ties_by_position(spark):
    df = spark.createDataFrame([("b", 1, 0.5), ("a", 0, 0.5), ("c", 2, 0.9)], "feature string, position int, importance double")
    rows = select.importance_rank(df, "importance", "position", 2).orderBy("rank").collect()
    assert [r["feature"] for r in rows] == ["c", "a", "b"] and [r["selected"] for r in rows] == [True, True, False]


def test_usage_counts_unused(spark):
    runs = spark.createDataFrame([(["a", "b", "a"],), (["a"],)], "features array<string>")
    usage = select.feature_usage(runs, "features", ["a", "b", "z"])
    assert {r["feature"]: r["n"] for r in usage.collect()} == {"a": 2, "b": 1, "z": 0}
