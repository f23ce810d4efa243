"""The model zoo: names, settings and how each one is fitted on Spark."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass, field

from pyspark.ml.regression import RandomForestRegressor

# Penalties, neighbour counts, and (below) the names and settings of the zoo.
PENALTIES = (1e-4, 3e-4, 1e-3, 3e-3, 1e-2)
NEIGHBOURS = (10, 25, 50, 100)
MAX_BINS = 256
DEEPEST = 30
# Histogram boosting ends early where train rows are more than so many and a held-out tenth has not gained for so many rounds.
EARLY_STOP_ROWS, PATIENCE = 10_000, 10


@dataclass(frozen=True)
class ModelSpec:
    """``kind`` picks the fitting route; ``notes`` says where MLlib differs from the original model."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)
    notes: str = ""


@dataclass(frozen=True)
class TreeCounts:
    """Trees and boosting rounds of the ensembles; a model's name always states its own count."""

    forest: int = 400
    extra: int = 600
    boosting: int = 500
    histogram: tuple[int, int, int] = (400, 600, 800)
    xgboost: tuple[int, int] = (1200, 1800)


# Small ensembles for trials and checks: models of their own, with names of their own.
TRIAL_COUNTS = TreeCounts(forest=4, extra=6, boosting=5, histogram=(4, 6, 8), xgboost=(12, 18))


def model_zoo(seed: int = 7, counts: TreeCounts = TreeCounts()) -> dict[str, ModelSpec]:
    """All models by name."""
    h = counts.histogram
    specs = [
        ModelSpec("DummyMean", "mean"),
        ModelSpec("LinearRegression", "station_linear", {"alpha": 0.0}),
        ModelSpec("Ridge_a1", "station_linear", {"alpha": 1.0}),
    ]
    for a in PENALTIES:
        specs.append(ModelSpec(f"Lasso_a{a:g}", "penalized", {"alpha": a, "l1_ratio": 1.0}))
        specs.append(ModelSpec(f"ElasticNet_a{a:g}_l1r0.5", "penalized", {"alpha": a, "l1_ratio": 0.5}))
    specs.append(ModelSpec("HuberRobust", "huber", {"epsilon": 1.35, "alpha": 1e-4}))
    for k in NEIGHBOURS:
        for weights in ("dist", "uniform"):
            specs.append(ModelSpec(f"KNN_k{k}_{weights}", "neighbours", {"k": k, "weights": weights}))
    specs += [
        ModelSpec(f"RandomForest_{counts.forest}_leaf2", "extra_trees", dict(
            trees=counts.forest, min_leaf=2, seed=seed, best=True, bootstrap=True), "splits at 254 quantiles of each feature"),
        ModelSpec(f"ExtraTrees_{counts.extra}_leaf1", "extra_trees", dict(trees=counts.extra, min_leaf=1, seed=seed)),
        ModelSpec(f"GradientBoosting_{counts.boosting}_lr0.05_depth3_sub0.8", "boosting", dict(
            rounds=counts.boosting, rate=0.05, deepest=3, leaves=8, min_leaf=1, subsample=0.8, seed=seed),
            "splits at 254 quantiles of each feature"),
        ModelSpec(f"HGB_d6_lr0.05_it{h[0]}_leaf50_l2e-6", "boosting", dict(
            rounds=h[0], rate=0.05, deepest=6, leaves=31, min_leaf=50, l2=1e-6, patience=PATIENCE, seed=seed)),
        ModelSpec(f"HGB_leaf20_lr0.05_it{h[1]}_d6_l2e-3", "boosting", dict(
            rounds=h[1], rate=0.05, deepest=6, leaves=31, min_leaf=20, l2=1e-3, patience=PATIENCE, seed=seed)),
        ModelSpec(f"HGB_leaf20_lr0.05_it{h[2]}_nodes63_l2e-3", "boosting", dict(
            rounds=h[2], rate=0.05, leaves=63, min_leaf=20, l2=1e-3, patience=PATIENCE, seed=seed)),
    ]
    if importlib.util.find_spec("xgboost") is not None:
        common = dict(reg_lambda=1.0, objective="reg:squarederror", random_state=seed)
        specs += [
            ModelSpec(f"XGBoost_curr_{counts.xgboost[0]}_lr0.03_d8_sub0.9_col0.9", "xgboost", dict(
                n_estimators=counts.xgboost[0], learning_rate=0.03, max_depth=8, subsample=0.9,
                colsample_bytree=0.9, **common)),
            ModelSpec(f"XGBoost_safe_{counts.xgboost[1]}_lr0.02_d6_child10_sub0.8_col0.8", "xgboost", dict(
                n_estimators=counts.xgboost[1], learning_rate=0.02, max_depth=6, min_child_weight=10,
                subsample=0.8, colsample_bytree=0.8, **common)),
        ]
    return {s.name: s for s in specs}


def extra_trees_like(trees: int, min_leaf: int, seed: int) -> dict:
    """MLlib's closest forest to extremely randomized trees: every tree sees all rows, randomness comes from
    the feature subset at each node. With all features and no bootstrap the trees would be equal. The
    zoo has the trees themselves (``operators.extra_trees``); this stands beside them for comparison."""
    return dict(numTrees=trees, minInstancesPerNode=min_leaf, bootstrap=False, subsamplingRate=1.0,
                featureSubsetStrategy="onethird", maxDepth=DEEPEST, seed=seed)


def pick_model(zoo: dict[str, ModelSpec], name: str) -> ModelSpec:
    if name not in zoo:
        raise ValueError(f"Unknown model '{name}'. Available: {sorted(zoo)}")
    return zoo[name]


def vector_estimator(spec: ModelSpec, target: str, out: str):
    """MLlib estimator over ``features``."""
    io = dict(featuresCol="features", labelCol=target, predictionCol=out)
    if spec.kind == "forest":
        return RandomForestRegressor(maxBins=MAX_BINS, **spec.params, **io)
    if spec.kind == "xgboost":
        from xgboost.spark import SparkXGBRegressor

        return SparkXGBRegressor(features_col="features", label_col=target, prediction_col=out, **spec.params)
    raise ValueError(f"no MLlib estimator for kind '{spec.kind}'")
