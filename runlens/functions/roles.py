"""Stage roles of pipeline nodes, as a Column and as SQL text from one table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The role of each declared kind, and the signs in an operator's class name, first hit first.
KINDS = {
    "input": "input", "model": "model", "merge": "merge", "mean": "merge", "average": "merge", "weighted_mean": "merge", "vote": "merge", "voting": "merge",
    "stacking": "merge", "bagging": "merge", "aggregator": "merge", "augmentation": "augmentation", "split": "split", "feature_selection": "feature_selection",
}
SIGNS = [
    ("augmentation", (
        "augment", "augmentation", "mixup", "jitter", "warp", "randomshift", "rotation", "addnoise", "gaussiannoise",
        "synthetic", "oversampl", "smote",
    )),
    ("scaler", (
        "standardscaler", "minmaxscaler", "robustscaler", "maxabsscaler", "normalizer", "standardize", "minmax", "scaler",
    )),
    ("feature_selection", (
        "selectkbest", "selectfrommodel", "rfe", "boruta", "vip", "cars", "_spa", "geneticselect", "featureselect",
        "variancethreshold", "pca", "kernelpca", "feature_select",
    )),
    ("merge", (
        "stacking", "stackingregressor", "stackingclassifier", "voting", "votingregressor", "bagging", "baggingregressor",
        "averaging", "weightedmean", "meanensemble", "concat", "blend",
    )),
    ("model", (
        "plsregression", "plsr", "_pls", "pls(", "opls", "ikpls", "mbpls", "simpls", "ridge", "lasso", "elasticnet",
        "linearregression", "logistic", "svr", "svc", "svm", "randomforest", "extratrees", "gradientboost", "histgradientboost",
        "xgb", "lgbm", "lightgbm", "catboost", "mlpregressor", "mlpclassifier", "cnn", "lstm", "gru", "transformerencoder",
        "tabpfn", "gaussianprocess", "gpr", "kneighbors", "knn", "decisiontree", "adaboost", "regressor", "classifier",
    )),
    ("sampler", (
        "kennard", "spxy", "sampling", "duplex", "sampler",
    )),
    ("split", (
        "kfold", "shufflesplit", "groupkfold", "stratified", "leaveoneout", "traintest", "split",
    )),
    ("preprocessing", (
        "snv", "msc", "emsc", "savgol", "savitzky", "detrend", "derivative", "deriv", "baseline", "gapsegment", "smooth",
        "normalize", "osc", "scatter", "resample", "crop", "trim", "haar", "wavelet", "continuum", "firstderiv", "secondderiv",
        "logtransform", "preprocess", "transform", "filter",
    )),
]


def leaf(operator: Column) -> Column:
    """The class name: what is behind the last dot."""
    return F.substring_index(operator, ".", -1)


def label_or_hash(label: Column, key: Column) -> Column:
    """label, or the first ten signs of the key where it is null or empty."""
    return F.coalesce(F.nullif(label, F.lit("")), F.substring(key, 1, 10))


def classify(operator: Column, kind: Column) -> Column:
    """The declared kind decides if it is known, then the whole path's "augment",
    then the first sign in the class name, then the kind itself."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    full = F.lower(F.coalesce(operator, F.lit("")))
    name = leaf(full)
    plain = k.isin("", "transform")
    out = F.when(k.isin(*KINDS), F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.when(k.isin(*KINDS), k).otherwise("input")))
    out = out.when((name == "") & plain, "preprocessing").when(name == "", k).when(F.contains(full, F.lit("augment")), "augmentation")
    for role, signs in SIGNS:
        hit = F.lit(False)
        for s in signs:
            hit |= F.contains(name, F.lit(s))
        out = out.when(hit, role)
    return out.when(plain, "preprocessing").otherwise(k)


def classify_sql(operator: str, kind: str) -> str:
    """The same as ANSI SQL with contains()."""
    k, full = f"lower(trim(coalesce({kind}, '')))", f"lower(coalesce({operator}, ''))"
    name = f"split_part({full}, '.', -1)"
    whens = [f"WHEN {k} = '{a}' THEN '{b}'" for a, b in KINDS.items()]
    whens += [f"WHEN {name} = '' AND {k} IN ('', 'transform') THEN 'preprocessing'", f"WHEN {name} = '' THEN {k}", f"WHEN contains({full}, 'augment') THEN 'augmentation'"]
    whens += ["WHEN " + " OR ".join(f"contains({name}, '{s}')" for s in signs) + f" THEN '{role}'" for role, signs in SIGNS]
    return f"CASE {' '.join(whens)} WHEN {k} IN ('', 'transform') THEN 'preprocessing' ELSE {k} END"
