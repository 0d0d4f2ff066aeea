"""Model matrix, preprocessing learned on training rows, elastic-net fits, candidate selection and locked scoring."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if
from .features import COMPOSITION_NAMES, DEPTH_NAMES, DIVERSITY_NAMES, LENGTH_NAMES, LENGTH_STATS, PHYSICO_NAMES, TOP_NAMES
from .public import COHORTS, descriptive_prefixes, model_prefixes, reference_feature_names

# -- feature manifest --------------------------------------------------------------------------------------------------

SCALE, ONE_HOT, NOTHING = "standardize within each training fold", "one-hot encode in model pipeline", "none"


@dataclass(frozen=True)
class Family:
    """Features that are defined together: what they are, how a model may use them and how they are prepared."""

    group: str
    role: str
    default: str
    preparation: str
    names: tuple[str, ...] = ()
    pattern: str = ""

    def holds(self, name: Column) -> Column:
        return name.isin(list(self.names)) if self.names else name.rlike(self.pattern)


def _any_prefix(prefixes: Iterable[str]) -> str:
    return "^(" + "|".join(prefixes) + ")_"


def families(cohorts: tuple[str, str] = COHORTS) -> list[Family]:
    """Every family of features, the more special first.

    Fixed values: the labels of groups, roles, defaults and preparations, and the names of columns.
    """
    candidate = ("candidate_predictor", "yes", SCALE)
    weighted = [x for x in COMPOSITION_NAMES if x.startswith("weighted_")]
    drop = ("composition_reference_drop", "no", "drop before model fitting")
    model_names = [*model_prefixes(cohorts).values(), f"{cohorts[1]}_{cohorts[0]}_specific_ref"]
    return [
        Family("identifier", "join_key", "no", NOTHING, ("sample_id",)),
        Family("outcome", "outcome_label", "no", "binary encode in model pipeline", ("cohort",)),
        Family("identifier_trace", "trace_only", "no", "exclude from predictors", ("patient",)),
        Family("clinical", "primary_predictor", "yes", SCALE, ("age",)),
        Family("clinical", "primary_predictor", "yes", ONE_HOT, ("sex",)),
        Family("clinical_optional", "optional_predictor", "optional", ONE_HOT, ("material",)),
        Family("technical_qc", "qc_only", "no", "exclude from primary model", ("batch",)),
        Family("tcr_qc_depth", "qc_or_sensitivity_predictor", "sensitivity", SCALE, tuple(DEPTH_NAMES)),
        Family("tcr_diversity", *candidate, tuple(DIVERSITY_NAMES)),
        Family("tcr_clonal_expansion", *candidate, tuple(TOP_NAMES.values())),
        Family("tcr_3mer_unweighted", *candidate, pattern="^unweighted_3mer_"),
        Family("tcr_3mer_weighted", *candidate, pattern="^weighted_3mer_"),
        Family("public_descriptive", "descriptive_only", "no", NOTHING, pattern=_any_prefix(p for p in descriptive_prefixes(cohorts).values() if p.endswith("_aa"))),
        Family("public_reference_dynamic", "dynamic_predictor_train_fixed_predictor_test", "dynamic", SCALE, pattern=_any_prefix(model_names)),
        Family("tcr_aa_length", *drop, ("weighted_length_other_freq",)),
        Family("tcr_aa_length", *candidate, names=(*LENGTH_STATS, *LENGTH_NAMES)),
        Family("tcr_aa_composition_weighted", *drop, ("weighted_Y_frequency",)),
        Family("tcr_aa_composition_unweighted", *drop, ("Y_frequency",)),
        Family("tcr_aa_composition_weighted", *candidate, tuple(weighted)),
        Family("tcr_aa_composition_unweighted", *candidate, tuple(x for x in COMPOSITION_NAMES if x not in weighted)),
        Family("tcr_physicochemical", *drop, ("nonpolar_aa_ratio", "weighted_nonpolar_aa_ratio")),
        Family("tcr_physicochemical", *candidate, names=tuple(PHYSICO_NAMES)),
        Family("tcr_other_static", *candidate, pattern="."),
    ]


#: Roles that never enter a model; their preparation doesn't depend on the type.
EXCLUDED_ROLES = ["join_key", "outcome_label", "trace_only", "qc_only", "descriptive_only", "composition_reference_drop"]


def classify_features(names: DataFrame, cohorts: tuple[str, str] = COHORTS, receptor_prefixes: Sequence[str] = ()) -> DataFrame:
    """Add group, role, model default and transformation to a (feature_name, data_type) table: those of the family that defines
    the feature.  A receptor's prefix doesn't count; columns that are no number are not scaled."""
    plain = F.col("feature_name")
    if receptor_prefixes:
        plain = F.regexp_replace(plain, "^(" + "|".join(receptor_prefixes) + ")", "")
    found = F.coalesce(*[
        F.when(f.holds(F.col("_plain")), F.struct(*[F.lit(getattr(f, x)).alias(x) for x in ("group", "role", "default", "preparation")])) for f in families(cohorts)
    ])
    number = F.col("data_type").isin("numeric", "integer")
    prepared = F.when((F.col("_f.preparation") == SCALE) & ~number, NOTHING).otherwise(F.col("_f.preparation"))
    out = names.withColumn("_plain", plain).withColumn("_f", found)
    return out.withColumns({
        "feature_group": F.col("_f.group"), "feature_role": F.col("_f.role"), "model_default": F.col("_f.default"), "transformation": prepared
    }).drop("_plain", "_f")


def simple_type(dtype: str) -> str:
    if dtype in ("bigint", "int", "smallint", "tinyint"):
        return "integer"
    return "numeric" if dtype in ("double", "float") or dtype.startswith("decimal") else "categorical"


#: What the manifest says of features that a training table may hold only for description.
DYNAMIC_NOTE = "Counts its own sample in training; make it anew from the training part of every fold."


def manifest(tables: dict[str, DataFrame], sources: dict[str, str] | None = None, metadata: Iterable[str] = ()) -> DataFrame:
    """One row per column over all matrices, in order of first appearance, with source, presence flags and preparation.

    `source_file` is 'metadata' for the columns of the first table that `metadata` names, else what `sources` says of the first
    table that holds the column (its name by default).  Only column names and types are read, no data.
    """
    spark = next(iter(tables.values())).sparkSession
    first, known = next(iter(tables)), set(metadata)
    seen: dict[str, tuple[str, str]] = {}
    for n, t in tables.items():
        for c, d in t.dtypes:
            origin = "metadata" if n == first and c in known else (sources or {}).get(n, n)
            seen.setdefault(c, (simple_type(d), origin))
    rows = [(c, i, d, o, *[c in t.columns for t in tables.values()]) for i, (c, (d, o)) in enumerate(seen.items(), 1)]
    flags = ", ".join(f"present_in_{n} boolean" for n in tables)
    base = classify_features(spark.createDataFrame(rows, f"feature_name string, feature_order int, data_type string, source_file string, {flags}"))
    eligible = F.col(f"present_in_{first}") & ~F.col("feature_role").isin(EXCLUDED_ROLES)
    dynamic = F.col("feature_group") == "public_reference_dynamic"
    return base.withColumns({
        "eligible_for_fixed_train_cv_input": eligible, "dynamic_in_training": dynamic, "reference_drop": F.col("feature_role") == "composition_reference_drop",
        "notes": F.when(dynamic, DYNAMIC_NOTE).otherwise(""),
    })


def static_predictors(manifest_: DataFrame, base: str = "train_base", prefix: str = "tcr_") -> DataFrame:
    """Ordered predictor list read from the manifest."""
    ok = F.col(f"present_in_{base}") & F.col("feature_group").startswith(prefix) & (F.col("feature_role") == "candidate_predictor")
    return manifest_.filter(ok).select("feature_name", "feature_order")


def ordered_predictors(manifest_: DataFrame, known: DataFrame, base: str = "train_base", prefix: str = "tcr_") -> DataFrame:
    """The predictors a task uses, by position: static predictors that have a value in the training rows.

    `known` holds (feature_name, n), n being the rows with a value.  The window has a row per feature.
    """
    used = static_predictors(manifest_, base, prefix).join(known.filter("n > 0"), "feature_name")
    return used.withColumn("position", F.row_number().over(Window.orderBy("feature_order"))).drop("feature_order")


def same_schema(train: DataFrame, test: DataFrame) -> bool:
    return train.columns == test.columns


# -- preprocessing -----------------------------------------------------------------------------------------------------

def fold_statistics(long: DataFrame, fold: str, k: int) -> DataFrame:
    """Mean and population sd of the training part of every fold, per feature.

    Each fold is summarised once as (n, mean, variance); the training part merges the other folds, which is stable for large
    values and never reads the rows again.  A feature gathers k entries.
    """
    per_fold = long.groupBy("feature", fold).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    gathered = per_fold.groupBy("feature").agg(F.collect_list(F.struct(F.col(fold).cast("int").alias("f"), "n", "m", "v")).alias("_p"))
    tasks = gathered.select("feature", "_p", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("task_fold"))
    others = tasks.select("feature", "task_fold", F.filter("_p", lambda x: x["f"] != F.col("task_fold")).alias("_o"))

    def added(fn) -> Column:
        return F.aggregate("_o", F.lit(0.0), lambda acc, x: acc + fn(x))

    sized = others.select("*", added(lambda x: x["n"]).alias("n"), added(lambda x: x["n"] * x["m"]).alias("_s")).withColumn("mean", F.col("_s") / F.col("n"))
    spread = added(lambda x: x["n"] * (x["v"] + (x["m"] - F.col("mean")) * (x["m"] - F.col("mean"))))
    return sized.select("feature", "task_fold", F.col("n").cast("bigint").alias("n"), "mean", F.sqrt(spread / F.col("n")).alias("sd"))


def usable(stats: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Predictors whose training sd is finite and above the tolerance."""
    return stats.filter((F.col("sd") > tol) & (F.col("sd") < F.lit(float("inf"))))


def zero_variance(df: DataFrame, columns: list[str], tol: float = 1e-12) -> DataFrame:
    aggs = [F.stddev_pop(c).alias(c) for c in columns]
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("sd")) for c in columns]
    out = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return out.withColumn("keep", F.coalesce((F.col("sd") > tol) & (F.col("sd") < F.lit(float("inf"))), F.lit(False)))


def standardize(long: DataFrame, stats: DataFrame, fold: str) -> DataFrame:
    """Validation values of every fold scaled with the statistics of its training part."""
    s = usable(stats).select("feature", F.col("task_fold").alias(fold), "mean", "sd")
    return long.join(s, ["feature", fold]).select(*[c for c in long.columns if c != "value"], ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value"))


def levels(training: DataFrame, column: str) -> list[str]:
    """Sorted training categories (a metadata column; used as column names)."""
    return [r[0] for r in training.select(F.col(column).cast("string")).distinct().orderBy(column).collect()]


def dummy_code(df: DataFrame, column: str, cats: list[str], keep: list[str], locked: bool = False) -> DataFrame:
    """Columns `col__cat_vs_ref`, the first category being the reference.  An unseen category gives zeros, or stops a
    locked scoring job."""
    c = F.col(column).cast("string")
    if locked:
        c = F.when(c.isin(cats), c).otherwise(F.raise_error(F.concat(F.lit(f"unseen {column}: "), F.coalesce(c, F.lit("null")))))
    return df.select(*keep, *[(c == x).cast("double").alias(f"{column}__{x}_vs_{cats[0]}") for x in cats[1:]])


def model_specifications(static: list[str], public: list[str]) -> dict[str, list[str]]:
    """The four nested models."""
    clinical = ["age", "sex"]
    return {
        "M0_clinical": clinical, "M1_static_tcr": clinical + static, "M2_static_tcr_public": clinical + static + public,
        "M3_static_tcr_public_material": clinical + ["material"] + static + public,
    }


def public_feature_sets(cohorts: tuple[str, str] = COHORTS) -> dict[str, list[str]]:
    a, b = cohorts
    pair = ["clone_ratio", "frequency_sum"]
    shared = [f"{p}_{m}" for p in ("all_ref_public", "shared_ref") for m in pair]
    return {
        "raw_bilateral": shared + [f"{c}_specific_ref_{m}" for c in (a, b) for m in pair],
        "log_ratio": shared + [f"{b}_{a}_specific_ref_frequency_log_ratio"],
        "all18": reference_feature_names(cohorts),
    }


def expand_models(long: DataFrame, specs: dict[str, list[str]]) -> DataFrame:
    """Long features tagged with every model that uses them (the specification is a literal, not a join)."""
    used = F.array_compact(F.array(*[F.when(F.col("feature").isin(f), F.lit(m)) for m, f in specs.items()]))
    return long.select(F.explode(used).alias("model"), *long.columns)


# -- elastic net -------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Candidate:
    alpha: float
    lam: float


DEFAULT_ALPHAS = [0.1, 0.5, 0.9]
DEFAULT_LAMBDAS = [0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0]


@dataclass
class Fitted:
    candidate: Candidate
    features: list[str]
    coefficients: list[float]
    intercept: float
    converged: bool
    model: object


def balanced_weights(rows: DataFrame, label: str = "y") -> DataFrame:
    """Rows with `weight` = n / (2 * n of the row's class)."""
    counts = rows.agg(F.count(F.lit(1)).alias("_n"), count_if(F.col(label) == 1).alias("_p"))
    n, p = (counts.select(c).scalar() for c in ("_n", "_p"))
    return rows.withColumn("weight", n / (2.0 * F.when(F.col(label) == 1, p).otherwise(n - p)))


def fit_elastic_net(rows: DataFrame, features: list[str], candidate: Candidate, label: str = "y", max_iter: int = 10000, tol: float = 1e-6) -> Fitted:
    """Class-balanced elastic-net logistic regression on scaled columns.

    The penalised objective is (penalty + C * summed weighted loss) with C = 1 / lambda.  Spark minimises the mean weighted
    loss plus regParam * penalty and balanced weights sum to n, hence regParam = lambda / n.
    """
    weighted = balanced_weights(rows, label)
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(weighted).select("features", F.col(label).cast("double").alias("label"), "weight")
    n = assembled.count()
    lr = LogisticRegression(
        elasticNetParam=candidate.alpha, regParam=candidate.lam / n, standardization=False, weightCol="weight", maxIter=max_iter, tol=tol, family="binomial")
    m = lr.fit(assembled)
    return Fitted(candidate, features, [float(c) for c in m.coefficients], float(m.intercept), m.summary.totalIterations < max_iter, m)


def score(fitted: Fitted, rows: DataFrame, keep: list[str]) -> DataFrame:
    assembled = VectorAssembler(inputCols=fitted.features, outputCol="features").transform(rows)
    out = fitted.model.transform(assembled)
    return out.select(*keep, vector_to_array("probability")[1].alias("p"))


def scaled_task(rows: DataFrame, task_fold: int, fold: str, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, list[str]]:
    """Design of one task: statistics and categories of the training rows, applied to all rows.

    Only per-column statistics and category names reach the driver.
    """
    training = rows.filter(F.col(fold) != task_fold)
    stats = training.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in numeric]).first()
    used = [c for c in numeric if stats[c].s is not None and 1e-12 < stats[c].s < float("inf")]
    scaled = [((F.col(c) - F.lit(stats[c].m)) / F.lit(stats[c].s)).alias(f"z_{c}") for c in used]
    dummies = []
    for c in categorical:
        cats = levels(training, c)
        dummies += [(F.col(c).cast("string") == x).cast("double").alias(f"{c}__{x}_vs_{cats[0]}") for x in cats[1:]]
    design = rows.select(*rows.columns, *scaled, *dummies)
    return design, [f"z_{c}" for c in used] + [c for c in design.columns if "_vs_" in c]


def tune(
    rows: DataFrame, fold: str, k: int, candidates: list[Candidate], numeric: list[str], categorical: list[str], parallel: int = 4, sample: str = "sample_id"
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and fit log of every candidate: fits run concurrently, each one distributed by Spark ML."""
    spark = rows.sparkSession
    designs = {f: scaled_task(rows, f, fold, numeric, categorical) for f in range(1, k + 1)}

    def one(job: tuple[int, Candidate]) -> tuple[DataFrame, tuple]:
        f, c = job
        design, features = designs[f]
        fitted = fit_elastic_net(design.filter(F.col(fold) != f), features, c)
        held = score(fitted, design.filter(F.col(fold) == f), [sample, "y", F.col(fold)])
        tagged = held.select(F.lit(c.alpha).alias("l1_ratio_alpha"), F.lit(c.lam).alias("lambda"), sample, "y", F.col(fold).cast("int").alias(fold), "p")
        return tagged, (c.alpha, c.lam, f, fitted.converged, sum(abs(x) > 1e-12 for x in fitted.coefficients))

    jobs = [(f, c) for c in candidates for f in range(1, k + 1)]
    with ThreadPoolExecutor(parallel) as pool:
        results = list(pool.map(one, jobs))
    preds = results[0][0]
    for p, _ in results[1:]:
        preds = preds.unionByName(p)
    log = spark.createDataFrame([r for _, r in results], f"l1_ratio_alpha double, lambda double, {fold} int, converged boolean, n_nonzero_coefficients int")
    return preds, log


def coefficient_rows(fitted: Fitted, spark) -> DataFrame:
    rows = [("__INTERCEPT__", fitted.intercept)] + list(zip(fitted.features, fitted.coefficients))
    return spark.createDataFrame([(n, float(c), abs(float(c)), abs(c) > 1e-12) for n, c in rows], "feature_name string, coefficient double, absolute_coefficient double, nonzero boolean")


# -- candidate choice --------------------------------------------------------------------------------------------------

def best_parameters(results: DataFrame, keys: list[str], digits: int = 12) -> DataFrame:
    """Per key the candidate of highest ROC AUC, then PR AUC, lambda, alpha."""
    order = F.struct(F.round("roc_auc", digits), F.round("pr_auc", digits), F.col("lambda"), F.col("l1_ratio_alpha"))
    return results.groupBy(*keys).agg(
        F.max_by("l1_ratio_alpha", order).alias("l1_ratio_alpha"), F.max_by("lambda", order).alias("lambda"),
        F.max_by("roc_auc", order).alias("roc_auc"), F.max_by("pr_auc", order).alias("pr_auc"))


def candidate_summary(repeat_metrics: DataFrame, fold_fits: DataFrame, pooled: DataFrame) -> DataFrame:
    """Per candidate: repeat metrics, sample-mean metrics (`pooled`: ROC and PR AUC of the mean prediction) and fit statistics."""
    key = ["l1_ratio_alpha", "lambda"]
    r = repeat_metrics.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_repeats"), F.avg("roc_auc").alias("mean_repeat_roc_auc"), F.coalesce(F.stddev_samp("roc_auc"), F.lit(0.0)).alias("sd_repeat_roc_auc"),
        F.percentile("roc_auc", 0.5).alias("median_repeat_roc_auc"), F.avg("pr_auc").alias("mean_repeat_pr_auc"), F.stddev_samp("pr_auc").alias("sd_repeat_pr_auc"))
    f = fold_fits.groupBy(*key).agg(
        F.avg("n_nonzero_coefficients").alias("mean_nonzero_coefficients"), F.percentile("n_nonzero_coefficients", 0.5).alias("median_nonzero_coefficients"),
        F.bool_and("converged").alias("all_fits_converged"))
    p = pooled.select(*key, F.col("roc_auc").alias("sample_mean_oof_roc_auc"), F.col("pr_auc").alias("sample_mean_oof_pr_auc"))
    se = F.col("sd_repeat_roc_auc") / F.sqrt("n_repeats")
    return r.join(f, key).join(p, key).withColumn("se_repeat_roc_auc", se)


def converged_only(summary: DataFrame) -> DataFrame:
    return summary.filter("all_fits_converged")


def select_candidate(summary: DataFrame, rule: str = "one_se", digits: int = 12) -> DataFrame:
    """Best mean, or the sparsest candidate within one standard error of it (a grid of tens of candidates)."""
    ok = converged_only(summary)
    m, pr = F.round("mean_repeat_roc_auc", digits), F.round("mean_repeat_pr_auc", digits)
    nz = F.col("mean_nonzero_coefficients")
    lead = F.struct(m, pr, -nz, F.col("lambda"), F.col("l1_ratio_alpha"))
    best = ok.agg(F.max_by("mean_repeat_roc_auc", lead).alias("best_mean_roc_auc"), F.max_by("se_repeat_roc_auc", lead).alias("best_se"), F.max(lead).alias("_lead"))
    scope = ok.select("*", *[best.select(c).scalar().alias(c) for c in ("best_mean_roc_auc", "best_se")])
    cutoff = F.col("best_mean_roc_auc") - F.col("best_se")
    if rule == "best_mean":
        order, eligible = lead, F.lit(True)
    else:
        order, eligible = F.struct(-nz, pr, F.col("lambda"), F.col("l1_ratio_alpha"), m), F.col("mean_repeat_roc_auc") >= cutoff - 1e-12
    names = ["l1_ratio_alpha", "lambda", "mean_repeat_roc_auc", "mean_nonzero_coefficients"]
    within = scope.withColumn("one_se_cutoff", cutoff).filter(eligible)
    return within.agg(
        *[F.max_by(c, order).alias(c) for c in names], F.max("one_se_cutoff").alias("one_se_cutoff"),
        F.lit(1).alias("n_eligible") if rule == "best_mean" else F.count(F.lit(1)).alias("n_eligible"), F.lit(rule).alias("selection_rule"))


# -- locked scoring ----------------------------------------------------------------------------------------------------

def preprocessing_table(long: DataFrame) -> DataFrame:
    """(feature, mean, sd) of the training rows: what gets locked."""
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def locked_score(long: DataFrame, preprocessing: DataFrame, coefficients: DataFrame, intercept: float, keys: list[str], threshold: float) -> DataFrame:
    """Probability and label from stored means, sds and coefficients: a join to one row per feature and a sum."""
    locked = preprocessing.join(coefficients, "feature")
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    scored = long.join(locked, "feature").groupBy(*keys).agg((F.sum(F.col("coefficient") * z) + F.lit(float(intercept))).alias("linear"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("linear")))
    return scored.select(*keys, p.alias("p"), (p >= threshold).cast("int").alias("predicted_label"))


def coefficient_table(coefficients: DataFrame, preprocessing: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Coefficients with effect size per sd, training mean and sd, and display order (non-zero first, then size)."""
    j = coefficients.join(preprocessing.withColumnRenamed("feature", "feature_name"), "feature_name", "left")
    c = F.col("coefficient")
    shaped = j.select(
        "feature_name", "coefficient", F.abs(c).alias("absolute_coefficient"), F.exp(c).alias("odds_ratio_per_sd"), (F.abs(c) > tol).alias("nonzero"),
        F.col("mean").alias("training_mean"), F.col("sd").alias("training_sd"))
    order = Window.orderBy(F.col("nonzero").desc(), F.col("absolute_coefficient").desc(), "feature_name")
    return shaped.withColumn("display_rank", F.row_number().over(order))


def selected_predictions(preds: DataFrame, best: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Out-of-fold predictions of the winning parameters, with the chosen threshold attached."""
    on = [*keys, "l1_ratio_alpha", "lambda"]
    # one row per key on the right; the predictions, exploded from a small table, look smaller to Spark than they are
    mine = preds.join(F.broadcast(best.select(*on)), on, "left_semi").join(F.broadcast(thresholds), keys)
    return mine.withColumn("predicted_label", (F.col("p") >= F.col("threshold")).cast("int"))


def task_violations(assignments: DataFrame, inner: DataFrame, base: DataFrame, fold: int, sample: str = "sample_id") -> DataFrame:
    """Leakage guards of one outer task: validation rows in the inner folds, training rows missing there, ids unknown to the matrix."""
    one = F.count(F.lit(1))
    valid = assignments.filter(F.col("fold") == fold)
    train = assignments.filter(F.col("fold") != fold)
    leaks = inner.join(valid.select(sample), sample, "left_semi").agg(F.lit("validation_row_in_inner").alias("check_name"), one.alias("violations"))
    absent = train.join(inner.select(sample), sample, "left_anti").agg(F.lit("training_row_not_in_inner").alias("check_name"), one.alias("violations"))
    unknown = assignments.join(base.select(sample), sample, "left_anti").agg(F.lit("row_not_in_matrix").alias("check_name"), one.alias("violations"))
    return leaks.unionByName(absent).unionByName(unknown)


