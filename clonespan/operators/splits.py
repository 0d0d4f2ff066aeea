"""Seeded stratified splits, balanced folds, nested cross-validation schedules and their checks.

All seeds or candidates are evaluated in one job.  Shuffles are orders by an md5 key of (seed, id); positions inside a
stratum use sliced running totals, so one large stratum does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if, hash_integer, joint_key, order_hash, stratum_train_size
from ..session import materialize, spread
from .ranking import attach_totals, positions

# Distributions of the imbalance score with their weights, and the penalties for categories the test set misses.
DISTRIBUTIONS = [
    ("cohort", ["cohort"], 6.0), ("batch", ["batch"], 3.0), ("material", ["material"], 3.5), ("sex", ["sex"], 1.0),
    ("cohort_x_batch", ["cohort", "batch"], 6.0), ("cohort_x_material", ["cohort", "material"], 3.5),
    ("material_x_batch", ["material", "batch"], 3.0), ("cohort_x_sex", ["cohort", "sex"], 1.5),
]
MISSING_PENALTIES = {"cohort": 100.0, "batch": 45.0, "material": 70.0, "sex": 20.0}
NONRARE_STRATUM_PENALTY = 100.0
BALANCE_WEIGHTS = {"batch": 1.0, "material": 0.75, "sex": 0.5}


# -- train / test split ------------------------------------------------------------------------------------------------

def stratified_split(
    meta: DataFrame, strata: list[str], seeds: range, ratio: float = 0.7, singleton: str = "train", id_col: str = "sample_id"
) -> DataFrame:
    """(seed, row) table with `split`: the first n_train rows of each shuffled stratum train."""
    sizes = meta.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    sized = spread(meta, id_col, len(seeds)).join(sizes, strata).select("*", F.explode(F.sequence(F.lit(seeds.start), F.lit(seeds.stop - 1))).alias("seed"))
    shuffled = positions(sized.withColumn("_h", order_hash("seed", id_col)), ["seed", *strata], "_h", id_col)
    coin = hash_integer(F.concat_ws("|", F.col("seed").cast("string"), F.lit("single"), F.col(id_col).cast("string")), 1, 8) / F.lit(float(16**8))
    single = {"train": F.lit(True), "test": F.lit(False)}.get(singleton, coin < ratio)
    train = F.when(F.col("_n") == 1, single).otherwise(F.col("position") < stratum_train_size("_n", ratio))
    return shuffled.withColumn("split", F.when(train, "train").otherwise("test")).drop("_n", "_h", "position")


def _cells(assigned: DataFrame) -> DataFrame:
    """Rows folded to the joint cells all distributions need."""
    return assigned.groupBy("seed", "cohort", "batch", "material", "sex").agg(
        count_if(F.col("split") == "train").alias("n_train"), count_if(F.col("split") == "test").alias("n_test")
    )


def split_scores(assigned: DataFrame, ratio: float = 0.7, singleton_aware: bool = False) -> DataFrame:
    """Imbalance score per seed: weighted total-variation distances plus penalties for missing test categories."""
    cells = _cells(assigned)
    totals = cells.groupBy("seed").agg(F.sum("n_train").alias("t_train"), F.sum("n_test").alias("t_test"))
    specs = [F.struct(F.lit(n).alias("spec"), joint_key(cols).alias("category"), F.lit(w).alias("weight")) for n, cols, w in DISTRIBUTIONS]
    counts = cells.select("seed", "n_train", "n_test", F.inline(F.array(*specs))).groupBy("seed", "spec", "weight", "category").agg(
        F.sum("n_train").alias("a"), F.sum("n_test").alias("b")
    )
    share = counts.join(totals, "seed")
    overall = (F.col("a") + F.col("b")) / (F.col("t_train") + F.col("t_test"))
    n_all, missing = F.col("a") + F.col("b"), F.col("b") == 0
    penalised = missing & (n_all >= 2) if singleton_aware else missing
    penalty = F.coalesce(*[F.when(F.col("spec") == s, F.lit(p)) for s, p in MISSING_PENALTIES.items()], F.lit(0.0))
    per_spec = share.groupBy("seed", "spec", "weight", "t_train", "t_test").agg(
        (F.sum(F.abs(F.col("a") / F.col("t_train") - overall)) / 2).alias("tv_train"),
        (F.sum(F.abs(F.col("b") / F.col("t_test") - overall)) / 2).alias("tv_test"),
        F.sum(F.when(penalised, penalty).otherwise(F.lit(0.0))).alias("category_penalty"),
        count_if((F.col("spec") == "cohort_x_batch") & missing & (n_all >= 2)).alias("nonrare"),
        count_if((F.col("spec") == "cohort_x_batch") & missing & (n_all == 1)).alias("missing_singletons"),
    )
    deviation = 50.0 * (F.col("tv_train") + F.col("tv_test"))
    out = per_spec.groupBy("seed", "t_train", "t_test").agg(
        (F.sum(F.col("weight") * deviation) / F.sum("weight")).alias("base_score"),
        *[F.max(F.when(F.col("spec") == n, deviation)).alias(f"dev_{n}") for n, _, _ in DISTRIBUTIONS],
        F.sum("category_penalty").alias("missing_test_category_penalty"),
        (F.sum("nonrare") * NONRARE_STRATUM_PENALTY).alias("missing_nonrare_cohort_batch_penalty"),
        F.sum("missing_singletons").alias("missing_test_singleton_cohort_x_batch"),
    )
    total = F.col("missing_test_category_penalty") + F.col("missing_nonrare_cohort_batch_penalty")
    actual = F.col("t_train") / (F.col("t_train") + F.col("t_test"))
    return out.select(
        "*", F.col("t_train").alias("n_train"), F.col("t_test").alias("n_test"), actual.alias("actual_train_ratio"),
        total.alias("total_penalty"), (F.col("base_score") + total).alias("score"), F.abs(actual - F.lit(ratio)).alias("ratio_deviation"),
    ).drop("t_train", "t_test")


def ranked_seeds(scores: DataFrame, digits: int = 10) -> DataFrame:
    """Min-method rank of every seed and the selected one (score, ratio deviation, seed); a few thousand rows at most."""
    s = scores.withColumn("score", F.round("score", digits)).withColumn("ratio_deviation", F.round("ratio_deviation", digits))
    best = s.agg(F.min_by("seed", F.struct("score", "ratio_deviation", "seed")).alias("best"))
    ranked = s.withColumn("rank", F.rank().over(Window.orderBy("score")))
    return attach_totals(ranked, best, []).withColumn("is_selected_best", F.col("seed") == F.col("best")).drop("best")


def split_integrity(meta: DataFrame, assigned: DataFrame, id_col: str = "sample_id", patient: str = "patient") -> DataFrame:
    """Violations per check: repeated ids, ids on both sides, uncovered ids, patients on both sides."""
    ids = assigned.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("sides"))
    patients = assigned.groupBy(patient).agg(F.count_distinct("split").alias("sides"))
    uncovered = meta.join(assigned, id_col, "left_anti").agg(F.count(F.lit(1)).alias("v"))
    a = ids.agg(count_if(F.col("n") > 1).alias("repeated"), count_if(F.col("sides") > 1).alias("both"))
    p = patients.agg(count_if(F.col("sides") > 1).alias("v"))
    rows = a.select(F.inline(F.array(
        F.struct(F.lit("repeated_ids").alias("check_name"), F.col("repeated").alias("violations")),
        F.struct(F.lit("ids_on_both_sides").alias("check_name"), F.col("both").alias("violations")),
    )))
    return rows.unionByName(uncovered.select(F.lit("uncovered_ids").alias("check_name"), F.col("v").alias("violations"))).unionByName(
        p.select(F.lit("patients_on_both_sides").alias("check_name"), F.col("v").alias("violations")))


def distribution_table(assigned: DataFrame, columns: list[str]) -> DataFrame:
    """Category counts and percentages overall, in train and in test."""
    sides = {"overall": F.lit(True), "train": F.col("split") == "train", "test": F.col("split") == "test"}
    counts = assigned.groupBy(joint_key(columns).alias("category")).agg(*[count_if(c).alias(f"{s}_n") for s, c in sides.items()])
    totals = assigned.agg(*[count_if(c).alias(f"_{s}") for s, c in sides.items()])
    j = attach_totals(counts, totals, [])
    return j.select("category", *[c for s in sides for c in (F.col(f"{s}_n"), (100.0 * F.col(f"{s}_n") / F.col(f"_{s}")).alias(f"{s}_pct"))])


def strata_status(assigned: DataFrame, strata: list[str]) -> DataFrame:
    counts = assigned.groupBy(joint_key(strata).alias("stratum")).agg(
        F.count(F.lit(1)).alias("total_n"), count_if(F.col("split") == "train").alias("train_n"), count_if(F.col("split") == "test").alias("test_n")
    )
    warning = (
        F.when(F.col("total_n") == 1, "singleton: cannot be on both sides")
        .when((F.col("train_n") == 0) | (F.col("test_n") == 0), "missing from one side")
        .when(F.col("test_n") == 1, "fragile: one test row").otherwise("")
    )
    return counts.withColumn("warning", warning)


# -- folds -------------------------------------------------------------------------------------------------------------

def deal(rows: DataFrame, keys: list[str], k: int, seed: int, label: str, id_col: str) -> DataFrame:
    """Fold of every row for its (keys, candidate): each label is shuffled and dealt round-robin, starting where the
    previous label stopped, which keeps the counts of every label and the fold totals within one of each other."""
    sizes = rows.groupBy(*keys, label, "candidate").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys, "candidate").orderBy(F.col("_n").desc(), F.col(label)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, label, "candidate", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    hashed = rows.withColumn("_h", order_hash(F.lit(seed), *keys, "candidate", id_col))
    placed = positions(hashed, [*keys, "candidate", label], "_h", id_col)
    dealt = placed.join(F.broadcast(offsets), [*keys, label, "candidate"])  # a row per label and candidate; the rows must not be broadcast
    return dealt.withColumn("fold", ((F.col("position") + F.col("_offset")) % k + 1).cast("int")).drop("_h", "_offset", "position")


def fold_candidates(
    rows: DataFrame, keys: list[str], k: int, candidates: int, seed: int = 1, label: str = "cohort", id_col: str = "sample_id"
) -> DataFrame:
    """All candidate fold assignments of every key in one table."""
    wide = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(candidates))).alias("candidate"))
    return deal(wide, keys, k, seed, label, id_col)


def round_robin_folds(rows: DataFrame, k: int, seed: int = 1, label: str = "cohort", id_col: str = "sample_id") -> DataFrame:
    """Per label: shuffled, fold = (position + pseudo-random offset) mod k + 1."""
    offset = hash_integer(F.concat_ws("|", F.lit(str(seed)), F.col(label)), 1, 8) % k
    placed = positions(rows.withColumn("_h", order_hash(F.lit(seed), id_col)), [label], "_h", id_col)
    return placed.withColumn("fold", ((F.col("position") + offset) % k + 1).cast("int")).drop("_h", "position")


def fold_scores(
    assigned: DataFrame, keys: list[str], k: int, balance: dict[str, float] = BALANCE_WEIGHTS, label: str = "cohort", id_col: str = "sample_id"
) -> DataFrame:
    """Balance score and partition fingerprint per assignment, in one pass over the rows.

    The squared deviations over all folds of a category equal sum(n^2) - k * expected^2, so absent cells need no rows.  The
    fingerprint is a pair of order-independent sums of md5 parts of (id, fold): nothing is collected per assignment.
    """
    text = F.concat_ws(":", F.col(id_col).cast("string"), F.col("fold").cast("string"))
    cells = assigned.groupBy(*keys, "fold", label, *balance).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hash_integer(text, 1, 10)).alias("h_a"), F.sum(hash_integer(text, 11, 10)).alias("h_b"))
    terms = [F.struct(F.lit("__size__").alias("variable"), F.lit("all").alias("category"), F.lit(0.25).alias("weight"))]
    for v, w in balance.items():
        terms.append(F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("category"), F.lit(w).alias("weight")))
        terms.append(F.struct(F.lit(f"{label}|{v}").alias("variable"), F.concat_ws("|", label, F.col(v).cast("string")).alias("category"), F.lit(1.5 * w).alias("weight")))
    per_fold = cells.select(*keys, "fold", "n", "h_a", "h_b", F.inline(F.array(*terms))).groupBy(*keys, "fold", "variable", "category", "weight").agg(
        *[F.sum(c).alias(c) for c in ("n", "h_a", "h_b")])
    per_category = per_fold.groupBy(*keys, "variable", "category", "weight").agg(
        F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"), F.sum("h_a").alias("h_a"), F.sum("h_b").alias("h_b"))
    expected = F.col("s") / k
    scale = F.greatest(expected, F.lit(1.0))
    size = F.col("variable") == "__size__"
    return per_category.groupBy(*keys).agg(
        F.sum(F.col("weight") * (F.col("ss") - k * expected * expected) / (scale * scale)).alias("score"),
        F.sum(F.when(size, F.col("h_a"))).alias("sig_a"), F.sum(F.when(size, F.col("h_b"))).alias("sig_b"))


def fold_signatures(assigned: DataFrame, keys: list[str], id_col: str = "sample_id") -> DataFrame:
    """Order-independent fingerprint of the id -> fold mapping."""
    text = F.concat_ws(":", F.col(id_col).cast("string"), F.col("fold").cast("string"))
    return assigned.groupBy(*keys).agg(F.sum(hash_integer(text, 1, 10)).alias("sig_a"), F.sum(hash_integer(text, 11, 10)).alias("sig_b"))


def best_distinct(assigned: DataFrame, keys: list[str], k: int, take: int = 1, digits: int = 9, **kw) -> DataFrame:
    """The `take` best-scoring candidates per key with pairwise different partitions, ranked (`repeat`).

    Works on one row per candidate (hundreds per key); scores are compared after rounding.
    """
    scored = fold_scores(assigned, [*keys, "candidate"], k, **kw).withColumn("_s", F.round("score", digits))
    first = Window.partitionBy(*keys, "sig_a", "sig_b").orderBy("_s", "candidate")
    distinct = scored.withColumn("_f", F.row_number().over(first)).filter("_f = 1").drop("_f")
    order = Window.partitionBy(*keys).orderBy("_s", "candidate")
    return distinct.withColumn("repeat", F.row_number().over(order)).filter(F.col("repeat") <= take).drop("_s")


def outer_schedule(
    rows: DataFrame, k: int, repeats: int, candidates: int, seed: int = 1, label: str = "cohort", id_col: str = "sample_id"
) -> DataFrame:
    """Repeated outer folds: every repeat has its own candidates, and takes the best one whose partition no earlier repeat has.

    If all its partitions are taken already, the repeat takes its best candidate all the same, and `schedule_violations` tells.
    Scores and fingerprints (repeats x candidates rows) decide on the driver; only the chosen candidates are dealt again.
    """
    keys = ["outer_repeat"]
    rows = spread(rows, id_col, repeats * candidates)
    wide = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("outer_repeat"))
    scored = fold_scores(fold_candidates(wide, keys, k, candidates, seed, label, id_col), [*keys, "candidate"], k, label=label, id_col=id_col)
    ranked = scored.select("outer_repeat", F.round("score", 9).alias("s"), "candidate", "sig_a", "sig_b").collect()
    picks, used = [], set()
    for r in range(1, repeats + 1):
        own = sorted((x.s, x.candidate, (x.sig_a, x.sig_b)) for x in ranked if x.outer_repeat == r)
        _, candidate, partition = next((x for x in own if x[2] not in used), own[0])
        used.add(partition)
        picks.append(F.struct(F.lit(r).alias("outer_repeat"), F.lit(candidate).alias("candidate")))
    picked = rows.select("*", F.inline(F.array(*picks)))
    return deal(picked, keys, k, seed, label, id_col).drop("candidate").withColumnRenamed("fold", "outer_fold")


def outer_tasks(outer: DataFrame, k: int) -> DataFrame:
    """Every assignment exploded to k tasks with the role of the row."""
    tasks = outer.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("task_fold"))
    role = F.when(F.col("outer_fold") == F.col("task_fold"), "validation").otherwise("training")
    return tasks.withColumn("role", role)


def inner_schedule(
    outer: DataFrame, k: int, candidates: int, seed: int = 1, label: str = "cohort", id_col: str = "sample_id"
) -> DataFrame:
    """Inner folds on the outer-training rows of every (repeat, fold)."""
    keys = ["outer_repeat", "task_fold"]
    outer = spread(outer, id_col, k * candidates)
    training = outer_tasks(outer, k).filter("role = 'training'").drop("role", "outer_fold")
    pool = fold_candidates(training, keys, k, candidates, seed, label, id_col)
    chosen = best_distinct(pool, keys, k).select(*keys, "candidate")
    picked = training.join(materialize(chosen), keys)
    dealt = deal(picked, keys, k, seed, label, id_col)
    return dealt.drop("candidate").withColumnsRenamed({"fold": "inner_fold", "task_fold": "outer_fold"})


def balance_table(assigned: DataFrame, keys: list[str], fold: str, k: int, variables: list[str]) -> DataFrame:
    """Counts and shares per fold for every variable and category, zero cells kept (the k folds are summed side by side)."""
    cats = [F.struct(F.lit("__fold__").alias("variable"), F.lit("all").alias("category"))]
    cats += [F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("category")) for v in variables]
    folds = range(1, k + 1)
    wide = assigned.select(*keys, F.col(fold).alias("_fold"), F.inline(F.array(*cats))).groupBy(*keys, "variable", "category").agg(
        *[count_if(F.col("_fold") == f).alias(f"_c{f}") for f in folds])
    long = wide.select(*keys, "variable", "category", F.inline(F.array(*[F.struct(F.lit(f).alias("fold"), F.col(f"_c{f}").alias("count")) for f in folds])))
    sizes = long.filter("variable = '__fold__'").select(*keys, "fold", F.col("count").alias("fold_size"))
    j = long.join(sizes, [*keys, "fold"])
    return j.withColumn("proportion_within_fold", F.when(F.col("fold_size") > 0, F.col("count") / F.col("fold_size")))


def schedule_violations(outer: DataFrame, inner: DataFrame, k: int, id_col: str = "sample_id", label: str = "cohort") -> DataFrame:
    """Violations per rule of a nested schedule; all zero for a valid one."""
    one = F.lit(1)
    per_id = outer.groupBy("outer_repeat", id_col).agg(F.count(one).alias("n"))
    once = per_id.agg(F.lit("sample_not_once_per_repeat").alias("check_name"), count_if(F.col("n") != 1).alias("violations"))
    folds = outer.groupBy("outer_repeat").agg(F.count_distinct("outer_fold").alias("f")).agg(F.lit("fold_missing").alias("check_name"), count_if(F.col("f") != k).alias("violations"))
    by_label = outer.groupBy("outer_repeat", label, "outer_fold").agg(F.count(one).alias("n")).groupBy("outer_repeat", label).agg(F.max("n").alias("hi"), F.min("n").alias("lo"))
    even = by_label.agg(F.lit("label_counts_uneven").alias("check_name"), count_if(F.col("hi") - F.col("lo") > 1).alias("violations"))
    sig = fold_signatures(outer.withColumnRenamed("outer_fold", "fold"), ["outer_repeat"], id_col)
    unique = sig.groupBy("sig_a", "sig_b").agg(F.count(one).alias("n")).agg(F.lit("partition_repeated").alias("check_name"), count_if(F.col("n") > 1).alias("violations"))
    key = ["outer_repeat", "outer_fold", id_col]
    held = inner.join(outer.select(*key), key, "left_semi").agg(F.lit("validation_row_in_inner").alias("check_name"), F.count(one).alias("violations"))
    want = outer_tasks(outer, k).filter("role = 'training'").select("outer_repeat", F.col("task_fold").alias("outer_fold"), id_col)
    absent = want.join(inner.select(*key), key, "left_anti").agg(F.lit("training_row_not_in_inner").alias("check_name"), F.count(one).alias("violations"))
    twice = inner.groupBy(*key).agg(F.count(one).alias("n")).agg(F.lit("inner_row_repeated").alias("check_name"), count_if(F.col("n") > 1).alias("violations"))
    out = once
    for t in (folds, even, unique, held, absent, twice):
        out = out.unionByName(t)
    return out


def task_roles(outer: DataFrame, repeat: int, fold: int, id_col: str = "sample_id") -> DataFrame:
    """Rows of one repeat labelled for the chosen fold."""
    role = F.when(F.col("outer_fold") == fold, "validation").otherwise("training")
    return outer.filter(F.col("outer_repeat") == repeat).select(id_col, "cohort", "outer_fold", role.alias("role"))


