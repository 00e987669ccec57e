"""Queries for profiling, shares, rates, sampling and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import Levels, blank_to_null, cut, label_above
from surveyloom.models.trees import best_splits
from surveyloom.models.pruning import select_cp
from surveyloom.operators import cleaning, distribution, metrics, profiling, sampling, shares
from surveyloom.plans import survey
from surveyloom.plans.preparing import CIGARETTE_CUT, DRINKING_CUT, SLEEP_CUT
from surveyloom.plans.registry import over_clean, over_raw, query, rounded
from surveyloom.plans.survey import survey_clean, survey_raw
from surveyloom.sources import read_table, settle

c = F.col


def is_case():
    return c("hd") == "Yes"


# ---- frequency tables and profiles

@query(over_raw("select genhlth, count(*) as n from survey_raw group by 1"))
def freq_table(spark, folder):
    return profiling.freq_table(survey_raw(spark, folder), "genhlth")


@query(over_raw("""
select sleptim, count(*) as n from survey_raw where sleptim is null or sleptim > 24 group by 1"""))
def freq_out_of_domain(spark, folder):
    return profiling.freq_table(survey_raw(spark, folder).where("sleptim is null or sleptim > 24"), "sleptim")


@query(over_raw("""
select 1 as step, 'income' as name, count(*) filter (where income is null) as n from survey_raw union all
select 2, 'income and sleep', count(*) filter (where income is null and sleptim is null) from survey_raw union all
select 3, 'weight, no height', count(*) filter (where htm_cm is null and wtkg_x100 is not null) from survey_raw"""))
def null_cooccurrence(spark, folder):
    missing = {name: c(name).isNull() for name in ("income", "sleptim", "htm_cm", "wtkg_x100")}
    return cleaning.tally(survey_raw(spark, folder), {
        "income": missing["income"],
        "income and sleep": missing["income"] & missing["sleptim"],
        "weight, no height": missing["htm_cm"] & ~missing["wtkg_x100"],
    })


RAW_COLUMNS = list(survey.ANSWERS)


@query(over_raw(" union all ".join(
    f"select '{name}' as \"column\", count(*) filter (where {name} is null) as n from survey_raw"
    for name in RAW_COLUMNS)))
def null_counts(spark, folder):
    return cleaning.null_counts(survey_raw(spark, folder))


@query(over_raw(f"select count(*) as n_rows, {len(RAW_COLUMNS)} as n_cols from survey_raw"))
def table_shape(spark, folder):
    return profiling.table_shape(survey_raw(spark, folder))


NUMERIC = ["genhlth", "sleptim", "packday", "htm_cm", "wtkg_x100"]


def _profile_sql(name):
    return f"""select '{name}' as "column", '{'double' if name == 'packday' else 'bigint'}' as type,
  round(avg({name}), 6) as mean, round(stddev_samp({name}), 6) as sd, cast(min({name}) as double) as min,
  quantile_cont({name}, 0.5) as median, cast(max({name}) as double) as max,
  round(quantile_cont({name}, 0.75) - quantile_cont({name}, 0.25), 6) as iqr,
  round(stddev_samp({name}) / avg({name}), 6) as cv, count(distinct {name}) as n_distinct, count({name}) as n_valid,
  count(*) - count({name}) as n_missing from survey_raw"""


@query(over_raw(" union all ".join(map(_profile_sql, NUMERIC))))
def profile_numeric(spark, folder):
    profile = profiling.profile_numeric(survey_raw(spark, folder), NUMERIC)
    return profile.withColumns({name: rounded(name) for name in ("mean", "sd", "iqr", "cv")})


TOP_COLUMNS = ["genhlth", "diabetes", "income", "site"]


@query(over_raw("""
select "column", value, n, rank, n_valid, n_distinct, n_missing, round(n / n_valid, 6) as share
from (select *, row_number() over (partition by "column" order by n desc, value) as rank from f where value is not null)
join v using ("column") where rank <= 3""", "f as (" + " union all ".join(
    f"select '{name}' as \"column\", cast({name} as varchar) as value, count(*) as n from survey_raw group by 2"
    for name in TOP_COLUMNS) + """),
v as (select "column", cast(sum(n) filter (where value is not null) as bigint) as n_valid, count(value) as n_distinct,
  cast(coalesce(sum(n) filter (where value is null), 0) as bigint) as n_missing from f group by 1)"""))
def profile_topk(spark, folder):
    top = profiling.profile_topk(survey_raw(spark, folder), TOP_COLUMNS, k=3)
    return top.withColumn("share", rounded("share"))


@query(over_raw("""
select cast(sum(extra) as bigint) as n_duplicates from (
  select count(*) - 1 as extra from survey_raw group by age_g, genhlth, hd, diabetes, exercise, site)"""))
def duplicate_count(spark, folder):
    return profiling.duplicate_count(
        survey_raw(spark, folder).select("age_g", "genhlth", "hd", "diabetes", "exercise", "site"))


YES_NO_MAYBE = Levels.of(("Yes", "No", "Refused"))


@query(over_raw("""
select 'hd' as "column", level, ord, count(hd) as n from
  (values ('Yes', 1, 1), ('No', 2, 2), ('Refused', 3, -1)) as t(level, ord, code) left join survey_raw on hd = code
group by 2, 3"""))
def level_counts(spark, folder):
    labelled = survey_raw(spark, folder).select(survey.HEART.label(c("hd")).alias("hd"))
    return profiling.level_counts(labelled, {"hd": YES_NO_MAYBE})


BAR_COLUMNS = ["hd", "diabetes", "income", "smoking", "bmi_category", "exercise"]


@query(over_clean(" union all ".join(
    f"select '{name}' as \"column\", {name} as value, count(*) as n from survey_clean group by 2"
    for name in BAR_COLUMNS)))
def bar_counts(spark, folder):
    return profiling.frequencies(survey_clean(spark, folder), BAR_COLUMNS)


# ---- quantiles, fences, box statistics

PROBS = (0.05, 0.25, 0.5, 0.75, 0.99)
SKETCHED = ("l_extendedprice", "l_quantity", "l_discount")


@query(" union all ".join(
    f"select '{name}' as \"column\", {p}e0 as prob, true as close from (select count({name}) as n from lineitem) where n > 0"
    for name in SKETCHED for p in PROBS))
def quantile_sketch(spark, folder):
    """Sketches kept per return flag, merged, and their quantiles held against the exact ranks."""
    lineitem = read_table(spark, folder, "lineitem")
    parts = settle(distribution.quantile_sketches(lineitem, SKETCHED, ["l_returnflag"]))
    found = distribution.sketched_quantiles(distribution.merged_sketches(parts), PROBS)
    errors = distribution.rank_errors(lineitem, found, SKETCHED)
    return errors.select("column", "prob", (F.col("rank_error") <= distribution.SKETCH_ERROR).alias("close"))


@query(" union all ".join(
    f"select '{name}' as \"column\", {p}e0 as prob, round(quantile_cont({name}, {p}), 6) as value from lineitem"
    for name in ("l_extendedprice", "l_quantity") for p in PROBS))
def quantiles(spark, folder):
    lineitem = read_table(spark, folder, "lineitem")
    return (distribution.quantiles(lineitem, ["l_extendedprice", "l_quantity"], PROBS)
            .withColumn("value", rounded("value")))


@query("""
select 'value' as "column", min(value) as min, round(quantile_cont(value, 0.25), 6) as q1,
  round(median(value), 6) as median, round(avg(value), 4) as mean, round(quantile_cont(value, 0.75), 6) as q3,
  max(value) as max from events""")
def six_number_summary(spark, folder):
    summary = distribution.six_number_summary(read_table(spark, folder, "events"), ["value"])
    return summary.withColumns({"q1": rounded("q1"), "median": rounded("median"), "mean": rounded("mean", 4),
                                "q3": rounded("q3")})


def _outlier_sql(name, table):
    return f"""select '{name}' as "column", count(*) as outliers from {table},
  (select quantile_cont({name}, 0.25) as a, quantile_cont({name}, 0.75) as b from {table})
where {name} < a - 1.5e0 * (b - a) or {name} > b + 1.5e0 * (b - a)"""


@query(over_clean(" union all ".join(_outlier_sql(n, "survey_clean") for n in ("cigs_per_day", "phys_days", "bmi"))))
def iqr_outlier_count(spark, folder):
    return distribution.count_outliers(survey_clean(spark, folder), ["cigs_per_day", "phys_days", "bmi"])


def _box_sql(table, columns, by=None):
    select_by = f"{by}, " if by else ""
    join = f"join q on q.{by} is not distinct from t.{by}" if by else "cross join q"
    parts = []
    for name in columns:
        q = (f"select {select_by}quantile_cont({name}, 0.25) as a, quantile_cont({name}, 0.5) as m, "
             f"quantile_cont({name}, 0.75) as b from {table} {'group by 1' if by else ''}")
        inside = f"{name} between a - 1.5e0 * (b - a) and b + 1.5e0 * (b - a)"
        parts.append(f"""select {f't.{by}, ' if by else ''}'{name}' as "column", round(a, 6) as q1, round(m, 6) as median,
  round(b, 6) as q3, cast(min({name}) filter (where {inside}) as double) as whisker_low,
  cast(max({name}) filter (where {inside}) as double) as whisker_high,
  count(*) filter (where not ({inside})) as outliers
from {table} t {join.replace('join q', f'join ({q}) q')} group by {f't.{by}, ' if by else ''}a, m, b""")
    return " union all ".join(parts)


def _rounded_box(box):
    return box.withColumns({name: rounded(name) for name in ("q1", "median", "q3")})


@query(_box_sql("lineitem", ["l_extendedprice"]))
def box_stats(spark, folder):
    return _rounded_box(distribution.box_stats(read_table(spark, folder, "lineitem"), ["l_extendedprice"]))


@query(over_clean(_box_sql("survey_clean", ["phys_days", "drink_days", "weight_kg"], by="hd")))
def box_stats_grouped(spark, folder):
    return _rounded_box(distribution.box_stats(
        survey_clean(spark, folder), ["phys_days", "drink_days", "weight_kg"], by=["hd"]))


# ---- shares, rates, group means

def _rate_sql(label):
    return f"""
select t.bin, t.total, h.age_g, h.cases, round(h.cases / t.total * 100, 6) as percentage
from t left join h on t.bin is not distinct from h.bin""", f"""
b as (select {label} as bin, age_g, hd from survey_clean),
t as (select bin, count(*) as total from b group by 1),
h as (select bin, age_g, count(*) as cases from b where hd = 'Yes' group by 1, 2)"""


def _rate(spark, folder, column, breaks, labels):
    binned = survey_clean(spark, folder).withColumn("bin", cut(c(column), breaks, labels))
    return shares.rate_by(binned, "bin", "age_g", is_case()).withColumn("percentage", rounded("percentage"))


@query(over_clean(*_rate_sql(SLEEP_CUT)))
def rate_by_bin(spark, folder):
    return _rate(spark, folder, "sleep_hr", survey.SLEEP_BREAKS, survey.SLEEP_LABELS)


@query(over_clean(*_rate_sql(CIGARETTE_CUT)))
def rate_by_cigarettes(spark, folder):
    return _rate(spark, folder, "cigs_per_day", survey.CIGARETTE_BREAKS, survey.CIGARETTE_LABELS)


@query(over_clean(*_rate_sql(DRINKING_CUT)))
def rate_by_drinking(spark, folder):
    return _rate(spark, folder, "drink_days", survey.DRINKING_BREAKS, survey.DRINKING_LABELS)


def _adjusted_sql(group):
    return f"""
select a.{group}, a.exercise, a.n, round(a.n / a.t, 6) as proportion, g.total, g.cases,
  round(g.cases / g.total, 6) as rate, round(a.n / a.t * (g.cases / g.total), 6) as adjusted
from (select *, sum(n) over (partition by {group}) as t from
  (select {group}, exercise, count(*) as n from survey_clean where hd = 'Yes' group by 1, 2)) a
left join (select {group}, count(*) as total, count(*) filter (where hd = 'Yes') as cases from survey_clean group by 1) g
  on a.{group} is not distinct from g.{group}"""


def _adjusted(spark, folder, group):
    table = shares.adjusted_proportion(survey_clean(spark, folder), group, "exercise", is_case())
    return table.withColumns({name: rounded(name) for name in ("proportion", "rate", "adjusted")})


@query(over_clean(_adjusted_sql("genhlth")))
def adjusted_proportion(spark, folder):
    return _adjusted(spark, folder, "genhlth")


@query(over_clean(_adjusted_sql("bmi_category")))
def adjusted_proportion_bmi(spark, folder):
    return _adjusted(spark, folder, "bmi_category")


@query(over_raw("""
select site, round(avg(physhlth), 6) as physhlth from survey_raw
where physhlth is not null and site is not null group by 1"""))
def aggregate_formula(spark, folder):
    return (shares.aggregate_formula(survey_raw(spark, folder), "physhlth", ["site"])
            .withColumn("physhlth", rounded("physhlth")))


@query(over_clean("""
select age_g, round(avg(phys_days), 6) as mean_phys_days from survey_clean where hd = 'Yes' group by 1"""))
def filtered_group_mean(spark, folder):
    return (shares.group_mean(survey_clean(spark, folder), "phys_days", ["age_g"], where=is_case())
            .withColumn("mean_phys_days", rounded("mean_phys_days")))


@query(over_clean("select exercise, round(avg(phys_days), 6) as phys_days from survey_clean group by 1"))
def chart_mean(spark, folder):
    return (shares.aggregate_formula(survey_clean(spark, folder), "phys_days", ["exercise"], fn=lambda x: F.avg(x))
            .withColumn("phys_days", rounded("phys_days")))


def _balanced_sql(x, outcome):
    return f"""
select {x}, {outcome}, n, round(prop, 6) as prop, round(prop / sum(prop) over (partition by {x}), 6) as share from (
  select {x}, {outcome}, n, n / sum(n) over (partition by {outcome}) as prop from (
    select {x}, {outcome}, count(*) as n from survey_clean group by 1, 2))"""


def _balanced(spark, folder, x, outcome):
    return (shares.balanced_share(survey_clean(spark, folder), x, outcome)
            .withColumns({"prop": rounded("prop"), "share": rounded("share")}))


@query(over_clean(_balanced_sql("age_g", "hd")))
def balanced_share(spark, folder):
    return _balanced(spark, folder, "age_g", "hd")


@query(over_clean(_balanced_sql("bmi_category", "diabetes")))
def balanced_share_three_classes(spark, folder):
    return _balanced(spark, folder, "bmi_category", "diabetes")


@query("""
select l_returnflag, l_linestatus, count(*) as n,
  round(count(*) / sum(count(*)) over (partition by l_returnflag), 6) as share from lineitem group by 1, 2""")
def row_share(spark, folder):
    return (shares.row_share(read_table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")
            .withColumn("share", rounded("share")))


@query(over_raw("""
select site, diabetes, n, round(n / sum(n) over (partition by site), 6) as proportion from
  (select nullif(site, '') as site, diabetes, count(*) as n from survey_raw group by 1, 2)"""))
def within_group_share(spark, folder):
    rows = survey_raw(spark, folder).select(blank_to_null(c("site")).alias("site"), "diabetes")
    return (shares.within_group_share(rows, "site", "diabetes").withColumn("proportion", rounded("proportion")))


# ---- exact samples

SPLIT_SQL = """
select *, row_number() over (partition by hd order by md5(concat(cast(resp_id as varchar), ':200')), resp_id)
  <= cast(round_even(cast(cast(count(*) over (partition by hd) * 0.7e0 as varchar) as decimal(38, 17)), 0) as bigint) as train
from survey_clean"""


def split(spark, folder):
    return sampling.split_stratified(survey_clean(spark, folder), "hd", "resp_id", ratio=0.7, seed=200)


def balanced_split(spark, folder):
    return sampling.balance(split(spark, folder), "hd", "Yes", "resp_id", ratio=2, seed="200:balance",
                            within=["train"])


@query(over_clean("select resp_id, hd, train from s", f"s as ({SPLIT_SQL})"))
def split_stratified(spark, folder):
    return split(spark, folder).select("resp_id", "hd", "train")


@query(over_clean("""
select resp_id, hd, train from (
  select *, row_number() over (partition by train, hd order by md5(concat(cast(resp_id as varchar), ':200:balance')),
      resp_id) as place, count(*) filter (where hd = 'Yes') over (partition by train) as few from s)
where hd = 'Yes' or place <= 2 * few""", f"s as ({SPLIT_SQL})"))
def balance_downsample(spark, folder):
    return balanced_split(spark, folder).select("resp_id", "hd", "train")


# ---- classification metrics on a score made from the answers

SCORE_SQL = """p as (select resp_id, hd, score, case when score > 0.4e0 then 'Yes' else 'No' end as predicted from
  (select resp_id, hd, (age_g * 31 + genhlth * 62 + phys_days) / 600.0e0 as score from survey_clean))"""


def scored(spark, folder):
    score = (c("age_g") * 31 + c("genhlth") * 62 + c("phys_days")) / 600.0
    return (survey_clean(spark, folder).select("resp_id", "hd", score.alias("score"))
            .withColumn("predicted", label_above(c("score"), 0.4)))


CONFUSION_SQL = """m as (select actual, predicted, count(resp_id) as n from
  (select a.v as actual, b.v as predicted from (values ('No'), ('Yes')) a(v), (values ('No'), ('Yes')) b(v))
  left join (select resp_id, hd as actual, predicted from p) using (actual, predicted) group by 1, 2)"""


def _matrix(spark, folder):
    return metrics.confusion(scored(spark, folder), "hd", "predicted", ["No", "Yes"])


@query(over_clean("select * from m", f"{SCORE_SQL}, {CONFUSION_SQL}"))
def confusion_matrix(spark, folder):
    return _matrix(spark, folder)


@query(over_clean("select *, round(n / sum(n) over (), 6) as prop from m", f"{SCORE_SQL}, {CONFUSION_SQL}"))
def confusion_prop(spark, folder):
    return metrics.cell_proportions(_matrix(spark, folder)).withColumn("prop", rounded("prop"))


@query(over_clean("select round(avg(case when hd = predicted then 1.0e0 else 0.0e0 end), 8) as accuracy from p",
                  SCORE_SQL))
def accuracy(spark, folder):
    return (metrics.accuracy(scored(spark, folder), "hd", "predicted").withColumn("accuracy", rounded("accuracy", 8)))


@query(over_clean("""
select actual, cast(sum(n) as bigint) as n, cast(sum(n) filter (where actual <> predicted) as bigint) as wrong,
  round(sum(n) filter (where actual <> predicted) / sum(n), 6) as class_error from m group by 1""",
                  f"{SCORE_SQL}, {CONFUSION_SQL}"))
def class_error(spark, folder):
    return metrics.class_error(_matrix(spark, folder)).withColumn("class_error", rounded("class_error"))


ROC_SQL = SCORE_SQL + """,
w as (select score, count(*) filter (where hd = 'Yes') as pos, count(*) filter (where hd = 'No') as neg from p group by 1),
r as (select score, pos, neg, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp,
  sum(pos) over () as np, sum(neg) over () as nn, lead(score) over (order by score desc) as below from w),
roc as (select case when below is null then cast('-Infinity' as double) else (score + below) / 2 end as threshold,
    cast(tp as double) / np as sensitivity, 1 - cast(fp as double) / nn as specificity from r
  union all select cast('Infinity' as double), 0.0e0, 1.0e0)"""


@query(over_clean("""
select threshold, round(sensitivity, 8) as sensitivity, round(specificity, 8) as specificity from roc""", ROC_SQL))
def roc_curve(spark, folder):
    curve = metrics.roc_curve(scored(spark, folder), "score", is_case())
    return curve.withColumns({"sensitivity": rounded("sensitivity", 8), "specificity": rounded("specificity", 8)})


@query(over_clean("""
select round(sum(cast(neg as double) * (tp - pos / 2)) / (max(np) * max(nn)), 8) as auc from r""", ROC_SQL))
def auc(spark, folder):
    return metrics.auc(scored(spark, folder), "score", is_case()).withColumn("auc", rounded("auc", 8))


@query(over_clean("""
select threshold, round(sensitivity, 8) as sensitivity, round(specificity, 8) as specificity from roc
order by (1 - sensitivity) * (1 - sensitivity) + (1 - specificity) * (1 - specificity), threshold limit 1""", ROC_SQL))
def best_threshold(spark, folder):
    best = metrics.best_threshold(metrics.roc_curve(scored(spark, folder), "score", is_case()))
    return best.withColumns({"sensitivity": rounded("sensitivity", 8), "specificity": rounded("specificity", 8)})


# ---- single splits and the choice of a pruning strength

@query(over_clean("""
select split, round(2 * pl * (1 - pl), 8) as gini_left, round(2 * pr * (1 - pr), 8) as gini_right,
  round(2 * p * (1 - p) - (nl * 2 * pl * (1 - pl) + (n - nl) * 2 * pr * (1 - pr)) / n, 8) as gain
from (select (v + below) / 2 as split, cast(n_run as double) as nl, cast(n_all as double) as n,
    pos_run / n_run as pl, (pos_all - pos_run) / (n_all - n_run) as pr, pos_all / n_all as p
  from (select v, lead(v) over (order by v) as below, sum(n) over (order by v) as n_run, sum(n) over () as n_all,
      sum(pos) over (order by v) as pos_run, sum(pos) over () as pos_all
    from (select phys_days as v, count(*) as n, count(*) filter (where hd = 'Yes') as pos from survey_clean group by 1))
  where below is not null)"""))
def best_split(spark, folder):
    splits = best_splits(survey_clean(spark, folder), "phys_days", is_case())
    return splits.withColumns({name: rounded(name, 8) for name in ("gini_left", "gini_right", "gain")})


@query(over_clean("""
select min_index, round(cap, 8) as cap, optimal_index, round(case when prev is null then cp else sqrt(cp * prev) end, 8)
  as cp from (select * from (select *, lag(cp) over (order by i) as prev from t),
  (select min(i) as min_index from t where xerror + xstd = (select min(xerror + xstd) from t)),
  (select xerror + xstd as cap from t where i = (select min(i) from t where xerror + xstd =
    (select min(xerror + xstd) from t))),
  (select min(i) as optimal_index from t where xerror < (select xerror + xstd from t where i =
    (select min(i) from t where xerror + xstd = (select min(xerror + xstd) from t)))))
where i = optimal_index""", """
t as (select row_number() over (order by cp desc) as i, * from (
  select 1.0e0 / (age_g * age_g) as cp, round(avg(phys_days) / 10, 6) as xerror,
    round(stddev_samp(phys_days) / sqrt(count(*)), 6) as xstd from survey_clean group by age_g))"""))
def cp_select(spark, folder):
    table = survey_clean(spark, folder).groupBy("age_g").agg(
        (rounded(F.avg("phys_days") / 10)).alias("xerror"),
        rounded(F.stddev_samp("phys_days") / F.sqrt(F.count("*"))).alias("xstd")
    ).withColumn("cp", 1.0 / (c("age_g") * c("age_g")))
    chosen = select_cp(table)
    return chosen.withColumns({"cap": rounded("cap", 8), "cp": rounded("cp", 8)})
