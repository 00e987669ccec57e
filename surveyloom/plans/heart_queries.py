"""Queries over a 31-column table of the heart-disease survey's shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyloom.functions import label_above
from surveyloom.models import forest, logit, pruning
from surveyloom.models.design import answer_patterns, complete_rows
from surveyloom.operators import cleaning, distribution, metrics, profiling, sampling, shares
from surveyloom.operators.joins import left_merge
from surveyloom.plans import heart
from surveyloom.plans.preparing import cut_sql
from surveyloom.plans.registry import over_raw, query, rounded
from surveyloom.plans.survey import written_once, survey_raw
from surveyloom.sources import settle

# How the columns follow from ``survey_raw``.  ``draw`` stands for
# a number from 0 to 99 that depends on the respondent and the column.
FROM_SURVEY = {
    "_AGE_G": "age_g", "GENHLTH": "genhlth", "PHYSHLTH": "physhlth", "_TOTINDA": "exercise", "SLEPTIM1": "sleptim",
    "CVDCRHD4": "hd", "DIABETE4": "diabetes", "_EDUCAG": "educag", "INCOME3": "income", "WTKG3": "wtkg_x100",
    "HTM4": "htm_cm", "_RFSMOK3": "rfsmok", "_PACKDAY": "packday", "ALCDAY4": "alcday",
}
ILLNESS = ("case when draw < 1 then 7 when draw < 2 then 9 when draw = 99 then null"
           " when draw < case when hd = 1 then {with_disease} else {without} end then 1 else 2 end")
DRAWN = {
    "_SEX": "draw % 2 + 1",
    "MENTHLTH": "case when draw < 1 then null when draw < 3 then 77 when draw < 5 then 99 when draw < 60 then 88"
                " else draw % 30 + 1 end",
    "MEDCOST1": ILLNESS.format(with_disease=14, without=10),
    "CHECKUP1": "case when draw < 2 then 7 when draw < 3 then 8 when draw < 4 then 9 else draw % 4 + 1 end",
    "CVDSTRK3": ILLNESS.format(with_disease=22, without=6),
    "_CASTHM1": "case when draw < 2 then 9 when draw < 15 then 2 else 1 end",
    "CHCSCNC1": ILLNESS.format(with_disease=16, without=10),
    "CHCOCNC1": ILLNESS.format(with_disease=20, without=12),
    "CHCCOPD3": ILLNESS.format(with_disease=25, without=9),
    "ADDEPEV3": ILLNESS.format(with_disease=24, without=21),
    "CHCKDNY2": ILLNESS.format(with_disease=18, without=6),
    "_DRDXAR2": "case when draw < 2 then null when draw < case when hd = 1 then 60 else 35 end then 1 else 2 end",
    "_BMI5": "case when draw < 3 then null else round(wtkg_x100 * 100.0e0 / (htm_cm * htm_cm) * 100) end",
    "_BMI5CAT": "case when draw < 3 then null else draw % 4 + 1 end",
    "_RFBMI5": "case when draw < 3 then 9 else draw % 2 + 1 end",
    "DRNKANY6": "case when alcday = 888 then 2 when alcday = 777 then 7 when alcday = 999 then 9"
                " when draw < 4 then 9 else 1 end",
    "_RFDRHV8": "case when draw < 3 then 9 when draw < 10 then 2 else 1 end",
}


def _answer(place: int, name: str) -> str:
    if name in FROM_SURVEY:
        return f"{FROM_SURVEY[name]} as {name}"
    draw = f"((resp_id * {7919 + 104 * place} + {31 * place * place + 17}) % 1000003 % 100)"
    return f"{DRAWN[name].replace('draw', draw)} as {name}"


ANSWERS = [_answer(place, name) for place, name in enumerate(heart.COLUMNS)]


def heart_raw(spark, folder):
    return written_once(spark, folder, "heart raw", lambda: survey_raw(spark, folder).selectExpr(*ANSWERS))


def heart_kept(spark, folder):
    """The cleaned rows without extreme smokers, which all charts and models use."""
    return written_once(spark, folder, "heart kept", lambda: heart.without_extreme_smokers(heart_table(spark, folder)))


def heart_table(spark, folder):
    return written_once(spark, folder, "heart clean", lambda: heart.clean(heart_raw(spark, folder)))


# ---- the same cleaning as plain SQL

def _label_sql(name: str, raw: str) -> str:
    arms = " ".join(f"when {code} then '{label}'" for code, label in heart.CODEBOOKS[name].pairs)
    return f"case {raw} {arms} end"


def _coded_sql() -> str:
    parts = []
    for raw, name in heart.COLUMNS.items():
        if name == "INCOME":
            sql = f"coalesce({_label_sql(name, raw)}, 'Missing')"
        elif name in heart.CODEBOOKS:
            sql = _label_sql(name, raw)
        elif name in ("PHYSICAL_HEALTH", "MENTAL_HEALTH"):
            sql = f"case when {raw} = 88 then 0 when {raw} in (77, 99) then null else {raw} end"
        elif name == "SLEEP_DURATION_HR":
            sql = f"case when {raw} in (77, 99) then null else {raw} end"
        elif name == "DRINKING_DAYS_PER_MONTH":
            sql = (f"case when {raw} between 101 and 199 then ({raw} - 100) * 4 when {raw} between 201 and 299"
                   f" then {raw} - 200 when {raw} in (777, 999) then null when {raw} = 888 then 0 else {raw} end")
        else:
            sql = raw
        parts.append(f"{sql} as {name}")
    return f"select {', '.join(parts)} from heart_raw"


def _not_null(names) -> str:
    return " and ".join(f"{name} is not null" for name in names)


HEART_SQL = f"""
heart_raw as (select {', '.join(ANSWERS)} from survey_raw), coded as ({_coded_sql()}),
smokers as (select * replace (case when CIGARETTES_PER_DAY > 0 then 'Yes' else SMOKING end as SMOKING) from coded
  where {_not_null(heart.REQUIRED)}),
packs as (select s.* replace (case when SMOKING = 'No' then 0 when CIGARETTES_PER_DAY is null then m
    else CIGARETTES_PER_DAY end as CIGARETTES_PER_DAY,
    case when DRINKING_DAYS_PER_MONTH > 0 or HEAVY_DRINKING = 'Yes' then 'Yes' else DRINKING end as DRINKING)
  from smokers s, (select avg(CIGARETTES_PER_DAY) as m from smokers where SMOKING = 'Yes') where SMOKING is not null),
sized as (select * replace (HEIGHT_M / 100.0e0 as HEIGHT_M, WEIGHT_KG / 100.0e0 as WEIGHT_KG,
    cast(round_even(cast(cast(CIGARETTES_PER_DAY * 20 as varchar) as decimal(38, 17)), 0) as double) as CIGARETTES_PER_DAY,
    cast(round_even(cast(cast(WEIGHT_KG / 100.0e0 / ((HEIGHT_M / 100.0e0) * (HEIGHT_M / 100.0e0)) as varchar) as decimal(38, 19)), 2)
      as double) as BMI)
  from packs where {_not_null(heart.REQUIRED_LATER)}),
heart as (select distinct * replace (case when BMI < 18.5e0 then 'Underweight' when BMI < 23.0e0 then 'Normal Weight'
    when BMI < 30.0e0 then 'Overweight' else 'Obese' end as BMI_CATEGORY,
    case when BMI >= 23.0e0 then 'Yes' else 'No' end as OVERWEIGHT_OR_OBESE) from sized),
kept as (select heart.* from heart, (select avg(CIGARETTES_PER_DAY) as m, stddev_samp(CIGARETTES_PER_DAY) as s from heart)
  where not ((CIGARETTES_PER_DAY - m) / s > 3 or (CIGARETTES_PER_DAY - m) / s < -3))"""


def over_heart(sql: str) -> str:
    return over_raw(sql, HEART_SQL)


@query(over_heart("select * from heart"))
def heart_clean(spark, folder):
    return heart.clean(heart_raw(spark, folder))


CHECKED = (*heart.REQUIRED, "SMOKING", *heart.REQUIRED_LATER)


@query(over_raw(" union all ".join(
    f"select {i} as step, '{name}' as name, count(*) as n from inferred where {_not_null(CHECKED[:i])}"
    for i, name in enumerate(CHECKED, start=1)), HEART_SQL + """,
inferred as (select * replace (case when CIGARETTES_PER_DAY > 0 then 'Yes' else SMOKING end as SMOKING,
  case when DRINKING_DAYS_PER_MONTH > 0 or HEAVY_DRINKING = 'Yes' then 'Yes' else DRINKING end as DRINKING) from coded)"""))
def heart_attrition(spark, folder):
    return heart.attrition(heart_raw(spark, folder))


@query(over_heart(" union all ".join(
    f"select '{name}' as \"column\", count(*) filter (where {name} < {low} or {name} > {high}) as n from heart"
    for name, (low, high) in heart.PLAUSIBLE.items())))
def heart_range_audit(spark, folder):
    return cleaning.range_audit(heart_table(spark, folder), heart.PLAUSIBLE)


@query(over_heart("select count(*) as n_rows, 31 as n_cols from heart"))
def heart_shape(spark, folder):
    return profiling.table_shape(heart_table(spark, folder))


@query(over_heart(" union all ".join(
    f"select '{name}' as \"column\", {name} as value, count(*) as n from kept group by 2" for name in heart.FACTORS)))
def heart_bars(spark, folder):
    return heart.bars(heart_kept(spark, folder))


@query(over_heart("""
select "column", value, HEART_DISEASE, n, round(prop, 6) as prop,
  round(prop / sum(prop) over (partition by "column", value), 6) as share
from (select *, n / sum(n) over (partition by "column", HEART_DISEASE) as prop from (""" + " union all ".join(
    f"select '{name}' as \"column\", {name} as value, HEART_DISEASE, count(*) as n from kept"
    + (" where INCOME <> 'Missing'" if name == "INCOME" else "") + " group by 2, 3" for name in heart.SHARED) + "))"))
def heart_shares(spark, folder):
    return (heart.disease_shares(heart_kept(spark, folder))
            .withColumns({"prop": rounded("prop"), "share": rounded("share")}))


@query(over_heart("select HEART_DISEASE, " + ", ".join(
    f"round(avg({name}), 6) as {name}" for name in heart.MEASURES) + " from kept group by 1"))
def heart_means(spark, folder):
    means = heart.measure_means(heart_kept(spark, folder))
    return means.withColumns({name: rounded(name) for name in heart.MEASURES})


# ---- rates by bins and age, adjusted proportions, diabetes and means by group

def _rate_sql(column: str, bins: tuple) -> str:
    return over_raw("""
select t.bin, t.total, h.AGE_GROUP, h.cases, round(h.cases / t.total * 100, 6) as percentage
from t left join h on t.bin is not distinct from h.bin""", HEART_SQL + f""",
b as (select {cut_sql(column, *bins)} as bin, AGE_GROUP, HEART_DISEASE from kept),
t as (select bin, count(*) as total from b group by 1),
h as (select bin, AGE_GROUP, count(*) as cases from b where HEART_DISEASE = 'Yes' group by 1, 2)""")


def _rate(column: str, bins: tuple):
    def run(spark, folder):
        return heart.disease_rate(heart_kept(spark, folder), column, bins).withColumn("percentage", rounded("percentage"))
    return run


for _name, _column, _bins in (("sleep", "SLEEP_DURATION_HR", heart.SLEEP_BINS),
                              ("cigarettes", "CIGARETTES_PER_DAY", heart.CIGARETTE_BINS),
                              ("drinking", "DRINKING_DAYS_PER_MONTH", heart.DRINKING_BINS)):
    query(_rate_sql(_column, _bins), name=f"heart_rate_by_{_name}")(_rate(_column, _bins))


def _adjusted_sql(group: str) -> str:
    return over_heart(f"""
select a.{group}, a.EXERCISE, a.n, round(a.n / a.t, 6) as proportion, g.total, g.cases, round(g.cases / g.total, 6) as rate,
  round(a.n / a.t * (g.cases / g.total), 6) as adjusted
from (select {group}, EXERCISE, count(*) as n, sum(count(*)) over (partition by {group}) as t from kept
    where HEART_DISEASE = 'Yes' group by 1, 2) a
join (select {group}, count(*) as total, count(*) filter (where HEART_DISEASE = 'Yes') as cases from kept group by 1) g
  on a.{group} is not distinct from g.{group}""")


def _adjusted(group: str):
    def run(spark, folder):
        table = shares.adjusted_proportion(heart_kept(spark, folder), group, "EXERCISE", heart.has_disease())
        return table.withColumns({name: rounded(name) for name in ("proportion", "rate", "adjusted")})
    return run


for _name, _column in (("health", "GENERAL_HEALTH"), ("bmi", "BMI_CATEGORY")):
    query(_adjusted_sql(_column), name=f"heart_adjusted_by_{_name}")(_adjusted(_column))


@query(over_heart("""
select BMI_CATEGORY, DIABETES, n, round(prop, 6) as prop, round(prop / sum(prop) over (partition by BMI_CATEGORY), 6) as share
from (select *, n / sum(n) over (partition by DIABETES) as prop
  from (select BMI_CATEGORY, DIABETES, count(*) as n from kept group by 1, 2))"""))
def heart_diabetes_by_bmi(spark, folder):
    return shares.balanced_share(heart_kept(spark, folder), "BMI_CATEGORY", "DIABETES").withColumns(
        {"prop": rounded("prop"), "share": rounded("share")})


# Measure, group and rows of the charted means.
CHARTED_MEANS = (("PHYSICAL_HEALTH", "EXERCISE", "true"), ("MENTAL_HEALTH", "EXERCISE", "true"),
                 ("MENTAL_HEALTH", "INCOME", "INCOME <> 'Missing'"),
                 ("PHYSICAL_HEALTH", "AGE_GROUP", "HEART_DISEASE = 'Yes'"))


@query(over_heart(" union all ".join(
    f"select '{y}' as measure, '{group}' as grouped_by, {group} as level, round(avg({y}), 6) as mean from kept where {rows} group by 3"
    for y, group, rows in CHARTED_MEANS)))
def heart_charted_means(spark, folder):
    kept, out = heart_kept(spark, folder), None
    for y, group, rows in CHARTED_MEANS:
        means = shares.group_mean(kept, y, [group], where=F.expr(rows)).select(
            F.lit(y).alias("measure"), F.lit(group).alias("grouped_by"), F.col(group).alias("level"),
            rounded(f"mean_{y}").alias("mean"))
        out = means if out is None else out.unionByName(means)
    return out


# ---- distributions

def _boxes_sql(by: str = "") -> str:
    parts = []
    for name in heart.MEASURES:
        parts.append(f"""
select {by}'{name}' as "column", q1, median, q3,
  min(v) filter (where v between q1 - 1.5e0 * (q3 - q1) and q3 + 1.5e0 * (q3 - q1)) as whisker_low,
  max(v) filter (where v between q1 - 1.5e0 * (q3 - q1) and q3 + 1.5e0 * (q3 - q1)) as whisker_high,
  count(*) filter (where v not between q1 - 1.5e0 * (q3 - q1) and q3 + 1.5e0 * (q3 - q1)) as outliers
from (select {by}cast({name} as double) as v,
    quantile_cont(cast({name} as double), 0.25) over same as q1, quantile_cont(cast({name} as double), 0.5) over same as median,
    quantile_cont(cast({name} as double), 0.75) over same as q3
  from kept window same as ({'partition by ' + by.rstrip(', ') if by else ''})) group by {by}q1, median, q3""")
    return over_heart(" union all ".join(parts))


@query(_boxes_sql())
def heart_boxes(spark, folder):
    return heart.boxes(heart_kept(spark, folder))


@query(_boxes_sql("HEART_DISEASE, "))
def heart_boxes_by_disease(spark, folder):
    return heart.boxes(heart_kept(spark, folder), ["HEART_DISEASE"])


@query(over_heart("""
select 'CIGARETTES_PER_DAY' as "column", cast(min(v) as double) as min, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
  round(avg(v), 6) as mean, quantile_cont(v, 0.75) as q3, max(v) as max
from (select cast(CIGARETTES_PER_DAY as double) as v from heart)"""))
def heart_six_numbers(spark, folder):
    found = distribution.six_number_summary(heart_table(spark, folder), ["CIGARETTES_PER_DAY"])
    return found.withColumn("mean", rounded("mean"))


@query(over_heart("""
select 'CIGARETTES_PER_DAY' as "column", count(*) filter (where v < q1 - 1.5e0 * (q3 - q1) or v > q3 + 1.5e0 * (q3 - q1)) as outliers
from (select CIGARETTES_PER_DAY as v from heart), (select quantile_cont(CIGARETTES_PER_DAY, 0.25) as q1,
  quantile_cont(CIGARETTES_PER_DAY, 0.75) as q3 from heart)"""))
def heart_outlier_count(spark, folder):
    return distribution.count_outliers(heart_table(spark, folder), ["CIGARETTES_PER_DAY"])


@query(over_heart("select * from kept"))
def heart_without_outliers(spark, folder):
    return heart.without_extreme_smokers(heart_table(spark, folder))


# ---- profiles of the whole table

NUMBERS = ("MENTAL_HEALTH", "PHYSICAL_HEALTH", "CIGARETTES_PER_DAY", "DRINKING_DAYS_PER_MONTH")
PROFILED = tuple(name for name in heart.COLUMNS.values())
FEW = 700  # distinct values of which every count is followed


@query(over_heart(" union all ".join(f"""
select '{name}' as "column", count({name}) as n_valid, count(*) - count({name}) as n_missing, true as distinct_close,
  case when count(distinct {name}) <= {FEW} then (select list(n order by n desc) from
    (select count(*) as n from kept where {name} is not null group by {name} order by n desc limit 3)) end as top_counts
from kept""" for name in PROFILED)))
def heart_profile_sketch(spark, folder):
    """All columns in one pass, by sketches kept per age group and merged; distinct values within 5 % of the exact number."""
    kept = heart_kept(spark, folder).select(*PROFILED)
    parts = settle(profiling.profile_sketches(kept.withColumn("part", F.col("AGE_GROUP")), ["part"]))
    found = settle(profiling.merged_profiles(parts, k=3))
    exact = profiling.frequencies(kept, PROFILED).where("value is not null").groupBy("column").agg(F.count("*").alias("distinct"))
    few = F.coalesce(F.col("distinct"), F.lit(0))
    return left_merge(found, exact, ["column"]).select(
        "column", "n_valid", "n_missing", (F.abs(F.col("n_distinct") - few) <= 0.05 * few).alias("distinct_close"),
        F.when(few <= FEW, F.nullif(F.transform("top", lambda t: t["count"]), F.array().cast("array<bigint>"))).alias("top_counts"))


@query(over_heart("""
select cast(count(*) - (select count(*) from (select distinct * from kept)) as bigint) as n_duplicates from kept"""))
def heart_profile_duplicates(spark, folder):
    return profiling.profile(heart_kept(spark, folder))[2]


@query(over_heart(" union all ".join(f"""
select '{name}' as "column", round(avg({name}), 6) as mean, round(stddev_samp({name}), 6) as sd, cast(min({name}) as double) as min,
  round(quantile_cont({name}, 0.5), 6) as median, cast(max({name}) as double) as max, count(distinct {name}) as n_distinct,
  count({name}) as n_valid, count(*) - count({name}) as n_missing from kept""" for name in NUMBERS)))
def heart_profile_numeric(spark, folder):
    found = profiling.profile(heart_kept(spark, folder))[0].where(F.col("column").isin(*NUMBERS))
    return found.select("column", rounded("mean").alias("mean"), rounded("sd").alias("sd"), "min", rounded("median").alias("median"),
                        "max", "n_distinct", "n_valid", "n_missing")


# ---- models: both parts rebalanced, threshold chosen on the test part

def heart_parts(spark, folder):
    def build():
        rows = settle(heart.with_row_id(heart_kept(spark, folder)))
        split = settle(sampling.split_stratified(rows, "HEART_DISEASE", "row_id", ratio=0.7, seed=200))
        return sampling.balance(split, "HEART_DISEASE", "Yes", "row_id", ratio=2, seed="200:balance", within=["train"])
    return written_once(spark, folder, "heart parts", build)


@query(over_heart("""
select train, HEART_DISEASE, case when HEART_DISEASE = 'Yes' then n else least(n, 2 * yes) end as n
from (select *, sum(n) filter (where HEART_DISEASE = 'Yes') over (partition by train) as yes
  from (select HEART_DISEASE, true as train, cast(round_even(cast(cast(count(*) * 0.7e0 as varchar) as decimal(38, 17)), 0) as bigint) as n
    from kept group by 1 union all select HEART_DISEASE, false,
      count(*) - cast(round_even(cast(cast(count(*) * 0.7e0 as varchar) as decimal(38, 17)), 0) as bigint) from kept group by 1))"""))
def heart_part_sizes(spark, folder):
    return heart_parts(spark, folder).groupBy("train", "HEART_DISEASE").agg(F.count("*").alias("n"))


def _patterns(spark, folder, terms):
    return answer_patterns(heart_parts(spark, folder).where("train"), terms, "HEART_DISEASE", "Yes")


def _fitted(spark, folder, terms):
    patterns = _patterns(spark, folder, terms)
    return patterns, logit.fit_logit(patterns, terms)


@query()
def heart_glm_all(spark, folder):
    """All terms; the certain alias of being overweight with the BMI levels has no estimate."""
    return logit.coefficient_table(spark, _fitted(spark, folder, heart.ALL_TERMS)[1])


@query()
def heart_stepwise(spark, folder):
    _, steps = logit.eliminate_backward(_patterns(spark, folder, heart.ALL_TERMS), heart.ALL_TERMS)
    return logit.step_table(spark, steps)


@query()
def heart_glm_reduced(spark, folder):
    return logit.coefficient_table(spark, _fitted(spark, folder, heart.REDUCED_TERMS)[1])


@query()
def heart_gvif(spark, folder):
    return logit.gvif(*_fitted(spark, folder, heart.REDUCED_TERMS))


@query()
def heart_glm_final(spark, folder):
    return logit.coefficient_table(spark, _fitted(spark, folder, heart.FINAL_TERMS)[1])


@query()
def heart_glm_statistics(spark, folder):
    """Deviances and AIC of the three models."""
    fits = [_fitted(spark, folder, heart.ALL_TERMS)[1], *_reduced_and_final(spark, folder)]
    parts = [logit.fit_statistics(spark, fit).withColumn("model", F.lit(name)) for name, fit in zip(("all", "reduced", "final"), fits)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _reduced_and_final(spark, folder):
    """Both fits; they share patterns and climb side by side if the same rows have answered the terms of both."""
    measures = logit.measure(_patterns(spark, folder, heart.REDUCED_TERMS), heart.REDUCED_TERMS)
    rows = complete_rows(heart_parts(spark, folder).where("train"), heart.FINAL_TERMS, "HEART_DISEASE").count()
    if rows == measures.rows:  # the final terms are some of the reduced ones
        return logit.fit_logits([heart.REDUCED_TERMS, heart.FINAL_TERMS], measures)
    return [*logit.fit_logits([heart.REDUCED_TERMS], measures), _fitted(spark, folder, heart.FINAL_TERMS)[1]]


@query()
def heart_importance(spark, folder):
    return logit.importance(spark, _fitted(spark, folder, heart.FINAL_TERMS)[1])


@query()
def heart_odds_ratios(spark, folder):
    """Odds ratios with profile likelihood limits of the final model, fitted to the rebalanced training rows."""
    patterns, fit = _fitted(spark, folder, heart.FINAL_TERMS)
    limits = logit.odds_ratio_limits(spark, fit, patterns, method="profile")
    return left_merge(logit.odds_ratios(spark, fit), limits, ["coefficient"])


def _scored(spark, folder):
    """Both parts with the final model's probability, and the best threshold on the test part."""
    _, fit = _fitted(spark, folder, heart.FINAL_TERMS)
    rows = settle(heart_parts(spark, folder).select("train", "HEART_DISEASE", fit.probability().alias("score")))
    test = rows.where("not train")
    best = metrics.best_threshold(metrics.roc_curve(test, "score", heart.has_disease())).first()
    return rows, metrics.auc(test, "score", heart.has_disease()).first().auc, best


@query()
def heart_roc(spark, folder):
    """Area, best threshold on the test part, and accuracy on both parts at that threshold."""
    rows, area, best = _scored(spark, folder)
    labelled = rows.withColumn("predicted", label_above(F.col("score"), best.threshold))
    right = F.avg((F.col("predicted") == F.col("HEART_DISEASE")).cast("double"))
    return labelled.groupBy("train").agg(right.alias("accuracy")).withColumns(
        {"auc": F.lit(area), "threshold": F.lit(best.threshold)})


@query()
def heart_confusion(spark, folder):
    """Confusion of test and training rows, both at the threshold chosen on the test part."""
    rows, _, best = _scored(spark, folder)
    labelled = rows.withColumn("predicted", label_above(F.col("score"), best.threshold))
    parts = [metrics.cell_proportions(metrics.confusion(labelled.where(F.col("train") == part), "HEART_DISEASE", "predicted", ["No", "Yes"]))
             .withColumn("train", F.lit(part)) for part in (True, False)]
    return parts[0].unionByName(parts[1])


def _forest_rows(spark, folder, train):
    rows = heart_parts(spark, folder).where("train" if train else "not train")
    return forest.labelled_rows(rows, heart.ALL_TERMS, "HEART_DISEASE", "Yes", "row_id")


# ---- classification tree on all terms

_fits: dict = {}


def _fit_once(spark, folder, name, build):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _fits:
        _fits[key] = build()
    return _fits[key]


def _tree(spark, folder):
    """The tree grown to its limits and its cross-validated complexity table."""
    def build():
        train = heart_parts(spark, folder).where("train")
        patterns = answer_patterns(train, heart.ALL_TERMS, "HEART_DISEASE", "Yes", keep=[pruning.fold_of("row_id", seed=200)])
        return pruning.cp_table(patterns, heart.ALL_TERMS)
    return _fit_once(spark, folder, "tree", build)


def _pruned(spark, folder):
    tree, rows = _tree(spark, folder)
    return pruning.prune(tree, pruning.select_cp(pruning.cp_frame(spark, rows)).first().cp)


@query()
def heart_tree_cp(spark, folder):
    return pruning.cp_frame(spark, _tree(spark, folder)[1])


@query()
def heart_tree_choice(spark, folder):
    return pruning.select_cp(heart_tree_cp(spark, folder))


@query()
def heart_tree_nodes(spark, folder):
    return pruning.node_table(spark, _pruned(spark, folder))


@query()
def heart_tree_importance(spark, folder):
    return pruning.tree_importance(spark, _pruned(spark, folder))


def _judged(labelled, actual, predicted):
    """Confusion with shares of all rows, and the accuracy beside every cell."""
    cells = metrics.cell_proportions(metrics.confusion(labelled, actual, predicted, ["No", "Yes"]))
    right = cells.agg(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("prop")))).scalar()
    return cells.withColumn("accuracy", right)


@query()
def heart_tree_confusion(spark, folder):
    test = heart_parts(spark, folder).where("not train")
    return _judged(pruning.predict_class(test, _pruned(spark, folder)), "HEART_DISEASE", "predicted")


# ---- forest on all terms

def _forest(spark, folder):
    return _fit_once(spark, folder, "forest", lambda: forest.fit_forest(_forest_rows(spark, folder, True), heart.ALL_TERMS))


@query()
def heart_forest_curve(spark, folder):
    return forest.curve_errors(_out_of_bag(spark, folder))


def _out_of_bag(spark, folder):
    return forest.oob_curve(_forest_rows(spark, folder, True), _forest(spark, folder))


@query()
def heart_forest_oob(spark, folder):
    """Out-of-bag confusion after the last tree, with the error of each class and of all rows."""
    last = settle(_out_of_bag(spark, folder).where(F.col("trees") == forest.STABLE_TREES).drop("trees"))
    wrong = F.sum(F.when(F.col("actual") != F.col("predicted"), F.col("n")).otherwise(0))
    overall = last.agg(F.try_divide(wrong, F.sum("n"))).scalar()
    return left_merge(last, metrics.class_error(last).select("actual", "class_error"), ["actual"]).withColumn("oob", overall)


@query()
def heart_forest_confusion(spark, folder):
    said = forest.predict_forest(_forest_rows(spark, folder, False), _forest(spark, folder))
    return _judged(said, "actual", "predicted")


@query()
def heart_forest_importance(spark, folder):
    return forest.importance_table(_forest_rows(spark, folder, True), _forest(spark, folder))


# Tables and fits that several queries share, for timing them by themselves.
SHARED = {"write_heart_parts": heart_parts, "fit_heart_tree": _tree, "fit_heart_forest": _forest}
