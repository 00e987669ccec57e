"""Queries for design matrices, logistic models, trees and forests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from surveyloom.models import forest, linear, logit, pruning, store, trees
from surveyloom.models.design import Term, answer_patterns
from surveyloom.models.design import design_matrix as design_of
from surveyloom.operators import metrics
from surveyloom.plans import survey
from surveyloom.plans.exploring import balanced_split
from surveyloom.plans.registry import over_clean, query, rounded
from surveyloom.plans.survey import survey_clean
from surveyloom.sources import scratch_folder, settle

c = F.col

# Levels as the cleaned survey-shaped table holds them; the first is the base.
AGE = Term("age_g", ("1", "2", "3", "4", "5", "6"))
HEALTH = Term("genhlth", ("1", "2", "3", "4", "5"))
DIABETES = Term("diabetes", ("No", "Yes", "Yes, but during pregnancy"))
EXERCISE = Term("exercise", ("Yes", "No"))
SMOKING = Term("smoking", ("No", "Yes"))
EDUCATION = Term("educag", ("1", "2", "3", "4"))
PHYSICAL = Term("phys_days")
SLEEP = Term("sleep_hr")
DRINKING = Term("drink_days")
PREDICTORS = (AGE, HEALTH, DIABETES, EXERCISE, SMOKING, EDUCATION, PHYSICAL, SLEEP, DRINKING)
BMI = Term("bmi_category", survey.BMI_LEVELS.labels)
OVERWEIGHT = Term("overweight", ("No", "Yes"))

_kept: dict[tuple, object] = {}


def _part(spark, folder, train):
    """The rebalanced training or test rows, written once per application."""
    key = (spark.sparkContext.applicationId, folder, "split")
    if key not in _kept:
        _kept[key] = settle(balanced_split(spark, folder))
    rows = _kept[key]
    return rows.where("train") if train else rows.where("not train")


# ---- logistic regression

@query(over_clean("""
select resp_id, case when hd = 'Yes' then 1.0e0 else 0.0e0 end as y,
  case when exercise = 'No' then 1.0e0 else 0.0e0 end as "exerciseNo",
""" + ", ".join(f"case when age_g = {i} then 1.0e0 else 0.0e0 end as \"age_g{i}\"" for i in range(2, 7)) + """,
  cast(phys_days as double) as phys_days from survey_clean"""))
def design_matrix(spark, folder):
    return design_of(survey_clean(spark, folder), [EXERCISE, AGE, PHYSICAL], "hd", "Yes", keep=["resp_id"])


ONE_FACTOR_SQL = """
t as (select genhlth, cast(count(*) filter (where hd = 'Yes') as double) as y,
  cast(count(*) filter (where hd = 'No') as double) as n from survey_clean group by 1),
b as (select y as y0, n as n0 from t where genhlth = 1),
k as (select '(Intercept)' as coefficient, ln(y0 / n0) as b, sqrt(1 / y0 + 1 / n0) as se from b
  union all select concat('genhlth', cast(genhlth as varchar)), ln(y / n) - ln(y0 / n0),
    sqrt(1 / y + 1 / n + 1 / y0 + 1 / n0) from t, b where genhlth <> 1)"""


def _one_factor(spark, folder):
    patterns = answer_patterns(survey_clean(spark, folder), [HEALTH], "hd", "Yes")
    return patterns, logit.fit_logit(patterns, [HEALTH])


def _rounded(df, *names, digits=5):
    return df.withColumns({name: rounded(name, digits) for name in names})


@query(over_clean("select coefficient, round(b, 5) as estimate from k", ONE_FACTOR_SQL))
def glm_coefficients(spark, folder):
    _, fit = _one_factor(spark, folder)
    return _rounded(logit.coefficient_table(spark, fit).select("coefficient", "estimate"), "estimate")


@query(over_clean("select coefficient, round(b, 5) as estimate, round(se, 5) as std_error, round(b / se, 4) as z from k",
                  ONE_FACTOR_SQL))
def glm_summary(spark, folder):
    _, fit = _one_factor(spark, folder)
    table = logit.coefficient_table(spark, fit).drop("p")
    return _rounded(table, "estimate", "std_error").withColumn("z", rounded("z", 4))


@query(over_clean("""
select round(null_deviance, 4) as null_deviance, n - 1 as null_df, round(deviance, 4) as deviance, n - k as residual_df,
  round(deviance + 2 * k, 4) as aic
from (select -2 * sum(y * ln(y / (y + n)) + n * ln(n / (y + n))) as deviance, count(*) as k,
    -2 * (sum(y) * ln(sum(y) / sum(y + n)) + sum(n) * ln(sum(n) / sum(y + n))) as null_deviance,
    cast(sum(y + n) as bigint) as n from t)""", ONE_FACTOR_SQL))
def glm_deviance(spark, folder):
    _, fit = _one_factor(spark, folder)
    return _rounded(logit.fit_statistics(spark, fit), "null_deviance", "deviance", "aic", digits=4)


@query(over_clean("select coefficient, round(exp(b), 5) as odds_ratio from k", ONE_FACTOR_SQL))
def odds_ratios(spark, folder):
    _, fit = _one_factor(spark, folder)
    return _rounded(logit.odds_ratios(spark, fit), "odds_ratio")


@query(over_clean("""
select coefficient, round(exp(b - 1.959963984540054e0 * se), 5) as lower,
  round(exp(b + 1.959963984540054e0 * se), 5) as upper from k""", ONE_FACTOR_SQL))
def odds_ratio_ci(spark, folder):
    _, fit = _one_factor(spark, folder)
    return _rounded(logit.odds_ratio_limits(spark, fit), "lower", "upper")


def _deviance_sql(intercept, effect):
    """SQL of the deviance of two groups: y0 of n0 and y1 of n1 positive."""
    def part(y, n, eta):
        return f"{y} * ln(1 + exp(-({eta}))) + ({n} - {y}) * ln(1 + exp({eta}))"
    return f"2 * ({part('y0', 'n0', intercept)} + {part('y1', 'n1', f'{intercept} + {effect}')})"


# Where the deviance of the best fit with one coefficient held has grown by the critical value, by bisection.  With the
# effect held the odds of the first group solve a quadratic equation; with the intercept held the second group fits as before.
PROFILE_SQL = f"""
select coefficient, round(exp(max(spot) filter (where side = -1)), 5) as lower, round(exp(max(spot) filter (where side = 1)), 5) as upper
from (with recursive t as (
    select cast(count(*) filter (where exercise = 'Yes') as double) as n0, cast(count(*) filter (where exercise = 'No') as double) as n1,
      cast(count(*) filter (where exercise = 'Yes' and hd = 'Yes') as double) as y0,
      cast(count(*) filter (where exercise = 'No' and hd = 'Yes') as double) as y1
    from survey_clean where hd is not null),
  best as (select *, ln(y0 / (n0 - y0)) as a, ln(y1 / (n1 - y1)) - ln(y0 / (n0 - y0)) as b from t),
  fit as (select *, {_deviance_sql('a', 'b')} as dev from best),
  search as (
    select coefficient, side, 0 as i, case when coefficient = 'exerciseNo' then b else a end as inside,
      case when coefficient = 'exerciseNo' then b else a end + side * 3.0e0 as outside
    from fit, (values ('exerciseNo'), ('(Intercept)')) as c(coefficient), (values (-1), (1)) as s(side)
    union all
    select coefficient, side, i + 1, case when gain < 3.841458820694124e0 then spot else inside end,
      case when gain < 3.841458820694124e0 then outside else spot end
    from (select *, case when coefficient = 'exerciseNo' then {_deviance_sql('ln(odds)', 'spot')} - dev
            else {_deviance_sql('spot', '(a + b - spot)')} - dev end as gain
      from (select *, (-q + sqrt(q * q + 4 * p * (y0 + y1))) / (2 * p) as odds
        from (select *, exp(spot) * (n0 + n1 - y0 - y1) as p, n0 + n1 * exp(spot) - (y0 + y1) * (1 + exp(spot)) as q
          from (select *, (inside + outside) / 2 as spot from search where i < 60), fit))))
  select coefficient, side, inside as spot from search where i = 60)
group by coefficient"""


@query(over_clean(PROFILE_SQL))
def odds_ratio_ci_profile(spark, folder):
    patterns = answer_patterns(survey_clean(spark, folder), [EXERCISE], "hd", "Yes")
    fit = logit.fit_logit(patterns, [EXERCISE])
    return _rounded(logit.odds_ratio_limits(spark, fit, patterns, method="profile"), "lower", "upper")


@query(over_clean("select coefficient, round(abs(b / se), 4) as importance from k where coefficient <> '(Intercept)'",
                  ONE_FACTOR_SQL))
def glm_importance(spark, folder):
    _, fit = _one_factor(spark, folder)
    return _rounded(logit.importance(spark, fit), "importance", digits=4)


@query(over_clean("""
select resp_id, round(y / (y + n), 6) as probability from survey_clean join t using (genhlth)""", ONE_FACTOR_SQL))
def score_probability(spark, folder):
    _, fit = _one_factor(spark, folder)
    return survey_clean(spark, folder).select("resp_id", rounded(fit.probability()).alias("probability"))


@query()
def stepwise_trace(spark, folder):
    terms = (HEALTH, AGE, DIABETES, EXERCISE, SLEEP, BMI, OVERWEIGHT)
    train = _part(spark, folder, True).withColumn("overweight", F.when(c("bmi") >= 23.0, "Yes").otherwise("No"))
    _, steps = logit.eliminate_backward(answer_patterns(train, terms, "hd", "Yes"), terms)
    return logit.step_table(spark, steps)


@query(over_clean("""
select 0 as step, cast(null as varchar) as dropped, round(d + 2 * k, 4) as aic, round(d, 4) as deviance from s union all
select 1, 'genhlth', round(d0 + 2, 4), round(d0, 4) from s where d0 + 2 < d + 2 * k""", ONE_FACTOR_SQL + """,
s as (select -2 * sum(y * ln(y / (y + n)) + n * ln(n / (y + n))) as d, count(*) as k,
  -2 * (sum(y) * ln(sum(y) / sum(y + n)) + sum(n) * ln(sum(n) / sum(y + n))) as d0 from t)"""))
def stepwise_single_term(spark, folder):
    patterns = answer_patterns(survey_clean(spark, folder), [HEALTH], "hd", "Yes")
    _, steps = logit.eliminate_backward(patterns, [HEALTH])
    return _rounded(logit.step_table(spark, steps).drop("terms"), "aic", "deviance", digits=4)


@query(over_clean("""
select term, 1 as df, round(1 / (1 - r * r), 6) as gvif, round(sqrt(1 / (1 - r * r)), 6) as gvif_adjusted
from (select corr(height_m, weight_kg / height_m) as r from survey_clean), (values ('height_m'), ('slim')) as v(term)"""))
def vif_linear(spark, folder):
    rows = survey_clean(spark, folder).withColumn("slim", c("weight_kg") / c("height_m"))
    return _rounded(linear.vif_linear(rows, [Term("height_m"), Term("slim")]), "gvif", "gvif_adjusted", digits=6)


@query()
def gvif(spark, folder):
    terms = (HEALTH, AGE, DIABETES, EXERCISE, PHYSICAL)
    patterns = answer_patterns(_part(spark, folder, True), terms, "hd", "Yes")
    return logit.gvif(patterns, logit.fit_logit(patterns, terms))


@query()
def logit_test_confusion(spark, folder):
    """The whole logistic path: fit on train, choose the threshold on test, score test."""
    terms = (HEALTH, AGE, DIABETES, EXERCISE, PHYSICAL)
    fit = logit.fit_logit(answer_patterns(_part(spark, folder, True), terms, "hd", "Yes"), terms)
    test = _part(spark, folder, False).withColumn("score", fit.probability())
    best = metrics.best_threshold(metrics.roc_curve(test, "score", c("hd") == "Yes"))
    threshold = best.first().threshold
    labelled = test.withColumn("predicted", F.when(c("score") > threshold, "Yes").when(c("score") <= threshold, "No"))
    return metrics.confusion(labelled, "hd", "predicted", ["No", "Yes"])


# ---- classification tree

def _folded(spark, folder):
    train = _part(spark, folder, True)
    return answer_patterns(train, PREDICTORS, "hd", "Yes", keep=[pruning.fold_of("resp_id", seed=200)])


def _grown(spark, folder):
    key = (spark.sparkContext.applicationId, folder, "tree")
    if key not in _kept:
        _kept[key] = pruning.cp_table(_folded(spark, folder), PREDICTORS)
    return _kept[key]


def _chosen(spark, folder):
    tree, rows = _grown(spark, folder)
    return pruning.prune(tree, pruning.select_cp(pruning.cp_frame(spark, rows)).first().cp)


@query()
def cp_table(spark, folder):
    _, rows = _grown(spark, folder)
    return pruning.cp_frame(spark, rows)


@query()
def tree_nodes(spark, folder):
    tree, _ = _grown(spark, folder)
    return pruning.node_table(spark, pruning.prune(tree, 0.0))


@query()
def prune_tree(spark, folder):
    return pruning.node_table(spark, _chosen(spark, folder))


@query()
def tree_importance(spark, folder):
    return pruning.tree_importance(spark, _chosen(spark, folder))


@query()
def score_class(spark, folder):
    scored = pruning.predict_class(_part(spark, folder, False), _chosen(spark, folder))
    return scored.select("resp_id", "hd", "predicted")


# A tree of one split, which plain SQL can follow: who is obese, by weight in steps of 10 kg.
STUMP_SQL = """
w as (select resp_id, floor(weight_kg / 10) as v, case when bmi_category = 'Obese' then 'Yes' else 'No' end as obese
  from survey_clean),
g as (select v, cast(count(*) as double) as n, cast(count(*) filter (where obese = 'Yes') as double) as y from w group by 1),
r as (select (v + lead(v) over (order by v)) / 2 as cut, sum(n) over (order by v) as nl, sum(y) over (order by v) as yl,
  sum(n) over () as n, sum(y) over () as y from g),
best as (select * from r where cut is not null
  order by yl * (nl - yl) / nl + (y - yl) * (n - nl - y + yl) / (n - nl), cut limit 1),
nodes as (
  select 0 as id, 0 as depth, 'root' as rule, n, y, false as is_leaf from best
  union all select 1, 1, concat('weight_band <= ', cast(cut as varchar)), nl, yl, true from best
  union all select 2, 1, concat('weight_band > ', cast(cut as varchar)), n - nl, y - yl, true from best)"""
WEIGHT_BAND = Term("weight_band")


def _stump(spark, folder):
    rows = survey_clean(spark, folder).select(
        "resp_id", F.floor(c("weight_kg") / 10).alias("weight_band"),
        F.when(c("bmi_category") == "Obese", "Yes").otherwise("No").alias("obese"))
    tree = trees.grow_tree(answer_patterns(rows, [WEIGHT_BAND], "obese", "Yes"), [WEIGHT_BAND], max_depth=1)
    return rows, pruning.prune(tree, 0.0)


@query(over_clean("""
select id, depth, rule, n, least(y, n - y) as loss, case when y > n - y then 'Yes' else 'No' end as class,
  round((n - y) / n, 6) as share_no, round(y / n, 6) as share_yes, is_leaf from nodes""", STUMP_SQL))
def tree_stump(spark, folder):
    _, pruned = _stump(spark, folder)
    return _rounded(pruning.node_table(spark, pruned), "share_no", "share_yes", digits=6)


@query(over_clean("""
select resp_id, obese, case when (v <= cut) = (yl > nl - yl) then 'Yes' else 'No' end as predicted from w, best""",
                  STUMP_SQL))
def stump_class(spark, folder):
    rows, pruned = _stump(spark, folder)
    return pruning.predict_class(rows, pruned).select("resp_id", "obese", "predicted")


@query(over_clean("""
select resp_id, obese, case when (v <= cut) = (yl > nl - yl) then 'Yes' else 'No' end as predicted from w, best""", STUMP_SQL))
def tree_from_table(spark, folder):
    """The tree of one split written as a table, and rows scored by joins with it."""
    rows, pruned = _stump(spark, folder)
    path = scratch_folder(spark)
    store.node_rows(spark, [pruned.tree.splits], [WEIGHT_BAND]).write.parquet(path)
    said = store.score_by_nodes(rows, spark.read.parquet(path), [WEIGHT_BAND], "resp_id")
    return rows.join(said.select("resp_id", F.col("class").alias("predicted")), "resp_id").select("resp_id", "obese", "predicted")


@query(over_clean("""
select resp_id, round(y / (y + n), 6) as probability from survey_clean join t using (genhlth)""", ONE_FACTOR_SQL))
def logit_from_table(spark, folder):
    """Probabilities by a written table of coefficients."""
    path = scratch_folder(spark)
    store.coefficient_rows(spark, _one_factor(spark, folder)[1]).write.parquet(path)
    probability = store.probability_from(spark.read.parquet(path), [HEALTH])
    return survey_clean(spark, folder).select("resp_id", rounded(probability).alias("probability"))


# ---- trees of one split on one column, which plain SQL can follow through folds, bootstraps and permutations

def _u(*parts):
    """SQL of the number that the MD5 of the parts joined by colons gives."""
    return f"(cast(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) as bigint) / 4294967296.0e0)"


BANDS_SQL = """
w as (select resp_id, floor(weight_kg / 10) as v, case when bmi_category = 'Obese' then 1.0e0 else 0.0e0 end as y
  from survey_clean where weight_kg is not null and bmi_category is not null)"""

# For every sample s of weighted rows: the best cut, sizes and positives left of it and in all.
CUTS_SQL = """
g as (select s, v, sum(k) as n, sum(k * y) as y from sampled group by all),
r as (select s, (v + lead(v) over (partition by s order by v)) / 2 as cut, sum(n) over (partition by s order by v) as nl,
  sum(y) over (partition by s order by v) as yl, sum(n) over (partition by s) as n, sum(y) over (partition by s) as y from g),
cuts as (select * from r where cut is not null qualify row_number() over (partition by s
  order by yl * (nl - yl) / nl + (y - yl) * (n - nl - y + yl) / (n - nl), cut) = 1)"""


def _banded(spark, folder):
    return survey_clean(spark, folder).where("weight_kg is not null and bmi_category is not null").select(
        "resp_id", F.floor(c("weight_kg") / 10).alias("weight_band"),
        F.when(c("bmi_category") == "Obese", "Yes").otherwise("No").alias("obese"))


@query(over_clean("""
select round(cp, 9) as cp, nsplit, round(rel_error, 9) as rel_error, round(e / root, 9) as xerror,
  round(sqrt(e - e * e / n) / root, 9) as xstd
from (select strength / root as cp, 0 as nsplit, 1.0e0 as rel_error, bare as e, root, n from whole, held
  union all select 0.0e0, 1, 1 - strength / root, split, root, n from whole, held)""", BANDS_SQL + """,
folds as (select *, cast(floor(""" + _u("cast(resp_id as varchar)", "'200'") + """ * 10) as int) as fold from w),
sampled as (select s, v, y, 1.0e0 as k from folds, range(11) as t(s) where fold <> s),""" + CUTS_SQL + """,
whole as (select least(y, n - y) as root, n,
  least(y, n - y) - least(yl, nl - yl) - least(y - yl, n - nl - y + yl) as strength from cuts where s = 10),
held as (select sum(case when f.y = (case when c.y > c.n - c.y then 1 else 0 end) then 0.0e0 else 1.0e0 end) as bare,
  sum(case when f.y = (case when f.v <= cut then (case when yl > nl - yl then 1 else 0 end)
                       else (case when c.y - yl > c.n - nl - c.y + yl then 1 else 0 end) end) then 0.0e0 else 1.0e0 end) as split
  from folds f join cuts c on c.s = f.fold)"""))
def cp_table_stump(spark, folder):
    patterns = answer_patterns(_banded(spark, folder), [WEIGHT_BAND], "obese", "Yes",
                               keep=[pruning.fold_of("resp_id", seed=200)])
    _, rows = pruning.cp_table(patterns, [WEIGHT_BAND], max_depth=1)
    return _rounded(pruning.cp_frame(spark, rows), "cp", "rel_error", "xerror", "xstd", digits=9)


STUMPS = 5


def _poisson_sql():
    chance, reached, arms = math.exp(-1), 0.0, []
    for k in range(forest.MOST_DRAWS):
        reached += chance
        chance /= k + 1
        arms.append(f"when u < {reached!r} then {k}.0e0")
    return f"case {' '.join(arms)} else {forest.MOST_DRAWS}.0e0 end"


FOREST_SQL = BANDS_SQL + f""",
drawn as (select resp_id, v, y, s, {_u("cast(resp_id as varchar)", "'200'", "cast(s as varchar)")} as u
  from w, range({STUMPS}) as t(s)),
sampled as (select *, {_poisson_sql()} as k from drawn where {_poisson_sql()} > 0),""" + CUTS_SQL + """,
rules as (select s, cut, case when yl > nl - yl then 1.0e0 else 0.0e0 end as at_left,
  case when y - yl > n - nl - y + yl then 1.0e0 else 0.0e0 end as at_right from cuts),
votes as (select resp_id, d.y, d.v, d.s, u, case when d.v <= cut then at_left else at_right end as vote, cut, at_left, at_right
  from drawn d join rules using (s))"""


def _stumps(spark, folder):
    rows = forest.labelled_rows(_banded(spark, folder), [WEIGHT_BAND], "obese", "Yes", "resp_id")
    return rows, forest.fit_forest(rows, [WEIGHT_BAND], trees=STUMPS, max_depth=1)


@query(over_clean(f"""
select actual, predicted, coalesce(m, 0) as n
from (select * from (values ('No'), ('Yes')) as a(actual), (values ('No'), ('Yes')) as p(predicted))
left join (select case when y = 1 then 'Yes' else 'No' end as actual,
    case when 2 * yes > {STUMPS} then 'Yes' else 'No' end as predicted, count(*) as m
  from (select resp_id, y, sum(vote) as yes from votes group by all) group by all) using (actual, predicted)""", FOREST_SQL))
def forest_stumps(spark, folder):
    rows, grown = _stumps(spark, folder)
    return metrics.confusion(forest.predict_forest(rows, grown), "actual", "predicted", ["No", "Yes"])


OOB_SQL = FOREST_SQL + f""",
cast_votes as (select t.n as trees, resp_id, y, sum(vote) as yes, count(*) as cast_n
  from votes, range(1, {STUMPS + 1}) as t(n) where s < t.n and u < {math.exp(-1)!r} group by all),
judged as (select trees, y, case when 2 * yes > cast_n then 1.0e0 else 0.0e0 end as said from cast_votes)"""


@query(over_clean("""
select trees, round(avg(case when y <> said then 1.0e0 else 0.0e0 end), 9) as oob,
  round(avg(case when y <> said then 1.0e0 else 0.0e0 end) filter (where y = 0), 9) as error_no,
  round(avg(case when y <> said then 1.0e0 else 0.0e0 end) filter (where y = 1), 9) as error_yes, count(*) as n_rows
from judged group by trees""", OOB_SQL))
def oob_curve_stumps(spark, folder):
    return _rounded(forest.curve_errors(forest.oob_curve(*_stumps(spark, folder))), "oob", "error_no", "error_yes", digits=9)


@query(over_clean(f"""
select case when y = 1 then 'Yes' else 'No' end as actual, count(*) as n, cast(sum(abs(y - said)) as bigint) as wrong,
  round(avg(abs(y - said)), 9) as class_error from judged where trees = {STUMPS} group by y""", OOB_SQL))
def oob_error_stumps(spark, folder):
    curve = forest.oob_curve(*_stumps(spark, folder))
    return _rounded(metrics.class_error(curve.where(c("trees") == STUMPS)), "class_error", digits=9)


@query(over_clean(f"""
select 'weight_band' as term, round(avg(lost), 9) as importance
from (select s, sum(cast(vote = y as int) - cast((case when other <= cut then at_left else at_right end) = y as int))
    / cast(count(*) as double) as lost
  from votes join neighbours using (resp_id) where u < {math.exp(-1)!r} group by s)""", FOREST_SQL + """,
ordered as (select resp_id, v, md5(concat_ws(':', cast(resp_id as varchar), '200', 'order')) as o from w),
neighbours as (select resp_id, coalesce(lag(v) over (order by o, resp_id),
  last_value(v) over (order by o, resp_id rows between unbounded preceding and unbounded following)) as other from ordered)"""))
def permutation_importance_stumps(spark, folder):
    return _rounded(forest.permutation_importance(*_stumps(spark, folder)), "importance", digits=9)


@query(over_clean(f"""
select 'weight_band' as term, round(avg(d), 9) as drop, round(gini, 6) as gini,
""" + ", ".join(f"""round(case when {e} < {forest.EPSILON!r} then avg({m}) else avg({m}) / {e} end, 6) as {name}"""
                for m, name in (("d", "accuracy"), ("d0", "no"), ("d1", "yes"))
                for e in [f"sqrt(greatest(avg({m} * {m}) - avg({m}) * avg({m}), 0) / {STUMPS})"]) + f"""
from (select s, avg(was - now) as d, avg(was - now) filter (where y = 0) as d0, avg(was - now) filter (where y = 1) as d1
  from (select s, y, cast(vote = y as double) as was,
      cast((case when other <= cut then at_left else at_right end) = y as double) as now
    from votes join neighbours using (resp_id) where u < {math.exp(-1)!r}) group by s),
  (select avg(2 * y * (n - y) / n - 2 * yl * (nl - yl) / nl - 2 * (y - yl) * (n - nl - y + yl) / (n - nl)) as gini from cuts)
group by gini""", FOREST_SQL + """,
ordered as (select resp_id, v, md5(concat_ws(':', cast(resp_id as varchar), '200', 'order')) as o from w),
neighbours as (select resp_id, coalesce(lag(v) over (order by o, resp_id),
  last_value(v) over (order by o, resp_id rows between unbounded preceding and unbounded following)) as other from ordered)"""))
def forest_importance_stumps(spark, folder):
    return (_rounded(forest.importance_table(*_stumps(spark, folder)), "drop", digits=9)
            .withColumns({name: rounded(name) for name in ("no", "yes", "accuracy", "gini")}))


# ---- random forest

def _train_rows(spark, folder):
    return forest.labelled_rows(_part(spark, folder, True), PREDICTORS, "hd", "Yes", "resp_id")


def _forest(spark, folder):
    key = (spark.sparkContext.applicationId, folder, "forest")
    if key not in _kept:
        _kept[key] = forest.fit_forest(_train_rows(spark, folder), PREDICTORS)
    return _kept[key]


@query()
def forest_nodes(spark, folder):
    """The nodes of all trees."""
    return store.forest_node_rows(_forest(spark, folder))


@query()
def forest_fit(spark, folder):
    test = forest.labelled_rows(_part(spark, folder, False), PREDICTORS, "hd", "Yes", "resp_id")
    return metrics.confusion(forest.predict_forest(test, _forest(spark, folder)), "actual", "predicted", ["No", "Yes"])


def _oob(spark, folder):
    return forest.oob_curve(_train_rows(spark, folder), _forest(spark, folder))


@query()
def oob_error(spark, folder):
    return metrics.class_error(_oob(spark, folder).where(c("trees") == forest.STABLE_TREES))


@query()
def oob_curve(spark, folder):
    return forest.curve_errors(_oob(spark, folder))


@query()
def permutation_importance(spark, folder):
    return forest.permutation_importance(_train_rows(spark, folder), _forest(spark, folder))


# Fits that several queries share, for timing them by themselves.
SHARED = {"fit_tree": _grown, "fit_forest": _forest}
