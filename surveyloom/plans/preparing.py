"""Queries for sources, recoding, filters, joins and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from surveyloom.functions import (blank_to_null, cut, decode_units, fifelse, fill_missing,
                                  label_above, round_even, sentinel_to_null, sentinel_to_value)
from surveyloom.operators import cleaning, distribution
from surveyloom.operators.joins import left_merge, scalars
from surveyloom.operators.profiling import infer_levels as infer_levels_of
from surveyloom.plans import heart, survey
from surveyloom.plans.registry import over_clean, over_raw, query, rounded
from surveyloom.plans.survey import survey_raw
from surveyloom.sources import ingest, ingest_delimited, read_delimited, read_table, scratch_folder, write_delimited

INCOME = heart.CODEBOOKS["INCOME"]
INCOME_SQL = "case income " + " ".join(f"when {code} then '{label}'" for code, label in INCOME.pairs) + " end"

c = F.col


# ---- sources and sinks

@query("select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem")
def scan_project(spark, folder):
    return read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("""
with v as (
  select 'p_name' as "column", p_name as level from part union select 'p_brand', p_brand from part
  union select 'p_type', p_type from part)
select "column", level, row_number() over (partition by "column" order by level) as ord from v where level is not null
""")
def infer_levels(spark, folder):
    return infer_levels_of(read_table(spark, folder, "part"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def ingest_roundtrip(spark, folder):
    table = ingest(lambda: read_table(spark, folder, "orders"), scratch_folder(spark))
    return table.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("""
select case when o_orderkey % 50 = 0 then 'o_totalprice: not of type double' when o_orderkey % 77 = 0 then '4 cells for 3 columns'
  when o_orderkey % 91 = 0 then '2 cells for 3 columns' end as reason, count(*) as n,
  sum(case when o_orderkey % 50 <> 0 and o_orderkey % 77 <> 0 and o_orderkey % 91 <> 0 then o_custkey end)::bigint as customers
from orders group by 1""")
def ingest_quarantine(spark, folder):
    """Orders as delimited text with some lines spoiled: what is taken in, and why the rest is not."""
    key = c("o_orderkey")
    price = F.when(key % 50 == 0, "1,5 EUR").otherwise(c("o_totalprice").cast("string"))
    line = F.concat_ws(",", key, "o_custkey", F.when(key % 50 == 0, F.concat(F.lit('"'), price, F.lit('"'))).when(
        key % 77 == 0, F.concat(price, F.lit(",more"))).when(key % 91 == 0, F.lit(None)).otherwise(price))
    source = scratch_folder(spark)
    read_table(spark, folder, "orders").select(line).write.text(source)
    schema = StructType().add("o_orderkey", "long").add("o_custkey", "long").add("o_totalprice", "double")
    good, bad = ingest_delimited(spark, source, schema, scratch_folder(spark), header=False)
    taken = good.agg(F.lit(None).cast("string").alias("reason"), F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))
    return taken.unionByName(bad.groupBy("reason").agg(F.count("*").alias("n")).withColumn("customers", F.lit(None).cast("bigint")))


@query(over_raw(f"""
select resp_id, {INCOME_SQL} as income, case diabetes when 1 then 'Yes' when 2 then 'Yes, but during pregnancy'
  when 3 then 'No' when 4 then 'No' end as diabetes, packday, nullif(site, '') as site from survey_raw"""))
def csv_roundtrip(spark, folder):
    table = survey_raw(spark, folder).select(
        "resp_id", INCOME.label(c("income")).alias("income"),
        survey.DIABETES.label(c("diabetes")).alias("diabetes"), "packday", blank_to_null(c("site")).alias("site"))
    path = scratch_folder(spark)
    write_delimited(table, path)
    return read_delimited(spark, path, schema=table.schema)


# ---- projection, recode, derived columns

RENAMES = {"age_g": "AGE_GROUP", "genhlth": "GENERAL_HEALTH", "physhlth": "PHYSICAL_HEALTH", "sleptim": "SLEEP_TIME"}


@query(over_raw("select resp_id, " + ", ".join(f"{old} as {new}" for old, new in RENAMES.items())
                + " from survey_raw"))
def bulk_rename(spark, folder):
    return survey_raw(spark, folder).transform(cleaning.rename(RENAMES)).select("resp_id", *RENAMES.values())


@query(over_raw("select resp_id, nullif(site, '') as site from survey_raw"), name="blank_to_null")
def blank_to_null_columns(spark, folder):
    return cleaning.blanks_to_null(survey_raw(spark, folder).select("resp_id", "site"))


SENTINELS = {"genhlth": (7, 9), "physhlth": (77, 99), "sleptim": (77, 99), "income": (77, 99), "educag": (9,),
             "rfsmok": (9,), "exercise": (9,)}


@query(over_raw("select resp_id, " + ", ".join(
    f"case when {name} in ({', '.join(map(str, codes))}) then null else {name} end as {name}"
    for name, codes in SENTINELS.items()) + " from survey_raw"), name="sentinel_to_null")
def sentinel_to_null_codes(spark, folder):
    recode = cleaning.recode({name: sentinel_to_null(c(name), codes) for name, codes in SENTINELS.items()})
    return survey_raw(spark, folder).transform(recode).select("resp_id", *SENTINELS)


@query(over_raw("select resp_id, case when physhlth = 88 then 0 else physhlth end as physhlth from survey_raw"), name="sentinel_to_value")
def sentinel_to_value_codes(spark, folder):
    return survey_raw(spark, folder).select(
        "resp_id", sentinel_to_value(c("physhlth"), {88: 0}).alias("physhlth"))


@query(over_raw(f"""
select resp_id, case hd when 1 then 'Yes' when 2 then 'No' end as hd,
  case diabetes when 1 then 'Yes' when 2 then 'Yes, but during pregnancy' when 3 then 'No' when 4 then 'No' end
    as diabetes, {INCOME_SQL} as income from survey_raw"""))
def recode_labels(spark, folder):
    return survey_raw(spark, folder).select(
        "resp_id", survey.HEART.label(c("hd")).alias("hd"), survey.DIABETES.label(c("diabetes")).alias("diabetes"),
        INCOME.label(c("income")).alias("income"))


BMI_SQL = "(wtkg_x100 / 100.0e0) / ((htm_cm / 100.0e0) * (htm_cm / 100.0e0))"


def _bmi():
    metres = c("htm_cm") / 100.0
    return c("wtkg_x100") / 100.0 / (metres * metres)


@query(over_raw(f"""
select resp_id, case when {BMI_SQL} is null then null when {BMI_SQL} < 18.5e0 then 'Underweight'
  when {BMI_SQL} < 23.0e0 then 'Normal Weight' when {BMI_SQL} < 30.0e0 then 'Overweight' else 'Obese' end
  as bmi_category, case when {BMI_SQL} is null then null when {BMI_SQL} >= 23.0e0 then 'Yes' else 'No' end
  as overweight from survey_raw"""))
def fifelse_category(spark, folder):
    bmi = _bmi()
    return survey_raw(spark, folder).select(
        "resp_id", survey.bmi_category(bmi).alias("bmi_category"), fifelse(bmi >= 23.0, "Yes", "No").alias("overweight"))


@query(over_raw("""
select resp_id, case when alcday between 101 and 199 then (alcday - 100) * 4
  when alcday between 201 and 299 then alcday - 200 when alcday in (777, 999) then null when alcday = 888 then 0
  else alcday end as drink_days from survey_raw"""), name="decode_units")
def decode_units_days(spark, folder):
    return survey_raw(spark, folder).select("resp_id", decode_units(c("alcday"), survey.ALCOHOL_UNITS).alias("drink_days"))


@query(over_raw("""
select resp_id, case when packday > 0 then 'Yes' else smoking end as smoking,
  case when (case when packday > 0 then 'Yes' else smoking end) = 'No' then 0 else packday end as packday
from (select resp_id, packday, case rfsmok when 1 then 'No' when 2 then 'Yes' end as smoking from survey_raw)"""))
def conditional_update(spark, folder):
    stages = [
        cleaning.recode({"smoking": survey.SMOKING.label(c("rfsmok"))}),
        cleaning.assign("smoking", [(c("packday") > 0, "Yes")]),
        cleaning.assign("packday", [(c("smoking") == "No", 0.0)]),
    ]
    return cleaning.run_stages(survey_raw(spark, folder), stages).select("resp_id", "smoking", "packday")


@query(over_raw(f"""
select resp_id, coalesce({INCOME_SQL}, 'Missing') as income,
  case when {INCOME_SQL} is null then 12 else income end as ord from survey_raw"""))
def fill_missing_level(spark, folder):
    levels = INCOME.levels.with_label("Missing")
    income = fill_missing(INCOME.label(c("income")))
    return survey_raw(spark, folder).select("resp_id", income.alias("income"), levels.ordinal(income).alias("ord"))


@query(over_raw(f"""
select resp_id, round({BMI_SQL}, 6) as bmi, packday * 20 as cigarettes, htm_cm / 100.0e0 as height_m from survey_raw"""))
def derive_ratio(spark, folder):
    return survey_raw(spark, folder).select(
        "resp_id", rounded(_bmi()).alias("bmi"), (c("packday") * 20).alias("cigarettes"),
        (c("htm_cm") / 100.0).alias("height_m"))


@query("""
select l_orderkey, l_linenumber, l_partkey,
  cast(round_even(cast(cast(l_extendedprice * l_discount as varchar) as decimal(38, 19)), 2) as double) as rounded2,
  cast(round_even(cast(cast(l_quantity / 4 as varchar) as decimal(38, 17)), 0) as double) as rounded0 from lineitem""", name="round_even")
def round_even_digits(spark, folder):
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        round_even(c("l_extendedprice") * c("l_discount"), 2).alias("rounded2"),
        round_even(c("l_quantity") / 4).alias("rounded0"))


@query("""
select l_orderkey, l_linenumber, l_partkey, round(exp(l_discount), 8) as exp_discount,
  round(sqrt(l_quantity), 8) as sqrt_quantity from lineitem""")
def scalar_math(spark, folder):
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(F.exp("l_discount"), 8).alias("exp_discount"),
        rounded(F.sqrt("l_quantity"), 8).alias("sqrt_quantity"))


def cut_sql(column, breaks, labels):
    arms = [f"when {column} >= {breaks[0]}" + ("" if b == float("inf") else f" and {column} <= {b}")
            + f" then '{label}'" for b, label in zip(breaks[1:], labels)]
    return f"case {' '.join(arms)} end"


SLEEP_CUT = cut_sql("sleep_hr", survey.SLEEP_BREAKS, survey.SLEEP_LABELS)
CIGARETTE_CUT = cut_sql("cigs_per_day", survey.CIGARETTE_BREAKS, survey.CIGARETTE_LABELS)
DRINKING_CUT = cut_sql("drink_days", survey.DRINKING_BREAKS, survey.DRINKING_LABELS)


@query(over_raw(f"""
select resp_id, {cut_sql("sleptim", survey.SLEEP_BREAKS, survey.SLEEP_LABELS)} as sleep_bin,
  {cut_sql("packday", (0, 0.5, 1, 1.5), ("low", "mid", "high"))} as pack_bin from survey_raw"""))
def bin_cut(spark, folder):
    return survey_raw(spark, folder).select(
        "resp_id", cut(c("sleptim"), survey.SLEEP_BREAKS, survey.SLEEP_LABELS).alias("sleep_bin"),
        cut(c("packday"), (0, 0.5, 1, 1.5), ("low", "mid", "high")).alias("pack_bin"))


@query(over_clean("""
select bmi_category, case bmi_category when 'Underweight' then 1 when 'Normal Weight' then 2 when 'Overweight' then 3
  when 'Obese' then 4 end as ord, count(*) as n from survey_clean group by 1 order by 2"""))
def level_order(spark, folder):
    return (survey.survey_clean(spark, folder).groupBy("bmi_category").agg(F.count("*").alias("n"))
            .withColumn("ord", survey.BMI_LEVELS.ordinal(c("bmi_category"))).orderBy("ord"))


@query("""
select o_orderkey, round((o_totalprice - m) / s, 6) as z
from orders, (select avg(o_totalprice) as m, stddev_samp(o_totalprice) as s from orders)""")
def zscore(spark, folder):
    orders = read_table(spark, folder, "orders")
    return orders.select("o_orderkey", rounded(distribution.zscore(orders, "o_totalprice")).alias("z"))


@query(over_raw("""
select resp_id, case when packday is null then null when packday > 1 then 'Yes' else 'No' end as heavy
from survey_raw"""))
def threshold_label(spark, folder):
    return survey_raw(spark, folder).select("resp_id", label_above(c("packday"), 1.0).alias("heavy"))


@query("select o_orderkey, concat(o_orderstatus, '/', o_orderpriority) as label from orders")
def concat_label(spark, folder):
    return read_table(spark, folder, "orders").select(
        "o_orderkey", F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("label"))


# ---- filters and predicates

@query("""
select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem
where (l_quantity > 30 and l_discount < 0.05e0) or l_returnflag = 'R'""")
def filter_compare(spark, folder):
    return (read_table(spark, folder, "lineitem")
            .where(((c("l_quantity") > 30) & (c("l_discount") < 0.05)) | (c("l_returnflag") == "R"))
            .select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))


@query(over_raw("""
select resp_id, htm_cm, wtkg_x100, genhlth from survey_raw
where htm_cm is not null and wtkg_x100 is not null and genhlth is not null"""))
def drop_null_rows(spark, folder):
    return cleaning.run_stages(survey_raw(spark, folder), [
        cleaning.drop_missing("htm_cm"), cleaning.drop_missing("wtkg_x100"), cleaning.drop_missing("genhlth"),
    ]).select("resp_id", "htm_cm", "wtkg_x100", "genhlth")


@query(over_raw("select resp_id, age_g, hd, income from survey_raw where income is null"))
def null_rows(spark, folder):
    return cleaning.null_rows(survey_raw(spark, folder), "income").select("resp_id", "age_g", "hd", "income")


OUTLIER_SQL = """
select resp_id, cigs_per_day from survey_clean,
  (select avg(cigs_per_day) as m, stddev_samp(cigs_per_day) as s from survey_clean)
where {} ((cigs_per_day - m) / s > 3 or (cigs_per_day - m) / s < -3)"""


@query(over_clean(OUTLIER_SQL.format("not")))
def outlier_removal(spark, folder):
    return distribution.without_outliers(survey.survey_clean(spark, folder), "cigs_per_day").select(
        "resp_id", "cigs_per_day")


@query(over_clean(OUTLIER_SQL.format("")))
def outlier_rows(spark, folder):
    return distribution.outlier_rows(survey.survey_clean(spark, folder), "cigs_per_day").select(
        "resp_id", "cigs_per_day")


@query(over_clean("select resp_id, income from survey_clean where income <> 'Missing'"))
def filter_not_equal(spark, folder):
    return survey.survey_clean(spark, folder).where(c("income") != "Missing").select("resp_id", "income")


PLAUSIBLE = {"sleep_hr": (4, 11), "height_m": (1.55, 2.0), "weight_kg": (50, 130), "cigs_per_day": (0, 30),
             "drink_days": (0, 25)}


@query(over_clean(" union all ".join(
    f"select '{name}' as \"column\", count(*) filter (where {name} < {low}e0 or {name} > {high}e0) as n "
    "from survey_clean" for name, (low, high) in PLAUSIBLE.items())))
def range_audit(spark, folder):
    return cleaning.range_audit(survey.survey_clean(spark, folder), PLAUSIBLE)


ATTRITION = {"education": "educag <> 9", "weight": "wtkg_x100 is not null", "height": "htm_cm is not null",
             "general health": "genhlth <= 5", "heart": "hd <= 2", "sleep": "sleptim <= 24", "smoking": "rfsmok <= 2",
             "alcohol": "alcday not in (777, 999)"}


@query(over_raw(" union all ".join(
    f"select {i} as step, '{name}' as name, count(*) as n from survey_raw where "
    + " and ".join(list(ATTRITION.values())[:i]) for i, name in enumerate(ATTRITION, start=1))))
def attrition_report(spark, folder):
    return cleaning.attrition(survey_raw(spark, folder), {name: F.expr(test) for name, test in ATTRITION.items()})


# ---- joins and imputation

@query(over_raw("""
select a.site, a.total, b.diabetes, b.cases from t a left join h b on a.site is not distinct from b.site""",
                """s as (select nullif(site, '') as site, diabetes, hd from survey_raw),
t as (select site, count(*) as total from s group by 1),
h as (select site, diabetes, count(*) as cases from s where hd = 1 group by 1, 2)"""))
def merge_left_nullsafe(spark, folder):
    rows = survey_raw(spark, folder).select(blank_to_null(c("site")).alias("site"), "diabetes", "hd")
    totals = rows.groupBy("site").agg(F.count("*").alias("total"))
    cases = rows.where("hd = 1").groupBy("site", "diabetes").agg(F.count("*").alias("cases"))
    return left_merge(totals, cases, ["site"])


@query(over_raw("""
select resp_id, round(case when rfsmok = 1 then 0 when rfsmok = 2 and packday is null then m else packday end, 6)
  as packday from survey_raw, (select avg(packday) as m from survey_raw where rfsmok = 2)"""))
def impute_group_mean(spark, folder):
    smoker, other = c("rfsmok") == 2, c("rfsmok") == 1
    return cleaning.run_stages(survey_raw(spark, folder), [
        cleaning.assign("packday", [(other, 0.0)]),
        cleaning.impute_mean("packday", among=smoker, where=smoker & c("packday").isNull()),
    ]).select("resp_id", rounded("packday").alias("packday"))


@query(over_raw("""
select resp_id, packday - m as deviation
from survey_raw, (select max(packday) as m from survey_raw)"""))
def scalar_back_join(spark, folder):
    raw = survey_raw(spark, folder)
    top = scalars(raw.agg(F.max("packday").alias("m")))["m"]
    return raw.select("resp_id", (c("packday") - top).alias("deviation"))


# ---- whole cleaning run and duplicates

@query(over_clean("""
select * exclude (bmi, cigs_per_day), round(bmi, 6) as bmi, round(cigs_per_day, 6) as cigs_per_day
from survey_clean"""))
def survey_clean(spark, folder):
    return (survey.clean(survey_raw(spark, folder))
            .withColumns({"bmi": rounded("bmi"), "cigs_per_day": rounded("cigs_per_day")}))


ANSWER_COLUMNS = ["age_g", "genhlth", "hd", "diabetes", "exercise", "site"]


@query(over_raw(f"select distinct {', '.join(ANSWER_COLUMNS)} from survey_raw"))
def dedupe_rows(spark, folder):
    return cleaning.dedupe(survey_raw(spark, folder).select(*ANSWER_COLUMNS))


@query(over_raw(f"""
select {', '.join(ANSWER_COLUMNS)} from (
  select *, row_number() over (partition by {', '.join(ANSWER_COLUMNS)} order by resp_id) as copy from survey_raw)
where copy > 1"""))
def duplicate_rows(spark, folder):
    return cleaning.duplicate_rows(survey_raw(spark, folder).select(*ANSWER_COLUMNS))
