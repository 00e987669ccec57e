"""A survey-shaped table derived from ``orders``, and its cleaned form.

``survey_raw`` maps every order to one respondent with coded answers.
``survey_clean`` runs the cleaning stages on it.  Both are written to the
shared folder once per application and source folder: a phase boundary that
later queries read from.  The two SQL texts describe the same tables for an
independent check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions import blank_to_null, decode_units, fill_missing, sentinel_to_null, sentinel_to_value
from surveyloom.operators.cleaning import assign, drop_missing, impute_mean, recode, run_stages
from surveyloom.plans import heart
from surveyloom.sources import read_table, settle

NOT_ASKED = (7, 9)
NOT_ASKED_DAYS = heart.DAYS_UNKNOWN
ALCOHOL_UNITS = heart.ALCOHOL_UNITS
BMI_LEVELS = heart.BMI_LEVELS
DIABETES = heart.CODEBOOKS["DIABETES"]
HEART = heart.YES_NO
EXERCISE = heart.YES_NO
SMOKING = heart.NO_YES
SLEEP_BREAKS, SLEEP_LABELS = heart.SLEEP_BINS
CIGARETTE_BREAKS, CIGARETTE_LABELS = heart.CIGARETTE_BINS
DRINKING_BREAKS, DRINKING_LABELS = heart.DRINKING_BINS
bmi_category = heart.bmi_category

# Fixed values: (name, multiplier, price multiplier, shift, modulus) of the
# pseudo-random draws the coded answers are made from.
DRAWS = (
    ("age_draw", 8023, 33, 990, 6),
    ("u_gen", 8127, 35, 3934, 100),
    ("u_phys", 8231, 37, 8832, 100),
    ("u_sleep", 8335, 39, 15684, 100),
    ("u_hd", 8439, 41, 24490, 100),
    ("u_dia", 8543, 43, 35250, 100),
    ("u_inc", 8647, 45, 47964, 100),
    ("u_edu", 8751, 47, 62632, 100),
    ("u_smk", 8855, 49, 79254, 100),
    ("u_pk", 8959, 51, 97830, 100),
    ("u_alc", 9063, 53, 118360, 100),
    ("u_bmi", 9167, 55, 140844, 100),
    ("u_ht", 9271, 57, 165282, 60),
    ("u_wt", 9375, 59, 191674, 9000),
    ("u_ex", 9479, 61, 220020, 100),
)

# Answers as SQL over the draws; valid in Spark and in the checking engine.
ANSWERS = {
    "resp_id": "resp_id",
    "age_g": "age_draw + 1",
    "genhlth": "case when u_gen < 1 then null when u_gen < 2 then 9 when u_gen < 4 then 7 else u_gen % 5 + 1 end",
    "physhlth": "case when u_phys < 1 then null when u_phys < 3 then 77 when u_phys < 4 then 99"
                " when u_phys < 60 then 88 else u_phys % 30 + 1 end",
    "sleptim": "case when u_sleep < 1 then null when u_sleep < 3 then 77 when u_sleep < 4 then 99"
               " else u_sleep % 10 + 3 end",
    "hd": "case when u_hd < 1 then 7 when u_hd < 2 then 9"
          " when u_hd >= 97 - 3 * (age_draw + 1) - 4 * (u_gen % 5) then 1 else 2 end",
    "diabetes": "case when u_dia < 1 then null when u_dia < 2 then 7 when u_dia < 3 then 9 when u_dia < 16 then 1"
                " when u_dia < 18 then 2 when u_dia < 95 then 3 else 4 end",
    "income": "case when u_inc < 3 then null when u_inc < 11 then 77 when u_inc < 21 then 99 else u_inc % 11 + 1 end",
    "educag": "case when u_edu < 1 then 9 else u_edu % 4 + 1 end",
    "rfsmok": "case when u_smk < 8 then 9 when u_smk < 20 then 2 else 1 end",
    "packday": "case when u_smk >= 8 and u_smk < 20 and u_pk >= 6 then cast((u_pk % 40 + 1) as double) / 20"
               " else null end",
    "alcday": "case when u_alc < 2 then null when u_alc < 4 then 777 when u_alc < 6 then 999 when u_alc < 45 then 888"
              " when u_alc < 65 then 101 + u_alc % 7 else 201 + u_alc % 30 end",
    "htm_cm": "case when u_bmi < 5 then null else 150 + u_ht end",
    "wtkg_x100": "case when u_bmi >= 3 and u_bmi < 9 then null else 4500 + u_wt end",
    "exercise": "case when u_ex < 1 then 9 else u_ex % 2 + 1 end",
    "site": "case when u_ex < 5 then '' else o_orderpriority end",
}

CENTS = "cast(round(o_totalprice * 100) as bigint)"


def _draw(a: int, b: int, shift: int, modulus: int) -> str:
    return f"((o_orderkey * {a} + cents * {b} + {shift}) % 1000003) % {modulus}"


def survey_raw_sql() -> str:
    draws = ", ".join(f"{_draw(*rule)} as {name}" for name, *rule in DRAWS)
    answers = ", ".join(f"{sql} as {name}" for name, sql in ANSWERS.items())
    return (f"select {answers} from (select o_orderkey as resp_id, o_orderpriority, {draws} from "
            f"(select o_orderkey, o_orderpriority, {CENTS} as cents from orders))")


def build_raw(orders: DataFrame) -> DataFrame:
    draws = (orders.selectExpr("o_orderkey", "o_orderpriority", f"{CENTS} as cents")
             .selectExpr("o_orderkey as resp_id", "o_orderpriority",
                         *[f"{_draw(*rule)} as {name}" for name, *rule in DRAWS]))
    return draws.selectExpr(*[f"{sql} as {name}" for name, sql in ANSWERS.items()])


def clean(raw: DataFrame) -> DataFrame:
    """Recode, drop by column, impute pack counts before the last drop, derive."""
    c = F.col
    height, weight = c("height_m"), c("weight_kg")
    stages = [
        # Drops that need only the raw code reach the file scan.
        drop_missing("wtkg_x100", "htm_cm"),
        recode({
            "genhlth": sentinel_to_null(c("genhlth"), NOT_ASKED),
            "phys_days": sentinel_to_null(sentinel_to_value(c("physhlth"), {88: 0}), NOT_ASKED_DAYS),
            "sleep_hr": sentinel_to_null(c("sleptim"), NOT_ASKED_DAYS),
            "hd": HEART.label(c("hd")),
            "diabetes": DIABETES.label(c("diabetes")),
            "income": fill_missing(F.concat(F.lit("band "),
                                            sentinel_to_null(c("income"), NOT_ASKED_DAYS).cast("string"))),
            "educag": sentinel_to_null(c("educag"), (9,)),
            "smoking": SMOKING.label(c("rfsmok")),
            "drink_days": decode_units(c("alcday"), ALCOHOL_UNITS),
            "height_m": c("htm_cm") / 100.0,
            "weight_kg": c("wtkg_x100") / 100.0,
            "exercise": EXERCISE.label(c("exercise")),
            "site": blank_to_null(c("site")),
        }),
        drop_missing("educag", "genhlth", "phys_days", "hd", "diabetes", "exercise", "sleep_hr", "smoking"),
        assign("packday", [(c("smoking") == "No", 0.0)]),
        impute_mean("packday", among=c("smoking") == "Yes",
                    where=(c("smoking") == "Yes") & c("packday").isNull()),
        drop_missing("drink_days"),
        recode({"cigs_per_day": c("packday") * 20, "bmi": weight / (height * height)}),
        recode({"bmi_category": bmi_category(c("bmi"))}),
    ]
    return run_stages(raw, stages).select(*CLEAN_COLUMNS)


CLEAN_COLUMNS = ("resp_id", "age_g", "genhlth", "phys_days", "sleep_hr", "hd", "diabetes", "income", "educag",
                 "smoking", "cigs_per_day", "drink_days", "height_m", "weight_kg", "bmi", "bmi_category",
                 "exercise", "site")


def survey_clean_sql() -> str:
    """The cleaned table over ``survey_raw``, stated as plain SQL."""
    bmi = "weight_kg / (height_m * height_m)"
    return f"""
with c as (
  select resp_id, age_g,
    case when genhlth in (7, 9) then null else genhlth end as genhlth,
    case when physhlth = 88 then 0 when physhlth in (77, 99) then null else physhlth end as phys_days,
    case when sleptim in (77, 99) then null else sleptim end as sleep_hr,
    case hd when 1 then 'Yes' when 2 then 'No' end as hd,
    case diabetes when 1 then 'Yes' when 2 then 'Yes, but during pregnancy' when 3 then 'No' when 4 then 'No' end
      as diabetes,
    case when income in (77, 99) or income is null then 'Missing'
      else concat('band ', cast(income as varchar)) end as income,
    case when educag = 9 then null else educag end as educag,
    case rfsmok when 1 then 'No' when 2 then 'Yes' end as smoking, packday,
    case when alcday between 101 and 199 then (alcday - 100) * 4 when alcday between 201 and 299 then alcday - 200
      when alcday in (777, 999) then null when alcday = 888 then 0 else alcday end as drink_days,
    htm_cm / 100.0e0 as height_m, wtkg_x100 / 100.0e0 as weight_kg,
    case exercise when 1 then 'Yes' when 2 then 'No' end as exercise, nullif(site, '') as site
  from survey_raw),
d as (select * from c where educag is not null and weight_kg is not null and height_m is not null
  and genhlth is not null and phys_days is not null and hd is not null and diabetes is not null
  and exercise is not null and sleep_hr is not null and smoking is not null),
m as (select avg(packday) as mean_pack from d where smoking = 'Yes'),
e as (select d.*, case when smoking = 'No' then 0.0e0 when packday is null then mean_pack else packday end as packs
  from d cross join m)
select resp_id, age_g, genhlth, phys_days, sleep_hr, hd, diabetes, income, educag, smoking,
  packs * 20 as cigs_per_day, drink_days, height_m, weight_kg, {bmi} as bmi,
  case when {bmi} < 18.5e0 then 'Underweight' when {bmi} < 23.0e0 then 'Normal Weight'
    when {bmi} < 30.0e0 then 'Overweight' else 'Obese' end as bmi_category, exercise, site
from e where drink_days is not null"""


_written: dict[tuple[str, str, str], DataFrame] = {}


def written_once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        _written[key] = settle(build())
    return _written[key]


def survey_raw(spark: SparkSession, folder: str) -> DataFrame:
    return written_once(spark, folder, "raw", lambda: build_raw(read_table(spark, folder, "orders")))


def survey_clean(spark: SparkSession, folder: str) -> DataFrame:
    return written_once(spark, folder, "clean", lambda: clean(survey_raw(spark, folder)))
