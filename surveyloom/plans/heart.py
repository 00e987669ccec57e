"""The heart-disease survey: 31 coded columns, their cleaning, charts and models.

The functions take the survey as published (numeric codes, original column
names) and need nothing but that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions import (Codebook, Levels, UnitRule, cut, decode_units, fifelse, fill_missing, round_even,
                                  sentinel_to_null, sentinel_to_value)
from surveyloom.models.design import Term
from surveyloom.operators import cleaning, distribution, profiling, shares
from surveyloom.operators.cleaning import Stage, assign, drop_missing, impute_mean, recode, rename, run_stages
from surveyloom.sources import settle_wide

# Published column names and the names used here.
COLUMNS = {
    "_SEX": "SEX",
    "_AGE_G": "AGE_GROUP",
    "GENHLTH": "GENERAL_HEALTH",
    "PHYSHLTH": "PHYSICAL_HEALTH",
    "MENTHLTH": "MENTAL_HEALTH",
    "MEDCOST1": "UNABLE_TO_AFFORD_MED",
    "CHECKUP1": "CHECKUP_DURATION_YR",
    "_TOTINDA": "EXERCISE",
    "SLEPTIM1": "SLEEP_DURATION_HR",
    "CVDCRHD4": "HEART_DISEASE",
    "CVDSTRK3": "STROKE",
    "_CASTHM1": "ASTHMA",
    "CHCSCNC1": "SKIN_CANCER",
    "CHCOCNC1": "OTHER_CANCER",
    "CHCCOPD3": "LUNG_DISEASE",
    "ADDEPEV3": "DEPRESSION",
    "CHCKDNY2": "KIDNEY_DISEASE",
    "_DRDXAR2": "ARTHRITIS",
    "DIABETE4": "DIABETES",
    "_EDUCAG": "EDUCATION",
    "INCOME3": "INCOME",
    "WTKG3": "WEIGHT_KG",
    "HTM4": "HEIGHT_M",
    "_BMI5": "BMI",
    "_BMI5CAT": "BMI_CATEGORY",
    "_RFBMI5": "OVERWEIGHT_OR_OBESE",
    "_RFSMOK3": "SMOKING",
    "_PACKDAY": "CIGARETTES_PER_DAY",
    "ALCDAY4": "DRINKING_DAYS_PER_MONTH",
    "DRNKANY6": "DRINKING",
    "_RFDRHV8": "HEAVY_DRINKING",
}

# Codes and their labels; a code that is not listed means no answer.
YES_NO = Codebook.of({1: "Yes", 2: "No"})
NO_YES = Codebook.of({1: "No", 2: "Yes"})
CODEBOOKS = {
    "SEX": Codebook.of({1: "Male", 2: "Female"}),
    "AGE_GROUP": Codebook.of({1: "[18,24]", 2: "[25,34]", 3: "[35,44]", 4: "[45,54]", 5: "[55,64]", 6: "[65,Inf)"}),
    "GENERAL_HEALTH": Codebook.of({1: "Excellent", 2: "Very good", 3: "Good", 4: "Fair", 5: "Poor"}),
    "UNABLE_TO_AFFORD_MED": YES_NO,
    "CHECKUP_DURATION_YR": Codebook.of({1: "[0,1)", 2: "[1,2)", 3: "[2,5)", 4: "[5, Inf)"}),
    "EXERCISE": YES_NO,
    "HEART_DISEASE": YES_NO,
    "STROKE": YES_NO,
    "ASTHMA": NO_YES,
    "SKIN_CANCER": YES_NO,
    "OTHER_CANCER": YES_NO,
    "LUNG_DISEASE": YES_NO,
    "DEPRESSION": YES_NO,
    "KIDNEY_DISEASE": YES_NO,
    "ARTHRITIS": YES_NO,
    "DIABETES": Codebook.of({1: "Yes", 2: "Yes, but during pregnancy", 3: "No", 4: "No"}),
    "EDUCATION": Codebook.of({1: "Attended Some High School", 2: "Graduated High School",
                              3: "Attended Some College", 4: "Graduated College"}),
    "INCOME": Codebook.of({1: "(-Inf, 10,000)", 2: "[10,000, 15,000)", 3: "[15,000, 20,000)", 4: "[20,000, 25,000)",
                           5: "[25,000, 35,000)", 6: "[35,000, 50,000)", 7: "[50,000, 75,000)",
                           8: "[75,000, 100,000)", 9: "[100,000, 150,000)", 10: "[150,000, 200,000)",
                           11: "[200,000, Inf)"}),
    "SMOKING": NO_YES,
    "DRINKING": YES_NO,
    "HEAVY_DRINKING": NO_YES,
}
DAYS_NONE = 88
DAYS_UNKNOWN = (77, 99)
ALCOHOL_UNITS = (
    UnitRule(101, 199, offset=100, factor=4),
    UnitRule(201, 299, offset=200),
    UnitRule(777, 777, factor=None),
    UnitRule(888, 888, offset=888),
    UnitRule(999, 999, factor=None),
)
BMI_LEVELS = Levels.of(("Underweight", "Normal Weight", "Overweight", "Obese"))
# Plausible ranges and the edges and labels of bins.
PLAUSIBLE = {
    "SLEEP_DURATION_HR": (0, 24),
    "HEIGHT_M": (0.5, 2.5),
    "WEIGHT_KG": (20, 300),
    "CIGARETTES_PER_DAY": (0, 100),
    "DRINKING_DAYS_PER_MONTH": (0, 31),
}
SLEEP_BINS = ((1, 4, 5, 6, 7, 8, 9, float("inf")), ("[1 - 4]", "[5]", "[6]", "[7]", "[8]", "[9]", "[10+]"))
CIGARETTE_BINS = ((0, 1, 5, 10, 15, 20, float("inf")),
                  ("[0]", "[1 - 5]", "[6 - 10]", "[11 - 15]", "[16 - 20]", "[21 - 25]"))
DRINKING_BINS = ((0, 1, 5, 10, 15, 20, 25, 30),
                 ("[0]", "[1 - 5]", "[6 - 10]", "[11 - 15]", "[16 - 20]", "[21 - 25]", "[26 - 30]"))

# Columns a row must have an answer in, in the order they are checked; the
# first group before pack counts are imputed, the second after.
REQUIRED = ("EDUCATION", "UNABLE_TO_AFFORD_MED", "WEIGHT_KG", "HEIGHT_M", "GENERAL_HEALTH", "PHYSICAL_HEALTH",
            "MENTAL_HEALTH", "HEART_DISEASE", "STROKE", "ASTHMA", "SKIN_CANCER", "OTHER_CANCER", "LUNG_DISEASE",
            "DEPRESSION", "KIDNEY_DISEASE", "ARTHRITIS", "DIABETES", "CHECKUP_DURATION_YR", "EXERCISE",
            "SLEEP_DURATION_HR")
REQUIRED_LATER = ("DRINKING", "HEAVY_DRINKING")

c = F.col


def recoded() -> dict[str, Column]:
    labels = {name: book.label(c(name)) for name, book in CODEBOOKS.items()}
    days = {name: sentinel_to_null(sentinel_to_value(c(name), {DAYS_NONE: 0}), DAYS_UNKNOWN)
            for name in ("PHYSICAL_HEALTH", "MENTAL_HEALTH")}
    return labels | days | {
        "INCOME": fill_missing(labels["INCOME"]),
        "SLEEP_DURATION_HR": sentinel_to_null(c("SLEEP_DURATION_HR"), DAYS_UNKNOWN),
        "DRINKING_DAYS_PER_MONTH": decode_units(c("DRINKING_DAYS_PER_MONTH"), ALCOHOL_UNITS),
    }


def bmi_category(bmi: Column) -> Column:
    return fifelse(bmi < 18.5, "Underweight",
                   fifelse(bmi < 23.0, "Normal Weight", fifelse(bmi < 30.0, "Overweight", "Obese")))


def stages() -> list[Stage]:
    """Cleaning stages; ``CIGARETTES_PER_DAY`` counts packs until the last ones."""
    smoker = c("SMOKING") == "Yes"
    bmi = c("BMI")
    return [
        rename(COLUMNS),
        cleaning.blanks_to_null,
        drop_missing(*REQUIRED),           # missing codes: this reaches the file scan
        recode(recoded()),
        drop_missing(*REQUIRED),           # codes that stand for no answer
        assign("SMOKING", [(c("CIGARETTES_PER_DAY") > 0, "Yes")]),
        drop_missing("SMOKING"),
        settle_wide,                       # read for the mean and for what follows; keeps the plan short
        assign("CIGARETTES_PER_DAY", [(c("SMOKING") == "No", 0.0)]),
        impute_mean("CIGARETTES_PER_DAY", among=smoker, where=smoker & c("CIGARETTES_PER_DAY").isNull()),
        assign("DRINKING", [(c("DRINKING_DAYS_PER_MONTH") > 0, "Yes"), (c("HEAVY_DRINKING") == "Yes", "Yes")]),
        drop_missing(*REQUIRED_LATER),
        recode({"HEIGHT_M": c("HEIGHT_M") / 100.0, "WEIGHT_KG": c("WEIGHT_KG") / 100.0,
                "CIGARETTES_PER_DAY": round_even(c("CIGARETTES_PER_DAY") * 20)}),
        recode({"BMI": round_even(c("WEIGHT_KG") / (c("HEIGHT_M") * c("HEIGHT_M")), 2)}),
        recode({"BMI_CATEGORY": bmi_category(bmi), "OVERWEIGHT_OR_OBESE": fifelse(bmi >= 23.0, "Yes", "No")}),
    ]


def clean(raw: DataFrame) -> DataFrame:
    """The published survey in, one distinct row per complete answer sheet out."""
    return run_stages(raw.select(*COLUMNS), stages()).transform(cleaning.dedupe)


def with_row_id(cleaned: DataFrame) -> DataFrame:
    """Distinct rows have no id of their own; a hash of all answers serves as one."""
    answers = F.to_json(F.struct(*cleaned.columns), {"ignoreNullFields": "false"})
    return cleaned.withColumn("row_id", F.md5(answers))


def attrition(raw: DataFrame) -> DataFrame:
    """Rows left after each required column, in the order in which they are checked.

    Smoking and drinking are checked after they were inferred from the other
    answers; that takes the mean of the pack counts only for rows that answered
    the columns before, and changes no test, so one scan serves all.
    """
    coded = run_stages(raw.select(*COLUMNS), [
        rename(COLUMNS), cleaning.blanks_to_null, recode(recoded()),
        assign("SMOKING", [(c("CIGARETTES_PER_DAY") > 0, "Yes")]),
        assign("DRINKING", [(c("DRINKING_DAYS_PER_MONTH") > 0, "Yes"), (c("HEAVY_DRINKING") == "Yes", "Yes")])])
    return cleaning.attrition(coded, {name: c(name).isNotNull() for name in (*REQUIRED, "SMOKING", *REQUIRED_LATER)})


def without_extreme_smokers(cleaned: DataFrame) -> DataFrame:
    return distribution.without_outliers(cleaned, "CIGARETTES_PER_DAY")


# ---- charts: one table of statistics for each kind

# The columns that are charted as levels and as numbers.
FACTORS = ("HEART_DISEASE", "AGE_GROUP", "EDUCATION", "INCOME", "UNABLE_TO_AFFORD_MED", "BMI_CATEGORY",
           "GENERAL_HEALTH", "CHECKUP_DURATION_YR", "EXERCISE", "SMOKING", "DRINKING", "HEAVY_DRINKING", "STROKE",
           "ASTHMA", "SKIN_CANCER", "OTHER_CANCER", "LUNG_DISEASE", "DEPRESSION", "KIDNEY_DISEASE", "ARTHRITIS",
           "OVERWEIGHT_OR_OBESE", "DIABETES")
SHARED = tuple(name for name in FACTORS if name not in ("HEART_DISEASE", "HEAVY_DRINKING"))
MEASURES = ("PHYSICAL_HEALTH", "MENTAL_HEALTH", "SLEEP_DURATION_HR", "CIGARETTES_PER_DAY", "DRINKING_DAYS_PER_MONTH")


def has_disease() -> Column:
    return c("HEART_DISEASE") == "Yes"


def bars(cleaned: DataFrame) -> DataFrame:
    return profiling.frequencies(cleaned, FACTORS)


def boxes(cleaned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return distribution.box_stats(cleaned, MEASURES, by)


def disease_shares(cleaned: DataFrame) -> DataFrame:
    """Class-balanced share of heart disease for every factor; unknown incomes are left out."""
    known = cleaned.withColumn("INCOME", F.nullif(c("INCOME"), F.lit("Missing")))
    return shares.balanced_shares(known, SHARED, "HEART_DISEASE")


def disease_rate(cleaned: DataFrame, column: str, bins: tuple) -> DataFrame:
    return shares.rate_by(cleaned.withColumn("bin", cut(c(column), *bins)), "bin", "AGE_GROUP", has_disease())


def measure_means(cleaned: DataFrame) -> DataFrame:
    """Mean of every measure with and without heart disease, in one scan."""
    return (cleaned.dropna(subset=["HEART_DISEASE"]).groupBy("HEART_DISEASE")
            .agg(*[F.avg(name).alias(name) for name in MEASURES]))


# ---- model terms; the first level is the base

def _alphabetical(name: str) -> Term:
    return Term(name, ("No", "Yes"))


AGE = Term("AGE_GROUP", CODEBOOKS["AGE_GROUP"].levels.labels)
EDUCATION = Term("EDUCATION", CODEBOOKS["EDUCATION"].levels.labels)
HEALTH = Term("GENERAL_HEALTH", CODEBOOKS["GENERAL_HEALTH"].levels.labels)
BMI = Term("BMI_CATEGORY", BMI_LEVELS.labels)
DIABETES = Term("DIABETES", ("No", "Yes", "Yes, but during pregnancy"))
# The terms of the full model, and those left out of the reduced ones.
ALL_TERMS = (
    AGE, EDUCATION, _alphabetical("UNABLE_TO_AFFORD_MED"), BMI, HEALTH, Term("MENTAL_HEALTH"),
    Term("PHYSICAL_HEALTH"), _alphabetical("EXERCISE"), _alphabetical("SMOKING"), Term("CIGARETTES_PER_DAY"),
    _alphabetical("DRINKING"), Term("DRINKING_DAYS_PER_MONTH"), _alphabetical("STROKE"), _alphabetical("ASTHMA"),
    _alphabetical("SKIN_CANCER"), _alphabetical("OTHER_CANCER"), _alphabetical("LUNG_DISEASE"),
    _alphabetical("DEPRESSION"), _alphabetical("KIDNEY_DISEASE"), _alphabetical("ARTHRITIS"),
    _alphabetical("OVERWEIGHT_OR_OBESE"), DIABETES,
)
_LEFT_OUT = ("MENTAL_HEALTH", "SMOKING", "DRINKING", "DRINKING_DAYS_PER_MONTH", "ASTHMA", "DEPRESSION",
             "OVERWEIGHT_OR_OBESE")
REDUCED_TERMS = tuple(t for t in ALL_TERMS if t.name not in _LEFT_OUT)
FINAL_TERMS = tuple(t for t in REDUCED_TERMS if t.name != "EXERCISE")
