"""Domain vocabulary of the grading tables and formulas over it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe.functions.clean import first_group
from gradeframe.functions.encode import code_of, label_index

# Grades, codes and labels as the data and the results use them.
QUALITY = ["1++", "1+", "1", "2", "3"]
YIELD = ["A", "B", "C"]
OUTSIDE = "등외"
GRADES = [
    "1++A", "1++B", "1++C", "1+A", "1+B", "1+C", "1A", "1B", "1C",
    "2A", "2B", "2C", "3A", "3B", "3C", "등외",
]
SEX_CODES = {"암": 0, "수": 1, "거세": 2}
REGIONS = [
    "강원특별자치도", "경기도", "경상남도", "경상북도", "광주광역시", "대구광역시", "대전광역시",
    "부산광역시", "서울특별시", "세종특별자치시", "울산광역시", "인천광역시", "전라남도", "전라북도",
    "전북특별자치도", "전라북도특별자치도", "제주특별자치도", "충청남도", "충청북도",
]
SEASONS = ["봄(3-5)", "여름(6-8)", "가을(9-11)", "겨울(12-2)"]
HERD_EDGES = [0, 20, 50, 100, 200, float("inf")]
HERD_LABELS = ["소규모(<20)", "중소(20-50)", "중형(50-100)", "대형(100-200)", "초대형(200+)"]
DENSITY_LABELS = ["저밀도", "중저", "중고", "고밀도"]
QUALITY_PATTERN = r"^(1\+\+|1\+|1|2|3|등외)"
YIELD_PATTERN = r"(A|B|C)$"
HIGH_QUALITY = ["1++", "1+"]
# Yield index: constant, back fat, eye area and weight terms, then the A and B limits.
YIELD_INDEX = {
    "암": (6.90137, -0.9446, 0.31806, 0.54952, 61.83, 59.70),
    "수": (0.20108, -2.18625, 0.29275, 0.64099, 68.45, 66.32),
    "거세": (11.06338, -1.25149, 0.28238, 0.56781, 62.52, 60.40),
}


def grade_score(grade: Column) -> Column:
    """Ordinal score, best grade highest; unknown or missing is 0."""
    return code_of(grade, {g: len(GRADES) - 1 - i for i, g in enumerate(GRADES)}, 0)


def grade_index(grade: Column, strict: bool = False) -> Column:
    """Class index; a missing grade counts as the lowest class."""
    return label_index(grade, GRADES, OUTSIDE, strict)


def sex_code(sex: Column) -> Column:
    return code_of(sex, SEX_CODES)


def region_code(region: Column) -> Column:
    return code_of(region, {name: i for i, name in enumerate(REGIONS)})


def quality_of(grade: Column) -> Column:
    return first_group(grade, QUALITY_PATTERN)


def yield_of(grade: Column) -> Column:
    return first_group(grade, YIELD_PATTERN)


def join_grade(quality: Column, yield_: Column) -> Column:
    """Final class from its two parts; a part that is outside or missing makes the whole so."""
    inside = quality.isin(QUALITY) & yield_.isin(YIELD)
    return F.when(inside, F.concat(quality, yield_)).otherwise(F.lit(OUTSIDE))


def yield_index(sex: Column, back_fat: Column, eye_area: Column, weight: Column) -> Column:
    """Yield index by sex; NULL for an unknown sex or a zero weight."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, (base, fat, area, mass, _, _) in YIELD_INDEX.items():
        total = F.lit(base) + back_fat * F.lit(fat) + eye_area * F.lit(area) + weight * F.lit(mass)
        out = out.when(sex == name, F.try_divide(total, weight.cast("double")) * F.lit(100.0))
    return out


def yield_grade(sex: Column, index: Column) -> Column:
    """A, B or C from the yield index and the limits of the sex."""
    out = F.when(index.isNull(), F.lit(None).cast("string"))
    for name, (*_, a_from, b_from) in YIELD_INDEX.items():
        mine = sex == name
        out = out.when(mine & (index >= a_from), "A").when(mine & (index >= b_from), "B").when(mine, "C")
    return out
