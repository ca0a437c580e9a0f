"""Localised numbers, months and explanations (ru, zh)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.calendar import MONTHS

#: Characters that HTML reserves (the ampersand first), and the opening braces of templates.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("{{", "{ {"))
THIN = "\u202f"
#: Month names by case, and explanation templates by class.
PREPOSITIONAL = ("январе", "феврале", "марте", "апреле", "мае", "июне", "июле", "августе", "сентябре", "октябре", "ноябре", "декабре")
GENITIVE = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
EXPLAIN = {
    "ru": {
        "GROWING": "рост к прогнозу в {ratio} раза, рост идёт {months} мес.",
        "SEASONAL": "устойчивая сезонность без роста",
        "FALLING": "в {ratio} раза реже прогноза",
        "STABLE": "стабильный спрос",
    },
    "zh": {"GROWING": "较预测增长{ratio}倍，增长已持续{months}个月", "SEASONAL": "稳定季节性，无增长", "FALLING": "比预测低{ratio}倍", "STABLE": "需求平稳"},
}


def normalize_locale(raw: Column) -> Column:
    return F.when(F.lower(F.element_at(F.split(F.replace(raw, F.lit("_"), F.lit("-")), "-"), 1)) == "zh", "zh").otherwise("ru")


def format_number(value: Column, locale: str = "ru") -> Column:
    grouped = F.format_number(value, 0)
    return grouped if locale == "zh" else F.replace(grouped, F.lit(","), F.lit(THIN))


def format_share(value: Column, locale: str = "ru") -> Column:
    """A share in percent with four decimals."""
    text = F.replace(F.format_number(value, 4), F.lit(","), F.lit(""))
    return F.concat(text, F.lit("%")) if locale == "zh" else F.concat(F.replace(text, F.lit("."), F.lit(",")), F.lit(THIN + "%"))


def _decimal(value: Column, places: int, locale: str) -> Column:
    text = F.replace(F.format_number(value, places), F.lit(","), F.lit(""))
    return text if locale == "zh" else F.replace(text, F.lit("."), F.lit(","))


def format_score(value: Column, locale: str = "ru") -> Column:
    return _decimal(value, 2, locale)


def format_ratio(value: Column, locale: str = "ru") -> Column:
    return _decimal(value, 1, locale)


def _name(number: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), number)


def format_month(period: Column, locale: str = "ru") -> Column:
    if locale == "zh":
        return F.concat(F.year(period).cast("string"), F.lit("年"), F.month(period).cast("string"), F.lit("月"))
    return F.concat(_name(F.month(period), MONTHS), F.lit(" "), F.year(period).cast("string"))


def format_month_name(month: Column, locale: str = "ru", case: str = "prepositional") -> Column:
    if locale == "zh":
        return F.concat(month.cast("string"), F.lit("月"))
    return _name(month, {"prepositional": PREPOSITIONAL, "nominative": MONTHS, "genitive": GENITIVE}[case])


def format_date(day: Column, locale: str = "ru") -> Column:
    y, m, d = F.year(day).cast("string"), F.month(day), F.dayofmonth(day).cast("string")
    if locale == "zh":
        return F.concat(y, F.lit("年"), m.cast("string"), F.lit("月"), d, F.lit("日"))
    return F.concat(d, F.lit(" "), _name(m, GENITIVE), F.lit(" "), y, F.lit(" г."))


def display_phrase(phrase: Column, translation: Column, locale: str = "ru") -> Column:
    if locale == "ru":
        return phrase
    return F.when(translation.isNotNull(), F.concat(translation, F.lit("（"), phrase, F.lit("）"))).otherwise(phrase)


def escape_data(value: Column) -> Column:
    """Text that is safe inside HTML and holds no opening template braces."""
    out = value.cast("string")
    for mark, shown in ESCAPES:
        out = F.replace(out, F.lit(mark), F.lit(shown))
    return out


def explain(klass: Column, score: Column, age: Column, locale: str = "ru") -> Column:
    """Why a phrase is listed: the class's template with ratio and months filled in."""
    template = F.try_element_at(F.create_map(*[F.lit(x) for p in EXPLAIN[locale].items() for x in p]), klass)
    with_ratio = F.replace(template, F.lit("{ratio}"), F.coalesce(format_ratio(score, locale), F.lit("")))
    return F.replace(with_ratio, F.lit("{months}"), F.coalesce(age, F.lit(1)).cast("string"))


def chart_points(values: Column, width: float = 100.0, height: float = 100.0) -> Column:
    """x in even steps, y down from the height by value over maximum."""
    top, n = F.array_max(values), F.size(values)
    y = lambda v: F.lit(height) - F.coalesce(F.try_divide(v, top), F.lit(0.0)) * height
    return F.transform(values, lambda v, i: F.struct((F.coalesce(F.try_divide(i * F.lit(width), n - 1), F.lit(0.0))).alias("x"), y(v).alias("y")))
