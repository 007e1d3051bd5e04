"""Filings and announcements: classification, selection rules, registry entries, citations and periods asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.periods import parse_period
from quillmark.functions.text import chinese_year
from quillmark.operators.manypatterns import contained

#: Words of announcements that are no reports. Fixed values.
NO_REPORT = ["董事会", "股东周年大会", "股东大会", "投票结果", "投票", "通函", "章程", "翌日披露", "翌日报表", "回购", "购回", "变动月报表", "证券变动", "邀请", "会议召开", "meeting", "notice of", "poll result", "任命", "辞任", "股权激励", "分红", "股息", "股票期权"]
#: Words of whole-year results. Fixed values.
YEAR_RESULTS = ["全年業績", "全年业绩", "年度業績", "年度业绩", "末期業績", "末期业绩", "年度業績報告", "年度业绩报告", "年度财报", "年度財報", "全年财报", "全年財報", "annual results"]
#: Words of annual and of interim reports. Fixed values.
ANNUAL_REPORT = ["annual report", "年度报告", "年度報告", "年度业绩公告", "年度業績公告", "全年业绩公告", "全年業績公告", "年度财报", "年度財報", "全年财报", "全年財報"]
INTERIM_REPORT = ["中期报告", "中期報告", "中期业绩", "中期業績", "interim report", "interim results", "半年报", "半年報"]
_CHINESE_DIGITS = "一二三四五六七八九"


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words, whatever their case."""
    low = F.lower(text)
    return reduce(lambda a, w: a | low.contains(w.lower()), words, F.lit(False))


def title_year(title: Column) -> Column:
    """The first year of a title: 20xx in digits, or four Chinese numerals."""
    digits = F.regexp_extract(title, r"(?<!\d)(20\d{2})(?!\d)", 1)
    numerals = F.regexp_extract(title, "([二〇○零]{2,}[〇○零一二三四五六七八九]{2})", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(chinese_year(F.substring(numerals, 1, 4)))


def closing_month(title: Column) -> Column:
    """The month that a reporting period of a title ends in (截至2024年6月 ...)."""
    raw = F.regexp_extract(title, r"截至(?:20\d{2}|[二〇○零一二三四五六七八九]{2,})年(\d{1,2}|[一二三四五六七八九十]{1,3})月", 1)
    ones = F.position(F.regexp_replace(raw, "^十", ""), F.lit(_CHINESE_DIGITS))
    numeral = F.when(raw == "十", 10).when(raw.startswith("十"), 10 + ones).when(F.length(raw) == 1, ones)
    return F.when(raw.rlike(r"^\d+$"), raw.cast("int")).when(raw != "", numeral.cast("int"))


def us_quarter(title: Column, month: Column) -> Column:
    """Q1 to Q4 by name, or by the last quarter that was over in the month of release."""
    named = F.regexp_extract(title, r"[Qq]\s*([1-4])", 1)
    chinese = F.regexp_extract(title, r"第\s*([一二三四1-4])\s*(?:季度|季)", 1)
    number = F.when(named != "", named).when(chinese != "", F.translate(chinese, "一二三四", "1234"))
    released = F.when(month.between(1, 3), "4").otherwise(F.floor((month - 1) / 3).cast("int").cast("string"))
    return F.concat(F.lit("Q"), F.coalesce(number, F.when(month.between(1, 12), released)))


def form_types(title: Column, month: Column) -> Column:
    """The kinds of report that a title announces, as an array; a half year is its second quarter too."""
    end = closing_month(title)
    year_words = has_any(title, YEAR_RESULTS)
    interim = has_any(title, ["六个月", "六個月", "interim", "中期"])
    quarter = has_any(title, ["三个月", "三個月", "九个月", "九個月", "十二个月", "十二個月"]) | year_words
    one = lambda *kinds: F.array(*map(F.lit, kinds))
    by_end = (
        F.when((end == 12) & year_words, one("FY")).when((end == 6) & interim, one("H1", "Q2")).when(quarter & end.isin(3, 6, 9, 12), F.array(F.concat(F.lit("Q"), F.floor(end / 3).cast("int").cast("string"))))
    )
    annual = (has_any(title, ["年报", "年報"]) & ~has_any(title, ["季报", "季報"])) | has_any(title, ANNUAL_REPORT)
    sec = F.when(has_any(title, ["10-k", "20-f"]), one("FY")).when(has_any(title, ["10-q", "8-k", "6-k"]), F.array(us_quarter(title, month)))
    found = F.coalesce(by_end, F.when(annual, one("FY")), F.when(has_any(title, INTERIM_REPORT), one("H1", "Q2")), sec)
    return F.when(~has_any(title, NO_REPORT), F.filter(found, lambda x: x.isNotNull()))


def classify(announcements: DataFrame, title: str = "title", year: str = "release_year", month: str = "release_month") -> DataFrame:
    """A row for each kind of report: form_type and fiscal_year beside the announcement's columns.

    Without a year in the title it is that of the release, or the one before for a year's (a fourth
    quarter's) report out in its first six (four) months."""
    t = F.coalesce(F.col(title), F.lit(""))
    rows = announcements.withColumn("_forms", form_types(t, F.col(month))).where(F.size("_forms") > 0)
    late = (F.array_contains("_forms", "FY") & (F.col(month) <= 6)) | (F.array_contains("_forms", "Q4") & (F.col(month) <= 4))
    released = F.when(F.col(year) > 0, F.when(late, F.col(year) - 1).otherwise(F.col(year)))
    rows = rows.withColumn("fiscal_year", F.coalesce(title_year(t), released).cast("int")).where("fiscal_year > 0")
    return rows.select(*announcements.columns, F.explode("_forms").alias("form_type"), "fiscal_year")


def title_passes(title: Column, kinds: list[str], words: list[str]) -> Column:
    """One of the file types and one of the words; an empty list asks for nothing."""
    ok = F.coalesce(title, F.lit("")) != ""
    for some in (kinds, words):
        ok = ok & (has_any(title, some) if some else F.lit(True))
    return ok


def file_passes(name: Column, title: Column, ticker: Column, suffixes: list[str] | None = None) -> Column:
    """Files of an accession folder to take: by suffix, or the main report of a 10-K or 10-Q, or a
    20-F and the first press exhibit of a 6-K."""
    low = F.lower(name)
    if suffixes:
        return reduce(lambda a, s: a | low.endswith(s.lower()), suffixes, F.lit(False))
    t = F.lower(ticker)
    main = low.startswith(t) & F.substr(low, F.length(t) + 1).rlike(r"^[-_]\d{8}\.html?$")
    foreign = low.endswith("20f.htm") | low.endswith("20f.html") | low.rlike(r"ex99[-_]?1(?![0-9])")
    return F.when(F.coalesce(name, F.lit("")) == "", False).when(has_any(title, ["10-K", "10-Q"]), main).when(has_any(title, ["6-K", "20-F"]), foreign).otherwise(False)


def is_complete(deleted: Column, deleted_too: Column, complete: Column) -> Column:
    """Not deleted, and not marked as incomplete; a missing mark is none."""
    return ~(F.coalesce(deleted, F.lit(False)) | F.coalesce(deleted_too, F.lit(False))) & F.coalesce(complete, F.lit(True))


def selection_reason(meta: Column, complete: Column, year: Column, first: str | None, last: str | None) -> Column:
    """Why a filing folder is left out (missing_meta, incomplete, out_of_range), or ``selected``."""
    y = year.cast("string")
    inside = y.isNotNull() & (F.lit(first).cast("string").isNull() | (y >= F.lit(first))) & (F.lit(last).cast("string").isNull() | (y <= F.lit(last)))
    return F.when(meta.isNull(), "missing_meta").when(~complete, "incomplete").when(~F.coalesce(inside, F.lit(False)), "out_of_range").otherwise("selected")


def security_passes(kind: Column, name: Column, kinds: list[str], derivatives: list[str]) -> Column:
    """Securities of the wanted kinds whose names mark no derivative."""
    of = lambda c, words: reduce(lambda a, w: a | F.coalesce(c, F.lit("")).contains(w), words, F.lit(False))
    return of(kind, kinds) & ~of(name, derivatives)


def exchange_name(code: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[code.cast("string")], F.lit("OTHER"))


def registry_entry(quotes: DataFrame, adr: list[str]) -> DataFrame:
    """symbol, market, file types and title words that a company's filings are sought by."""
    market = F.when(F.col("market").isin("US", "HK", "CN"), F.col("market")).otherwise("")
    none = F.array().cast("array<string>")
    words = lambda *w: F.array(*map(F.lit, w))
    kinds = F.when(market == "US", F.when(F.col("symbol").isin(adr), words("20-F", "6-K")).otherwise(words("10-K", "10-Q"))).otherwise(none)
    title = F.when(market == "CN", words("季度报告", "年度报告")).when(market == "HK", words("季度报告", "年度报告", "业绩公告", "财报公告")).otherwise(none)
    return quotes.select(F.trim("symbol").alias("ticker"), market.alias("market"), F.trim("name").alias("display_name"), kinds.alias("file_types"), title.alias("title_words"))


def canonical_period(period: Column, year: Column) -> Column:
    """A filing's own period if it is a whole one, else one made of its kind and fiscal year."""
    p = F.upper(F.trim(period))
    joined = F.when(p.startswith("FY"), F.concat(F.lit("FY"), year.cast("string"))).otherwise(F.concat(year.cast("string"), p))
    return F.when(p != "", F.coalesce(parse_period(p)["canonical"], parse_period(joined)["canonical"]))


def asked_periods(start: Column, end: Column) -> Column:
    """struct(from_year, to_year, period): the range of years that two periods ask for; the first's kind counts
    before the second's."""
    a, b = parse_period(start), parse_period(end)
    return F.struct(a["fy"].alias("from_year"), b["fy"].alias("to_year"), F.coalesce(a["canonical"], b["canonical"]).alias("period"))


def citation(place: Column, tags: Column, header: Column) -> Column:
    """[Cn] with ticker, year, period and heading (or the context's header), as far as there are any."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    parts = [filled(tags[k]) for k in ("ticker", "fiscal_year", "fiscal_period")]
    return F.concat_ws(" ", F.concat(F.lit("[C"), place.cast("string"), F.lit("]")), *parts, F.coalesce(filled(tags["heading"]), filled(header)))


def benchmarks(code: Column, currency: Column, by_market: dict[str, str], adr: list[str], default: str = "US.SPY") -> Column:
    """The indices to try, in order, for a security's beta: a chain for US listings that report in CNY."""
    market = F.regexp_extract(code, r"^([^.]*)\.", 1)
    own = F.coalesce(F.create_map(*(F.lit(x) for kv in by_market.items() for x in kv))[market], F.lit(default))
    return F.when((market == "US") & (currency == "CNY"), F.array_distinct(F.array(*map(F.lit, [*adr, default])))).otherwise(F.array(own))


def first_enough(candidates: DataFrame, counts: DataFrame, key: str, least: int = 24) -> DataFrame:
    """For each key the first of its candidates (an array) that has ``least`` months: key, benchmark, place."""
    rows = candidates.select(key, F.posexplode("candidates").alias("place", "benchmark"))
    held = rows.join(counts.where(F.col("n") >= least), "benchmark")
    return held.groupBy(key).agg(F.min(F.struct("place", "benchmark")).alias("x")).select(key, "x.benchmark", "x.place")


def alias_match(labels: DataFrame, aliases: DataFrame, label: str = "label") -> DataFrame:
    """Each label's segment code: an alias that equals it before one that it holds, then the alias's order.
    ``aliases`` (code, alias, place) may be of any size."""
    a = aliases.select("code", F.lower("alias").alias("_alias"), "place")
    low = F.lower(F.trim("_label"))
    hits = contained(labels.select(F.col(label).alias("_label")).distinct().withColumn("_low", low), "_low", a, "_alias").join(a, "_alias")
    best = F.min(F.struct(F.when(F.col("_low") == F.col("_alias"), 0).otherwise(1).alias("kind"), "place", "code"))
    found = hits.groupBy("_label").agg(best.alias("m")).select(F.col("_label").alias(label), F.col("m.code").alias("code"))
    return labels.join(found, label, "left").select(*labels.columns, "code")
