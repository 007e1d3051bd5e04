"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"
#: Upper-case words that look like tickers and aren't. Fixed values.
TICKER_STOP = ["Q1", "Q2", "Q3", "Q4", "FY", "H1", "H2", "YOY", "QOQ", "THE", "AND", "FOR", "HOW", "WHAT", "WHY", "CEO", "CFO", "GDP", "EPS", "ROE", "ROA", "PE", "PB", "MAU", "DAU", "ARPU", "GMV"]


def count_occurrences(text: Column, needle: Column | str) -> Column:
    """Non-overlapping occurrences; 0 for an empty or null side."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    found = (F.length(text) - F.length(F.replace(text, n, F.lit("")))) / F.length(n)
    return F.when((F.length(n) > 0) & text.isNotNull(), found.cast("int")).otherwise(0)


def ngrams(run: Column, n: int) -> Column:
    """Overlapping n-character pieces of a string."""
    size = F.length(run) - n
    return F.when(size >= 0, F.transform(F.sequence(F.lit(1), size + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def base_terms(question: Column) -> Column:
    """CJK 2-, 3- and 4-grams and whole runs of 2 to 8, then ASCII words of three or more."""
    runs = F.regexp_extract_all(question, F.lit(f"({CJK}+)"), F.lit(1))
    pieces = F.flatten(F.transform(runs, lambda r: F.concat(ngrams(r, 2), ngrams(r, 3), ngrams(r, 4), F.when(F.length(r).between(2, 8), F.array(r)).otherwise(F.array().cast("array<string>")))))
    return F.array_distinct(F.concat(pieces, F.regexp_extract_all(F.lower(question), F.lit(r"([a-z0-9]{3,})"), F.lit(1))))


def seed_terms(text: Column) -> Column:
    """CJK 2- and 3-grams, then ASCII words of two or more."""
    runs = F.regexp_extract_all(text, F.lit(f"({CJK}+)"), F.lit(1))
    pieces = F.flatten(F.transform(runs, lambda r: F.concat(ngrams(r, 2), ngrams(r, 3))))
    return F.array_distinct(F.concat(pieces, F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]{2,})"), F.lit(1))))


def keep_by_length(words: Column) -> Column:
    """Words of two characters or more, pure ASCII ones of three or more."""
    return F.filter(words, lambda w: F.when(w.rlike(r"^[\x00-\x7f]*$"), F.length(w) >= 3).otherwise(F.length(w) >= 2))


def cap(words: Column, n: int = 15) -> Column:
    return F.slice(F.array_distinct(words), 1, n)


def estimate_tokens(text: Column) -> Column:
    """ceil(CJK / 1.5) + floor(ASCII non-space / 4) + other characters that aren't space."""
    cjk = F.regexp_count(text, F.lit(CJK))
    ascii_ = F.regexp_count(text, F.lit(r"[\x21-\x7e]"))
    other = F.regexp_count(text, F.lit(r"[^\x00-\x7f\x{4e00}-\x{9fff}\s]"))
    return F.coalesce((F.ceil(cjk / 1.5) + F.floor(ascii_ / 4) + other).cast("bigint"), F.lit(0))


def hash16(seed: Column) -> Column:
    return F.substring(F.sha2(seed.cast("binary"), 256), 1, 16)


def abbreviate(text: Column, n: int = 600) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 3), F.lit("..."))).otherwise(t)


def citation_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"\[(\d+)\]", r"[C$1]")


def normalise_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\x{00a0}]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Pieces that end with sentence signs of either script, or at a line break; none empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[。！？；!?;])\n*|(?<=\.)\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def normalise_ticker(raw: Column) -> Column:
    """Upper case; a Hong Kong number gets five digits, a mainland one six."""
    t = F.upper(F.trim(raw))
    bare = F.regexp_replace(t, r"^(HK|SH|SZ|US|BJ)\.|\.(HK|SH|SZ|SS|US|BJ|O|N)$", "")
    return F.when(bare.rlike(r"^\d{1,5}$"), F.lpad(bare, 5, "0")).when(bare.rlike(r"^\d{6}$"), bare).otherwise(bare)


def market_of(ticker: Column) -> Column:
    t = normalise_ticker(ticker)
    return F.when(t.rlike(r"^\d{5}$"), "HK").when(t.rlike(r"^6\d{5}$"), "SH").when(t.rlike(r"^[03]\d{5}$"), "SZ").when(t.rlike(r"^[48]\d{5}$"), "BJ").when(t.rlike(r"^[A-Z][A-Z.\-]{0,9}$"), "US")


def tickers_in(text: Column) -> Column:
    """Numbers of four to six digits and words of two to five letters, however cased, that may be tickers."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"(?<![A-Z0-9_])(\d{4,6}|[A-Z]{2,5})(?![A-Z0-9_])"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda x: ~x.isin(TICKER_STOP))


def first_ticker(text: Column) -> Column:
    return F.try_element_at(tickers_in(text), F.lit(1))


def chinese_year(text: Column) -> Column:
    """二零二五 and 二〇二五 as 2025; other texts null."""
    digits = F.translate(text, "〇零○一二三四五六七八九", "000123456789")
    return F.when(digits.rlike(r"^\d{4}$"), digits.cast("int"))


def hierarchy(raw: Column) -> Column:
    """struct(name, level): tree signs are dropped, two leading spaces are a level."""
    lead = F.length(raw) - F.length(F.ltrim(raw))
    return F.struct(F.trim(F.regexp_replace(raw, r"^[\s├└│─]+", "")).alias("name"), (F.floor(lead / 2) + 1).cast("int").alias("level"))


def command_signature(args: Column) -> Column:
    """Numbers and quoted parts masked, space collapsed, so calls alike compare equal."""
    t = F.regexp_replace(F.regexp_replace(args, r"\"[^\"]*\"|'[^']*'", "?"), r"\d+", "#")
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, 200)


def camel_to_snake(name: str) -> str:
    return "".join(("_" if i and c.isupper() else "") + c.lower() for i, c in enumerate(name))


def format_big(x: Column) -> Column:
    """Numbers in 万, 亿 and 万亿, two decimals."""
    a = F.abs(x)
    show = lambda d, u: F.concat(F.format_string("%.2f", x / d), F.lit(u))
    return F.when(a >= 1e12, show(1e12, "万亿")).when(a >= 1e8, show(1e8, "亿")).when(a >= 1e4, show(1e4, "万")).otherwise(show(1.0, ""))


def scale_int(value: Column, pow10: int, decimals: int | None = None) -> Column:
    """A scaled integer as decimal, digits past ``decimals`` dropped."""
    p = pow10 if decimals is None else decimals
    x = value.cast(f"decimal(38,{max(pow10, 1)})") / F.lit(10**pow10).cast("decimal(20,0)")
    f = F.lit(10**p).cast("decimal(20,0)")
    return (F.when(x >= 0, F.floor(x * f)).otherwise(F.ceil(x * f)) / f).cast(f"decimal(38,{p})")


def json_keywords(text: Column) -> Column:
    """A JSON list of words, also from within a fenced block or behind an object's ``keywords``."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)^.*?```(?:json)?\s*", ""), r"(?s)```.*$", "")
    return F.coalesce(F.from_json(bare, "array<string>"), F.from_json(bare, "struct<keywords:array<string>>")["keywords"])


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://(?:[^/@]*@)?([^/:?#]+)", 1))


def domain_allowed(url: Column, allow: list[str] | None = None, deny: list[str] | None = None) -> Column:
    """Host equal to, or under, one of ``allow`` (if any) and none of ``deny``."""
    h = url_host(url)

    def under(domains: list[str] | None) -> Column:
        return reduce(lambda a, d: a | (h == d) | h.endswith("." + d), domains or [], F.lit(False))

    return (under(allow) if allow else F.lit(True)) & ~under(deny)
