"""Column expressions of the evidence model: parsing, scoring, labels. No Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed scores of the confidence model.
TIER_SCORES = {"gold": 35, "silver": 22}
TIER_DEFAULT = 15
EXTRACTED, CONTEXT_FIELD, WITH_URL = 30, 6, 5
RECENT, RECENT_ENOUGH = 5, 3
HIGH, MEDIUM = 70, 40
TIERS = ("gold", "silver", "bronze")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key(c: Column | str) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(F.trim(col(c)))


def is_blank(c: Column | str) -> Column:
    """Null, white space, or the text `nan`."""
    return F.coalesce(key(c).isin("", "nan"), F.lit(True))


def blank_to_null(c: Column | str) -> Column:
    return F.when(~is_blank(c), F.trim(col(c)))


def is_stub(c: Column | str) -> Column:
    """A value that points elsewhere instead of giving a number: blank, or `see link`."""
    return is_blank(c) | F.coalesce(F.contains(key(c), F.lit("see link")), F.lit(False))


def first_number(c: Column | str) -> Column:
    """The first number outside brackets, with thousands separators; signs are ignored; null for stubs."""
    bare = F.regexp_replace(col(c), r"\s*\([^)]*\)\s*", " ")
    found = F.regexp_extract(bare, r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)", 1)
    return F.when(~is_stub(c), F.replace(found, F.lit(","), F.lit("")).try_cast("double"))


def plain_number(c: Column | str) -> Column:
    """The whole text as a number, else null: `21,000` gives null, and so does `nan`."""
    return F.when(~is_blank(c), F.trim(col(c)).try_cast("double"))


def tier_rank(c: Column | str) -> Column:
    return F.when(key(c) == "gold", 0).when(key(c) == "silver", 1).otherwise(2)


def loose_year(c: Column | str) -> Column:
    """The first four digits that begin a token; dashes part tokens."""
    return F.regexp_extract(F.translate(col(c), "-", " "), r"(?:^|\s)(\d{4})", 1).try_cast("int")


def strict_year(c: Column | str) -> Column:
    """The text before the first dash, if that is an integer."""
    return F.trim(F.split_part(col(c), F.lit("-"), F.lit(1))).try_cast("int")


def recent_year(c: Column | str) -> Column:
    """The first 19xx or 20xx anywhere."""
    return F.regexp_extract(col(c), r"(20\d{2}|19\d{2})", 1).try_cast("int")


def tier_score(c: Column | str) -> Column:
    return reduce(lambda w, kv: w.when(key(c) == kv[0], kv[1]), TIER_SCORES.items(), F.when(F.lit(False), 0)).otherwise(TIER_DEFAULT)


def recency_score(c: Column | str, as_of: int) -> Column:
    y = recent_year(c)
    return F.when(y >= as_of - 1, RECENT).when(y >= as_of - 5, RECENT_ENOUGH).otherwise(0)


def confidence_score(as_of: int, tier: str = "source_tier", value: str = "value", url: str | Column = "source_url", year: str = "year_or_range", context: tuple[str, ...] = ("definition", "year_or_range", "geography", "population")) -> Column:
    """Tier, extraction, completeness, recency and URL points, between 0 and 100. url is a column's name, or whether there is one."""
    complete = sum((F.when(is_blank(c), 0).otherwise(CONTEXT_FIELD) for c in context), F.lit(0))
    points = tier_score(tier) + F.when(is_stub(value), 0).otherwise(EXTRACTED) + complete + recency_score(year, as_of) + F.when(~is_blank(url) if isinstance(url, str) else url, WITH_URL).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def confidence_label(score: Column | str) -> Column:
    return F.when(col(score) >= HIGH, "high").when(col(score) >= MEDIUM, "medium").otherwise("low")


def legacy_confidence(c: Column | str) -> Column:
    """Labels pass in lower case; numbers from 0 to 1 become labels; other text is kept."""
    n = key(c).try_cast("double")
    label = F.when(n >= 0.7, "high").when(n >= 0.4, "medium").otherwise("low")
    return F.when(key(c).isin("high", "medium", "low"), key(c)).when((n >= 0) & (n <= 1), label).otherwise(col(c))


def resolve_url(citation: Column | str, keys: list[tuple[str, str]], whole_words: bool = False) -> Column:
    """An embedded URL, else an article id's page, else the first key that the citation contains, in the keys' order."""
    c = col(citation)
    embedded = F.regexp_replace(F.regexp_extract(c, r"(https?://[^\s)\]\"']+)", 1), r"[.,;)]+$", "")
    article = F.regexp_extract(c, r"(?i)PMID[:\s]+(\d{6,10})", 1)
    hit = (lambda k: key(c).rlike(rf"\b{k}\b")) if whole_words else (lambda k: F.contains(F.lower(c), F.lit(k)))
    by_key = F.coalesce(*[F.when(hit(k), F.lit(u)) for k, u in keys], F.lit(None).cast("string"))
    return F.when(embedded != "", embedded).when(article != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), article, F.lit("/"))).otherwise(by_key)


def has_url(citation: Column | str, keys: list[tuple[str, str]], whole_words: bool = False) -> Column:
    """Whether resolve_url() finds one, without making it."""
    c = col(citation)
    hit = (lambda k: key(c).rlike(rf"\b{k}\b")) if whole_words else (lambda k: F.contains(F.lower(c), F.lit(k)))
    return F.coalesce(reduce(lambda a, b: a | b, [hit(k) for k, _ in keys], c.rlike(r"https?://[^\s)\]\"']|(?i:PMID)[:\s]+\d{6}")), F.lit(False))


def slug(c: Column | str) -> Column:
    """Lower case, with `_` for any run of other characters, and none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def fill_template(url: Column | str, values: dict[str, str]) -> Column:
    """`{name}` as the plain value, `{name_q}` as the value encoded for a query string."""
    out = col(url)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(value))
        out = F.replace(out, F.lit("{" + name + "_q}"), F.url_encode(F.lit(value)))
    return out


def first_class(text: Column | str, classes: list[tuple[str, list[str]]], default: str = "value") -> Column:
    """The first class with a keyword in the text."""
    c = F.lower(col(text))
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    return F.coalesce(*[F.when(has(words), F.lit(name)) for name, words in classes], F.lit(default))


def match_text(c: Column | str) -> Column:
    """Trimmed lower case with every kind of dash as `-`, for keyword rules."""
    return F.translate(key(c), "\u2010\u2011\u2012\u2013\u2014\u2212", "------")


def candidates(text: Column | str, rules: list[tuple[list[str], str]]) -> Column:
    """The names of all rules with a keyword in the text, in the rules' order, each once."""
    c = match_text(text)
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    return F.array_distinct(F.array_compact(F.array(*[F.when(has(words), F.lit(name)) for words, name in rules])))


def plausible_number(c: Column | str, years: tuple[int, int] = (1900, 2050), versions: bool = True) -> Column:
    """A number of 0.01 or more that is neither a year nor, with versions, a text such as 2.2025."""
    text = F.regexp_replace(col(c), "[, ]", "")
    n = text.try_cast("double")
    year = (n >= years[0]) & (n <= years[1]) & ~F.contains(text, F.lit("."))
    version = text.rlike(r"^\d+\.\d{4}$") if versions else F.lit(False)
    return F.coalesce((n >= 0.01) & ~year & ~version, F.lit(False))


def relevance(text: Column | str, reference: Column | str, terms: list[str]) -> Column:
    """Jaccard similarity of the words of three letters or more, plus 0.07 for each term in the text, up to six."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-zA-Z]{3,}"), F.lit(0)))
    a, b = words(text), words(reference)
    shared, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    bonus = sum((F.contains(F.lower(col(text)), F.lit(t)).cast("int") for t in terms), F.lit(0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.greatest(either, F.lit(1)) + 0.07 * F.least(bonus, F.lit(6)))


def same_percent(new: Column | str, old: Column | str) -> Column:
    """A new percentage on the scale of the old share: over 1 against a share is divided by 100, and dropped if still over 1.5."""
    n, o = col(new), col(old)
    scaled = F.when(o.between(0, 1) & (n > 1), n / 100).otherwise(n)
    return F.when(o.between(0, 1) & (scaled > 1.5), F.lit(None).cast("double")).otherwise(F.round(scaled, 4))


def clean_cell(c: Column | str) -> Column:
    """A table cell without white space and percent signs at its end; `-` and blanks are null."""
    text = F.regexp_replace(F.trim(col(c)), r"[%\s]+$", "")
    return F.when(~text.isin("", "-"), text)


def safe_name(c: Column | str) -> Column:
    """A name for files and partitions: blanks as `_`, without commas; blank and null are `unknown`."""
    return F.coalesce(F.nullif(F.trim(F.translate(col(c), " ,", "_")), F.lit("")), F.lit("unknown"))


def mapped_key(c: Column | str, keys: list[str], names: dict[str, str]) -> Column:
    """A trimmed label that is a key itself, or else the key that names give it; null for others and for blanks."""
    label = F.trim(col(c))
    return F.coalesce(F.when(label.isin(keys), label), *[F.when(label == k, F.lit(v)) for k, v in names.items()], F.lit(None).cast("string"))


def aliases_of(context: Column | str, table: list[tuple[str, list[str]]]) -> Column:
    """The alias list of the first key that the lower-case context contains; else the context itself, or none if it is blank."""
    c = key(context)
    lists = [F.when(F.contains(c, F.lit(k)), F.array(*[F.lit(a) for a in names])) for k, names in table]
    return F.coalesce(*lists, F.when(c != "", F.array(c)), F.array().cast("array<string>"))


def phrases(text: Column | str, rules: list[tuple[list[list[str]], list[str], list[str]]], suffix: str) -> Column:
    """The phrases to search for a label: those of the first rule that fits, in its order.

    A rule is (alternatives, none of, phrases): it fits if all words of one alternative are in the text, and none of the words
    ruled out. Without a rule it is the label without what stands in brackets, alone and with the suffix; for a blank one the suffix alone.
    """
    c = F.coalesce(match_text(text), F.lit(""))
    has = lambda w: F.contains(c, F.lit(w))
    fits = lambda ways, none: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(has, way)) for way in ways]) & ~reduce(lambda a, b: a | b, map(has, none), F.lit(False))
    base = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s*\([^)]*\)\s*", " "))
    plain = F.when(base != "", F.array(base, F.concat(base, F.lit(" " + suffix)))).otherwise(F.array(F.lit(suffix)))
    return F.coalesce(*[F.when(fits(ways, none), F.array(*map(F.lit, out))) for ways, none, out in rules], plain)
