"""Personal-data scan: 15 categories over text columns, in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftmark.functions.stats import char_entropy

# Category -> severity, pattern, column-name keywords.
RULES = {
    "email": ("high", r"[\w\.+-]+@[\w\.-]+\.\w+", ("email", "e-mail", "mail", "contact")),
    "phone": (
        "high",
        r"\b\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b",
        ("phone", "mobile", "tel", "contact", "fax"),
    ),
    "credit_card": ("critical", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", ("card", "cc", "credit", "payment")),
    "ssn": ("critical", r"\b\d{3}-\d{2}-\d{4}\b", ("ssn", "social", "security", "tax_id")),
    "ip_address": ("medium", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", ("ip", "ip_address", "ipaddr")),
    "date_of_birth": ("high", r"\b\d{4}-\d{2}-\d{2}\b", ("dob", "birth", "birth_date", "born")),
    "passport": ("critical", r"\b[A-Z]{1,2}\d{6,9}\b", ("passport", "passport_no")),
    "driver_license": ("high", r"\b[A-Z]\d{3,7}\b", ("license", "driver", "driving")),
    "bank_account": ("critical", r"\b\d{8,17}\b", ("account", "bank", "iban", "aba")),
    "health_insurance": (
        "high",
        r"\b[A-Z]{2,3}\d{6,12}\b",
        ("insurance", "health", "medicare", "medicaid"),
    ),
    "street_address": (
        "medium",
        r"\b\d{1,5}\s+[A-Za-z]+\s+(Street|Ave|Road|Drive|Lane|Blvd|Court|Way)\b",
        ("address", "street", "location", "addr"),
    ),
    "zip_code": ("medium", r"\b\d{5}(?:-\d{4})?\b", ("zip", "postal", "postcode", "zip_code")),
    "url": ("low", r"https?://[^\s/$.?#].[^\s]*", ("url", "website", "link", "web")),
    "api_key": (
        "critical",
        r"\b(?:sk-[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|AIza[0-9A-Za-z_-]{35})\b",
        ("api_key", "api", "secret", "token"),
    ),
    "password_hash": (
        "critical",
        r"\b\$2[ayb]\$\d{2}\$[./A-Za-z0-9]{53}\b",
        ("password", "hash", "bcrypt", "passwd"),
    ),
}
CATEGORIES = tuple(RULES)
# Text that every match of a category holds; looking for it first spares most rows the pattern.
REQUIRED_TEXT = {
    "url": ("http",),
    "api_key": ("sk-", "AKIA", "ghp_", "AIza"),
    "password_hash": ("$2",),
}
# Categories all of whose matches lie within words with digits and single signs or spaces between such words.
DIGIT_KINDS = (
    "phone", "credit_card", "ssn", "ip_address", "date_of_birth", "passport", "driver_license", "bank_account", "health_insurance",
    "zip_code",
)
STREET_WORDS = ("Street", "Ave", "Road", "Drive", "Lane", "Blvd", "Court", "Way")
# Words are parted by white space. A run of words without a digit, and one of words without an at sign.
_NO_DIGIT = r"(?U)(?<!\S)[^\s\d]++(?!\S)(?:\s++[^\s\d]++(?!\S))*+"
_NO_AT = r"(?U)(?<!\S)[^\s@]++(?!\S)(?:\s++[^\s@]++(?!\S))*+"
# Stands for such a run: no match holds it, and \b sees the same beside it as beside the run with its white space.
_LEFT_OUT = "#"
# What a text holds if any rule can match in it.
_SOMETHING = r"(?U)[\d@]|http|sk-|AKIA|ghp_|AIza"
ENTROPY_CHECKED = ("credit_card", "api_key", "password_hash")
MIN_ENTROPY = 0.1
MIN_ZIP_LENGTH = 5
# The shortest match that any rule has, as a driver's license.
MIN_MATCH = 4
# Rows of short texts that a task searches, about.
TASK_ROWS = 1 << 16


def text_columns(df: DataFrame, hints: Sequence[str] | None = None) -> list[str]:
    """The hinted columns that exist, or else all string columns."""
    if hints:
        return [c for c in hints if c in df.columns]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def _search(text: Column, category: str) -> Column:
    """All matches of a category in a text. ``(?U)`` gives \\w, \\d, \\s and \\b their Unicode meaning."""
    return F.regexp_extract_all(text, F.lit("(?U)" + RULES[category][1]), F.lit(0))


def _where(possible: Column, matches: Column) -> Column:
    return F.when(possible, matches).otherwise(F.array().cast("array<string>"))


def _holds(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def digit_words(text: Column) -> Column:
    """The words with digits and the white space around them; what lies between is left out."""
    return F.regexp_replace(text, _NO_DIGIT, _LEFT_OUT)


def at_words(text: Column) -> Column:
    return F.when(text.contains("@"), F.regexp_replace(text, _NO_AT, _LEFT_OUT)).otherwise("")


def found_in(text: Column, category: str, digits: Column, ats: Column) -> Column:
    """All matches of a category, looked for where they can be: in the words with digits, those with an at sign, or the text."""
    if category in DIGIT_KINDS:
        return _search(digits, category)
    if category == "email":
        return _search(ats, category)
    needed = STREET_WORDS if category == "street_address" else REQUIRED_TEXT[category]
    return _where(_holds(text, needed), _search(text, category))


def found(text: Column, category: str) -> Column:
    """All matches of one category in a text."""
    return found_in(text, category, digit_words(text), at_words(text))


def keep_match(category: Column, match: Column) -> Column:
    """Low-entropy keys, cards and hashes and short zip codes are no findings."""
    plain = F.regexp_replace(match, "[^a-zA-Z0-9]", "")
    dull = category.isin(*ENTROPY_CHECKED) & (char_entropy(plain) < MIN_ENTROPY)
    short = (category == "zip_code") & (F.length(match) < MIN_ZIP_LENGTH)
    return ~(dull | short)


def text_rows(df: DataFrame, table: str, *, hints: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row per text: the given key columns, table, column and text."""
    columns = text_columns(df, hints)
    if not columns:
        none = [F.lit("").alias(c) for c in ("column_name", "_text")]
        return df.where("false").select(*keys, F.lit(table).alias("table_name"), *none)
    texts = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("_text")) for c in columns]
    )
    return df.select(*keys, F.lit(table).alias("table_name"), F.inline(texts))


def deal_short_texts(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows dealt by key to as many tasks as ``size``, their number, asks for.

    Spark cuts files by compressed bytes. Of short texts such as names and numbers millions stand in one cut, and each may be a
    match of its own that the task holds until it is counted.
    """
    return rows.repartition(max(1, -(-size // TASK_ROWS)), key)


def matches_in(texts: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """``raw_matches_in`` without what the entropy and length rules drop."""
    return raw_matches_in(texts, categories).where(keep_match(F.col("category"), F.col("match")))


def raw_matches_in(texts: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row per match in ``text_rows`` of any number of tables: their other columns, category and match.

    Each text is unfolded into its matches per category, and those into single matches. Texts without a digit, an at sign or the
    beginning of a key or address drop out first. One pass over a text keeps the words with digits, and another, where it has an
    at sign, the words with one; each rule then looks only at its kind.
    """
    text, own = F.col("_text"), [c for c in texts.columns if c != "_text"]
    digits, ats = F.col("_digits"), F.col("_ats")
    hits = F.array(*[F.struct(F.lit(c).alias("category"), found_in(text, c, digits, ats).alias("_found")) for c in categories])
    return (
        texts.where((F.octet_length(text) >= MIN_MATCH) & text.rlike(_SOMETHING))
        .select("*", digit_words(text).alias("_digits"), at_words(text).alias("_ats"))
        .select(*own, F.inline(hits))
        .select(*own, "category", F.explode("_found").alias("match"))
    )


def pii_matches(
    df: DataFrame,
    table: str,
    *,
    hints: Sequence[str] | None = None,
    categories: Sequence[str] = CATEGORIES,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per match in one table: the given key columns, table_name, column_name, category, match."""
    return matches_in(text_rows(df, table, hints=hints, keys=keys), categories)


def _any_keyword(category: str, column: Column) -> Column:
    hit = F.lit(False)
    for word in RULES[category][2]:
        hit = hit | F.lower(column).contains(word)
    return hit


def pii_report(matches: DataFrame, samples: int = 5) -> DataFrame:
    """Per table, column and category: matches, the first distinct samples, confidence and severity.

    Equal matches are merged before the shuffle, and counts and samples read that one exchange, so the texts are searched
    once and no match is written anywhere. Only the smallest ``samples`` values of a category travel to its last task.
    """
    key = ["table_name", "column_name", "category"]
    distinct = matches.groupBy(*key, "match").agg(F.count("*").alias("n"))
    totals = distinct.groupBy(*key).agg(F.sum("n").alias("matches"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("match"))
    first = (
        distinct.withColumn("_rank", rank)
        .where(F.col("_rank") <= samples)
        .groupBy(*key)
        # with the count, so that this side needs the same exchange as the totals
        .agg(F.array_sort(F.collect_list(F.struct("match", "n")))["match"].alias("sample_values"))
    )
    severity, named = F.lit(None).cast("string"), F.lit(False)
    for category, (level, _, _) in RULES.items():
        here = F.col("category") == category
        severity = F.when(here, level).otherwise(severity)
        named = named | (here & _any_keyword(category, F.col("column_name")))
    return totals.join(first, key).select(
        *key,
        "matches",
        "sample_values",
        F.when(named, "high").otherwise("medium").alias("confidence"),
        severity.alias("severity"),
    )


def pii_scan(df: DataFrame, table: str, hints: Sequence[str] | None = None, samples: int = 5) -> DataFrame:
    return pii_report(pii_matches(df, table, hints=hints), samples)
