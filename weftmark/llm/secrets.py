"""Secret scan with DataFrame functions: fixed patterns, and character Markov models for strings without a mark.

Two models give the chance of a character after another, one for random strings and one for ordinary identifiers. A run of
key characters is a secret if its log-likelihood ratio under the two is high enough. Both are trained from labelled
samples: strings made from digests of the document numbers, and words of documents, alone and joined to identifiers.

Positions count code points, ends are exclusive. A null or empty text has no spans. Repeated rows each get their row. An
empty input gives an empty table; the models then know no samples and find nothing. Extra columns are not read, or kept by
``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.llm.batches import documents, set_aside

# Kinds in order with their patterns
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

RUN = r"[A-Za-z0-9+/_=-]{20,}"
# nats by which a random string must be likelier, in all and for each character
MIN_RATIO = 15.0
MIN_RATE = 0.4
SMOOTHING = 0.5
# documents whose words are samples of ordinary identifiers, and numbers whose digests are samples of random strings
SAMPLE_DOCS = 5000
SALTS = 16
MASK = "[SECRET]"

# characters are numbered from the blank
_CODES = 96
# elements summed in order at a time
_BLOCK = 512


def _running(lengths: Column, start: Column) -> Column:
    """Sums of the array up to each element, that included."""

    def step(state, x):
        now = state["at"] + x
        return F.struct(now.alias("at"), F.concat(state["out"], F.array(now)).alias("out"))

    first = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(lengths, first, step)["out"]


def running_sums(lengths: Column) -> Column:
    """As ``_running`` from 0, in blocks, so that the work grows less than with the square of the length."""
    zero = F.lit(0).cast("bigint")
    count = F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    sums = F.transform(blocks, lambda x: F.aggregate(x, zero, lambda a, b: a + b))
    before = F.zip_with(_running(sums, zero), sums, lambda a, b: a - b)
    parts = F.zip_with(blocks, before, _running)
    return F.when(F.size(lengths) <= _BLOCK, _running(lengths, zero)).otherwise(F.flatten(parts))


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")


def _spans(text: str, pattern: str, found: str, kind: int) -> Column:
    """Spans of all matches ``found`` of the pattern, from the lengths of what lies between them."""
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    steps = F.transform(
        found, lambda m, i: F.get(between, i).cast("bigint") + F.when(i > 0, F.char_length(F.get(found, i - 1))).otherwise(0)
    )
    spans = F.zip_with(
        running_sums(steps), found,
        lambda at, m: F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.char_length(m)).alias("end")),
    )
    return F.when(F.size(found) > 0, spans).otherwise(_none())


def sample_strings(docs: DataFrame) -> DataFrame:
    """Labelled samples: text and random (true or false).

    Of up to ``SAMPLE_DOCS`` documents, those with the smallest hashes of their numbers: ``SALTS`` digests of the number
    in four writings, and the words, alone and joined.
    """
    picked = docs.select(F.col("doc_id").alias("picked"), F.xxhash64("doc_id").alias("hash")).where("picked IS NOT NULL")
    picked = picked.distinct().orderBy("hash", "picked").limit(SAMPLE_DOCS).select("picked")
    digest = F.sha2(F.concat_ws(":", "picked", "salt"), 256)
    writings = F.array(digest, F.upper(digest), F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")))
    salted = picked.select("picked", F.explode(F.sequence(F.lit(1), F.lit(SALTS))).alias("salt"))
    random = salted.select(F.explode(writings).alias("text"), F.lit(True).alias("random"))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("picked"), "left_semi")
    # assigned values and long runs with digits are what is looked for, not samples of the ordinary
    clean = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), "(?=[A-Za-z+/_=-]*[0-9])" + RUN, " ")
    words = texts.select(F.regexp_extract_all(clean, F.lit("[A-Za-z0-9]+"), F.lit(0)).alias("words"))

    def joined(w, i):
        after = F.coalesce(F.get("words", i + 1), F.lit(""))
        sign = F.element_at(F.array(*map(F.lit, ("", "_", "-", "/", "+", "="))), (i % 6 + 1).cast("int"))
        return F.when(sign == "", F.concat(w, F.initcap(after))).otherwise(F.concat(w, sign, after))

    both = F.concat("words", F.transform("words", joined))
    ordinary = words.where("words IS NOT NULL").select(F.explode(both).alias("text"), F.lit(False).alias("random"))
    return random.union(ordinary)


def train_ratios(samples: DataFrame) -> list[float]:
    """Log ratio of the two chances of each character after each other one, from samples (text, random).

    The samples are counted on the executors; one number for each pair of characters and label comes back.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("text") - 1), lambda i: F.substring("text", i, 2))
    counted = (
        samples.where(F.char_length("text") > 1)
        .select("random", F.explode(pairs).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    tables = {True: {}, False: {}}
    for row in counted:
        codes = [ord(c) - 32 for c in row["pair"]]
        if all(0 <= c < _CODES for c in codes):
            tables[row["random"]][tuple(codes)] = row["count"]
    seen = sorted({c for t in tables.values() for pair in t for c in pair})
    out = [0.0] * (_CODES * _CODES)
    totals = {k: [sum(t.get((a, b), 0) for b in seen) for a in range(_CODES)] for k, t in tables.items()}
    for a in seen:
        for b in seen:
            p, q = (
                (tables[k].get((a, b), 0) + SMOOTHING) / (totals[k][a] + SMOOTHING * len(seen)) for k in (True, False)
            )
            out[a * _CODES + b] = round(math.log(p / q), 4)
    return out


def ratio_of(text: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string of the characters of ``RUN``."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) - 32)

    def step(state, code):
        ratio = F.when(state["last"] >= 0, F.get(table, state["last"] * _CODES + code)).otherwise(0.0)
        return F.struct(code.alias("last"), (state["sum"] + ratio).alias("sum"))

    return F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step)["sum"]


def with_spans(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Add ``_base`` and ``_spans``: arrays of (start, kind, end) by start, then kind; the second has all spans."""
    none = F.array().cast("array<string>")
    found = docs.withColumns({
        f"_{name}": F.coalesce(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), none)
        for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", f"[0-9a-f]{{{HEX_LENGTH},}}"), ("random", RUN))
    })
    values = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))
    found = found.withColumns({
        "_value": F.when(F.size("_assign") > 0, values).otherwise(none),
        # a run of hex digits that is long enough matches whole, so the length can be asked in the pattern
        "_b2": _spans("text", f"[0-9a-f]{{{HEX_LENGTH},}}", "_hex", 2),
        "_b1": F.filter(_spans("text", ACCESS, "_access", 1), lambda s: s["end"] - s["start"] >= ACCESS_LENGTH),
        "_b0": _spans("text", ASSIGN, "_assign", 0),
        "_likely": F.filter(
            F.transform(
                F.when(F.size("_random") > 0, F.col("_random")).otherwise(none),
                lambda m: ratio_of(m, ratios) >= F.greatest(F.lit(MIN_RATIO), MIN_RATE * F.char_length(m)),
            ),
            lambda _: F.lit(True),
        ),
    })
    # the likelihood decides before positions are looked for
    spans = _spans("text", RUN, "_random", 3)
    added = F.when(
        F.exists("_likely", lambda x: x), F.filter(spans, lambda s, i: F.get("_likely", i))
    ).otherwise(_none())
    long_value = F.filter("_b0", lambda s, i: F.char_length(F.get("_value", i)) >= ASSIGN_VALUE)
    found = found.withColumns({"_base": F.array_sort(F.concat(long_value, "_b1", "_b2")), "_added": added})
    new = F.filter(
        "_added", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    found = found.withColumn("_spans", F.array_sort(F.concat("_base", new)))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), "_base", "_spans")


def _text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_random: what the models add."""
    rows = documents(docs)
    found = with_spans(rows, train_ratios(sample_strings(rows)))
    return found.select(
        "doc_id", *(_count("_base", n).alias(f"n_{kind}") for n, kind in enumerate(KINDS[:3])), F.sha2(_text("_base"), 256).alias("base_sha256"),
        _text("_spans").alias("spans"), _count("_spans", 3).alias("n_random"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by ``MASK``; n_chars, where there is one, follows the text."""
    rows, restore = set_aside(docs, "doc_id", "text", "n_chars")
    found = with_spans(rows, train_ratios(sample_strings(documents(docs))))

    def step(state, s):
        gap = F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        grown = F.when(s["start"] >= state["at"], F.concat(state["out"], gap, F.lit(MASK))).otherwise(state["out"])
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), grown.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate("_spans", start, step)
    text = F.when(F.size("_spans") > 0, F.concat(done["out"], F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))).otherwise(F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in rows.columns:
        length = F.char_length("text").cast(rows.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.size("_spans") > 0, length).otherwise(F.col("n_chars")))
    return restore(found)
