"""Registered queries over texts, vectors and the run-event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmark.functions.stats import text_entropy
from weftmark.operators import candidates, pii, runlog, vectors
from weftmark.operators.profile import union_all
from weftmark.plans import inputs, sql
from weftmark.plans.registry import comparable, query, snap_sql
from weftmark.session import workspace
from weftmark.sources import event_store

# -- personal data ------------------------------------------------------------------------------------------

# Letters beyond ASCII count as word characters, as they do in the Spark patterns; here they become "_".
_LETTERS = r"[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02C1}\x{0370}-\x{03FF}\x{0400}-\x{052F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]"
# every text column of every table: table of the report -> (table in SQL, text columns)
_TABLES = {
    "region": ("region", ("r_name",)),
    "nation": ("nation", ("n_name",)),
    "customer": ("customer", ("c_name", "c_mktsegment")),
    "supplier": ("supplier", ("s_name",)),
    "part": ("part", ("p_name", "p_brand", "p_type")),
    "orders": ("orders", ("o_orderstatus", "o_orderpriority")),
    "lineitem": ("lineitem", ("l_returnflag", "l_linestatus")),
    "events": ("events", ("event_type", "props")),
    "documents": ("documents", ("text", "lang", "source")),
    "benchmark": ("benchmark", ("text",)),
    "pages": ("pages", ("url", "html")),
    "conversations": ("conversations", ("role", "text")),
    "customers": ("raw_customers", ("name", "email", "country")),
    "contacts": (
        "contacts",
        ("tax_id", "birth_date", "passport_no", "license", "insurance", "address", "api_token", "password_hash", "card_number"),
    ),
}
_COLUMNS = {(t, c): f"SELECT {c} AS t FROM {name}" for t, (name, columns) in _TABLES.items() for c in columns}
_ENTROPY_SQL = """list_sum(list_transform(list_distinct(string_split({s}, '')),
  lambda c: -((length({s}) - length(replace({s}, c, ''))) / CAST(length({s}) AS DOUBLE))
    * log2((length({s}) - length(replace({s}, c, ''))) / CAST(length({s}) AS DOUBLE))))"""


def _matches_sql(columns, categories) -> str:
    """Rows (table_name, column_name, category, match) before the entropy and length rules."""
    parts = []
    for table, column in columns:
        for category in categories:
            pattern = pii.RULES[category][1].replace("'", "''")
            parts.append(
                f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{category}' AS category, "
                f"unnest(regexp_extract_all(regexp_replace(t, '{_LETTERS}', '_', 'g'), '{pattern}')) AS match "
                f"FROM ({_COLUMNS[table, column]})"
            )
    return sql.union_columns(parts)


def _kept_sql(columns, categories) -> str:
    plain = "regexp_replace(match, '[^a-zA-Z0-9]', '', 'g')"
    entropy = _ENTROPY_SQL.format(s=plain)
    return f"""{sql.RAW_CUSTOMERS}, {sql.CONTACTS}, raw_matches AS ({_matches_sql(columns, categories)}), kept AS (
      SELECT * FROM raw_matches WHERE NOT (category IN ('credit_card', 'api_key', 'password_hash')
        AND COALESCE({entropy}, 0) < 0.1) AND NOT (category = 'zip_code' AND length(match) < 5))"""


def _rule_case(value) -> str:
    return " ".join(f"WHEN '{c}' THEN {value(c)}" for c in pii.CATEGORIES)


def _named_sql(category: str) -> str:
    return "(" + " OR ".join(f"contains(lower(column_name), '{w}')" for w in pii.RULES[category][2]) + ")"


def _report_sql(columns, categories=pii.CATEGORIES) -> str:
    severity = _rule_case(lambda c: f"'{pii.RULES[c][0]}'")
    return sql.with_(_kept_sql(columns, categories)) + f"""SELECT table_name, column_name, category,
      count(*) AS matches, array_to_string(list_sort(list_distinct(list(match)))[1:5], '|') AS sample_values,
      CASE WHEN CASE category {_rule_case(_named_sql)} END THEN 'high' ELSE 'medium' END AS confidence,
      CASE category {severity} END AS severity
      FROM kept GROUP BY table_name, column_name, category"""


# tables of short texts most of which differ, and their keys
_SHORT = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}


def _sources(spark, sf_dir, names=tuple(_TABLES)):
    def source(name):
        df = inputs.read(spark, sf_dir, "customer" if name in ("customers", "contacts") else name)
        if name == "customers":
            return pii.deal_short_texts(inputs.raw_customers(spark, sf_dir), "customer_id", df.count())
        if name == "contacts":
            # the key is dealt, before the texts are made from it
            return inputs.contacts_of(pii.deal_short_texts(df.select("c_custkey"), "c_custkey", df.count()))
        return pii.deal_short_texts(df, _SHORT[name], df.count()) if name in _SHORT else df

    return {name: source(name) for name in names}


@query("pii_scan", _report_sql(list(_COLUMNS)))
def pii_scan(spark, sf_dir):
    texts = union_all([pii.text_rows(df, name) for name, df in _sources(spark, sf_dir).items()])
    return comparable(pii.pii_report(pii.matches_in(texts)))


_HINTED = {
    "documents": ["source", "no_such_column"], "conversations": ["text"], "contacts": ["card_number", "api_token", "birth_date"],
}
_HINTED_COLUMNS = [(t, c) for t, hints in _HINTED.items() for c in hints if (t, c) in _COLUMNS]


@query("pii_column_hints", _report_sql(_HINTED_COLUMNS))
def pii_column_hints(spark, sf_dir):
    tables = _sources(spark, sf_dir, _HINTED)
    texts = union_all([pii.text_rows(tables[t], t, hints=h) for t, h in _HINTED.items()])
    return comparable(pii.pii_report(pii.matches_in(texts)))


def _category_query(category: str) -> None:
    def build(spark, sf_dir):
        texts = union_all([pii.text_rows(df, t) for t, df in _sources(spark, sf_dir).items()])
        return pii.matches_in(texts, [category]).groupBy("table_name", "column_name", "match").agg(F.count("*").alias("matches"))

    text = sql.with_(_kept_sql(list(_COLUMNS), [category]))
    query(
        f"pii_{category}",
        text + "SELECT table_name, column_name, match, count(*) AS matches FROM kept GROUP BY ALL",
    )(build)


for _category in pii.CATEGORIES:
    _category_query(_category)


@query(
    "char_entropy",
    f"""SELECT doc_id, {snap_sql("COALESCE(" + _ENTROPY_SQL.format(s="text") + ", 0)", 6)} AS entropy
      FROM documents WHERE text IS NOT NULL""",
)
def entropy_of_documents(spark, sf_dir):
    documents = inputs.read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return comparable(documents.select("doc_id", text_entropy(F.col("text")).alias("entropy")), 6)


_CHECKED = ["credit_card", "api_key", "password_hash", "zip_code"]


@query(
    "pii_entropy_filter",
    sql.with_(_kept_sql(list(_COLUMNS), _CHECKED))
    + """SELECT category, (SELECT count(*) FROM raw_matches r WHERE r.category = c.category) AS found,
      (SELECT count(*) FROM kept k WHERE k.category = c.category) AS kept
      FROM (SELECT DISTINCT category FROM raw_matches) c""",
)
def pii_entropy_filter(spark, sf_dir):
    """How many matches the entropy and length rules leave, over all texts."""
    texts = union_all([pii.text_rows(df, name) for name, df in _sources(spark, sf_dir).items()])
    rows = pii.raw_matches_in(texts, _CHECKED)
    keep = pii.keep_match(F.col("category"), F.col("match"))
    return rows.groupBy("category").agg(F.count("*").alias("found"), F.count_if(keep).alias("kept"))


# -- vectors ------------------------------------------------------------------------------------------------------

# every row whose id is divisible by 50 asks, at any size and wherever ids start
_PAIRS = """pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS id, CAST(d.label AS VARCHAR) AS category,
    sqrt(list_sum(list_transform(list_zip(d.embedding, q.embedding),
      lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS distance
  FROM embeddings d JOIN embeddings q ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
)"""


def _ranked(source: str) -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM {source}"


def _vector_inputs(spark, sf_dir):
    docs = inputs.vector_documents(spark, sf_dir)
    return docs, docs.where(F.col("id") % 50 == 0)


_TOP_K = (
    sql.with_(_PAIRS)
    + f"SELECT query_id, rank, id, {snap_sql('distance', 5)} AS distance FROM ({_ranked('pairs')}) WHERE rank <= 5"
)
_TOP_K_CATEGORY = (
    sql.with_(_PAIRS)
    + f"""SELECT 'cut first' AS form, query_id, rank, id, {snap_sql("distance", 5)} AS distance
        FROM ({_ranked("pairs")}) WHERE rank <= 20 AND category = '3'
      UNION ALL SELECT 'filter first', query_id, rank, id, {snap_sql("distance", 5)}
        FROM ({_ranked("(SELECT * FROM pairs WHERE category = '3')")}) WHERE rank <= 5"""
)


# the second names of both are older
@query("vector_top_k_fiftieth", _TOP_K)
@query("vector_top_k", _TOP_K)
def vector_top_k(spark, sf_dir):
    docs, asked = _vector_inputs(spark, sf_dir)
    return comparable(vectors.vector_top_k(docs, asked, 5, skip_self=True), 5)


@query("vector_top_k_category_fiftieth", _TOP_K_CATEGORY)
@query("vector_top_k_category", _TOP_K_CATEGORY)
def vector_top_k_category(spark, sf_dir):
    docs, asked = _vector_inputs(spark, sf_dir)

    def form(name, k, prefilter):
        found = vectors.vector_top_k_category(docs, asked, "3", k, prefilter=prefilter, skip_self=True)
        return found.select(F.lit(name).alias("form"), "query_id", "rank", "id", "distance")

    return comparable(form("cut first", 20, False).unionByName(form("filter first", 5, True)), 5)


# an approximate search has no SQL; its recall against the exact one has
@query("vector_candidates_lsh")
def vector_candidates_lsh(spark, sf_dir):
    docs, asked = _vector_inputs(spark, sf_dir)
    return comparable(candidates.vector_candidates_lsh(docs, asked, 5, skip_self=True), 5)


@query(
    "vector_candidates_recall",
    sql.with_(_PAIRS)
    + f"""SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS nine_tenths_found
      FROM ({_ranked("pairs")}) WHERE rank <= 5""",
)
def vector_candidates_recall(spark, sf_dir):
    """The candidates of every query against its exact neighbours."""
    docs, asked = _vector_inputs(spark, sf_dir)
    exact = vectors.vector_top_k(docs, asked, 5, skip_self=True)
    counted = candidates.recall_of(candidates.vector_candidates_lsh(docs, asked, 5, skip_self=True), exact)
    enough = (F.col("found") >= F.col("neighbours") * 0.9).alias("nine_tenths_found")
    return counted.select("queries", "neighbours", enough)


@query(
    "vector_append",
    """SELECT CAST(label AS VARCHAR) AS category, count(*) AS documents, min(vec_id) AS first_id, max(vec_id) AS last_id
      FROM embeddings GROUP BY label""",
)
def vector_append(spark, sf_dir):
    """Seed with the even ids, then append everything: known ids are not added twice."""
    path = workspace(spark, "vectors")
    docs = inputs.vector_documents(spark, sf_dir).select(
        "id",
        F.concat(F.lit("document "), F.col("id").cast("string")).alias("text"),
        "vector",
        F.create_map(F.lit("category"), F.col("category")).alias("metadata"),
        "category",
    )
    vectors.seed_documents(docs.where(F.col("id") % 2 == 0), path)
    vectors.seed_documents(docs, path)
    vectors.append_documents(docs, path)
    stored = spark.read.parquet(path).withColumn("category", F.get_json_object("metadata", "$.category"))
    return stored.groupBy("category").agg(
        F.count("*").alias("documents"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query("vector_count", "SELECT count(*) AS documents FROM embeddings")
def vector_count(spark, sf_dir):
    path = workspace(spark, "vectors")
    docs = inputs.vector_documents(spark, sf_dir).select(
        "id", F.lit("").alias("text"), "vector", F.create_map(F.lit("k"), F.col("category")).alias("metadata"), "category"
    )
    vectors.append_documents(docs, path)
    return vectors.count_documents(spark, path)


# -- run log ------------------------------------------------------------------------------------------------------

_EVENTS = """run_events AS (
  SELECT event_id, user_id AS run_id, ts, event_type AS agent,
    CASE event_type WHEN 'signup' THEN 'profile' WHEN 'view' THEN 'etl' WHEN 'click' THEN 'sql'
      WHEN 'error' THEN 'anomaly' WHEN 'purchase' THEN 'report' ELSE '' END AS step,
    CASE event_type WHEN 'error' THEN 'job_failed' WHEN 'purchase' THEN 'job_finished' ELSE 'tool_call' END AS type,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_in,
    2 * TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_out,
    CAST(55 * TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS DECIMAL(24,0)) AS micro_usd,
    CAST(value AS DECIMAL(18,2)) AS centi_s
  FROM events
)"""
_LOG = sql.with_(_EVENTS)
_ntz = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("token_cost", _LOG + "SELECT event_id, tokens_in, tokens_out, CAST(micro_usd AS DOUBLE) / 1e6 AS cost_usd FROM run_events")
def token_cost(spark, sf_dir):
    return comparable(inputs.run_events(spark, sf_dir).select("event_id", "tokens_in", "tokens_out", "cost_usd"))


@query(
    "run_summary",
    _LOG + """, per_run AS (
        SELECT run_id,
          COALESCE(array_to_string(list_sort(list_distinct(list(step) FILTER (WHERE type = 'tool_call' AND step <> ''))), ','), '')
            AS steps_done,
          count(*) FILTER (WHERE type = 'tool_call') AS tool_calls, sum(tokens_in)::BIGINT AS tokens_in,
          sum(tokens_out)::BIGINT AS tokens_out,
          CAST(round(CAST(sum(micro_usd) AS DECIMAL(30,0)) * CAST(0.000001 AS DECIMAL(7,6)), 4) AS DOUBLE) AS total_cost_usd,
          floor(CAST(sum(centi_s) AS DOUBLE) / 100 / 60 * 100 + 0.5) / 100 AS agent_minutes
        FROM run_events GROUP BY run_id),
      hours AS (SELECT run_id, sum(CASE step WHEN 'profile' THEN 2.0e0 WHEN 'etl' THEN 6.0e0 WHEN 'anomaly' THEN 3.0e0
          WHEN 'sql' THEN 1.0e0 WHEN 'report' THEN 2.0e0 ELSE 0.0e0 END) AS human_hours
        FROM (SELECT DISTINCT run_id, step FROM run_events WHERE type = 'tool_call' AND step <> '') GROUP BY run_id)
      SELECT p.*, COALESCE(human_hours, 0.0e0) AS human_hours,
        COALESCE(floor(COALESCE(human_hours, 0) * 60 / nullif(agent_minutes, 0) * 10 + 0.5) / 10, 0) AS speedup_x
      FROM per_run p LEFT JOIN hours h ON p.run_id = h.run_id""",
)
def run_summary(spark, sf_dir):
    return runlog.run_summary(inputs.run_events(spark, sf_dir))


@query(
    "agent_rollup",
    _LOG + f"""SELECT COALESCE(agent, 'ALL') AS agent, count(*) AS runs,
      (sum(tokens_in) + sum(tokens_out))::BIGINT AS total_tokens, CAST(sum(micro_usd) AS DOUBLE) / 1e6 AS total_cost,
      {snap_sql("CAST(sum(centi_s) AS DOUBLE) / 100 / count(*)", 6)} AS avg_duration_s,
      floor(count(*) FILTER (WHERE status = 'ok') * 100.0e0 / count(*) + 0.5) AS success_rate
      FROM run_events GROUP BY ROLLUP (agent)""",
)
def agent_rollup(spark, sf_dir):
    return comparable(runlog.agent_rollup(inputs.run_events(spark, sf_dir)), avg_duration_s=6)


@query(
    "recent_runs",
    _LOG + """SELECT event_id, ts, agent, status, CAST(round(centi_s / 100, 2) AS DOUBLE) AS duration_s,
      CAST(micro_usd AS DOUBLE) / 1e6 AS cost FROM run_events ORDER BY ts DESC, event_id LIMIT 10""",
)
def recent_runs(spark, sf_dir):
    return _ntz(comparable(runlog.recent_runs(inputs.run_events(spark, sf_dir))))


_RUN, _CURSOR = 42, 20


@query(
    "events_after",
    _LOG + f"""SELECT event_id, run_id, ts, agent, seq FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM run_events)
      WHERE run_id = {_RUN} AND seq > {_CURSOR}""",
)
def events_after(spark, sf_dir):
    """The log is written in three batches in order of time; the cursor then reads the files of its run."""
    path, events = workspace(spark, "run-log"), inputs.run_events(spark, sf_dir)
    # a third of the days each, and what has no time at last
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    first, last = span.select("a").scalar(), span.select("b").scalar()
    third = F.least(F.floor(3 * F.datediff("ts", first) / (F.datediff(last, first) + 1)), F.lit(2))
    for part in range(3):
        event_store.append_events(events.where(F.coalesce(third, F.lit(2)) == part), path)
    return _ntz(event_store.events_after(spark, path, _RUN, _CURSOR).select("event_id", "run_id", "ts", "agent", "seq"))


@query(
    "latest_finished",
    _LOG + """SELECT run_id, created FROM (
      SELECT run_id, min(ts) AS created,
        arg_max(type, (ts, event_id)) FILTER (WHERE type IN ('job_finished', 'job_failed')) AS last_type
      FROM run_events GROUP BY run_id) WHERE last_type = 'job_finished' ORDER BY created DESC, run_id DESC LIMIT 1""",
)
def latest_finished(spark, sf_dir):
    newest = runlog.latest_finished(inputs.run_events(spark, sf_dir))
    return newest.withColumn("created", F.col("created").cast("timestamp_ntz"))


@query(
    "run_status",
    _LOG + """SELECT run_id, count(*) AS steps, CASE WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'partial' END AS run_status
      FROM run_events GROUP BY run_id""",
)
def run_status(spark, sf_dir):
    return runlog.run_status(inputs.run_events(spark, sf_dir))


@query(
    "event_gaps",
    _LOG + """SELECT run_id, event_id, ts, least(greatest((epoch_us(ts) - epoch_us(COALESCE(prev, ts))) / 1e6, 0.15e0), 2.0e0)
        AS gap_s
      FROM (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS prev FROM run_events)""",
)
def event_gaps(spark, sf_dir):
    return _ntz(runlog.event_gaps(inputs.run_events(spark, sf_dir)))


# -- routing ------------------------------------------------------------------------------------------------------

# short syllables that occur in the test texts, so that labels compete
SYLLABLES = {
    "alpha": ("tion", "ment", "the "),
    "beta": ("ou", "eau", "doc"),
    "gamma": ("ing", "er", "and"),
}
SYLLABLE_PHRASES = ("tionment",)


def _route_sql(hints, phrases, default) -> str:
    def hits(words):
        return " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in words)

    scores = ", ".join(
        f"{{'rank': -({hits(words)}), 'place': {i}, 'label': '{label}'}}" for i, (label, words) in enumerate(hints.items())
    )
    everything = " OR ".join(f"contains(lower(text), '{p}')" for p in phrases)
    every = "[" + ", ".join(f"'{label}'" for label in hints) + "]"
    return f"""SELECT conv_id, turn, array_to_string(routes, '|') AS routes, routes[1] AS label, hits FROM (
      SELECT conv_id, turn, CASE WHEN {everything} THEN {every} WHEN len(ok) > 0
          THEN list_transform(list_sort(ok), lambda s: s.label) ELSE ['{default}'] END AS routes,
        CASE WHEN len(ok) > 0 THEN -(list_sort(ok)[1].rank) ELSE 0 END AS hits
      FROM (SELECT *, list_filter([{scores}], lambda s: s.rank < 0) AS ok FROM conversations))"""


def _routed(spark, sf_dir, *rules):
    turns = inputs.read(spark, sf_dir, "conversations")
    return comparable(runlog.keyword_route(turns, "text", *rules).select("conv_id", "turn", "routes", "label", "hits"))


@query("keyword_route", _route_sql(runlog.ROUTING_HINTS, runlog.ALL_LABEL_PHRASES, runlog.DEFAULT_LABEL))
def keyword_route(spark, sf_dir):
    return _routed(spark, sf_dir)


@query("keyword_route_custom", _route_sql(SYLLABLES, SYLLABLE_PHRASES, "gamma"))
def keyword_route_custom(spark, sf_dir):
    return _routed(spark, sf_dir, SYLLABLES, SYLLABLE_PHRASES, "gamma")
