"""Every query of the library by name, with the SQL that gives the same rows.

Each runs over the whole of its tables; limits are there only where they are the
feature (the latest n, a page, the best k).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import discourse, profiles
from .functions import text as T
from .operators import aliases, chats, dedup, notation, phrases, ranking, relational as R, structure
from .plans import rewrite as plan
from .sources import io

FLAGSHIP = "rewrite_documents"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Sentences, replacement of matches m, and the like, in SQL.
_SENT = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, e' \t\r\f')), lambda s: length(s) > 0)"
_REPLACED = "CASE WHEN regexp_matches({t}, '{p}') THEN array_to_string(list_transform(list_zip(string_split_regex({t}, '{p}'), regexp_extract_all({t}, '{p}')), lambda z: concat(z[1], {new})), '') ELSE {t} END"
_TOK = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
_SIG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' ')"
_SQUEEZE = r"trim(regexp_replace(lower({0}), '[ \t\n\r\f]+', ' ', 'g'), ' ')"
_NTOK = "CAST(greatest(len(regexp_extract_all({0}, '[A-Za-z0-9_'']+')), 1) AS BIGINT)"


def _query(table: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of the named tables (by spaces)."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(*[io.table(spark, sf_dir, t) for t in table.split()])
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# --- histories and telemetry


@_query("events", "SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_history(events):
    return R.latest(events.select("event_id", "ts", "user_id", "event_type", "value"), 50, "ts", "event_id")


@_query("events", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 42")
def point_lookup(events):
    return events.where("event_id = 42").select("event_id", "user_id", "event_type", "value")


@_query("events", "SELECT event_id, user_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rank FROM events) WHERE rank <= 5")
def tenant_recent_topn(events):
    return R.latest_of_each(events, "user_id", 5, "ts", "event_id").select("event_id", "user_id", "rank")


@_query("events", "SELECT count(*) AS n, round(sum(greatest(value - 10, 0)), 4) AS saved, round(avg(value), 6) AS avg_value, round(avg(nullif(event_id % 7, 0)), 6) AS avg_similarity, round(sum(value) / 1e6 * 0.015 * 30, 8) AS savings FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)")
def history_rollup(events):
    rows = R.latest(events, 500, "ts", "event_id")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(F.greatest(F.col("value") - 10, F.lit(0.0))), 4).alias("saved"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.avg(F.expr("nullif(event_id % 7, 0)")), 6).alias("avg_similarity"), F.round(F.sum("value") / 1e6 * 0.015 * 30, 8).alias("savings"))


@_query("events", "SELECT strftime(d.day, '%Y-%m-%d') AS day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS day) d LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) n FROM events GROUP BY 1) e ON CAST(d.day AS DATE) = e.day")
def daily_trend_zero_filled(events):
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return R.zero_filled_days(daily, "day", "2024-02-03", 7).select(F.col("day").cast("string").alias("day"), "n")


@_query("events orders", "SELECT e.event_id, e.event_type, o.o_custkey FROM events e JOIN orders o ON e.event_id = o.o_orderkey WHERE e.user_id = 7 ORDER BY e.ts DESC, e.event_id DESC LIMIT 100")
def recent_telemetry_join(events, orders):
    joined = events.where("user_id = 7").join(orders, events.event_id == orders.o_orderkey)
    return R.latest(joined, 100, "ts", "event_id").select("event_id", "event_type", "o_custkey")


@_query("events", "SELECT event_type, round(avg(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN value > 0 THEN (event_id % 50) / value ELSE 0 END)), 6) AS avg_utility, round(avg(value), 6) AS avg_duration, count(*) AS n FROM events GROUP BY event_type")
def pass_utility_priors(events):
    out = R.utility_priors(events, "event_type", F.when(F.col("event_id") % 3 == 0, F.col("value")), F.col("event_id") % 50, F.col("value"))
    return out.withColumn("avg_utility", F.round("avg_utility", 6)).withColumn("avg_duration", F.round("avg_duration", 6))


@_query("events", "SELECT user_id, round(list_sort(list(value))[CAST(round(0.95 * (count(*) - 1)) AS INTEGER) + 1], 2) AS p95, round(list_sort(list(value))[CAST(round(0.99 * (count(*) - 1)) AS INTEGER) + 1], 2) AS p99, round(avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END), 6) AS failure_rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r <= 500 AND value > 0 GROUP BY user_id")
def tenant_latency_percentiles(events):
    rows = R.latest_of_each(events, "user_id", 500, "ts", "event_id").where("value > 0")
    return rows.groupBy("user_id").agg(F.round(R.index_percentile(F.col("value"), 0.95), 2).alias("p95"), F.round(R.index_percentile(F.col("value"), 0.99), 2).alias("p99"), F.round(F.avg(F.when(F.col("value") < 10, 1.0).otherwise(0.0)), 6).alias("failure_rate"))


@_query("events", "SELECT round(avg(s), 4) AS avg_run, round(max(s), 4) AS max_run, avg(s) <= 600 AS latency_ok FROM (SELECT user_id, CAST(ts AS DATE) d, sum(value) s FROM events GROUP BY 1, 2)")
def telemetry_baseline(events):
    runs = events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.sum("value").alias("s"))
    return runs.agg(F.round(F.avg("s"), 4).alias("avg_run"), F.round(F.max("s"), 4).alias("max_run"), (F.avg("s") <= plan.LATENCY_MS).alias("latency_ok"))


@_query("events", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pass_order, greatest(CAST(floor(value) AS BIGINT) - event_id % 20, 0) AS saved, CASE WHEN floor(value) > 0 THEN round(greatest(floor(value) - event_id % 20, 0) / floor(value) * 100, 4) ELSE 0 END AS reduction FROM events")
def pass_metrics(events):
    before, after = F.floor("value"), F.col("event_id") % 20
    saved = F.greatest(before - after, F.lit(0))
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select("event_id", order.alias("pass_order"), saved.alias("saved"), F.when(before > 0, F.round(saved / before * 100, 4)).otherwise(0.0).alias("reduction"))


@_query("events", "SELECT event_type, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def profiler_steps(events):
    return events.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"))


@_query("events", "SELECT event_id, value <= 600 AS latency_ok, coalesce(nullif(event_id % 5, 0) / 4.0 >= 0.82, false) AS similarity_ok, floor(value) >= 20 AS savings_ok FROM events")
def guardrails(events):
    similarity = F.expr("nullif(event_id % 5, 0) / 4.0D")
    return events.select("event_id", (F.col("value") <= plan.LATENCY_MS).alias("latency_ok"), F.coalesce(similarity >= plan.SIMILARITY, F.lit(False)).alias("similarity_ok"), (F.floor("value") >= plan.SAVED_TOKENS).alias("savings_ok"))


@_query("events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def json_props_filter(events):
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", k.alias("k")).where("k >= 50")


@_query("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 21599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_rate_window(events):
    return R.windowed_count(events, "user_id", "ts", 6 * 3600).select("event_id", "n")


@_query("events", "SELECT event_id, CASE WHEN event_type = 'click' AND value > 50 OR event_type = 'view' AND value > 80 THEN 'failed' ELSE event_type END AS status FROM events")
def stale_job_reaper(events):
    return R.reaped(events, F.col("event_type"), F.col("value"), {"click": 50, "view": 80}).select("event_id", "status")


@_query("events", "SELECT user_id, event_type AS state, ts AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r = 1")
def job_latest_state(events):
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("updated_at"))


@_query("events", "SELECT e.event_type, e.avg_value FROM (SELECT event_type, round(avg(value), 6) avg_value, round(max(value), 6) m FROM events GROUP BY 1) e, (SELECT round(avg(value), 6) a, round(max(value), 6) b FROM events WHERE event_type = 'click') c WHERE e.avg_value >= c.a AND e.m <= c.b")
def pareto_filter(events):
    kinds = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.max("value"), 6).alias("m"))
    base = kinds.where("event_type = 'click'").select(F.col("avg_value").alias("a"), F.col("m").alias("b"))
    return kinds.join(F.broadcast(base), (F.col("avg_value") >= F.col("a")) & (F.col("m") <= F.col("b"))).select("event_type", "avg_value")


# --- usage, mappings and other tables


@_query("orders", "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS calls, max(o_orderdate) AS last FROM orders GROUP BY 1, 2")
def usage_by_period(orders):
    return orders.groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count("*").alias("calls"), F.max("o_orderdate").alias("last"))


@_query("orders", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS until, count(*) AS calls FROM orders GROUP BY 1, 2 ORDER BY period DESC LIMIT 24")
def usage_history(orders):
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    months = orders.groupBy(month.cast("string").alias("period"), F.add_months(month, 1).cast("string").alias("until")).agg(F.count("*").alias("calls"))
    return R.latest(months, 24, "period")


@_query("customer nation", "SELECT coalesce(n_name, 'ui') AS source, count(*) AS calls FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n ON c_nationkey = n_nationkey GROUP BY 1")
def usage_breakdown_left_join(customer, nation):
    keys = nation.where("n_nationkey % 5 <> 0").select("n_nationkey", "n_name")
    return customer.join(keys, customer.c_nationkey == keys.n_nationkey, "left").groupBy(F.coalesce("n_name", F.lit("ui")).alias("source")).agg(F.count("*").alias("calls"))


@_query("customer orders", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN true ELSE coalesce(n, 0) < c_acctbal / 500 END AS allowed, CASE WHEN c_acctbal < 0 THEN -1 ELSE greatest(CAST(floor(c_acctbal / 500) AS BIGINT) - coalesce(n, 0), 0) END AS remaining FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def quota_check(customer, orders):
    used = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = customer.join(used, customer.c_custkey == used.o_custkey, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    free = F.col("c_acctbal") < 0
    return rows.select("c_custkey", F.when(free, True).otherwise(F.col("n") < F.col("c_acctbal") / 500).alias("allowed"), F.when(~free, F.greatest(F.floor(F.col("c_acctbal") / 500) - F.col("n"), F.lit(0))).otherwise(-1).alias("remaining"))


@_query("customer", "SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 20 OFFSET 40")
def paged_listing(customer):
    return customer.select("c_custkey", "c_name").orderBy(F.lower("c_name"), "c_custkey").offset(40).limit(20)


@_query("customer", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY n")
def plan_catalog(customer):
    return customer.where("c_acctbal > 0").groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy("n")


@_query("nation customer", "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)")
def delete_guard(nation, customer):
    return nation.join(customer.where("c_acctbal > 9900"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti").select("n_nationkey")


@_query("customer orders", "SELECT c.c_custkey, coalesce(o.o_orderkey, -1) AS o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'O' WHERE c.c_mktsegment = 'BUILDING'")
def two_step_lookup(customer, orders):
    active = orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey")
    return customer.where("c_mktsegment = 'BUILDING'").join(active, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


@_query("part", "SELECT coalesce(b.k, o.k) AS k, coalesce(o.v, b.v) AS v FROM (SELECT p_partkey k, lower(p_type) v FROM part WHERE p_partkey % 2 = 0 AND p_size <> 7) b FULL JOIN (SELECT p_partkey k, lower(p_brand) v FROM part WHERE p_partkey % 3 = 0) o ON b.k = o.k")
def mapping_override_merge(part):
    base = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.lower("p_type").alias("v"))
    own = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("k"), F.lower("p_brand").alias("v"))
    return R.override(base, part.where("p_size = 7").select(F.col("p_partkey").alias("k")), own, "k", "v")


@_query("orders", "SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1")
def upsert_accumulate(orders):
    rows = orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("amount"), "o_orderkey")
    out = R.accumulate(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 <> 0"), "k", "amount")
    return out.select("k", F.round("amount", 2).alias("amount"))


@_query("part", "SELECT lower(p_name) AS k, arg_max(p_partkey, p_partkey) AS v FROM part GROUP BY 1")
def upsert_replace(part):
    rows = part.groupBy("p_name").agg(F.max("p_partkey").alias("v")).select(F.col("p_name").alias("k"), "v")
    old = rows.select("k", (F.col("v") * 0).alias("v"))
    return R.replace(old, rows, "k").groupBy(F.lower("k").alias("k")).agg(F.max("v").alias("v"))


@_query("part", "SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 0 FROM part WHERE p_partkey % 2 <> 0 AND p_partkey % 3 = 0")
def insert_if_absent(part):
    old = part.where("p_partkey % 2 = 0").select("p_partkey", "p_size")
    return R.insert_absent(old, part.where("p_partkey % 3 = 0").select("p_partkey", F.lit(0).alias("p_size")), "p_partkey")


@_query("part supplier", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)")
def bulk_delete(part, supplier):
    return part.join(supplier, F.col("p_partkey") == F.col("s_suppkey"), "left_anti").select("p_partkey")


@_query("part", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) r FROM part) WHERE r = 1")
def partial_unique_upsert(part):
    return R.evict(part, "p_brand", 1, "p_retailprice", "p_partkey").select("p_brand", "p_partkey")


@_query("part", "SELECT p_partkey AS id, p_name AS name, CAST('active' AS VARCHAR) AS status, CAST(0 AS BIGINT) AS used FROM part")
def migration_copy(part):
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("active").alias("status"), F.lit(0).cast("long").alias("used"))


@_query("documents", f"SELECT source, phrase, n FROM (SELECT source, phrase, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, phrase DESC) r FROM (SELECT source, phrase, count(*) n FROM (SELECT source, unnest({_TOK}) phrase FROM documents) WHERE length(phrase) > 3 GROUP BY 1, 2)) WHERE r <= 20")
def phrase_topn_evict(documents):
    used = documents.select("source", F.explode(T.tokens(F.col("text"))).alias("phrase")).where("length(phrase) > 3").groupBy("source", "phrase").agg(F.count("*").alias("n"))
    return R.evict(used, "source", 20, "n", "phrase")


@_query("lineitem", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS avg_q, list_sort(list(l_quantity))[CAST(floor(count(*) * 0.5) AS INTEGER) + 1] AS p50, list_sort(list(l_quantity))[CAST(floor(count(*) * 0.95) AS INTEGER) + 1] AS p95 FROM lineitem GROUP BY 1")
def benchmark_aggregation(lineitem):
    # the value at floor(n * p), from counts of each value: the values of a group never meet in one place
    counts = lineitem.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("c"))
    w = Window.partitionBy("l_returnflag")
    rows = counts.withColumn("upto", F.sum("c").over(w.orderBy("l_quantity"))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("l_quantity")))
    return rows.groupBy("l_returnflag").agg(F.max("n").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("c")) / F.max("n"), 6).alias("avg_q"), at(0.5).alias("p50"), at(0.95).alias("p95"))


# --- text functions and classification

_CASE = r"""CASE WHEN length(trim(t, ' ')) = 0 THEN 'general_prose'
  WHEN regexp_matches(trim(t, ' '), '^[\[{]') AND regexp_matches(trim(t, ' '), '[\]}]$') AND contains(t, '"') THEN 'json'
  WHEN length(text) < 100 THEN 'short'
  WHEN len(regexp_extract_all(t, '[{};]|=>|->|==')) >= 3 OR len(regexp_extract_all(t, '\b(?:def|class|import|function|return|const|public)\b')) >= 2 THEN 'code'
  WHEN len(regexp_extract_all(t, '(?:^|\n)(?:user|assistant|system|User|Assistant|System):')) >= 2 THEN 'dialogue'
  WHEN regexp_matches(t, '\b(?:GET|POST|PUT|DELETE) /|\b[Ee]ndpoint\b') THEN 'technical_doc'
  WHEN len(regexp_extract_all(t, '(?:^|\n)(?:#{1,6} |[-*] |```)')) >= 5 THEN 'markdown'
  WHEN length(text) > 15000 THEN 'heavy_document' ELSE 'general_prose' END"""
_HEAD = "CASE WHEN length(text) > 2000 THEN substr(text, 1, 666) || substr(text, CAST(floor(length(text) / 2.0) AS INTEGER) - 333, 666) || substr(text, length(text) - 665, 666) ELSE text END t"


@_query("documents", f"SELECT doc_id, {_CASE} AS kind FROM (SELECT doc_id, text, {_HEAD} FROM documents)")
def classify_documents(documents):
    return documents.select("doc_id", T.content_class(F.col("text")).alias("kind"))


@_query("pages", f"SELECT page_id, {_CASE} AS kind FROM (SELECT page_id, html AS text, {_HEAD.replace('text', 'html')} FROM pages)")
def classify_pages(pages):
    return pages.select("page_id", T.content_class(F.col("html")).alias("kind"))


@_query("documents", f"SELECT bin, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens FROM (SELECT t, CASE WHEN t < 512 THEN 'xs' WHEN t < 2048 THEN 'sm' WHEN t < 8192 THEN 'md' WHEN t < 16384 THEN 'lg' ELSE 'xl' END bin FROM (SELECT {_NTOK.format('text')} t FROM documents)) GROUP BY bin")
def token_bin_histogram(documents):
    n = documents.select(T.n_tokens(F.col("text")).alias("t"))
    return n.groupBy(T.token_bin(F.col("t")).alias("bin")).agg(F.count("*").alias("n"), F.sum("t").alias("tokens"))


@_query("documents", "SELECT doc_id, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM (SELECT doc_id, p, CAST(count(*) AS DOUBLE) c, CAST(any_value(len) - 1 AS DOUBLE) n FROM (SELECT doc_id, len(c) len, c[i] || c[i + 1] p FROM (SELECT doc_id, c, unnest(range(1, len(c))) i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') c FROM documents))) GROUP BY doc_id, p) GROUP BY doc_id")
def char_bigram_entropy(documents):
    return T.bigram_entropies(documents).withColumn("entropy", F.round("entropy", 6))


@_query("documents", f"SELECT doc_id, round(CASE WHEN len(s) > 0 THEN 1 - len(list_distinct(s)) / CAST(len(s) AS DOUBLE) ELSE 0 END, 6) AS redundancy FROM (SELECT doc_id, list_filter(list_transform({_SENT}, lambda x: {_SIG.format('x')}), lambda x: length(x) > 0) s FROM documents)")
def sentence_redundancy(documents):
    return dedup.redundancy(documents).select("doc_id", F.round("redundancy", 6).alias("redundancy"))


@_query("documents", r"SELECT doc_id, regexp_replace(text, '(^|[ \t\n])(?:(?:[Tt]he|[Aa]n?)[ \t]+)+', '\1', 'g') AS text FROM documents")
def article_removal(documents):
    return documents.select("doc_id", T.without_articles(F.col("text")).alias("text"))


@_query("documents", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\.{2,}', '.', 'g'), '[ \t]+([,:;])', '\1', 'g'), '([,:;])[ \t]+', '\1 ', 'g') AS text FROM documents")
def punctuation_compress(documents):
    return documents.select("doc_id", T.tight_punctuation(F.col("text")).alias("text"))


@_query("documents", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+\n', e'\n', 'g'), '\n{3,}', e'\n\n', 'g'), '[ \t]{2,}', ' ', 'g'), ' ') AS text FROM documents")
def whitespace_normalise(documents):
    return documents.select("doc_id", T.tidy_space(F.col("text")).alias("text"))


@_query("documents", f"SELECT doc_id, {_REPLACED.format(t='text', p=T.THOUSANDS, new="regexp_replace(regexp_replace(z[2], '[ ,_]', '', 'g'), '^0+([0-9])', '\\1')")} AS text FROM documents")
def thousands_separator(documents):
    return documents.select("doc_id", T.plain_numbers(F.col("text")).alias("text"))


@_query("documents")
def consecutive_duplicates(documents):
    return documents.select("doc_id", T.no_echo(F.col("text")).alias("text"))


_CUE = T.CUE.replace("'", "''")


@_query("documents", f"SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(x, '{_CUE}') THEN 1 ELSE 0 END) AS BIGINT) AS cued, CAST(sum(CASE WHEN regexp_matches(x, '{T.CONSTRAINT.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END) AS BIGINT) AS constrained FROM (SELECT doc_id, unnest({_SENT}) x FROM documents) GROUP BY 1")
def constraint_cues(documents):
    x = documents.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("x"))
    return x.groupBy("doc_id").agg(F.count_if(T.has_cue(F.col("x"))).alias("cued"), F.count_if(T.has_constraint(F.col("x"))).alias("constrained"))


_SIM = r"""WITH p AS (SELECT doc_id, text a, regexp_replace(text, '(^|[ \t\n])(?:(?:[Tt]he|[Aa]n?)[ \t]+)+', '\1', 'g') b FROM documents),
 q AS (SELECT doc_id, a, b, list_distinct(regexp_extract_all(lower(a), '[a-z0-9_]+')) ta, list_distinct(regexp_extract_all(lower(b), '[a-z0-9_]+')) tb,
  greatest(len(regexp_extract_all(a, '[.!?]')), 1) sa, greatest(len(regexp_extract_all(b, '[.!?]')), 1) sb FROM p),
 r AS (SELECT doc_id, round(CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0 ELSE 0.7::DOUBLE * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))
  + 0.15::DOUBLE * least(length(b) / CAST(length(a) AS DOUBLE), 1) + 0.15::DOUBLE * least(sb / CAST(sa AS DOUBLE), 1) END + 1e-9, 3) AS similarity FROM q)
SELECT doc_id, similarity, similarity >= 0.82 AS kept FROM r"""


@_query("documents", _SIM)
def lexical_similarity_guard(documents):
    score = T.similarity(F.col("text"), T.without_articles(F.col("text")))
    return documents.select("doc_id", score.alias("similarity"), (score >= plan.SIMILARITY).alias("kept"))


@_query("documents")
def rewrite_documents(documents):
    return plan.rewrite(documents)


# --- deduplication


@_query("documents", f"SELECT doc_id, CASE WHEN len(p) >= 8 THEN array_to_string(list_filter(p, lambda x, i: length({_SQUEEZE.format('x')}) = 0 OR list_position(k, {_SQUEEZE.format('x')}) = i), e'\\n') ELSE text END AS text FROM (SELECT doc_id, text, p, list_transform(p, lambda x: {_SQUEEZE.format('x')}) k FROM (SELECT doc_id, text, string_split(text, e'\\n') p FROM documents))")
def exact_line_dedup(documents):
    return dedup.lines(documents).select("doc_id", "text")


@_query("documents", f"SELECT doc_id, CASE WHEN len(p) > len(list_distinct(k)) THEN array_to_string(list_filter(p, lambda x, i: list_position(k, {_SQUEEZE.format('x')}) = i), ' ') ELSE text END AS text FROM (SELECT doc_id, text, p, list_transform(p, lambda x: {_SQUEEZE.format('x')}) k FROM (SELECT doc_id, text, {_SENT} p FROM documents))")
def exact_sentence_dedup(documents):
    return dedup.sentences(documents).select("doc_id", "text")


@_query("documents", f"SELECT doc_id, pair, count(*) AS n FROM (SELECT doc_id, s[i] || ' ' || s[i + 1] AS pair FROM (SELECT doc_id, s, unnest(range(1, len(s))) i FROM (SELECT doc_id, list_transform({_SENT}, lambda x: {_SQUEEZE.format('x')}) s FROM documents))) GROUP BY 1, 2 HAVING count(*) > 1")
def sentence_pair_dedup(documents):
    return dedup.sentence_pairs(documents)


@_query("documents", f"SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, array_to_string(t[i : i + 4], ' ') gram FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) i FROM (SELECT doc_id, {_TOK} t FROM documents) WHERE len(t) >= 5)) GROUP BY 1, 2 HAVING count(*) > 1")
def ngram_repeats(documents):
    return dedup.repeated_ngrams(documents)


@_query("documents", "SELECT md5(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_exact_duplicates(documents):
    return dedup.exact_groups(documents)


@_query("documents", f"""WITH t AS (SELECT doc_id, {_TOK} t FROM documents), g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) g FROM t WHERE len(t) > 1),
 u AS (SELECT min(doc_id) doc_id, g FROM g GROUP BY g), e AS (SELECT doc_id, len(g) n, unnest(g) x FROM u)
SELECT a, b, round(similarity, 6) AS similarity FROM (SELECT p.doc_id a, q.doc_id b, count(*) / CAST(any_value(p.n) + any_value(q.n) - count(*) AS DOUBLE) similarity FROM e p JOIN e q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2) WHERE similarity >= 0.8""")
def near_dup_pairs(documents):
    return dedup.bigram_pairs(documents).withColumn("similarity", F.round("similarity", 6))


@_query("documents")
def near_dup_lookback(documents):
    return dedup.kept_sentences(documents)


@_query("documents")
def minhash_near_documents(documents):
    return dedup.near_documents(documents).withColumn("similarity", F.round("similarity", 6))


@_query("documents", f"""WITH w AS (SELECT doc_id, string_split({_SQUEEZE.format('text')}, ' ') w FROM documents),
 g AS (SELECT doc_id, i - 1 f, array_to_string(w[i : i + 19], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) i FROM w WHERE len(w) >= 20)),
 a AS (SELECT doc_id, f FROM (SELECT *, min(f) OVER (PARTITION BY doc_id, g) o FROM g) WHERE f >= o + 20)
SELECT doc_id, count(*) AS n, min(f) AS first FROM a GROUP BY 1""")
def repeated_word_windows(documents):
    return dedup.window_counts(documents)


# --- ranking, chunks, chats


@_query("documents benchmark", f"""WITH d AS (SELECT doc_id, len(t) len, unnest(t) token FROM (SELECT doc_id, {_TOK} t FROM documents)), f AS (SELECT doc_id, token, len, count(*) tf FROM d GROUP BY 1, 2, 3),
 s AS (SELECT count(*) n, avg(l) mean FROM (SELECT len({_TOK}) l FROM documents) WHERE l > 0), q AS (SELECT item_id, token, count(*) q FROM (SELECT item_id, unnest({_TOK}) token FROM benchmark) GROUP BY 1, 2), e AS (SELECT token, count(*) df FROM f GROUP BY 1),
 r AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean)) * q / (q + 1)), 6) score FROM q JOIN e USING (token) JOIN f USING (token), s GROUP BY 1, 2)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank FROM r) WHERE rank <= 10""")
def bm25_rank(documents, benchmark):
    return ranking.bm25(documents, benchmark)


@_query("documents benchmark", f"""WITH d AS (SELECT doc_id, token, count(*) / CAST(any_value(len) AS DOUBLE) tf FROM (SELECT doc_id, len(t) len, unnest(t) token FROM (SELECT doc_id, {_TOK} t FROM documents)) GROUP BY 1, 2),
 c AS (SELECT CAST(count(*) AS DOUBLE) n FROM documents WHERE len({_TOK}) > 0), f AS (SELECT token, count(*) df FROM d GROUP BY 1),
 q AS (SELECT item_id, token, count(*) / CAST(any_value(len) AS DOUBLE) tf FROM (SELECT item_id, len(t) len, unnest(t) token FROM (SELECT item_id, {_TOK} t FROM benchmark)) GROUP BY 1, 2),
 i AS (SELECT item_id, token, tf, ln((n + 2) / (coalesce(df, 0) + 2)) + 1 idf, ln((n + 2) / (coalesce(df, 0) + 1)) + 1 plain FROM q LEFT JOIN f USING (token), c),
 s AS (SELECT doc_id, sum((tf * (ln((n + 2) / (df + 1)) + 1)) ** 2) sq FROM d JOIN f USING (token), c GROUP BY 1),
 v AS (SELECT item_id, sqrt(sum((tf * idf) ** 2)) b FROM i GROUP BY 1),
 r AS (SELECT item_id, doc_id, round(sum(i.tf * idf * d.tf * idf) / (sqrt(any_value(sq) + sum(d.tf ** 2 * (idf ** 2 - plain ** 2))) * any_value(b)), 6) score FROM i JOIN d USING (token) JOIN s USING (doc_id) JOIN v USING (item_id) GROUP BY 1, 2)
SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank FROM r) WHERE rank <= 10""")
def tfidf_rank(documents, benchmark):
    return ranking.tfidf(documents, benchmark)


@_query("documents", f"SELECT doc_id, round(sum(CASE WHEN r <= 12 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS score FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) r FROM (SELECT doc_id, token, count(*) n FROM (SELECT doc_id, unnest({_TOK}) token FROM documents) WHERE length(token) > 2 GROUP BY 1, 2)) GROUP BY doc_id")
def luhn_rank(documents):
    return ranking.luhn(documents).select("doc_id", F.round("score", 6).alias("score"))


@_query("embeddings", "SELECT vec_id, CAST(sum(cut) OVER (ORDER BY vec_id) AS BIGINT) AS run FROM (SELECT vec_id, CASE WHEN p IS NULL OR list_sum(list_transform(list_zip(v, p), lambda x: x[1] * x[2])) < 0.6 THEN 1 ELSE 0 END cut FROM (SELECT vec_id, v, lag(v) OVER (ORDER BY vec_id) p FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings)))")
def semantic_groups(embeddings):
    return ranking.adjacent_groups(embeddings)


@_query("documents")
def greedy_chunks(documents):
    return ranking.packed_chunks(documents)


@_query("documents", f"SELECT doc_id, CAST(i AS INTEGER) AS chunk, array_to_string(t[i * 180 + 1 : i * 180 + 200], ' ') AS text FROM (SELECT doc_id, t, unnest(range(0, (len(t) - 1) // 180 + 1)) i FROM (SELECT doc_id, {_TOK} t FROM documents) WHERE len(t) > 0)")
def fixed_chunks(documents):
    return ranking.fixed_chunks(documents)


_CON = T.CONSTRAINT.replace("'", "''")
_SCORES = f"""SELECT doc_id, pos, n_tokens, protected, s, round(0.45::DOUBLE * len(list_intersect(s, q)) / len(q) + CASE WHEN protected THEN 0.3 ELSE 0 END::DOUBLE + 0.15::DOUBLE / count(*) OVER (PARTITION BY doc_id, s) + 0.1::DOUBLE * e + 1e-9, 6) AS score
 FROM (SELECT doc_id, pos, n_tokens, protected, s, ['and', 'from', 'the', 'with'] q, CASE WHEN len(s) > 1 THEN least(list_sum(list_transform(s, lambda x: -(len(list_filter(t, lambda y: y = x)) / CAST(len(t) AS DOUBLE)) * ln(len(list_filter(t, lambda y: y = x)) / CAST(len(t) AS DOUBLE)))) / ln(len(s)), 1) ELSE 0 END e
  FROM (SELECT doc_id, pos, {_NTOK.format('x')} n_tokens, regexp_matches(x, '{_CON}') OR regexp_matches(x, '__[A-Za-z0-9_]+_[0-9]+__') protected, {_TOK.replace('text', 'x')} t, list_sort(list_distinct({_TOK.replace('text', 'x')})) s
   FROM (SELECT doc_id, unnest(range(0, len(s))) pos, unnest(s) x FROM (SELECT doc_id, {_SENT} s FROM documents))))"""
_ASKED = "the and from with"


@_query("documents", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, n_tokens, protected, score FROM ({_SCORES})")
def sentence_scores(documents):
    return ranking.sentence_scores(documents, _ASKED).drop("set", "size")


@_query("documents", f"""SELECT doc_id, n_sentences, total, round(least(0.95, greatest(0.2, 0.7 + CASE WHEN dense >= 0.2 THEN 0.1 WHEN dense >= 0.1 THEN 0.05 ELSE 0 END - CASE WHEN again >= 0.35 AND dense <= 0.18 THEN 0.12 WHEN again >= 0.22 AND dense <= 0.12 THEN 0.07 ELSE 0 END))::DOUBLE, 6) AS ratio
FROM (SELECT doc_id, count(*) n_sentences, CAST(sum(n_tokens) AS BIGINT) total, count(*) FILTER (protected) / CAST(count(*) AS DOUBLE) dense, 1 - count(DISTINCT s) / CAST(count(*) AS DOUBLE) again FROM ({_SCORES}) GROUP BY 1)""")
def budget_ratios(documents):
    return ranking.budget_ratios(ranking.sentence_scores(documents, _ASKED), True)


@_query("documents")
def budgeted_sentences(documents):
    scored = ranking.sentence_scores(documents, _ASKED)
    return ranking.within_budget(scored, ranking.budget_ratios(scored, True))


_SECTIONS = f"SELECT doc_id, unnest(range(0, len(s))) pos, unnest(s) x FROM (SELECT doc_id, {_SENT} s FROM documents)"


def _scored_sections(documents):
    sets = F.transform(T.sentences(F.col("text")), lambda x: F.array_distinct(T.tokens(x)))
    return documents.select("doc_id", F.transform(sets, lambda t, i: F.struct(i.alias("pos"), F.round(F.size(t) / (F.size(t) + 10.0), 6).alias("score"), t.alias("set"))).alias("s"))


@_query("documents")
def mmr_sections(documents):
    return ranking.mmr_sections(_scored_sections(documents))


@_query("documents", f"""WITH r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) - 1 p, greatest(1, count(*) OVER (PARTITION BY doc_id) // 3) t FROM (SELECT doc_id, pos, len({_TOK.replace('text', 'x')}) n FROM ({_SECTIONS}))),
 a AS (SELECT *, CASE WHEN p % 2 = 0 THEN (t + 1) // 2 - 1 - p // 2 ELSE (t + 1) // 2 + (p - 1) // 2 END i FROM r)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN p >= t THEN p WHEN i < t // 2 THEN i - 1000000000 ELSE i + 1000000000 END) - 1 AS INTEGER) AS place FROM a""")
def attention_order(documents):
    s = documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "x")).withColumn("n", F.size(T.tokens(F.col("x"))))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "pos")) - 1
    return ranking.attention_order(s.withColumn("place", place))


@_query("documents benchmark", f"""WITH b AS ({_SQL["bm25_rank"]}), d AS (SELECT doc_id, {_TOK} t FROM documents), g AS (SELECT doc_id, array_to_string(t[i : i + 11], ' ') g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 10)) i FROM d)),
 p AS (SELECT item_id, array_to_string(t[6:17], ' ') g FROM (SELECT item_id, {_TOK} t FROM benchmark) WHERE len(t) >= 17), r AS (SELECT DISTINCT item_id, doc_id FROM p JOIN g USING (g))
SELECT item_id, count(b.doc_id) AS hits, count(*) AS n, count(b.doc_id) / CAST(count(*) AS DOUBLE) AS recall FROM r LEFT JOIN b USING (item_id, doc_id) GROUP BY 1""")
def ranking_recall(documents, benchmark):
    """How many of the documents that hold a passage of an item are among the ten that BM25 ranks highest for it."""
    passages = benchmark.select("item_id", T.tokens(F.col("text")).alias("t")).where("size(t) >= 17").select("item_id", F.expr("slice(t, 6, 12)").alias("t"))
    return ranking.recall_at(ranking.bm25(documents, benchmark), ranking.holders(documents, passages, 12), 10, "item_id", "doc_id")


_WORDS = "|".join(T.literal(w) for w in sorted(T.DIRECTIVES, key=lambda x: (-len(x), x)))
_TURNS = rf"SELECT conv_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, count(*) OVER (PARTITION BY conv_id) AS n, round(CASE lower(role) WHEN 'system' THEN 3 WHEN 'developer' THEN 2.5 WHEN 'user' THEN 2 WHEN 'tool' THEN 1.5 ELSE 1 END + 1.5 * len(regexp_extract_all(text, '(?i)\b(?:{_WORDS})\b')) + 1 + 1.5 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) / CAST(count(*) OVER (PARTITION BY conv_id) AS DOUBLE), 6) AS score FROM conversations"


@_query("conversations", f"SELECT conv_id, turn, role, place, n, score FROM ({_TURNS})")
def turn_scores(conversations):
    return chats.turn_scores(conversations)


_RATIO = """SELECT conv_id, n, greatest((CASE WHEN n > 50 THEN 0.25 WHEN n > 20 THEN 0.3 ELSE 0.4 END)::DOUBLE * (CASE WHEN mean < 50 THEN 1.2 ELSE 1 END)::DOUBLE, CASE WHEN system THEN 0.3 ELSE 0 END, CASE WHEN n > 8 THEN 8 / n::DOUBLE ELSE 0.5 END) AS ratio
FROM (SELECT conv_id, count(*) n, floor(avg(len(regexp_extract_all(text, '[^ \\t\\n]+')))) mean, bool_or(lower(role) = 'system') system FROM conversations GROUP BY 1)"""
_KEPT = f"""WITH t AS (SELECT a.*, greatest(4, floor(a.n * ratio + 1e-9)) k, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) r, lower(role) = 'user' u, lower(role) = 'assistant' s FROM ({_TURNS}) a JOIN ({_RATIO}) b USING (conv_id)),
 l AS (SELECT *, CASE WHEN u AND coalesce(last_value(CASE WHEN u OR s THEN s END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END b FROM t),
 e AS (SELECT *, CASE WHEN u OR s THEN sum(b) OVER (PARTITION BY conv_id ORDER BY turn) END x, max(CASE WHEN u THEN place END) OVER (PARTITION BY conv_id) lu FROM l),
 f AS (SELECT *, max(CASE WHEN u THEN place END) OVER (PARTITION BY conv_id, x) eu, min(CASE WHEN s THEN place END) OVER (PARTITION BY conv_id, x) fr FROM e),
 o AS (SELECT *, coalesce(r <= k OR lower(role) = 'system' OR place = n OR place = lu OR (x IS NOT NULL AND eu = lu AND place = fr), false) own FROM f),
 p AS (SELECT *, n <= 5 OR k >= n OR own OR coalesce(x IS NOT NULL AND bool_or(own) OVER (PARTITION BY conv_id, x) AND eu IS NOT NULL AND fr IS NOT NULL AND (place = eu OR place = fr), false) kept FROM o)
SELECT conv_id, turn, role, text, score, kept FROM p"""


@_query("conversations", f"SELECT conv_id, turn, role, score FROM ({_KEPT}) WHERE kept")
def history_keep_top(conversations):
    return chats.kept_turns(conversations).where("kept").drop("text", "kept")


_CLAUSE = "[^.!?\\n]*(?:" + "|".join(T.DIRECTIVES) + ")[^.!?\\n]*"
_NOTES = f"""WITH s AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) t FROM ({_KEPT}) WHERE NOT kept),
 f AS (SELECT conv_id, turn, role, trim(CASE WHEN regexp_matches(t, '(?i){_CLAUSE}') THEN regexp_extract(t, '(?i){_CLAUSE}') ELSE regexp_extract(t, '[^.!?\\n]+') END) c FROM s),
 n AS (SELECT conv_id, turn, '- ' || upper(role[1]) || lower(role[2:]) || ': ' || CASE WHEN length(c) > 160 THEN rtrim(substr(c, 1, 157)) || '...' ELSE c END note FROM f WHERE length(c) > 0)
SELECT conv_id, turn, note FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(note) ORDER BY turn) r FROM n) WHERE r = 1"""


@_query("conversations", _NOTES)
def history_notes(conversations):
    return chats.notes(chats.kept_turns(conversations))


@_query("conversations", f"""WITH k AS ({_KEPT}), o AS ({_NOTES}), l AS (SELECT conv_id, string_agg(role || ': ' || trim(text), chr(10) ORDER BY turn) t FROM k WHERE kept GROUP BY 1), m AS (SELECT conv_id, string_agg(note, chr(10) ORDER BY turn) t FROM o GROUP BY 1)
SELECT conv_id, l.t || coalesce(chr(10) || 'Summary Notes:' || chr(10) || m.t, '') AS text FROM l LEFT JOIN m USING (conv_id)""")
def history_summary(conversations):
    return chats.transcript(chats.kept_turns(conversations))


@_query("conversations", r"""SELECT conv_id, role, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT conv_id, role, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) t FROM conversations) GROUP BY 1, 2""")
def chat_segments(conversations):
    line = F.concat("role", F.lit(": "), F.btrim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")))
    chats_ = conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    s = chats_.select("conv_id", F.explode(chats.segments(F.col("text"))).alias("s"))
    return s.groupBy("conv_id", F.col("s.role").alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("s.content")).alias("chars"))


@_query("conversations", f"SELECT conv_id, turn, {_CASE} AS kind FROM (SELECT conv_id, turn, text, {_HEAD} FROM conversations)")
def classify_conversations(conversations):
    return conversations.select("conv_id", "turn", T.content_class(F.col("text")).alias("kind"))


@_query("conversations", f"SELECT conv_id, n, round(ratio, 6) AS ratio FROM ({_RATIO})")
def history_keep_ratio(conversations):
    return chats.keep_ratios(conversations).withColumn("ratio", F.round("ratio", 6))


# --- more ranking, protection and structure


@_query("documents", f"""WITH s AS (SELECT doc_id, len(list_filter(s, lambda t: len(t) > 0)) n, unnest(range(0, len(s))) pos, unnest(s) t FROM (SELECT doc_id, list_transform({_SENT}, lambda x: {_TOK.replace('text', 'x')}) s FROM documents)),
 f AS (SELECT doc_id, n, pos, len, token, count(*) c FROM (SELECT doc_id, n, pos, len(t) len, unnest(t) token FROM s) GROUP BY ALL),
 w AS (SELECT *, c / CAST(len AS DOUBLE) * (ln((n + 1) / CAST(count(*) OVER (PARTITION BY doc_id, token) + 1 AS DOUBLE)) + 1) w FROM f),
 u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, pos)) u FROM w), a AS (SELECT *, sum(u) OVER (PARTITION BY doc_id, token) a FROM u)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(greatest(sum(u * a) - 1, 0), 4) AS score FROM a GROUP BY 1, 2""")
def lexrank_rank(documents):
    return ranking.lexrank(documents).withColumn("score", F.round("score", 4))


@_query("embeddings", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def embedding_topk(embeddings):
    return ranking.nearest_sections(embeddings, embeddings.where("vec_id = 0"), 20)


@_query("documents", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN count(*) > 1 THEN least((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)), 1) ELSE 0 END, 6) AS entropy FROM (SELECT doc_id, pos, token, count(*) c FROM (SELECT doc_id, pos, unnest({_TOK.replace('text', 'x')}) token FROM (SELECT doc_id, unnest(range(0, len(s))) pos, unnest(s) x FROM (SELECT doc_id, {_SENT} s FROM documents))) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def sentence_entropy(documents):
    return ranking.sentence_entropy(documents).withColumn("entropy", F.round("entropy", 6))


@_query("documents", f"SELECT token, round(ln((n + 1) / CAST(count(*) + 1 AS DOUBLE)) + 1, 6) AS idf FROM (SELECT doc_id, unnest(list_distinct({_TOK})) token FROM documents), (SELECT count(*) n FROM documents WHERE len({_TOK}) > 0) GROUP BY token, n")
def idf_weights(documents):
    return ranking.idf_weights(documents).withColumn("idf", F.round("idf", 6))


_PARA = r"list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n'), lambda x: trim(x, e' \t\r\f\n')), lambda x: length(x) > 0)"


@_query("documents", f"SELECT doc_id, CASE WHEN len(f) < len(p) THEN array_to_string(f, e'\\n\\n') ELSE text END AS text FROM (SELECT doc_id, text, p, list_filter(p, lambda x, i: length(x) < 100 OR list_position(k, {_SQUEEZE.format('x')}) = i) f FROM (SELECT doc_id, text, p, list_transform(p, lambda x: CASE WHEN length(x) >= 100 THEN {_SQUEEZE.format('x')} ELSE '' END) k FROM (SELECT doc_id, text, {_PARA} p FROM documents)))")
def verbatim_block_dedup(documents):
    return dedup.blocks(documents).select("doc_id", "text")


@_query("documents", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, regexp_matches(x, '{structure.HEADER}') AS is_header FROM (SELECT doc_id, unnest(range(0, len(p))) pos, unnest(p) x FROM (SELECT doc_id, {_PARA} p FROM documents))")
def header_sections(documents):
    return structure.sections(documents).select("doc_id", "pos", "is_header")


@_query("documents", f"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '{structure.PROTECTED}'))) AS INTEGER) AS n_spans, regexp_replace(text, '{structure.PROTECTED}', '⟦⟧', 'g') AS masked, text AS restored FROM documents")
def protect_restore(documents):
    rows = structure.protect(documents.select("doc_id", "text"))
    return rows.select("doc_id", F.size("spans").alias("n_spans"), F.regexp_replace("masked", structure.MARK, "⟦⟧").alias("masked"), structure.restore(F.col("masked"), F.col("spans")).alias("restored"))


@_query("documents", f"SELECT doc_id, label, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{structure.LABEL}', 1)) AS label FROM documents) GROUP BY 1, 2 HAVING count(*) >= 2")
def repeated_labels(documents):
    return structure.repeated_labels(documents)


@_query("events", "SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events")
def json_minify(events):
    return events.select("event_id", structure.minified(F.col("props")).alias("props"))


@_query("events", """WITH r AS (SELECT user_id, event_id a, event_id + CAST(floor(value) AS BIGINT) z FROM events), f AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END fresh FROM r)
SELECT user_id, min(a) AS first, max(z) AS last FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) g FROM f) GROUP BY user_id, g""")
def range_merge(events):
    rows = events.select("user_id", F.col("event_id").alias("first"), (F.col("event_id") + F.floor("value")).alias("last"))
    return structure.merged_ranges(rows, "user_id", "first", "last")


# --- content routing, discourse and weights

_LABEL = """CASE WHEN regexp_matches(lower(x), '^instructions?:') THEN 'instruction' WHEN regexp_matches(x, '{c}') THEN 'constraint' WHEN regexp_matches(x, '{e}') AND NOT regexp_matches(x, '{i}') THEN 'example'
 WHEN regexp_matches(x, '{i}') THEN 'instruction' ELSE 'background' END""".format(c=discourse.CONSTRAINT.replace("'", "''"), e=discourse.EXAMPLE, i=discourse.INSTRUCTION)


@_query("conversations", f"""SELECT conv_id, turn, label, CASE label WHEN 'instruction' THEN 0.9 WHEN 'constraint' THEN 0.85 WHEN 'example' THEN 0.6 ELSE 0.4 END::DOUBLE AS weight, CASE WHEN label = 'constraint' THEN 0.75 WHEN label = 'example' THEN 0.65
 WHEN label = 'instruction' THEN CASE WHEN regexp_matches(lower(x), '^instructions?:') THEN 0.9 WHEN regexp_matches(x, '{discourse.EXAMPLE}') THEN 0.55 ELSE 0.6 END WHEN regexp_matches(x, '{discourse.BACKGROUND}') THEN 0.65 ELSE 0.3 END::DOUBLE AS confidence
FROM (SELECT conv_id, turn, x, {_LABEL} AS label FROM (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Instructions: ' WHEN 1 THEN 'For example: ' WHEN 2 THEN 'Background. ' WHEN 3 THEN 'You must ' WHEN 4 THEN 'Please return, e.g. ' ELSE '' END || text AS x FROM conversations))""")
def discourse_labels(conversations):
    head = F.expr("element_at(array('Instructions: ', 'For example: ', 'Background. ', 'You must ', 'Please return, e.g. ', ''), cast(turn % 6 as int) + 1)")
    rows = conversations.select("conv_id", "turn", discourse.label(F.concat(head, "text")).alias("l"))
    return rows.select("conv_id", "turn", "l.label", discourse.label_weight(F.col("l.label")).alias("weight"), "l.confidence")


@_query("conversations", r"""WITH c AS (SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || regexp_replace(text, '[:\n]', ' ', 'g'), ' / ' ORDER BY turn) AS text FROM conversations GROUP BY 1),
 s AS (SELECT conv_id, string_split(regexp_replace(text, '(^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9 ]{0,40}:)', '\1' || chr(1) || '\2', 'g'), chr(1)) p FROM c), b AS (SELECT conv_id, list_filter(list_transform(p, lambda x: trim(x, e' \t\r\n\f')), lambda x: length(x) > 0) p FROM s)
SELECT conv_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS pos, unnest(p) AS block FROM b""")
def heading_blocks(conversations):
    line = F.concat(F.upper(F.substring("role", 1, 1)), F.substring("role", 2, 100), F.lit(": "), F.regexp_replace("text", r"[:\n]", " "))
    text = conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), " / ").alias("text"))
    return text.select("conv_id", F.posexplode(discourse.blocks(F.col("text"))).alias("pos", "block"))


_SPANS = "[(CAST(doc_id % 50 AS INTEGER), CAST(doc_id % 50 + 40 AS INTEGER), 'Instruction', NULL), (CAST(n_chars - 20 AS INTEGER), CAST(n_chars + 30 AS INTEGER), 'example', 1.7), (10, 5, NULL, NULL), (-3, 8, 'other', NULL), (CAST(n_chars AS INTEGER), CAST(n_chars + 1 AS INTEGER), NULL, 0.5)]"


def _spans(documents):
    one = "named_struct('start', cast({0} as int), 'end', cast({1} as int), 'label', {2}, 'weight', {3})"
    spans = [("doc_id % 50", "doc_id % 50 + 40", "'Instruction'", "cast(null as double)"), ("n_chars - 20", "n_chars + 30", "'example'", "1.7D"), ("10", "5", "cast(null as string)", "cast(null as double)"), ("-3", "8", "'other'", "cast(null as double)"), ("n_chars", "n_chars + 1", "cast(null as string)", "0.5D")]
    return documents.select("doc_id", "n_chars", discourse.clipped(F.expr(f"array({', '.join(one.format(*x) for x in spans)})"), F.col("n_chars").cast("int")).alias("spans"))


_CLIPPED = f"""SELECT doc_id, n_chars, i, greatest(s[1], 0) a, least(s[2], n_chars) z, s[3] label, CASE WHEN s[4] IS NULL THEN CASE lower(s[3]) WHEN 'instruction' THEN 0.9 WHEN 'constraint' THEN 0.85 WHEN 'example' THEN 0.6 WHEN 'background' THEN 0.4 ELSE 0.6 END ELSE least(greatest(s[4], 0), 1) END::DOUBLE w
 FROM (SELECT doc_id, n_chars, unnest(range(0, 5)) i, unnest({_SPANS}) s FROM documents) WHERE s[2] > s[1] AND s[1] < n_chars"""


@_query("documents", f"SELECT doc_id, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS until, label, w AS weight FROM ({_CLIPPED})")
def clipped_spans(documents):
    return _spans(documents).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", F.col("s.end").alias("until"), "s.label", "s.weight")


@_query("documents", f"SELECT d.doc_id, coalesce(arg_min(w, i) FILTER (a < 30 AND z > 0), 1) AS head, coalesce(arg_min(w, i) FILTER (a < d.n_chars AND z > d.n_chars - 10), 1) AS tail, 1.0::DOUBLE AS none FROM documents d LEFT JOIN ({_CLIPPED}) c USING (doc_id) GROUP BY 1")
def range_weights(documents):
    weight = lambda a, z: discourse.range_weight(a, z, F.col("spans"))
    n = F.col("n_chars").cast("int")
    return _spans(documents).select("doc_id", weight(F.lit(0), F.lit(30)).alias("head"), weight(n - 10, n).alias("tail"), weight(F.lit(5), F.lit(5)).alias("none"))


@_query("documents", f"""WITH k AS (SELECT doc_id, text, {_CASE} AS kind FROM (SELECT doc_id, text, {_HEAD} FROM documents))
SELECT doc_id, kind IN ('dialogue', 'markdown', 'technical_doc', 'heavy_document', 'general_prose') AND length(text) > 2000 AS learn_phrases, kind NOT IN ('code', 'json') AS weigh_discourse,
 CASE WHEN kind IN ('code', 'json') THEN 'fixed' WHEN kind IN ('dialogue', 'markdown', 'technical_doc') THEN 'structured' WHEN kind = 'short' THEN 'off' ELSE 'semantic' END AS chunking,
 length(text) // 4 > 10000 AND kind IN ('heavy_document', 'technical_doc', 'markdown') AS rank_sections,
 kind IN ('code', 'json', 'technical_doc') OR (kind = 'general_prose' AND regexp_matches(CASE WHEN length(text) > 4000 THEN substr(text, 1, 2000) || substr(text, length(text) // 2 - 499, 1000) || substr(text, length(text) - 1999, 2000) ELSE text END, '{profiles.NUMBERS}')) AS keep_digits FROM k""")
def smart_context(documents):
    rows = documents.select("doc_id", "text", T.content_class(F.col("text")).alias("kind"))
    return rows.select("doc_id", profiles.smart_context(F.col("text"), F.col("kind"), F.lit(0)).alias("c")).select("doc_id", "c.*")


@_query("documents", f"""SELECT doc_id, kind, CASE kind WHEN 'code' THEN 0.985 WHEN 'json' THEN 0.99 WHEN 'markdown' THEN 0.93 WHEN 'technical_doc' THEN 0.96 ELSE 1 END::DOUBLE AS semantic_guard,
 CASE kind WHEN 'code' THEN 0.4 WHEN 'json' THEN 0.35 WHEN 'dialogue' THEN 1.35 WHEN 'markdown' THEN 1.1 WHEN 'technical_doc' THEN 1.05 WHEN 'heavy_document' THEN 1.5 WHEN 'short' THEN 1 ELSE 1.15 END::DOUBLE AS entropy_budget,
 CAST(len(list_distinct(list_concat(['alias_json_keys', 'compress_examples', 'summarize_history', 'remove_articles', 'apply_symbolic_replacements', 'apply_macro_dictionary'],
  CASE kind WHEN 'short' THEN ['compress_repeated_fragments', 'prune_low_entropy', 'summarize_history', 'compress_examples'] WHEN 'heavy_document' THEN ['clean_instruction_noise'] WHEN 'markdown' THEN ['compress_clauses'] WHEN 'technical_doc' THEN ['shorten_synonyms', 'compress_clauses'] ELSE [] END))) AS INTEGER) AS n_disabled
FROM (SELECT doc_id, {_CASE} AS kind FROM (SELECT doc_id, text, {_HEAD} FROM documents)) WHERE kind NOT IN ('code', 'json')""")
def profile_settings(documents):
    rows = documents.select("doc_id", T.content_class(F.col("text")).alias("kind")).where("kind not in ('code', 'json')")
    off = profiles.disabled_passes(F.col("kind"), profiles.mode(F.lit(" Normal ")))
    return rows.select("doc_id", "kind", profiles.modifier(F.col("kind"), "semantic_guard").alias("semantic_guard"), profiles.modifier(F.col("kind"), "entropy_budget").alias("entropy_budget"), F.size(off).alias("n_disabled"))


# --- phrases, numbers and values

#: Rules of the queries below, over words that the test tables have.
_FORMS = {"in the": "within", "from": "per", "that": "it", "stupid": "unwise", "worthless": "Poor", "of the": "of"}
_PHRASE = "(?i)" + T.alternation(_FORMS)
_FORM = "CASE lower(m) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FORMS.items()) + " END"
_CASED = "CASE WHEN {f} <> lower({f}) THEN {f} WHEN m = upper(m) AND upper(m) <> lower(m) THEN upper({f}) WHEN m = lower(m) THEN {f} WHEN m[1] = upper(m[1]) AND m[2:] = lower(m[2:]) THEN upper({f}[1]) || {f}[2:] ELSE {f} END".format(f=_FORM)


@_query("documents", f"SELECT doc_id, {_REPLACED.format(t='text', p=_PHRASE, new=_CASED.replace('(m)', '(z[2])').replace(' m ', ' z[2] ').replace('m[1]', 'z[2][1]').replace('m[2:]', 'z[2][2:]'))} AS text FROM documents")
def canonical_forms(documents):
    return documents.select("doc_id", phrases.canonical(F.col("text"), _FORMS).alias("text"))


@_query("documents")
def phrase_dictionary(documents):
    return documents.select("doc_id", phrases.with_dictionary(F.col("text"), {k: v[:1] for k, v in _FORMS.items()}).alias("d")).select("doc_id", "d.*")


@_query("documents", f"SELECT doc_id, regexp_matches(text, '(?i)stupid|from|that|in|of|worthless') AS hinted, length(text) > 0 AND NOT contains(text, '?') AND NOT regexp_matches(text, '{T.NEGATION.replace(chr(39), chr(39) * 2)}') AS allowed FROM documents")
def canonical_gate(documents):
    text = F.col("text")
    # null texts have neither in SQL
    return documents.select("doc_id", text.rlike(T.ascii_words(phrases.hint(_FORMS))).alias("hinted"), F.when(text.isNotNull(), T.prose_may_change(text)).alias("allowed"))


@_query("lineitem")
def numeric_precision(lineitem):
    text = F.concat_ws(" and ", (F.col("l_extendedprice") / 7).cast("decimal(20,6)").cast("string"), (F.col("l_discount") / 9).cast("decimal(20,7)").cast("string"), F.col("l_quantity").cast("decimal(20,4)").cast("string"))
    return lineitem.select("l_orderkey", "l_linenumber", T.short_decimals(text).alias("text"))


_ENTROPY = "0.35::DOUBLE * len(list_distinct(string_split(w, ''))) / length(w) + 0.3::DOUBLE * len(regexp_extract_all(w, '[^A-Za-z0-9_]')) / length(w) + 0.2::DOUBLE * len(regexp_extract_all(w, '[0-9]')) / length(w) + 0.15::DOUBLE * len(regexp_extract_all(w, '[A-Z]')) / length(w) - 0.2::DOUBLE * (1 - len(list_distinct(string_split(w, ''))) / CAST(length(w) AS DOUBLE))"


@_query("conversations", f"SELECT conv_id, turn, count(*) AS n, count(*) FILTER (keep) AS kept, round(avg(e), 6) AS entropy FROM (SELECT conv_id, turn, e, regexp_matches(w, '{T.CODE_SIGNS}') OR regexp_matches(lower(w), '{T.KEPT_WORDS}') OR e >= 0.62 keep FROM (SELECT conv_id, turn, w, greatest(0, least(1, {_ENTROPY})) e FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) w FROM conversations))) GROUP BY 1, 2")
def token_prefilter(conversations):
    w = conversations.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f]+"), F.lit(0))).alias("w"))
    rows = w.select("conv_id", "turn", T.sure_to_stay(F.col("w")).alias("keep"), T.char_entropy(F.col("w")).alias("e"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count_if("keep").alias("kept"), F.round(F.avg("e"), 6).alias("entropy"))


@_query("documents", f"""SELECT doc_id, CAST(greatest(0, t + round_even((length(b) - length(a)) / CASE WHEN length(a) > 0 THEN greatest(length(a) / CAST(greatest(t, 1) AS DOUBLE), 1.5) ELSE 4 END, 0)) AS BIGINT) AS tokens FROM (SELECT doc_id, text a, substr(text, 1, 3 * length(text) // 5) b, {_NTOK.format('text')} t FROM documents)""")
def token_delta(documents):
    shorter = F.expr("substring(text, 1, cast(3 * length(text) div 5 as int))")
    return documents.select("doc_id", T.tokens_after(F.col("text"), shorter, T.n_tokens(F.col("text"))).alias("tokens"))


_VALUED = "text || ' AWS_REGION=eu-' || (doc_id % 3) || ' since 2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || CASE WHEN doc_id % 2 = 0 THEN ' on i-0123456789abcdef0' ELSE '' END"


@_query("documents", f"""WITH v AS (SELECT doc_id, text, list_distinct(list_concat(regexp_extract_all(t, '\\b[A-Z][A-Z0-9_]{{2,}}=[^ \\t\\n\\r\\f,;|<>"'']+'), regexp_extract_all(t, '(?i)\\bi-[0-9a-f]{{17}}\\b'), regexp_extract_all(t, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b'))) d FROM (SELECT doc_id, text, {_VALUED} t FROM documents))
SELECT doc_id, CAST(len(d) AS INTEGER) AS n, CASE WHEN regexp_matches(rtrim(text), '[.!?]$') THEN ' ' ELSE '. ' END || 'Include AWS_REGION=eu-' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN ', i-0123456789abcdef0, and ' ELSE ' and ' END || '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '.' AS tail FROM v WHERE len(d) = 3 - doc_id % 2 AND text = trim(text)""")
def hard_constraints(documents):
    text = F.expr("concat(text, ' AWS_REGION=eu-', doc_id % 3, ' since 2024-01-', lpad(doc_id % 28 + 1, 2, '0'), if(doc_id % 2 = 0, ' on i-0123456789abcdef0', ''))")
    rows = documents.select("doc_id", "text", T.hard_values(text).alias("v")).where("size(v) = 3 - doc_id % 2 and text = trim(text)")
    out = T.with_values(F.col("text"), F.col("v"))
    return rows.select("doc_id", F.size("v").alias("n"), F.substring(out, F.length(F.rtrim("text")) + 1, F.lit(1 << 20)).alias("tail"))


@_query("conversations", "SELECT conv_id, turn, length(trim(text, e' \\t\\r\\n')) = 0 OR regexp_matches(lower(text), 'to make it easier|please use|step-by-step guide|use the exact wording') OR len(regexp_extract_all(lower(text), 'please')) >= 3 AS low FROM conversations")
def low_quality_rewrites(conversations):
    return conversations.select("conv_id", "turn", T.low_quality(F.col("text")).alias("low"))


@_query("orders", "SELECT o_orderkey, length(o_orderstatus) AS before, try_cast(o_orderpriority[1:1] AS DOUBLE) AS level, coalesce(try_cast(o_orderpriority AS DOUBLE), -1) AS safe FROM orders")
def safe_numbers(orders):
    return orders.select("o_orderkey", F.length("o_orderstatus").cast("long").alias("before"), F.expr("try_cast(substring(o_orderpriority, 1, 1) as double)").alias("level"), F.coalesce(F.expr("try_cast(o_orderpriority as double)"), F.lit(-1.0)).alias("safe"))


# --- structure


@_query("orders", """WITH r AS (SELECT o_custkey, count(*) n, string_agg('    ' || o_orderkey || ',' || o_orderstatus, chr(10) ORDER BY o_orderkey) t, any_value(o_orderkey) k, any_value(o_orderstatus) s FROM orders GROUP BY 1)
SELECT o_custkey, 'customer' || chr(10) || '  key: ' || o_custkey || chr(10) || CASE WHEN n > 1 THEN '  orders[' || n || '] id,status' || chr(10) || t ELSE '  orders[1]' || chr(10) || '    -' || chr(10) || '      id: ' || k || chr(10) || '      status: ' || s END AS value FROM r""")
def structured_notation(orders):
    one = F.transform(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))), lambda x: x)
    rows = orders.groupBy("o_custkey").agg(one.alias("orders"))
    value = F.to_json(F.struct(F.struct(F.col("o_custkey").alias("key"), F.col("orders").alias("orders")).alias("customer")))
    return notation.notated(rows.select("o_custkey", value.alias("value")), "o_custkey", "value")


@_query("documents", r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) x FROM documents) SELECT doc_id, count(*) AS n, CAST(sum(length(trim(x, e' \t\r\f'))) AS BIGINT) AS chars FROM s WHERE length(trim(x, e' \t\r\f')) > 0 GROUP BY 1""")
def sentence_spans(documents):
    s = documents.select("doc_id", F.explode(structure.sentence_spans(F.col("text"))).alias("s"), "text")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("chars"))


@_query("conversations", r"""WITH t AS (SELECT conv_id, turn, 'Never delay.' || chr(10) || text || chr(10) || CASE WHEN turn % 2 = 0 THEN '- Never delay.' ELSE 'Be well.' END AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Global constraints (applies to all sections below):' || chr(10) || '- Never delay.' || chr(10) || chr(10) || regexp_replace(text[14:], '\n- Never delay\.$', '') ELSE text END AS text FROM t WHERE NOT contains(text[14:], chr(10) || chr(10)) AND text[14:15] NOT IN (' ', chr(10))""")
def hoisted_constraints(conversations):
    tail = F.when(F.col("turn") % 2 == 0, "- Never delay.").otherwise("Be well.")
    rows = conversations.select("conv_id", "turn", F.concat_ws("\n", F.lit("Never delay."), "text", tail).alias("text"))
    rows = rows.where("not contains(substring(text, 14), '\n\n') and substring(text, 14, 1) not in (' ', '\n') and substring(text, 14, 2) <> ' '")
    return rows.select("conv_id", "turn", structure.hoisted(F.col("text")).alias("text"))


@_query("documents", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'unclosed' ELSE '' END AS error, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE length(text) END AS protected FROM documents WHERE length(text) > 0")
def protect_tags(documents):
    text = F.concat(F.lit("a <protect>"), F.substring("text", 1, 1), F.lit("<PROTECT>"), F.expr("substring(text, 2)"), F.lit("</protect>"), F.when(F.col("doc_id") % 4 == 3, "").otherwise("</protect> b"))
    rows = documents.where("length(text) > 0").select("doc_id", structure.protected_chunks(text).alias("p"))
    size = F.aggregate(F.filter("p.chunks", lambda c: c["kind"] == "protected"), F.lit(0), lambda a, c: a + F.length(c["value"]))
    return rows.select("doc_id", F.coalesce("p.error", F.lit("")).alias("error"), F.when(F.col("p.error").isNull(), size).otherwise(0).cast("long").alias("protected"))


# --- requests, pages, costs and jobs


@_query("documents", f"SELECT doc_id AS request, CAST(i AS INTEGER) AS item, CASE WHEN doc_id % 5 >= 3 THEN NULL ELSE trim(text, e' \\t\\n\\r') END AS text, CASE doc_id % 3 WHEN 0 THEN 'maximum' WHEN 1 THEN 'conservative' ELSE 'balanced' END AS mode, CASE doc_id % 5 WHEN 3 THEN 'both' WHEN 4 THEN 'neither' END AS error FROM (SELECT *, unnest(range(0, CASE WHEN doc_id % 5 = 1 THEN 2 ELSE 1 END)) i FROM documents) WHERE length(trim(text, e' \\t\\n\\r')) > 0")
def request_items(documents):
    rows = documents.withColumn("t", F.col("text")).where("length(btrim(t, ' \t\n\r')) > 0")
    rows = rows.selectExpr("doc_id request", "if(doc_id % 5 in (0, 2, 3), t, null) prompt", "if(doc_id % 5 in (1, 3), array(t, t), null) prompts", "element_at(array('MAX ', 'safe', 'normal'), cast(doc_id % 3 as int) + 1) mode")
    return io.requests(rows)


@_query("customer", "SELECT c_custkey, c_name, total FROM (SELECT c_custkey, c_name, count(*) OVER () AS total FROM customer WHERE c_acctbal > 0 ORDER BY lower(c_name), c_custkey LIMIT 20 OFFSET 40)")
def counted_page(customer):
    rows = customer.where("c_acctbal > 0").select("c_custkey", "c_name")
    page = rows.orderBy(F.lower("c_name"), "c_custkey").offset(40).limit(20)
    return page.join(F.broadcast(rows.agg(F.count("*").alias("total"))))  # one row


@_query("part", "SELECT p_partkey, CASE WHEN lower(p_type) = lower('standard POLISHED tin') THEN 'changed' ELSE p_brand END AS p_brand FROM part")
def nocase_update(part):
    return part.select("p_partkey", F.when(F.lower("p_type") == F.lower(F.lit("standard POLISHED tin")), "changed").otherwise(F.col("p_brand")).alias("p_brand"))


@_query("events", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events WHERE ts >= TIMESTAMP '2024-01-16') WHERE r <= 3")
def ttl_evict(events):
    live = events.where("ts >= timestamp '2024-01-16'")
    return R.evict(live, "user_id", 3, "ts", "event_id").select("user_id", "event_type", "event_id")


@_query("orders", "WITH k AS (SELECT o_orderpriority AS kind, round(avg(o_totalprice), 4) a, count(*) b, round(min(o_totalprice), 4) c, round(max(o_totalprice), 4) d FROM orders GROUP BY 1) SELECT kind, a, b, c, d FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.a >= x.a AND y.b >= x.b AND y.c <= x.c AND y.d <= x.d AND (y.a > x.a OR y.b > x.b OR y.c < x.c OR y.d < x.d))")
def pareto_front(orders):
    k = orders.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.round(F.avg("o_totalprice"), 4).alias("a"), F.count("*").alias("b"), F.round(F.min("o_totalprice"), 4).alias("c"), F.round(F.max("o_totalprice"), 4).alias("d"))
    return R.pareto(k, ["a", "b"], ["c", "d"])


@_query("events", "SELECT s, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' AND value > 50 THEN 'click' WHEN event_type = 'view' AND value > 80 THEN 'view' END s FROM events) WHERE s IS NOT NULL GROUP BY 1")
def reaped_counts(events):
    stale = R.reaped(events, F.col("event_type"), F.col("value"), {"click": 50, "view": 80}).where("status = 'failed' and event_type <> 'failed'")
    return stale.groupBy(F.col("event_type").alias("s")).agg(F.count("*").alias("n"))


@_query("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS tokens, list_sort(list(l_quantity))[CAST(floor(count(*) * 0.99) AS INTEGER) + 1] AS p99, round(sum(l_quantity) / (sum(l_tax) + 1), 4) AS per_second FROM lineitem GROUP BY 1, 2")
def benchmark_throughput(lineitem):
    keys = ["l_returnflag", "l_linestatus"]
    total = lineitem.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("tokens"), F.round(F.sum("l_quantity") / (F.sum("l_tax") + 1), 4).alias("per_second"))
    return total.join(R.grouped_percentile(lineitem, keys, "l_quantity", 0.99).withColumnRenamed("value", "p99"), keys)


@_query("documents", "SELECT d.doc_id, f.first_id, f.n, f.chars FROM documents d JOIN (SELECT md5(text) h, min(doc_id) first_id, count(*) n, any_value(length(text)) chars FROM documents GROUP BY 1) f ON md5(d.text) = f.h")
def batch_fan_out(documents):
    return dedup.fanned_out(documents, lambda d: d.select("digest", F.length("text").alias("chars")))


@_query("orders", "SELECT o_custkey AS batch, count(*) AS n, round(sum(o_totalprice * (o_orderkey % 10)) / sum(o_totalprice), 6) AS weighted FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def batch_summary(orders):
    return R.weighted_mean(orders.where("o_totalprice > 0").withColumn("x", F.col("o_orderkey") % 10), F.col("o_custkey").alias("batch"), "x", "o_totalprice").withColumn("weighted", F.round("weighted", 6))


@_query("documents", f"SELECT doc_id, round(t / 1000.0 * 0.5, 9) AS cost_before, round(s / 1000.0 * 0.5, 9) AS cost_after, round(greatest(t - s, 0) / 1000.0 * 0.5, 9) AS cost_saved, CASE WHEN n > 0 THEN round(100.0 * (n - m) / n, 2) ELSE 0 END AS compression FROM (SELECT doc_id, {_NTOK.format('text')} t, {_NTOK.format('x')} s, length(text) n, length(x) m FROM (SELECT doc_id, text, substr(text, 1, length(text) // 2) x FROM documents))")
def cost_estimate(documents):
    x = F.expr("substring(text, 1, cast(length(text) div 2 as int))")
    before, after, n = T.n_tokens(F.col("text")), T.n_tokens(x), F.length("text")
    cost = lambda t: F.round(t / 1000 * 0.5, 9)
    return documents.select("doc_id", cost(before).alias("cost_before"), cost(after).alias("cost_after"), cost(F.greatest(before - after, F.lit(0))).alias("cost_saved"), F.when(n > 0, F.round(100 * (n - F.length(x)) / n, 2)).otherwise(0.0).alias("compression"))


@_query("events", "SELECT user_id, event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts <= a.ts AND b.ts + to_seconds(CAST(floor(b.value * 1000) AS BIGINT)) > a.ts) AS slots FROM events a")
def concurrency_slots(events):
    return R.in_flight(events, "user_id", "event_id", F.col("ts"), F.timestamp_add("SECOND", F.floor(F.col("value") * 1000), "ts"))


@_query("embeddings", "SELECT a.vec_id, b.vec_id AS other, round(greatest(-1, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def adjacent_cosine(embeddings):
    other = embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e"))
    return embeddings.join(other, "vec_id").select("vec_id", "other", F.round(T.cosine(F.col("embedding").cast("array<double>"), F.col("e").cast("array<double>")), 6).alias("cosine"))


@_query("documents", f"""WITH i AS (SELECT token, ln((1 + n) / CAST(1 + count(*) AS DOUBLE)) + 1 w FROM (SELECT doc_id, unnest(list_distinct({_TOK})) token FROM documents), (SELECT count(*) n FROM documents WHERE len({_TOK}) > 0) GROUP BY token, n),
 p AS (SELECT doc_id, list_distinct({_TOK}) a, list_distinct({_TOK.replace('text', 'substr(text, 1, length(text) // 2)')}) b FROM documents),
 u AS (SELECT doc_id, token, list_contains(a, token) AND list_contains(b, token) hit FROM (SELECT doc_id, a, b, unnest(list_distinct(list_concat(a, b))) token FROM p))
SELECT doc_id, round(coalesce(sum(CASE WHEN hit THEN coalesce(w, 1) ELSE 0 END) / sum(coalesce(w, 1)), 0), 6) AS score FROM u LEFT JOIN i USING (token) GROUP BY 1""")
def weighted_overlap(documents):
    return dedup.weighted_overlap(documents.select("doc_id", T.tokens(F.col("text")).alias("a"), T.tokens(F.expr("substring(text, 1, cast(length(text) div 2 as int))")).alias("b")), ranking.idf_weights(documents)).withColumn("score", F.round("score", 6))


# --- aliases, signatures and chunks

_URLS = "concat(text, ' see https://example.org/path/', doc_id % 7, '/index and https://example.org/path/', doc_id % 7, '/index or https://example.org/other/', doc_id)"


@_query("documents", "SELECT doc_id, 'R1=https://example.org/path/' || (doc_id % 7) || '/index' AS legend, text || ' see R1 and R1 or https://example.org/other/' || doc_id AS text, text || ' see https://example.org/path/' || (doc_id % 7) || '/index and https://example.org/path/' || (doc_id % 7) || '/index or https://example.org/other/' || doc_id AS restored FROM documents WHERE NOT contains(text, 'http') AND NOT regexp_matches(text, '\\b[A-Z][0-9]+\\b')")
def aliased_references(documents):
    rows = documents.where("not contains(text, 'http')").where(~F.col("text").rlike(r"\b[A-Z][0-9]+\b"))
    rows = rows.select("doc_id", aliases.aliased(F.expr(_URLS), "reference").alias("a")).select("doc_id", "a.*")
    return rows.select("doc_id", F.array_join("legend", "; ").alias("legend"), "text", aliases.restored(F.col("text"), F.col("legend")).alias("restored"))


@_query("documents", f"SELECT doc_id, CASE WHEN len(f) < len(p) THEN array_to_string(f, ' ') ELSE text END AS text FROM (SELECT doc_id, text, p, list_filter(p, lambda x, i: length(k[i]) = 0 OR list_position(k, k[i]) = i) f FROM (SELECT doc_id, text, p, list_transform(p, lambda x: CASE WHEN len(regexp_extract_all(x, '[A-Za-z0-9_]+')) >= 6 AND regexp_matches(x, '[.!?]$') THEN {_SIG.format('x')} ELSE '' END) k FROM (SELECT doc_id, text, {_SENT} p FROM documents)))")
def normalised_sentence_dedup(documents):
    return dedup.normalised_sentences(documents).select("doc_id", "text")


@_query("documents")
def only_deduplicated(documents):
    after = dedup.sentences(documents).select("doc_id", F.col("text").alias("after"))
    return documents.join(after, "doc_id").select("doc_id", dedup.only_deduplicated(F.col("text"), F.col("after")).alias("only"))


@_query("conversations")
def chat_chunks(conversations):
    return ranking.chat_chunks(conversations, 60)


@_query("benchmark")
def gzip_rank(benchmark):
    return ranking.ranked("gzip", benchmark.select("item_id", "text"), "the and from with that")


@_query("documents", f"""WITH c AS (SELECT doc_id, 'articles' AS name, text o, regexp_replace(text, '(^|[ \t\n])(?:(?:[Tt]he|[Aa]n?)[ \t]+)+', '\\1', 'g') t FROM documents UNION ALL SELECT doc_id, 'none', text, text FROM documents),
 s AS (SELECT *, {_NTOK.format('t')} n, list_distinct(regexp_extract_all(lower(o), '[a-z0-9_]+')) ta, list_distinct(regexp_extract_all(lower(t), '[a-z0-9_]+')) tb FROM c),
 r AS (SELECT *, round(CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0 ELSE 0.7::DOUBLE * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) + 0.15::DOUBLE * least(length(t) / CAST(length(o) AS DOUBLE), 1) + 0.15::DOUBLE * least(greatest(len(regexp_extract_all(t, '[.!?]')), 1) / CAST(greatest(len(regexp_extract_all(o, '[.!?]')), 1) AS DOUBLE), 1) END + 1e-9, 3) similarity FROM s)
SELECT doc_id, name, similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, similarity DESC, name) k FROM r WHERE similarity >= 0.9 AND len(regexp_extract_all(o, '{_CON}')) = len(regexp_extract_all(t, '{_CON}'))) WHERE k = 1""")
def guarded_candidates(documents):
    none = documents.select("doc_id", F.lit("none").alias("name"), F.col("text").alias("original"), "text")
    short = documents.select("doc_id", F.lit("articles").alias("name"), F.col("text").alias("original"), T.without_articles(F.col("text")).alias("text"))
    return ranking.fewest_tokens(none.unionByName(short), "doc_id", 0.9).drop("text")


@_query("documents", f"SELECT doc_id, CASE WHEN t > 0 AND t > 200 AND greatest(200, CAST(floor(t * 0.7::DOUBLE) AS BIGINT)) < t THEN greatest(200, CAST(floor(t * 0.7::DOUBLE) AS BIGINT), 1) ELSE -1 END AS budget FROM (SELECT doc_id, {_NTOK.format('text')} t FROM documents)")
def auto_budget(documents):
    return documents.select("doc_id", F.coalesce(ranking.auto_budget(T.n_tokens(F.col("text")), F.lit(200)).cast("long"), F.lit(-1)).alias("budget"))


@_query("conversations")
def section_ranking(conversations):
    text = conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return ranking.section_ranking(text, "the and from", 20)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from . import catalog_texts  # noqa: E402,F401  registers its queries above
