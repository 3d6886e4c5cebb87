"""Queries of rollups, rankings and activity, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflow.functions import brackets, classify, scalars
from folioflow.operators import activity, ordering, rollups
from folioflow.plans.model import AXIS_START, FILINGS_SQL, FLOOR, OFFICIALS_SQL, TODAY, TX_SQL, all_transactions, filings, officials, roster, table, transactions
from folioflow.session import checkpoint_dir

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


B = lambda c: f"CAST({c} AS BIGINT)"
N = "count(*)"


def n_if(c: str) -> str:
    return B(f"count(*) FILTER ({c})")


def total(c: str) -> str:
    return B(f"coalesce(sum({c}), 0)")


@query(f"""WITH {TX_SQL} SELECT *, CASE WHEN transactions > 0 THEN CAST(floor(late * 100 / transactions + 0.5) AS BIGINT) ELSE 0 END AS late_percent
FROM (SELECT count(*) AS transactions, {total("mid")} AS estimated_value, {n_if("late")} AS late FROM tx), (SELECT count(*) AS officials FROM roster)""")
def a1_headline(s, d):
    return rollups.headline(transactions(s, d), roster(s, d))


@query(f"WITH {TX_SQL} SELECT coalesce(CAST(max(date) AS VARCHAR), '') AS latest FROM tx")
def a2_latest(s, d):
    return rollups.latest(transactions(s, d))


@query(f"""WITH {TX_SQL} SELECT official_id, r.official, count(t.filing) AS n, {n_if("is_sale")} AS n_sales, {n_if("is_buy")} AS n_buys, {n_if("late")} AS n_late, {total("export_mid")} AS value
FROM roster r LEFT JOIN tx t USING (official_id) GROUP BY 1, 2""")
def a3_official_summary(s, d):
    return rollups.official_summary(roster(s, d), transactions(s, d))


@query(f"WITH {TX_SQL} SELECT official_id, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS all_n FROM tx GROUP BY 1")
def a4_index_counts(s, d):
    per = transactions(s, d).groupBy("official_id").agg(F.count("*").alias("n"))
    return per.crossJoin(per.agg(F.sum("n").alias("all_n")))


@query(f"""WITH {TX_SQL} SELECT upper(ticker) AS ticker, count(*) AS trades, {n_if("is_buy")} AS buys, {n_if("is_sale")} AS sells, count(DISTINCT official_id) AS officials, {total("mid")} AS value
FROM tx WHERE ticker <> '' GROUP BY 1""")
def a5_by_ticker(s, d):
    return rollups.by_ticker(transactions(s, d))


@query(f"""WITH {TX_SQL} SELECT upper(ticker) AS ticker, CASE upper(ticker) WHEN 'BRAND#7' THEN 'Seventh Brand' ELSE trim(regexp_replace(min_by(description, struct_pack(a := date, b := filing, c := line, d := part, e := supplier)), '\\s*\\([^)]*\\)\\s*$', '')) END AS company
FROM tx WHERE ticker <> '' GROUP BY 1""")
def a6_ticker_names(s, d):
    return rollups.ticker_names(transactions(s, d), {"BRAND#7": "Seventh Brand"})


@query(f"WITH {TX_SQL} SELECT DISTINCT upper(ticker) AS ticker FROM tx WHERE ticker <> ''")
def a7_tickers(s, d):
    return rollups.with_ticker(transactions(s, d)).select("ticker").distinct()


@query(f"""WITH {TX_SQL}, p AS (SELECT upper(ticker) AS ticker, official_id, count(*) AS trades, {total("mid")} AS value FROM tx WHERE ticker <> '' GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY value DESC, official_id) AS place, max(value) OVER (PARTITION BY ticker) AS largest FROM p""")
def a8_a49_ticker_officials(s, d):
    return rollups.ticker_officials(transactions(s, d))


@query(f"""WITH {TX_SQL} SELECT *, CASE WHEN sales_value + buys_value > 0 THEN CAST(floor(sales_value * 100 / (sales_value + buys_value) + 0.5) AS BIGINT) ELSE 0 END AS sales_percent
FROM (SELECT {n_if("is_sale")} AS sales, {n_if("is_buy")} AS buys, {B("coalesce(sum(mid) FILTER (is_sale), 0)")} AS sales_value, {B("coalesce(sum(mid) FILTER (is_buy), 0)")} AS buys_value FROM tx)""")
def a9_split(s, d):
    return rollups.split(transactions(s, d))


@query(f"""WITH {TX_SQL} SELECT {classify.asset_class_sql("description", "coalesce(ticker <> '', false)")} AS asset_class, {total("mid")} AS value, count(*) AS trades FROM tx GROUP BY 1""")
def a10_by_asset_class(s, d):
    return rollups.by_asset_class(transactions(s, d))


@query(f"SELECT doc_id, {classify.asset_class_sql('text', 'false')} AS asset_class FROM documents")
def x17_asset_class_of_texts(s, d):
    return table(s, d, "documents").select("doc_id", classify.asset_class(F.col("text"), F.lit(False)).alias("asset_class"))


MONTHS_SQL = f"""{TX_SQL}, per AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, {n_if("is_sale")} AS sales, {n_if("NOT is_sale")} AS purchases FROM tx GROUP BY 1),
months AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{AXIS_START}', (SELECT greatest(max(month), DATE '{AXIS_START}')::TIMESTAMP FROM per), INTERVAL 1 MONTH)) AS DATE) AS month),
dense AS (SELECT month, coalesce(sales, 0) AS sales, coalesce(purchases, 0) AS purchases FROM months LEFT JOIN per USING (month))"""


@query(f"WITH {MONTHS_SQL} SELECT * FROM dense")
def a11_by_month(s, d):
    return activity.by_month(transactions(s, d), AXIS_START)


@query(f"""WITH {TX_SQL}, per AS (SELECT level, CAST(date_trunc('month', date) AS DATE) AS month, {n_if("is_sale")} AS sales, {n_if("is_buy")} AS purchases, {n_if("late")} AS late, count(*) AS total FROM tx GROUP BY 1, 2),
axis AS (SELECT level, CAST(unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM per GROUP BY 1)
SELECT level, month, coalesce(sales, 0) AS sales, coalesce(purchases, 0) AS purchases, coalesce(late, 0) AS late, coalesce(total, 0) AS total FROM axis LEFT JOIN per USING (level, month)""")
def a12_series_by_month(s, d):
    return activity.series_by_month(transactions(s, d), "level")


@query(f"WITH {MONTHS_SQL} SELECT {B('coalesce(max(greatest(sales, purchases)), 0)')} AS peak FROM dense")
def a13_peak(s, d):
    return activity.peak(activity.by_month(transactions(s, d), AXIS_START))


LATE_SQL = f"""{TX_SQL}, stats AS (SELECT official_id, official, count(*) AS n, {n_if("late")} AS n_late, {n_if("late AND is_sale")} AS late_sales, {n_if("late AND is_buy")} AS late_buys,
  min(date) FILTER (late) AS first_late, max(date) FILTER (late) AS last_late, {n_if("late")} * 100 / count(*) AS rate FROM tx GROUP BY 1, 2 HAVING count(*) FILTER (late) > 0)"""


@query(f"WITH {LATE_SQL} SELECT * FROM stats")
def a14_late_stats(s, d):
    return rollups.late_stats(transactions(s, d))


@query(f"""WITH {TX_SQL}, p AS (SELECT official_id, count(*) AS n, {n_if("late")} AS n_late FROM tx GROUP BY 1)
SELECT {total("n")} AS n, {total("n_late")} AS n_late, {n_if("n_late > 0")} AS late_officials, {B("coalesce(floor(sum(n_late) * 1000 / sum(n) + 0.5), 0)")} AS rate_per_mille FROM p""")
def a15_late_overall(s, d):
    return rollups.late_overall(transactions(s, d))


@query(f"""WITH {LATE_SQL} SELECT CASE WHEN n_late = n THEN 'always' ELSE 'mostly' END AS cohort, count(*) AS officials, {total("n_late")} AS n_late FROM stats WHERE n_late * 2 > n GROUP BY 1""")
def a16_cohorts(s, d):
    return rollups.cohorts(rollups.late_stats(transactions(s, d)))


@query(f"""WITH {TX_SQL} SELECT official_id, count(DISTINCT filing) FILTER (late) AS late_reports, {n_if("late")} AS n_late, count(DISTINCT filing) FILTER (late) * 200 AS exposure FROM tx GROUP BY 1""")
def a17_fee_exposure(s, d):
    return rollups.fee_exposure(transactions(s, d))


@query(f"""WITH {TX_SQL}, p AS (SELECT level, date, count(*) AS n FROM tx GROUP BY 1, 2)
SELECT level, max(n) AS peak, min_by(date, struct_pack(a := -n, b := date)) AS peak_day, count(*) AS days, {n_if("n >= 100")} AS busy_days FROM p GROUP BY 1""")
def a18_daily(s, d):
    return activity.daily(transactions(s, d), "level")


@query(f"""WITH {TX_SQL}, m AS (SELECT official_id, date_trunc('month', date) AS month, count(*) AS n, min(date) AS low, max(date) AS high FROM tx GROUP BY 1, 2),
p AS (SELECT official_id, {B("sum(n)")} AS n, max(n) AS busiest, date_diff('day', min(low), max(high)) AS days FROM m GROUP BY 1)
SELECT official_id, n, busiest, n / greatest(1.0::DOUBLE, days / 7.0::DOUBLE) AS per_week, n >= 500 OR busiest >= 50 AS high_volume FROM p""")
def a19_a20_rhythm(s, d):
    return activity.rhythm(transactions(s, d), "official_id")


@query(f"""WITH {TX_SQL} SELECT *, row_number() OVER (ORDER BY value DESC, official_id) AS place FROM
(SELECT official_id, official, {total("mid")} AS value, count(*) AS trades FROM tx GROUP BY 1, 2 ORDER BY value DESC, official_id LIMIT 15)""")
def a22_t4_ranking(s, d):
    return rollups.ranking(transactions(s, d))


@query(f"""WITH {TX_SQL} SELECT official_id, count(*) AS trades, arg_max(filing, struct_pack(a := date, b := filing, c := line, d := part, e := supplier)) AS newest_filing, {total("mid")} AS value FROM tx GROUP BY 1""")
def a23_nested_trades(s, d):
    nested = rollups.nested_trades(transactions(s, d))
    first = F.get("trades", F.lit(0))
    return nested.groupBy("official_id").agg(rollups.total(F.size("trades")).alias("trades"), F.max_by(first["filing"], first).alias("newest_filing"), rollups.total(F.col("value")).alias("value"))


STATS_SQL = f"""{TX_SQL}, stats AS (SELECT official_id, official, count(*) AS n, {n_if("is_sale")} AS n_sales, {n_if("is_buy")} AS n_buys, {n_if("type = 'Exchange'")} AS n_exchanges, {n_if("late")} AS n_late,
  {total("export_mid")} AS value, {B("coalesce(sum(export_mid) FILTER (is_sale), 0)")} AS sales_value, {B("coalesce(sum(export_mid) FILTER (is_buy), 0)")} AS buys_value, min(date) AS first_date, max(date) AS last_date,
  arg_max(description || ' (' || amount || ')', struct_pack(m := export_mid, a := date_diff('day', date, DATE '1970-01-01'), b := -filing, c := -line, d := -part, e := -supplier)) AS largest FROM tx GROUP BY 1, 2)"""


@query(f"WITH {STATS_SQL} SELECT * FROM stats")
def a24_summary_stats(s, d):
    return rollups.summary_stats(transactions(s, d))


@query(f"""WITH {TX_SQL}, p AS (SELECT official_id, coalesce(ticker, description) AS asset, count(*) AS n FROM tx GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY official_id ORDER BY n DESC, asset) AS place FROM p QUALIFY place <= 5""")
def a24_top_assets(s, d):
    return rollups.top_assets(transactions(s, d))


def _counted_sql(n: str, noun: str) -> str:
    return f"CASE WHEN {n} > 0 THEN format('{{:,}}', {n}) || CASE WHEN {n} = 1 THEN ' {noun}' ELSE ' {noun}s' END END"


@query(f"""WITH {STATS_SQL} SELECT official_id, official || ' reported ' || coalesce(nullif(concat_ws(' and ', {_counted_sql("n_sales", "sale")}, {_counted_sql("n_buys", "purchase")}, {_counted_sql("n_exchanges", "exchange")}), ''), 'no transactions') || '.'
|| coalesce(' ' || {_counted_sql("n_late", "transaction")} || ' were filed late.', '') AS sentence FROM stats""")
def a25_sentences(s, d):
    return rollups.sentences(rollups.summary_stats(transactions(s, d)))


@query("SELECT o_custkey AS official_id, count(*) AS filings FROM orders GROUP BY 1")
def a26_filings_by_official(s, d):
    return filings(s, d).groupBy("official_id").agg(F.count("*").alias("filings"))


@query(f"""WITH {FILINGS_SQL}, u AS (SELECT DISTINCT official_id, date FROM filings WHERE date >= DATE '{FLOOR}'),
g AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY official_id ORDER BY date), date) AS gap FROM u),
p AS (SELECT official_id, count(*) AS filings, max(date) AS last_filing, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps FROM g GROUP BY 1 HAVING count(*) >= 4)
SELECT official_id, filings, last_filing, gaps[len(gaps) // 2 + 1] AS median_gap, last_filing + CAST(gaps[len(gaps) // 2 + 1] AS INTEGER) AS projected,
       date_diff('day', last_filing + CAST(gaps[len(gaps) // 2 + 1] AS INTEGER), DATE '{TODAY}') AS days_past FROM p""")
def a27_cadence(s, d):
    return activity.cadence(filings(s, d), "official_id", TODAY, FLOOR)


@query(f"""WITH {FILINGS_SQL}, u AS (SELECT DISTINCT official_id, date FROM filings)
SELECT official_id, date, date_diff('day', lag(date) OVER (PARTITION BY official_id ORDER BY date), date) AS gap FROM u""")
def w2_gaps(s, d):
    return activity.gaps(filings(s, d), "official_id")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def a32_by_status(s, d):
    return filings(s, d).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS cost, count(*) AS runs FROM events GROUP BY 1")
def a31_json_cost(s, d):
    cost = F.get_json_object("props", "$.k").cast("long")
    return table(s, d, "events").groupBy("event_type").agg(rollups.total(cost).alias("cost"), F.count("*").alias("runs"))


@query(f"SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, max(doc_id) AS latest FROM documents")
def a36_news_stats(s, d):
    return table(s, d, "documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("languages"), F.max("doc_id").alias("latest"))


@query("""WITH p AS (SELECT regexp_extract(url, '^[^?#]*[/.]([A-Za-z0-9_-]*)', 1) AS suffix, count(*) AS n FROM pages GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY n DESC, suffix) AS place FROM p QUALIFY place <= 10""")
def a37_url_suffixes(s, d):
    suffix = F.regexp_extract("url", r"^[^?#]*[/.]([A-Za-z0-9_-]*)", 1)
    return ordering.top(table(s, d, "pages").groupBy(suffix.alias("suffix")).agg(F.count("*").alias("n")), [F.desc("n"), F.asc("suffix")], 10)


@query(f"""WITH {TX_SQL}, {FILINGS_SQL} SELECT (SELECT count(*) FROM officials) AS officials, (SELECT count(*) FROM all_tx) AS transactions, (SELECT count(DISTINCT upper(ticker)) FROM all_tx WHERE ticker <> '') AS tickers,
(SELECT count(*) FROM all_tx WHERE late) AS late, (SELECT count(url) FROM filings) AS linked""")
def a38_readme_metrics(s, d):
    tx = all_transactions(s, d).agg(F.count("*").alias("transactions"), F.countDistinct(F.upper(F.nullif("ticker", F.lit("")))).alias("tickers"), rollups.n_if(F.col("late")).alias("late"))
    return tx.crossJoin(officials(s, d).agg(F.count("*").alias("officials"))).crossJoin(filings(s, d).agg(F.count("url").alias("linked")))


@query(f"WITH {FILINGS_SQL} SELECT official_id, count(*) AS documents, count(url) AS public, {n_if('url IS NULL')} AS on_request FROM filings GROUP BY 1")
def a39_document_counts(s, d):
    return filings(s, d).groupBy("official_id").agg(F.count("*").alias("documents"), F.count("url").alias("public"), rollups.n_if(F.col("url").isNull()).alias("on_request"))


@query(f"""WITH {FILINGS_SQL}, p AS (SELECT official_id, bool_and(status = 'F') AS all_f, bool_or(status = 'F') AS any_f FROM filings GROUP BY 1)
SELECT official_id, CASE WHEN all_f THEN 'all final' WHEN NOT any_f THEN 'none final' ELSE 'mixed' END AS outcome FROM p""")
def a41_outcomes(s, d):
    final = F.col("status") == "F"
    per = filings(s, d).groupBy("official_id").agg(F.bool_and(final).alias("every"), F.bool_or(final).alias("some"))
    return per.select("official_id", F.when(F.col("every"), "all final").when(~F.col("some"), "none final").otherwise("mixed").alias("outcome"))


@query(f"WITH {TX_SQL} SELECT {n_if('late')} AS late, {n_if('late AND official_id = 1')} AS own, {n_if('late AND official_id <> 1')} AS others FROM tx")
def a42_remainder(s, d):
    return rollups.remainder(transactions(s, d), 1)


@query(f"""WITH {MONTHS_SQL} SELECT {n_if("sales + purchases > 0")} AS active, count(*) AS months, min(month) FILTER (sales + purchases > 0) AS first_active, max(month) FILTER (sales + purchases > 0) AS last_active FROM dense""")
def a44_span_label(s, d):
    return activity.span_label(activity.by_month(transactions(s, d), AXIS_START))


@query(f"""WITH {TX_SQL}, p AS (SELECT official_id, date, count(*) AS n, {n_if("is_sale")} AS sales, {n_if("is_buy")} AS buys FROM tx GROUP BY 1, 2)
SELECT official_id, max(n) AS most, count(*) AS days, CASE WHEN sum(sales) = sum(n) THEN 'all sales' WHEN sum(buys) = sum(n) THEN 'all purchases' ELSE 'mixed' END AS note FROM p GROUP BY 1""")
def a45_x48_density(s, d):
    return activity.density(transactions(s, d), "official_id")


#: Prices of a million tokens in and out, by model class.
PRICES = (("view", 3.0, 15.0), ("click", 1.0, 5.0), ("signup", 5.0, 25.0), ("error", 0.75, 4.5), ("purchase", 0.2, 1.25))


@query(f"""WITH price(event_type, p_in, p_out) AS (VALUES {", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, a, b in PRICES)}),
u AS (SELECT event_type, count(*) AS runs, {B("sum(length(props))")} AS tokens_in, {B("sum(event_id % 100)")} AS tokens_out FROM events GROUP BY 1)
SELECT event_type, runs, tokens_in, tokens_out, (tokens_in * p_in + tokens_out * p_out) / 1000000.0::DOUBLE AS cost FROM u JOIN price USING (event_type)""")
def a46_token_cost(s, d):
    price = s.createDataFrame(PRICES, "event_type string, p_in double, p_out double")
    use = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("runs"), F.sum(F.length("props").cast("long")).alias("tokens_in"), F.sum(F.col("event_id") % 100).alias("tokens_out"))
    return use.join(price, "event_type").select("event_type", "runs", "tokens_in", "tokens_out", ((F.col("tokens_in") * F.col("p_in") + F.col("tokens_out") * F.col("p_out")) / 1_000_000.0).alias("cost"))


@query(f"WITH {TX_SQL} SELECT (SELECT count(*) FROM officials WHERE NOT former) AS officials, {total('n')} AS transactions FROM officials LEFT JOIN (SELECT official_id, count(*) AS n FROM tx GROUP BY 1) USING (official_id) WHERE NOT former")
def a47_site_totals(s, d):
    per = transactions(s, d).groupBy("official_id").agg(F.count("*").alias("n"))
    current = officials(s, d).filter(~F.col("former"))
    return current.join(per, "official_id", "left").agg(F.count("*").alias("officials"), rollups.total(F.col("n")).alias("transactions"))


@query(f"""WITH {TX_SQL}, p AS (SELECT official_id, min(date) AS low, max(date) AS high, CAST(CASE WHEN min(date) = max(date) THEN 30 ELSE ceil(date_diff('day', min(date), max(date)) * 0.04) END AS INTEGER) AS pad FROM tx GROUP BY 1),
q AS (SELECT official_id, low - pad AS low, high + pad AS high FROM p)
SELECT *, CAST(greatest(1, ceil((date_diff('month', date_trunc('month', low), date_trunc('month', high)) + 1) / 6)) AS BIGINT) AS stride FROM q""")
def a48_x50_padded_domain(s, d):
    return activity.month_stride(activity.padded_domain(transactions(s, d), "official_id"))


# -- rankings and scales -----------------------------------------------------------------


@query(f"""WITH {TX_SQL}, p AS (SELECT upper(ticker) AS ticker, count(DISTINCT official_id) AS officials, count(*) AS trades FROM tx WHERE ticker <> '' GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY officials DESC, trades DESC, ticker) AS place FROM p QUALIFY place <= 5""")
def t3_top_tickers(s, d):
    return ordering.top(rollups.by_ticker(transactions(s, d)).select("ticker", "officials", "trades"), [F.desc("officials"), F.desc("trades"), F.asc("ticker")], 5)


@query(f"""WITH {TX_SQL}, p AS (SELECT official_id, official, count(*) AS n, max(date) AS last FROM tx GROUP BY 1, 2),
q AS (SELECT 'volume' AS sorted_by, official_id, row_number() OVER (ORDER BY n DESC, official_id) AS place FROM p UNION ALL
SELECT 'name', official_id, row_number() OVER (ORDER BY official, official_id) FROM p UNION ALL SELECT 'recency', official_id, row_number() OVER (ORDER BY last DESC, official_id) FROM p)
SELECT * FROM q WHERE place <= 50""")
def t1_t2_sorted_lanes(s, d):
    per = transactions(s, d).groupBy("official_id", "official").agg(F.count("*").alias("n"), F.max("date").alias("last"))
    orders = {"volume": F.desc("n"), "name": F.asc("official"), "recency": F.desc("last")}
    lanes = [ordering.top(per, [order, F.asc("official_id")], 50).select(F.lit(name).alias("sorted_by"), "official_id", "place") for name, order in orders.items()]
    return lanes[0].union(lanes[1]).union(lanes[2])


@query(f"WITH {MONTHS_SQL} SELECT * FROM (SELECT month, sales + purchases AS total FROM dense ORDER BY total DESC, month LIMIT 3) WHERE total > 0")
def t5_top_months(s, d):
    return activity.top_months(activity.by_month(transactions(s, d), AXIS_START))


@query(f"""WITH {TX_SQL} SELECT filing, line, part, supplier, row_number() OVER (ORDER BY date DESC, description, filing, line, part, supplier) AS place FROM tx QUALIFY place <= 200""")
def t6_latest_rows(s, d):
    order = [F.desc("date"), *map(F.asc, ("description", "filing", "line", "part", "supplier"))]
    return ordering.top(transactions(s, d).select("date", "description", "filing", "line", "part", "supplier"), order, 200).select("filing", "line", "part", "supplier", "place")


@query(f"""WITH {TX_SQL} SELECT filing, line, part, supplier, CAST(3 AS BIGINT) AS page, CAST(ceil((SELECT count(*) FROM tx) / 100.0) AS BIGINT) AS pages FROM tx ORDER BY date DESC, filing, line, part, supplier LIMIT 100 OFFSET 200""")
def t11_page(s, d):
    order = [F.desc("date"), *map(F.asc, ("filing", "line", "part", "supplier"))]
    return ordering.page(transactions(s, d).select("date", "filing", "line", "part", "supplier"), order, "3").drop("date")


@query(f"""WITH {TX_SQL}, n AS (SELECT count(*) AS n FROM tx), a AS (SELECT least(7, CAST(ceil(n / 100.0) AS BIGINT)) AS at_page, CAST(ceil(n / 100.0) AS BIGINT) AS pages FROM n)
SELECT filing, line, part, supplier, place, at_page AS page, pages FROM (SELECT *, row_number() OVER (ORDER BY date DESC, filing, line, part, supplier) AS place FROM tx), a WHERE place > (at_page - 1) * 100 AND place <= at_page * 100""")
def t11_deep_page(s, d):
    """The same pages from rows that are stored in slices of their order, as a site asks for many of them."""
    order = [F.desc("date"), *map(F.asc, ("filing", "line", "part", "supplier"))]
    path = f"{checkpoint_dir(s)}/pages-{uuid.uuid4().hex}"
    ordering.write_paged(transactions(s, d).select("date", "filing", "line", "part", "supplier"), order, path)
    return ordering.read_page(s, path, "7").drop("date")


@query(f"""WITH {FILINGS_SQL} SELECT ordinal, date, row_number() OVER (ORDER BY date DESC, ordinal) AS place FROM filings QUALIFY place <= 4""")
def t12_t13_newest(s, d):
    return ordering.top(filings(s, d).select("ordinal", "date"), [F.desc("date"), F.asc("ordinal")], 4)


@query(f"""WITH {TX_SQL} SELECT filing, line, part, supplier, row_number() OVER (ORDER BY {brackets.sql_case("amount", 1)} DESC, filing, line, part, supplier) AS place FROM tx QUALIFY place <= 100""")
def t15_largest(s, d):
    rows = transactions(s, d).withColumn("least", brackets.least(F.col("amount")))
    order = [F.desc("least"), *map(F.asc, ("filing", "line", "part", "supplier"))]
    return ordering.top(rows.select("least", "filing", "line", "part", "supplier"), order, 100).drop("least")


@query(f"""WITH {TX_SQL} SELECT filing, line, part, supplier, row_number() OVER (PARTITION BY official_id, date ORDER BY filing, line, part, supplier) - 1 AS day_place, count(*) OVER (PARTITION BY official_id, date) AS day_rows FROM tx""")
def w4_jitter(s, d):
    return activity.jitter(transactions(s, d), "official_id", ["filing", "line", "part", "supplier"]).select("filing", "line", "part", "supplier", "day_place", "day_rows")


@query(f"""WITH {TX_SQL}, p AS (SELECT level, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n FROM tx GROUP BY 1, 2)
SELECT level, month, n, round(greatest(1.0, sqrt(n / max(n) OVER (PARTITION BY level)) * 100), 6) AS height FROM p""")
def w7_heights(s, d):
    per = transactions(s, d).groupBy("level", F.trunc("date", "month").alias("month")).agg(F.count("*").alias("n"))
    return ordering.root_heights(per, ["level"], "n").withColumn("height", F.round("height", 6))


@query(f"""WITH {TX_SQL}, p AS (SELECT official_id, {total("mid")} AS value FROM tx GROUP BY 1), x AS (SELECT log10(min(value)) AS low, log10(max(value)) AS high FROM p WHERE value > 0)
SELECT official_id, value, round(10 + 90 * CASE WHEN high > low THEN (log10(value) - low) / (high - low) ELSE 1.0 END, 6) AS width FROM p, x WHERE value > 0""")
def w8_widths(s, d):
    per = transactions(s, d).groupBy("official_id").agg(rollups.total(brackets.midpoint(F.col("amount"))).alias("value"))
    return ordering.log_widths(per, "value").withColumn("width", F.round("width", 6))


@query(f"WITH {MONTHS_SQL} SELECT round(coalesce(least(60 / sqrt(nullif(max(sales), 0)), 40 / sqrt(nullif(max(purchases), 0))), 0.0), 9) AS unit FROM dense")
def w10_two_sided_unit(s, d):
    return ordering.two_sided_unit(activity.by_month(transactions(s, d), AXIS_START), "sales", "purchases", 60, 40).select(F.round("unit", 9).alias("unit"))
