"""Queries of filters, scalar functions and quality rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import brackets, classify, scalars, tokens
from folioflow.operators import digest, merging, quality
from folioflow.operators.rollups import n_if
from folioflow.plans.analytics import B
from folioflow.plans.analytics import n_if as n_if_sql
from folioflow.plans.model import FILINGS_SQL, OFFICIALS_SQL, TODAY, TX_SQL, all_transactions, filings, in_roster, officials, table, transactions
from folioflow.streaming import subscribers

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


ROW = "filing, line, part, supplier"
ROWS = ("filing", "line", "part", "supplier")

# -- filters -----------------------------------------------------------------------------


@query(f"WITH {OFFICIALS_SQL} SELECT official_id, former FROM roster")
def f1_f2_roster(s, d):
    return officials(s, d).filter(in_roster()).select("official_id", "former")


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)278\\s+transaction') OR regexp_matches(text, '(?i)278[\\s\\-]*t(\\(|[^A-Za-z0-9_]|$)') OR source IN ('src1', 'src2')""")
def f3_f4_targets(s, d):
    docs = table(s, d, "documents")
    return docs.filter(classify.is_periodic_report(F.col("text")) | F.col("source").isin("src1", "src2")).select("doc_id")


_LEVEL = "CASE c_custkey % 5 WHEN 0 THEN 'Level I' WHEN 1 THEN 'Level II' WHEN 2 THEN 'level i' WHEN 3 THEN 'Level III' END"
_TARGET = f"CASE WHEN c_custkey % 11 = 0 THEN '{classify.TARGET_NAMES[0]}' WHEN c_custkey % 11 = 1 THEN '{classify.TARGET_NAMES[1]}' WHEN c_custkey % 11 = 2 THEN upper('{classify.TARGET_NAMES[0]}') ELSE c_name END"


@query(f"""SELECT official_id, coalesce(level IN ('Level I', 'Level II'), false) OR coalesce(name IN ({", ".join(f"'{n}'" for n in classify.TARGET_NAMES)}), false) AS target
FROM (SELECT c_custkey AS official_id, {_LEVEL} AS level, {_TARGET} AS name FROM customer)""")
def f3_target_level(s, d):
    people = table(s, d, "customer").select(F.col("c_custkey").alias("official_id"), F.expr(_LEVEL).alias("level"), F.expr(_TARGET).alias("name"))
    return people.select("official_id", classify.is_target_level(F.col("level"), F.col("name")).alias("target"))


@query("SELECT o_orderkey AS ordinal FROM orders WHERE substr(CAST(o_orderdate AS VARCHAR), 1, 10) >= '1999-02-01'")
def f5_date_floor(s, d):
    return table(s, d, "orders").filter(F.substring(F.col("o_orderdate").cast("string"), 1, 10) >= "1999-02-01").select(F.col("o_orderkey").alias("ordinal"))


def in_range(range_: str, today: str):
    """A predicate on date for a page's range parameter; one that isn't known takes all."""
    day = F.lit(today).cast("date")
    return {"ytd": F.col("date") >= F.trunc(day, "year"), "12mo": F.col("date") >= F.date_sub(day, 365)}.get(range_, F.lit(True))


def of_type(type_: str):
    return {"sale": brackets.is_sale(F.col("type")), "purchase": F.col("type") == "Purchase", "late": F.col("late")}.get(type_, F.lit(True))


@query(f"""WITH {TX_SQL} SELECT {n_if_sql("year(date) = 2001")} AS ytd, {n_if_sql(f"date >= DATE '{TODAY}' - 365")} AS last_year, count(*) AS everything,
{n_if_sql("year(date) = 2001 AND is_sale")} AS ytd_sales, {n_if_sql("late AND strftime(date, '%Y-%m') = '1998-03'")} AS month_late FROM tx""")
def f6_f9_layers(s, d):
    month = F.date_format("date", "yyyy-MM") == "1998-03"
    count = lambda c, name: n_if(c).alias(name)
    return transactions(s, d).agg(
        count(in_range("ytd", TODAY), "ytd"), count(in_range("12mo", TODAY), "last_year"), count(in_range("?", TODAY), "everything"), count(in_range("ytd", TODAY) & of_type("sale"), "ytd_sales"), count(of_type("late") & month, "month_late")
    )


@query(f"WITH {TX_SQL} SELECT official_id, count(*) AS n FROM tx WHERE level IN ('BUILDING', 'MACHINERY') AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1")
def f10_group_period(s, d):
    rows = transactions(s, d).filter(F.col("level").isin("BUILDING", "MACHINERY") & F.col("date").between(F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date")))
    return rows.groupBy("official_id").agg(F.count("*").alias("n"))


def search(rows, text: str, *columns: str):
    """Rows with the text in any of the columns, whatever the case; an empty text finds all."""
    hit = F.lit(text == "")
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    return rows.filter(hit)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_brand), 'brand#1') OR contains(lower(p_name), 'brand#1')")
def f11_search(s, d):
    return search(table(s, d, "part"), "Brand#1", "p_brand", "p_name").select("p_partkey")


@query(f"WITH {TX_SQL} SELECT count(*) AS n FROM tx WHERE ticker IS NOT NULL AND ticker <> ''")
def f13_with_ticker(s, d):
    return transactions(s, d).filter("ticker IS NOT NULL AND ticker <> ''").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND nullif(c_nationkey % 5, 0) IS NOT NULL")
def f14_f15_recipients(s, d):
    confirmed = F.nullif(F.col("c_nationkey") % 5, F.lit(0))
    return table(s, d, "customer").filter((F.col("c_mktsegment") == "BUILDING") & confirmed.isNotNull()).select(F.col("c_custkey").alias("id"))


_SIGNUPS = "c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'active' ELSE 'pending' END AS status, CASE WHEN c_custkey % 4 = 0 THEN DATE '2025-01-01' END AS asked_again, CASE WHEN c_custkey % 5 > 1 THEN DATE '2025-02-01' END AS confirmed"


@query(f"SELECT id FROM (SELECT {_SIGNUPS} FROM customer) WHERE status = 'active' AND asked_again IS NULL AND confirmed IS NULL")
def f15_repermission(s, d):
    signups = table(s, d, "customer").selectExpr(*_SIGNUPS.replace(", CASE", "|CASE").split("|"))
    return subscribers.to_ask_again(signups).select("id")


@query(f"""WITH {TX_SQL} SELECT {n_if_sql("coalesce(description, '') = ''")} AS no_description, {n_if_sql("coalesce(ticker, '') = ''")} AS no_ticker, {n_if_sql("date IS NULL")} AS no_date FROM all_tx""")
def f16_blanks(s, d):
    blank = lambda c: n_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"no_{c}")
    return all_transactions(s, d).agg(blank("description"), blank("ticker"), blank("date"))


@query("SELECT o_orderkey AS ordinal FROM orders WHERE o_orderstatus IN ('P', 'O') ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def f17_in_flight(s, d):
    return table(s, d, "orders").filter(F.col("o_orderstatus").isin("P", "O")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1).select(F.col("o_orderkey").alias("ordinal"))


@query(f"""WITH {TX_SQL}, p AS (SELECT official_id, min(date) - 14 AS low, max(date) + 14 AS high FROM tx GROUP BY 1), e AS (SELECT o_custkey AS official_id, o_orderkey AS ordinal, CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT official_id, ordinal FROM e JOIN p USING (official_id) WHERE date BETWEEN low AND high""")
def f18_visible_events(s, d):
    span = transactions(s, d).groupBy("official_id").agg(F.date_sub(F.min("date"), 14).alias("low"), F.date_add(F.max("date"), 14).alias("high"))
    return filings(s, d).join(span, "official_id").filter("date BETWEEN low AND high").select("official_id", "ordinal")


INGESTED = "CASE WHEN o_orderkey % 9 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END"


@query(f"SELECT o_orderkey AS ordinal, coalesce({INGESTED}, '') >= '2001-06-01' AS is_new, coalesce({INGESTED} >= CAST(DATE '{TODAY}' - 14 AS VARCHAR), false) AS recent FROM orders")
def f19_f20_badges(s, d):
    ingested = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date").cast("string"))
    since = F.date_sub(F.lit(TODAY).cast("date"), 14).cast("string")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("ordinal"), (F.coalesce(ingested, F.lit("")) >= "2001-06-01").alias("is_new"), F.coalesce(ingested >= since, F.lit(False)).alias("recent"))


@query(f"WITH {FILINGS_SQL} SELECT url FROM filings WHERE url IN (SELECT url FROM filings WHERE status = 'F') AND date >= DATE '2000-01-01'")
def f22_ledger_lookup(s, d):
    rows = filings(s, d)
    ledger = rows.filter("status = 'F' AND url IS NOT NULL").select("url")
    return rows.filter(F.col("date") >= F.lit("2000-01-01").cast("date")).join(ledger, "url", "left_semi").select("url")


#: Some words become remarks about fees, so that all texts are searched with the patterns of use.
_REMARKED = "replace(replace(text, ' and ', ' Filer  paid '), ' the ', ' paid late ')"


@query(f"SELECT doc_id, {classify.fee_snippet_sql('t')} AS snippet FROM (SELECT doc_id, {_REMARKED} AS t FROM documents) WHERE regexp_matches(t, '(?i){classify.FEE_REMARK}')")
def f23_snippets(s, d):
    # Asked for the remark alone: a filter on the snippet would make every snippet twice.
    text = F.expr(_REMARKED)
    return table(s, d, "documents").filter(classify.has_remark(text)).select("doc_id", classify.fee_snippet(text).alias("snippet"))


_ANNOTATION = f"(the{classify.SPACE}+and|and{classify.SPACE}+the)"


@query(f"SELECT doc_id, {classify.fee_snippet_sql('text', remark=_ANNOTATION)} AS snippet FROM documents WHERE regexp_matches(text, '(?i){_ANNOTATION}')")
def f23_snippets_all(s, d):
    """Another remark, in texts as they are."""
    text = F.col("text")
    return table(s, d, "documents").filter(classify.has_remark(text, _ANNOTATION)).select("doc_id", classify.fee_snippet(text, remark=_ANNOTATION).alias("snippet"))


@query("SELECT doc_id FROM documents WHERE length(trim(text)) >= 50 AND regexp_matches(lower(text), 'ouble|tion|ung')")
def f24_page_gate(s, d):
    return table(s, d, "documents").filter((F.length(F.trim("text")) >= 50) & F.lower("text").rlike("ouble|tion|ung")).select("doc_id")


# -- scalars -----------------------------------------------------------------------------


@query(f"""WITH {TX_SQL} SELECT {ROW}, {brackets.sql_case("amount", 1)} AS least, {brackets.sql_case("amount", 3)} AS label, mid AS site_mid, export_mid FROM tx""")
def x1_x2_x3_j18_brackets(s, d):
    a = F.col("amount")
    return transactions(s, d).select(*ROWS, brackets.least(a).alias("least"), brackets.label(a).alias("label"), brackets.midpoint(a).alias("site_mid"), brackets.midpoint(a, "export").alias("export_mid"))


_MONEY = "CAST(floor(o_totalprice) AS BIGINT) * (CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 37 WHEN 2 THEN 9001 ELSE 0 END) + o_orderkey % 1000"


@query(f"""WITH m AS (SELECT o_orderkey AS ordinal, {_MONEY} AS v FROM orders)
SELECT ordinal, CASE WHEN v >= 1000000000 THEN '$' || ((v * 10 + 500000000) // 1000000000) // 10 || '.' || ((v * 10 + 500000000) // 1000000000) % 10 || 'B'
WHEN v >= 1000000 THEN '$' || ((v * 10 + 500000) // 1000000) // 10 || '.' || ((v * 10 + 500000) // 1000000) % 10 || 'M'
WHEN v >= 1000 THEN '$' || (v + 500) // 1000 || 'K' ELSE '$' || v END AS shown, format('{{:,}}', v) AS grouped FROM m""")
def x4_x34_money(s, d):
    v = F.expr(f"CAST({_MONEY} AS BIGINT)")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("ordinal"), scalars.compact_currency(v).alias("shown"), F.format_number(v, 0).alias("grouped"))


_NAME = "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Doe ' || c_custkey || ', Jan ' || c_mktsegment WHEN 2 THEN 'Roe, Kim, Jr. ' || c_custkey ELSE 'Wright, Christopher A' END"
_DASH = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"""WITH m AS (SELECT c_custkey AS id, {_NAME} AS name FROM customer), p AS (SELECT *, list_transform(string_split(name, ','), lambda x: trim(x)) AS parts FROM m)
SELECT id, CASE WHEN len(parts) >= 2 THEN parts[2] || ' ' || parts[1] ELSE name END AS shown, array_to_string(list_reverse(parts), ' ') AS reversed,
CASE name WHEN 'Wright, Christopher A' THEN 'Wright, Christopher' ELSE name END AS canonical,
{_DASH.format("CASE WHEN len(parts) >= 2 THEN parts[2] || ' ' || parts[1] ELSE name END")} AS slug, {_DASH.format("array_to_string(list_reverse(parts), ' ')")} AS slug_all FROM p""")
def x5_x6_x26_j17_names(s, d):
    name = F.expr(_NAME)
    return table(s, d, "customer").select(
        F.col("c_custkey").alias("id"), scalars.display_name(name).alias("shown"), scalars.reversed_name(name).alias("reversed"), scalars.canonical_name(name).alias("canonical"), scalars.slug(name).alias("slug"), scalars.slug(name, True).alias("slug_all")
    )


@query("""SELECT s_suppkey AS id, upper(CASE WHEN len(p) >= 2 THEN substr(p[1], 1, 1) || substr(p[-1], 1, 1) ELSE substr(shown, 1, 2) END) AS initials
FROM (SELECT s_suppkey, shown, list_filter(string_split(shown, ' '), lambda x: x <> '') AS p FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ada  m. ' || s_name ELSE s_name END AS shown FROM supplier))""")
def x53_initials(s, d):
    shown = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("ada  m. "), "s_name")).otherwise(F.col("s_name"))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), scalars.initials(shown).alias("initials"))


_DATE_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS {}) || 'T10:00:00Z' WHEN 1 THEN '2020-13-45' WHEN 2 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS {}) END"


@query(f"""WITH m AS (SELECT o_orderkey AS ordinal, {_DATE_TEXT.format("VARCHAR", "VARCHAR")} AS t, CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT *, try_cast(CASE WHEN contains(t, 'T') THEN substr(t, 1, 10) ELSE t END AS DATE) AS dt FROM m)
SELECT ordinal, coalesce(['Jan.', 'Feb.', 'March', 'April', 'May', 'June', 'July', 'Aug.', 'Sept.', 'Oct.', 'Nov.', 'Dec.'][month(dt)] || ' ' || day(dt) || ', ' || year(dt), 'Unknown date') AS press,
nullif(regexp_extract(t, '^\\d{{4}}-\\d{{2}}', 0), '') AS month, strftime(date_trunc('month', d) + INTERVAL 1 MONTH, '%Y-%m') AS next_month, strftime(d, '%b %Y') AS short, d + 90 AS later FROM n""")
def x7_x8_x9_x11_x41_dates(s, d):
    text, date = F.expr(_DATE_TEXT.format("STRING", "STRING")), F.col("o_orderdate").cast("date")
    key = F.date_format(date, "yyyy-MM")
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("ordinal"), scalars.press_date(text).alias("press"), scalars.month_key(text).alias("month"), scalars.next_month(key).alias("next_month"), scalars.month_short(key).alias("short"), F.date_add(date, 90).alias("later")
    )


_ROLE = "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Director, Office of Science and Technology Policy' WHEN 2 THEN 'Administrator' WHEN 3 THEN 'Secretary of the Navy' ELSE c_mktsegment END"
_AGENCY = "CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Department of Defense - Department of the Navy' WHEN 2 THEN 'National Aeronautics and Space Administration' WHEN 3 THEN 'Executive Office of the United States' WHEN 4 THEN 'Department of the Interior' ELSE n_name END"
_STOP = ", ".join(f"'{w}'" for w in scalars.OFFICE_STOP_WORDS)
_TOK = f"list_filter(list_distinct(regexp_split_to_array(lower({{}}), '[^a-z0-9]+')), lambda t: length(t) >= 3 AND t NOT IN ({_STOP}))"


def _short_sql(line: str) -> str:
    for full, short in sorted(scalars.AGENCY_SHORT.items(), key=lambda p: -len(p[0])):
        line = f"replace({line}, '{full}', '{short}')"
    return line


@query(f"""WITH m AS (SELECT c_custkey AS id, {_ROLE} AS role, {_AGENCY} AS agency FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT *, CASE WHEN role = '' THEN agency ELSE role END AS r, CASE WHEN agency = '' OR role = '' OR len({_TOK.format("agency")}) = 0 OR len(list_intersect({_TOK.format("agency")}, {_TOK.format("role")})) > 0 THEN NULL ELSE agency END AS a FROM m)
SELECT id, len({_TOK.format("agency")}) AS tokens, concat_ws(' · ', r, a) AS line, {_short_sql("concat_ws(' · ', r, a)")} AS short FROM p""")
def x13_x14_x15_x16_office(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    role, agency = F.expr(_ROLE), F.expr(_AGENCY)
    return c.select(F.col("c_custkey").alias("id"), F.size(scalars.significant_tokens(agency)).cast("long").alias("tokens"), scalars.office_line(role, agency).alias("line"), scalars.office_line_short(role, agency).alias("short"))


_HTML = "CASE page_id % 4 WHEN 0 THEN '<a href=\"/files/a_' || page_id || '%20b.pdf\">278 Transaction</a> (Request)' WHEN 1 THEN '<a href=''https://x.example/' || page_id || '.PDF''>Ethics Agreement</a>' WHEN 2 THEN '<b>Nominee 278</b>' ELSE '<i></i> (none)' END"


@query(f"""WITH m AS (SELECT page_id, {_HTML} AS h FROM pages), u AS (SELECT *, nullif(regexp_extract(h, '(?i)href=["'']([^"'']+\\.pdf)["'']', 1), '') AS f, trim(regexp_replace(h, '<[^>]+>', '', 'g')) AS t FROM m)
SELECT page_id, CASE WHEN starts_with(f, 'http') THEN f WHEN starts_with(f, '/') THEN 'https://base.example' || f END AS link,
coalesce(nullif(trim(regexp_replace(t, '\\s*\\(.*\\)\\s*$', '')), ''), 'Disclosure') AS label,
CASE WHEN contains(h, 'Ethics Agreement') THEN 'ethics_agreement' WHEN contains(h, 'Nominee 278') THEN 'nominee_278' WHEN contains(h, '278 Transaction') THEN 'transaction_278t' ELSE 'other' END AS kind,
replace(url_decode(regexp_extract(f, '[^/]*$', 0)), '_', ' ') AS name, replace(replace(replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM u""")
def x18_x19_x20_x27_x28_x32_links(s, d):
    h = F.expr(_HTML.replace('\\"', '"').replace("''", "\\'"))
    rows = table(s, d, "pages").select("page_id", h.alias("h"))
    link = scalars.pdf_link(F.col("h"), "https://base.example/api/v2")
    name = F.replace(scalars.file_name(link), F.lit("_"), F.lit(" "))
    return rows.select("page_id", link.alias("link"), scalars.plain_label(F.col("h")).alias("label"), classify.document_kind(F.col("h")).alias("kind"), name.alias("name"), scalars.escape_html(F.col("h")).alias("escaped"))


_DESC = "CASE p_partkey % 5 WHEN 0 THEN p_name || ' (ABCD)' WHEN 1 THEN p_name || ' (LLC)' WHEN 2 THEN p_name || ' (BRK.B) units' WHEN 3 THEN '  ' ELSE p_name || ' (X)  ' END"
_TICK = "CASE WHEN p_partkey % 3 = 0 THEN 'ABCD' END"


@query(f"""WITH m AS (SELECT p_partkey AS id, {_DESC} AS t, {_TICK} AS k FROM part)
SELECT id, coalesce(k, nullif(regexp_extract(t, '\\(([A-Z]{{1,6}})\\)\\s*$', 1), '')) AS ticker, CASE WHEN regexp_extract(t, '\\(([A-Z]{{2,6}}(?:\\.[A-Z])?)\\)', 1) NOT IN ('', 'DRS', 'IRA', 'LP', 'LLC', 'LLP', 'INC') THEN regexp_extract(t, '\\(([A-Z]{{2,6}}(?:\\.[A-Z])?)\\)', 1) END AS holding,
coalesce(NOT contains(t, '(' || k || ')'), false) AS show, trim(regexp_replace(t, '\\s*\\([^)]*\\)\\s*$', '')) AS company, substr(nullif(trim(t), ''), 1, 7) AS cleaned FROM m""")
def x21_x22_x30_x31_x35_tickers(s, d):
    t, k = F.expr(_DESC), F.expr(_TICK)
    return table(s, d, "part").select(
        F.col("p_partkey").alias("id"), scalars.trailing_ticker(k, t).alias("ticker"), scalars.holding_ticker(t).alias("holding"), scalars.show_ticker(t, k).alias("show"), scalars.company_name(t).alias("company"), scalars.clean_text(t, 7).alias("cleaned")
    )


_BUCKET = "CASE p_partkey % 7 WHEN 0 THEN ' $1,001  - $15,000 ' WHEN 1 THEN '$15,001-$50,000' WHEN 2 THEN 'Over  $50,000,000' WHEN 3 THEN 'Over about $50M' WHEN 4 THEN 'None (less than 1,001)' WHEN 5 THEN '' ELSE '$201-$1,000' END"
_HELD = ", ".join(f"'{k}'" for k in brackets.HOLDING_MIDPOINTS)
_INC = ", ".join(f"'{k}'" for k in classify.INCOME_BUCKETS)


@query(f"""WITH m AS (SELECT p_partkey AS id, trim(regexp_replace({_BUCKET}, '\\s+', ' ', 'g')) AS t FROM part), c AS (SELECT *, '$' || regexp_extract(t, '\\$([\\d,]+)\\s*-\\s*\\$([\\d,]+)', 1) || ' - $' || regexp_extract(t, '\\$([\\d,]+)\\s*-\\s*\\$([\\d,]+)', 2) AS spaced FROM m),
b AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN t IN ({_HELD}) THEN t WHEN spaced IN ({_HELD}) THEN spaced WHEN contains(t, 'Over') AND contains(t, '$50') THEN 'Over $50,000,000' WHEN contains(t, 'None') AND contains(t, '1,001') THEN 'None (or less than $1,001)' ELSE t END AS bucket,
CASE WHEN spaced IN ({_INC}) THEN spaced END AS income FROM c)
SELECT id, bucket, CASE bucket {" ".join(f"WHEN '{k}' THEN {v}" for k, v in brackets.HOLDING_MIDPOINTS.items())} ELSE 0 END::BIGINT AS mid, income, CASE WHEN t <> '' AND income IS NULL THEN coalesce(nullif(regexp_extract(t, '\\$[\\d,]+(?:\\.\\d+)?', 0), ''), t) END AS exact FROM b""")
def x23_x24_holdings(s, d):
    t = F.expr(_BUCKET)
    bucket, inc = classify.value_bucket(t, tuple(brackets.HOLDING_MIDPOINTS)), classify.income(t)
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), bucket.alias("bucket"), brackets.holding_midpoint(bucket).alias("mid"), inc["bucket"].alias("income"), inc["exact"].alias("exact"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 > 0 THEN regexp_replace('1.' || s_suppkey || CASE WHEN s_suppkey % 3 = 2 THEN '.4' ELSE '' END, '\\.[^.]+$', '') END AS parent,
CASE s_suppkey % 3 WHEN 0 THEN 'Cabinet' WHEN 1 THEN 'Sub-Cabinet' ELSE 'Unknown' END AS level, s_suppkey % 2 = 0 AS mail_ok, '10.0.0.' || s_suppkey AS address,
[1, 2, 3, 9]::BIGINT[] = CASE WHEN s_suppkey % 9 + 1 = 2 THEN [1, 2, 3, 9]::BIGINT[] END AS second_page FROM supplier""")
def x25_x29_x36_x37_x54_small(s, d):
    k = F.col("s_suppkey")
    item = F.concat(F.lit("1"), F.when(k % 3 > 0, F.concat(F.lit("."), k.cast("string"))).otherwise(""), F.when(k % 3 == 2, ".4").otherwise(""))
    level = F.when(k % 3 == 0, " Level I ").when(k % 3 == 1, "Level II")
    mail = F.when(k % 2 == 0, "a@b.example").otherwise("a b@c")
    labels = scalars.page_labels((k % 9 + 1).cast("long"), F.lit(9).cast("long"))
    wanted = F.array(*(F.lit(v).cast("long") for v in (1, 2, 3, 9)))
    return table(s, d, "supplier").select(
        k.alias("id"), scalars.parent_item(item).alias("parent"), scalars.level_name(level).alias("level"), mail.rlike(scalars.EMAIL).alias("mail_ok"), scalars.first_address(F.concat(F.lit("10.0.0."), k.cast("string"), F.lit(" , 1.2.3.4"))).alias("address"), F.when(k % 9 + 1 == 2, labels == wanted).alias("second_page")
    )


@query("""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p)), lambda p: p <> '')) AS paragraphs FROM documents""")
def x33_paragraphs(s, d):
    return table(s, d, "documents").select("doc_id", F.size(scalars.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


@query(f"WITH {FILINGS_SQL} SELECT official_id, sha256(array_to_string(list_sort(list(DISTINCT url) FILTER (url IS NOT NULL)), chr(10))) AS send_key FROM filings GROUP BY 1")
def x39_u7_send_keys(s, d):
    everyone = filings(s, d).select("official_id").distinct()
    keys = digest.send_keys(filings(s, d), ["official_id"]).drop("urls")
    # An official without any url has no key.
    return everyone.join(keys, "official_id", "left")


# -- quality -----------------------------------------------------------------------------

_DATE_CASE = "CASE filing % 6 WHEN 0 THEN '2001/02/03' WHEN 1 THEN '2001-13-01' WHEN 2 THEN CAST(date AS {}) WHEN 3 THEN '2091-01-01' ELSE '2020-05-05' END"
DIRTY_SQL = f"""{TX_SQL}, dirty AS (SELECT official_id, filing * 100 + line AS row_id, CASE WHEN part % 11 = 0 THEN '  ' ELSE description END AS description, CASE WHEN part % 13 = 0 THEN 'Gift' ELSE type END AS type,
CASE WHEN part % 17 = 0 THEN '$1-$2' ELSE amount END AS amount, {_DATE_CASE.format("VARCHAR")} AS date_text, CASE WHEN part % 19 <> 0 THEN late END AS late, CASE WHEN part % 3 = 0 THEN 'SPY' WHEN part % 3 = 1 THEN 'ZZQ' ELSE ticker END AS ticker, (filing % 100) / 100.0::DOUBLE AS confidence FROM tx),
dated AS (SELECT *, regexp_matches(date_text, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AS shaped, try_cast(CASE WHEN regexp_matches(date_text, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN date_text END AS DATE) AS parsed FROM dirty),
judged AS (SELECT *, list_filter([CASE WHEN trim(description) = '' THEN 'Empty description' END, CASE WHEN type NOT IN ('Sale', 'Sale (Partial)', 'Sale (Full)', 'Purchase', 'Exchange') THEN 'Invalid type: "' || type || '"' END,
CASE WHEN amount NOT IN ({", ".join(f"'{b[0]}'" for b in brackets.BRACKETS)}) THEN 'Invalid amount: "' || amount || '"' END, CASE WHEN NOT shaped THEN 'Invalid date format: "' || date_text || '"' END, CASE WHEN shaped AND parsed IS NULL THEN 'Unparseable date: "' || date_text || '"' END,
CASE WHEN parsed > DATE '2026-01-01' THEN 'Future date: "' || date_text || '"' END, CASE WHEN parsed < DATE '2019-01-01' THEN 'Date before 2019: "' || date_text || '"' END, CASE WHEN late IS NULL THEN 'late flag missing' END,
CASE WHEN ticker <> '' AND NOT regexp_matches(ticker, '^[A-Za-z.]{{1,10}}$') THEN 'Suspicious ticker: "' || ticker || '"' END], lambda e: e IS NOT NULL) AS errors FROM dated)"""


def dirty(s, d):
    part = F.col("part")
    return transactions(s, d).select(
        "official_id",
        (F.col("filing") * 100 + F.col("line")).alias("row_id"),
        F.when(part % 11 == 0, "  ").otherwise(F.col("description")).alias("description"),
        F.when(part % 13 == 0, "Gift").otherwise(F.col("type")).alias("type"),
        F.when(part % 17 == 0, "$1-$2").otherwise(F.col("amount")).alias("amount"),
        F.expr(_DATE_CASE.format("STRING")).alias("date_text"),
        F.when(part % 19 != 0, F.col("late")).alias("late"),
        F.when(part % 3 == 0, "SPY").when(part % 3 == 1, "ZZQ").otherwise(F.col("ticker")).alias("ticker"),
        ((F.col("filing") % 100) / 100.0).alias("confidence"),
    )


@query(f"WITH {DIRTY_SQL} SELECT official_id, row_id, '[' || official_id || '][' || row_id || '] ' || unnest(errors) AS error FROM judged")
def v1_v8_errors(s, d):
    return quality.error_rows(dirty(s, d), "2026-01-01", "official_id", "row_id")


_KNOWN = ", ".join(f"'{t}'" for t in quality.KNOWN_TICKERS)


@query(f"""WITH {DIRTY_SQL} SELECT *, CASE WHEN failures > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (SELECT count(*) AS n, {n_if_sql("len(errors) > 0")} AS failures,
count(DISTINCT ticker) FILTER (ticker <> '' AND ticker NOT IN ({_KNOWN})) AS unknown_tickers, {n_if_sql("confidence < 0.8")} AS low_confidence FROM judged)""")
def a28_v7_v10_counters(s, d):
    return quality.counters(dirty(s, d), "2026-01-01")


@query(f"""WITH {DIRTY_SQL}, f AS (SELECT count(*) AS n, {n_if_sql("len(errors) > 0")} AS failures FROM judged), g AS (SELECT count(*) AS golden_total, {n_if_sql("accuracy >= 95")} AS golden_passed FROM (SELECT official_id, avg(CASE WHEN late THEN 0 ELSE 100 END) AS accuracy FROM tx GROUP BY 1))
SELECT n, failures, golden_passed, golden_total, CASE WHEN failures > 0 OR golden_passed < golden_total THEN 'FAIL' ELSE 'PASS' END AS verdict FROM f, g""")
def v10_verdict(s, d):
    golden = transactions(s, d).groupBy("official_id").agg((F.avg(F.when(F.col("late"), 0).otherwise(100)) >= 95).alias("passed"))
    return quality.verdict(quality.counters(dirty(s, d), "2026-01-01").select("n", "failures"), golden)


_PINS = (("region", 5), ("nation", 25), ("supplier", 100), ("sizes", 50), ("flags", 3))


@query(f"""SELECT name, n, pinned, n = pinned AS holds FROM (SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'sizes', count(DISTINCT p_size) FROM part
UNION ALL SELECT 'flags', count(DISTINCT l_returnflag) FROM lineitem) JOIN (VALUES {", ".join(map(str, _PINS))}) p(name, pinned) USING (name)""")
def v9_pinned_counts(s, d):
    counts = {t: table(s, d, t).agg(F.count("*").alias("n")) for t in ("region", "nation", "supplier")}
    counts |= {"sizes": table(s, d, "part").agg(F.countDistinct("p_size").alias("n")), "flags": table(s, d, "lineitem").agg(F.countDistinct("l_returnflag").alias("n"))}
    return quality.pinned(counts, dict(_PINS))


@query(f"WITH {DIRTY_SQL} SELECT ticker, count(*) AS n FROM dirty WHERE ticker <> '' AND ticker NOT IN ({_KNOWN}) GROUP BY 1")
def u13_unknown_tickers(s, d):
    return quality.unknown_tickers(dirty(s, d))


@query(f"""WITH {TX_SQL}, p AS (SELECT official_id, count(*) AS n, count(*) - count(DISTINCT struct_pack(a := description, b := type, c := amount, d := date)) AS duplicates, count(DISTINCT date) AS days FROM tx GROUP BY 1)
SELECT official_id, n, duplicates, n > 60 AS large, days = 1 AND n > 1 AS one_day FROM p WHERE n > 60 OR duplicates > 0 OR (days = 1 AND n > 1)""")
def a29_anomalies(s, d):
    return quality.anomalies(transactions(s, d), "official_id", ["description", "type", "amount"], 60, 1)


@query(f"""WITH {TX_SQL}, f AS (SELECT count(*) AS n, {n_if_sql("coalesce(description, '') = ''")} AS no_description, {n_if_sql("coalesce(type, '') = ''")} AS no_type, {n_if_sql("date IS NULL")} AS no_date, {n_if_sql("coalesce(ticker, '') = ''")} AS no_ticker,
{n_if_sql("official_id NOT IN (SELECT official_id FROM roster)")} AS orphans FROM all_tx), i AS (SELECT count(*) AS idle FROM roster WHERE official_id NOT IN (SELECT official_id FROM all_tx))
SELECT *, no_description + no_type + no_date + orphans AS issues, CASE WHEN no_description + no_type + no_date + orphans > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM f, i""")
def a30_j11_checks(s, d):
    return quality.checks(all_transactions(s, d), officials(s, d).filter(in_roster()))


@query(f"""WITH {TX_SQL}, p AS (SELECT official_id, count(*) - count(DISTINCT (description, date)) AS duplicates FROM tx GROUP BY 1) SELECT * FROM p WHERE duplicates > 0""")
def u12_duplicates(s, d):
    return merging.duplicates(transactions(s, d), "official_id", ["description", "date"])


# -- small rules of texts, ticks and lookups -----------------------------------------------


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 1 THEN s_name || ': new filing' ELSE (s_suppkey % 4) || ' new filings' END AS subject,
CASE s_suppkey % 3 WHEN 0 THEN 'urgent' WHEN 1 THEN 'default' ELSE 'low' END AS priority, CASE WHEN s_suppkey % 3 = 0 THEN 'URGENT: ' ELSE '' END || s_name AS headline,
concat_ws(', ', CASE WHEN s_suppkey % 2 > 0 THEN 'orphans: ' || s_suppkey % 2 END, CASE WHEN s_suppkey % 5 > 0 THEN 'blanks: ' || s_suppkey % 5 END) AS checks FROM supplier""")
def x47_x51_x55_texts(s, d):
    k = F.col("s_suppkey")
    alerts = F.create_map(*(F.lit(x) for pair in {"failure": "urgent", "review": "default", "info": "low"}.items() for x in pair))
    kind = F.when(k % 3 == 0, "failure").when(k % 3 == 1, "review").otherwise("info")
    return table(s, d, "supplier").select(
        k.alias("id"),
        scalars.subject(F.col("s_name"), k % 4).alias("subject"),
        alerts[kind].alias("priority"),
        F.concat(F.when(alerts[kind] == "urgent", "URGENT: ").otherwise(""), "s_name").alias("headline"),
        scalars.nonzero_text({"orphans": k % 2, "blanks": k % 5}).alias("checks"),
    )


@query("SELECT doc_id, contains(text, '278') OR contains(text, 'tion') AS loose, regexp_matches(text, '(?i)278\\s+transaction') OR regexp_matches(text, '(?i)278[\\s\\-]*t(\\(|[^A-Za-z0-9_]|$)') AS strict FROM documents")
def x52_a37_matchers(s, d):
    text = F.col("text")
    return table(s, d, "documents").select("doc_id", (F.contains(text, F.lit("278")) | F.contains(text, F.lit("tion"))).alias("loose"), classify.is_periodic_report(text).alias("strict"))


@query("""WITH e AS (SELECT date_trunc('month', min(o_orderdate))::DATE AS low, date_trunc('month', max(o_orderdate))::DATE AS high FROM orders),
m AS (SELECT k, CAST(low + INTERVAL 1 MONTH * k AS DATE) AS month, n FROM (SELECT low, CAST(date_diff('month', low, high) + 1 AS BIGINT) AS n FROM e), unnest(range(n)) AS t(k))
SELECT month, CASE WHEN month(month) = 1 THEN strftime(month, '%b %Y') ELSE strftime(month, '%b') END AS label, round((k + 0.5) * 100 / n, 4)::DOUBLE AS centre FROM m WHERE (month(month) - 1) % 3 = 0""")
def x12_quarter_ticks(s, d):
    """The axis of all months of orders, with a tick for each quarter in the middle of its first month."""
    day = F.col("o_orderdate").cast("date")
    ends = table(s, d, "orders").agg(F.trunc(F.min(day), "month").alias("low"), F.trunc(F.max(day), "month").alias("high"))
    months = ends.select(F.sequence("low", "high", F.expr("INTERVAL 1 MONTH")).alias("months"))
    axis = months.select(F.size("months").alias("n"), F.posexplode("months").alias("k", "month"))
    label = F.when(F.month("month") == 1, F.date_format("month", "MMM yyyy")).otherwise(F.date_format("month", "MMM"))
    return axis.filter((F.month("month") - 1) % 3 == 0).select("month", label.alias("label"), F.round((F.col("k") + 0.5) * 100 / F.col("n"), 4).alias("centre"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'lede ' || o_orderkey END AS lede FROM orders")
def s21_lede_lookup(s, d):
    k = F.col("o_orderkey")
    digests = table(s, d, "orders").select(k.alias("id"), F.sha2(k.cast("string"), 256).alias("send_key"))
    stored = table(s, d, "orders").select(F.sha2(F.when(k % 3 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit("-old"))), 256).alias("send_key"), F.when(k % 2 == 0, F.concat(F.lit("lede "), k.cast("string"))).otherwise("  ").alias("lede"))
    return digests.join(stored, "send_key", "left").select("id", F.nullif(F.trim("lede"), F.lit("")).alias("lede"))


@query("SELECT c_custkey AS id, 'm' || c_custkey AS message FROM customer")
def j19_paired_arrays(s, d):
    chunks = table(s, d, "customer").groupBy((F.floor(F.col("c_custkey") / 100)).alias("chunk")).agg(F.sort_array(F.collect_list("c_custkey")).alias("ids"))
    sent = chunks.withColumn("messages", F.transform("ids", lambda i: F.concat(F.lit("m"), i.cast("string"))))
    return sent.select(F.explode(F.arrays_zip("ids", "messages")).alias("z")).select(F.col("z.ids").alias("id"), F.col("z.messages").alias("message"))


@query("SELECT user_id, min_by(event_id, event_id) AS event_id, min_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' AND value > 10 GROUP BY 1")
def w11_first_qualifying(s, d):
    rows = table(s, d, "events").filter("event_type = 'purchase' AND value > 10")
    return merging.keep_one(rows, ["user_id"], [F.asc("event_id")]).select("user_id", "event_id", "value")


# -- tokens ------------------------------------------------------------------------------

_TOKEN_KEY, _NOW, _LIFE = b"a key of the tests", 1_700_000_500, 400


def _hmac_sql(payload: str) -> str:
    padded = _TOKEN_KEY.ljust(64, b"\0")
    inner, outer = ("'" + "".join(f"\\x{b ^ x:02X}" for b in padded) + "'::BLOB" for x in (0x36, 0x5C))
    return f"unhex(sha256({outer} || unhex(sha256({inner} || encode({payload})))))"


def _packed_sql(data: str) -> str:
    return f"rtrim(translate(to_base64({data}), '+/', '-_'), '=')"


_PAYLOAD = "c_custkey || ':confirm:' || (1700000000 + c_custkey % 700)"


@query(f"""SELECT c_custkey AS id, {_packed_sql(f"encode({_PAYLOAD})")} || '.' || {_packed_sql(_hmac_sql(_PAYLOAD))} AS token,
CASE WHEN c_custkey % 5 = 0 AND c_custkey % 700 BETWEEN {_NOW - _LIFE - 1_700_000_000} AND {_NOW - 1_700_000_000} THEN c_custkey END AS verified, c_custkey % 6 = 0 AND c_custkey % 5 = 0 AND false AS other_purpose FROM customer""")
def x38_tokens(s, d):
    """A token of each customer; of five one comes back as it is, the others changed in the id, the mark, the number of parts or not at all there."""
    k = F.col("c_custkey")
    made = table(s, d, "customer").select(k.alias("id"), tokens.mint(k, "confirm", F.lit(1_700_000_000) + k % 700, _TOKEN_KEY).alias("token"))
    other = tokens.mint(F.col("id") + 1, "confirm", F.lit(1_700_000_000) + F.col("id") % 700, _TOKEN_KEY)
    swapped = F.concat(F.substring_index(other, ".", 1), F.lit("."), F.substring_index("token", ".", -1))
    kind = F.col("id") % 5
    shown = F.when(kind == 0, F.col("token")).when(kind == 1, swapped).when(kind == 2, F.concat("token", F.lit("A"))).when(kind == 3, F.concat("token", F.lit("."))).otherwise("")
    back = made.withColumn("shown", shown)
    is_other = tokens.verify(F.col("shown"), "unsubscribe", _NOW, _TOKEN_KEY, _LIFE).isNotNull()
    return back.select("id", "token", tokens.verify(F.col("shown"), "confirm", _NOW, _TOKEN_KEY, _LIFE).alias("verified"), is_other.alias("other_purpose"))
