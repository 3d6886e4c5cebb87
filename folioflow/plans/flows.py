"""Queries of joins, merges, digests and subscribers, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflow.functions import brackets, scalars
from folioflow.operators import digest, matching, merging, ordering, rollups
from folioflow.plans.analytics import n_if, total
from folioflow.plans.model import FILINGS_SQL, TX_SQL, filings, officials, table, transactions
from folioflow.session import checkpoint_dir
from folioflow.streaming import amendments, delivery, limits, subscribers

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

# -- joins -------------------------------------------------------------------------------


@query("""SELECT o_custkey AS official_id, o_orderkey AS filing, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def j1_flatten(s, d):
    return table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("official_id"), F.col("o_orderkey").alias("filing"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")
    )


@query("SELECT c_custkey AS official_id, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j2_with_fallback(s, d):
    per = filings(s, d).groupBy("official_id").agg(F.count("*").alias("n"))
    return officials(s, d).select("official_id").join(per, "official_id", "left").select("official_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT l_orderkey AS filing, l_linenumber AS line, o_orderstatus AS status, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS place
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 49 QUALIFY place <= 50""")
def j3_review_queue(s, d):
    rows = table(s, d, "lineitem").filter("l_quantity >= 49").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return ordering.top(rows, order, 50).select(F.col("l_orderkey").alias("filing"), F.col("l_linenumber").alias("line"), F.col("o_orderstatus").alias("status"), "place")


@query(f"""WITH {TX_SQL}, {FILINGS_SQL}, u AS (SELECT official_id, date, min(ordinal) AS ordinal FROM filings WHERE coalesce(url, '') <> '' OR coalesce(label, '') <> '' GROUP BY 1, 2),
last AS (SELECT official_id, max_by(ordinal, date) AS ordinal FROM u GROUP BY 1)
SELECT t.filing, t.line, t.part, t.supplier, coalesce(n.ordinal, l.ordinal) AS filing_ordinal FROM tx t ASOF LEFT JOIN u n ON t.official_id = n.official_id AND t.date <= n.date LEFT JOIN last l ON t.official_id = l.official_id""")
def j4_as_of(s, d):
    return matching.as_of(transactions(s, d), filings(s, d), "official_id").select(*ROWS, "filing_ordinal")


_EXEMPT = ("Brand#3", "Brand#9")


@query(f"""WITH {TX_SQL}, h AS (SELECT p_brand AS ticker, min_by(p_name, p_partkey) AS held_as, CAST(sum({brackets.sql_case(brackets.sql_bracket_of("p_retailprice * 40"), 2)}) AS BIGINT) AS entry_value FROM part WHERE p_brand <> '' GROUP BY 1),
k AS (SELECT ticker, count(*) AS sales FROM tx WHERE is_sale AND ticker <> '' GROUP BY 1),
b AS (SELECT ticker, held_as, coalesce(sales, 0) AS n, coalesce(entry_value, 0) AS entry_value FROM h FULL JOIN k USING (ticker))
SELECT ticker, coalesce(held_as, 'Sold (' || ticker || ')') AS description, n AS sales, CASE WHEN ticker IN ('Brand#3', 'Brand#9') THEN 'exempt' WHEN n > 0 THEN 'sold' ELSE 'no-sale-on-file' END AS status,
CASE WHEN ticker IN ('Brand#3', 'Brand#9') THEN 'exempt from reporting' WHEN n > 0 AND held_as IS NOT NULL THEN n || CASE WHEN n = 1 THEN ' sale on file' ELSE ' sales on file' END WHEN n > 0 THEN 'sold, not among the parsed entries' ELSE 'no sale on file' END AS note, entry_value FROM b""")
def j5_u8_t14_reconcile(s, d):
    held = table(s, d, "part").select(
        F.col("p_brand").alias("ticker"), F.col("p_name").alias("description"), F.col("p_partkey").alias("ordinal"), brackets.midpoint(brackets.bracket_of(F.col("p_retailprice") * 40)).alias("value")
    )
    sold = transactions(s, d).filter(brackets.is_sale(F.col("type")))
    return matching.reconcile(held, sold, _EXEMPT)


@query(f"""WITH {TX_SQL}, h AS (SELECT p_brand || CASE WHEN p_partkey % 5 = 0 THEN '-P' ELSE '' END AS ticker, min_by(p_name, p_partkey) AS held_as, CAST(sum({brackets.sql_case(brackets.sql_bracket_of("p_retailprice * 40"), 2)}) AS BIGINT) AS entry_value FROM part WHERE p_brand <> '' GROUP BY 1),
k AS (SELECT ticker || CASE WHEN supplier % 5 = 0 THEN '-S' ELSE '' END AS ticker, count(*) AS sales FROM tx WHERE is_sale AND ticker <> '' GROUP BY 1),
b AS (SELECT ticker, held_as, coalesce(sales, 0) AS n, coalesce(entry_value, 0) AS entry_value FROM h FULL JOIN k USING (ticker))
SELECT ticker, coalesce(held_as, 'Sold (' || ticker || ')') AS description, n AS sales, CASE WHEN ticker IN ('Brand#3', 'Brand#9') THEN 'exempt' WHEN n > 0 THEN 'sold' ELSE 'no-sale-on-file' END AS status,
CASE WHEN ticker IN ('Brand#3', 'Brand#9') THEN 'exempt from reporting' WHEN n > 0 AND held_as IS NOT NULL THEN n || CASE WHEN n = 1 THEN ' sale on file' ELSE ' sales on file' END WHEN n > 0 THEN 'sold, not among the parsed entries' ELSE 'no sale on file' END AS note, entry_value FROM b""")
def j5_u8_t14_reconcile_all(s, d):
    """All parts and all sales; a suffix by the id makes tickers that only one side has."""
    suffix = lambda c, mark: F.when(F.col(c) % 5 == 0, mark).otherwise("")
    held = table(s, d, "part").filter("p_brand <> ''").select(
        F.concat("p_brand", suffix("p_partkey", "-P")).alias("ticker"), F.col("p_name").alias("description"), F.col("p_partkey").alias("ordinal"), brackets.midpoint(brackets.bracket_of(F.col("p_retailprice") * 40)).alias("value")
    )
    sold = transactions(s, d).filter(brackets.is_sale(F.col("type")) & (F.col("ticker") != "")).withColumn("ticker", F.concat("ticker", suffix("supplier", "-S")))
    return matching.reconcile(held, sold, _EXEMPT)


_PROMISES = (
    (1, "1997-01-01", ["Brand#1", "Brand#2"], []),
    (2, "1998-06-01", [], ["BLUE", "bolt"]),
    (3, "1999-01-01", ["Brand#5"], ["red", "ring"]),
    (4, "1996-01-01", [], []),
    (5, "2001-11-01", ["Brand#7"], ["nothing", "at all"]),
)
_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"


@query(f"""WITH {TX_SQL}, p(promise_id, confirmed, tickers, tokens) AS (VALUES {", ".join(f"({k}, DATE '{c}', {_LIST(a)}, {_LIST(b)})" for k, c, a, b in _PROMISES)}),
hits AS (SELECT promise_id, date, mid FROM p JOIN tx ON is_sale AND date >= confirmed AND (list_contains(tickers, ticker) OR (len(tokens) > 0 AND len(list_filter(tokens, lambda t: NOT contains(lower(description), lower(t)))) = 0)))
SELECT promise_id, count(date) AS sales, min(date) AS first_sale, max(date) AS last_sale, {total("mid")} AS value, CASE WHEN count(date) > 0 THEN 'sales-on-file' ELSE 'no-sales-on-file' END AS status FROM p LEFT JOIN hits USING (promise_id) GROUP BY 1""")
def j6_a40_promises(s, d):
    promises = s.createDataFrame(_PROMISES, "promise_id int, confirmed string, tickers array<string>, tokens array<string>").withColumn("confirmed", F.col("confirmed").cast("date"))
    sales = transactions(s, d).filter(brackets.is_sale(F.col("type"))).select(*ROWS, "date", "ticker", "description", "amount")
    return matching.promise_evidence(promises, sales, list(ROWS))


@query(f"WITH {FILINGS_SQL} SELECT ordinal, url FROM filings WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM filings WHERE status = 'F' AND url IS NOT NULL)")
def j7_j8_r1_new_filings(s, d):
    rows = filings(s, d)
    return matching.unknown_rows(rows, rows.filter("status = 'F'"), "url").select("ordinal", "url")


_FOLLOWS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS slug FROM customer"


def _recipients(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("slug"))


def _slugs(s):
    return s.createDataFrame([("BUILDING",), ("MACHINERY",)], "slug string")


@query(f"WITH r AS ({_FOLLOWS}) SELECT id, slug FROM r WHERE slug IS NULL OR slug IN ('BUILDING', 'MACHINERY')")
def j9_routed(s, d):
    return matching.routed(_recipients(s, d), _slugs(s)).select("id", "slug")


@query(f"""WITH r AS ({_FOLLOWS}) SELECT count(*) AS total, {n_if("slug IS NULL")} AS all_followers, {n_if("slug IS NULL OR slug IN ('BUILDING', 'MACHINERY')")} AS reached,
{n_if("slug IS NOT NULL AND slug NOT IN ('BUILDING', 'MACHINERY')")} AS excluded FROM r""")
def a33_follow_breakdown(s, d):
    return rollups.follow_breakdown(_recipients(s, d), _slugs(s))


@query(f"WITH r AS ({_FOLLOWS}) SELECT slug, count(*) AS followers, CASE slug WHEN 'BUILDING' THEN 3 ELSE 5 END AS new_count FROM r WHERE slug IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def j24_j25_follower_counts(s, d):
    cards = s.createDataFrame([("BUILDING", 3), ("MACHINERY", 5), ("NOBODY", 1)], "slug string, new_count int")
    return _recipients(s, d).join(cards, "slug").groupBy("slug").agg(F.count("*").alias("followers"), F.first("new_count").alias("new_count"))


@query(f"""WITH {FILINGS_SQL}, f AS (SELECT official_id AS owner, url, date, status FROM filings WHERE url IS NOT NULL)
SELECT owner, url, date, 'document' AS origin FROM f WHERE status = 'F' UNION ALL SELECT owner, url, date, 'filing' FROM f WHERE url NOT IN (SELECT url FROM f WHERE status = 'F')""")
def j12_merged_documents(s, d):
    rows = filings(s, d).filter("url IS NOT NULL").select(F.col("official_id").alias("owner"), "url", "date", "status")
    return matching.merged_documents(rows.filter("status = 'F'"), rows)


_GOLDEN_SQL = f"""{TX_SQL}, g AS (SELECT filing * 100 + line AS golden_id, description, CAST(CASE WHEN filing % 3 = 0 THEN date + 1 ELSE date END AS DATE) AS date, type, CASE WHEN filing % 5 = 0 THEN 'Over $50,000,000' ELSE amount END AS amount, late FROM tx),
g1 AS (SELECT DISTINCT ON (golden_id) * FROM g ORDER BY golden_id, description NULLS FIRST, date NULLS FIRST, type NULLS FIRST, amount NULLS FIRST, late NULLS FIRST),
r AS (SELECT description, date, type, min_by(struct_pack(amount, late), struct_pack(a := filing, b := line, c := part, d := supplier)) AS f FROM tx GROUP BY 1, 2, 3),
scored AS (SELECT golden_id, f IS NOT NULL AS present, CASE WHEN f IS NULL THEN 0::BIGINT ELSE CAST(g1.amount IS NOT DISTINCT FROM f.amount AS BIGINT) + CAST(g1.late IS NOT DISTINCT FROM f.late AS BIGINT) END AS agreeing
FROM g1 LEFT JOIN r ON g1.description IS NOT DISTINCT FROM r.description AND g1.date IS NOT DISTINCT FROM r.date AND g1.type IS NOT DISTINCT FROM r.type)"""


@query(f"""WITH {_GOLDEN_SQL} SELECT golden_id % 100 AS line, count(*) AS golden, {n_if("present")} AS present, {total("agreeing")} AS agreeing, round(sum(agreeing) * 100.0::DOUBLE / (count(*) * 2), 1) AS accuracy, sum(agreeing) * 100 >= count(*) * 2 * 95 AS passed, any_value(n) <> count(*) AS count_differs
FROM scored JOIN (SELECT line, count(*) AS n FROM tx GROUP BY 1) c ON c.line = golden_id % 100 GROUP BY 1""")
def j13_x46_golden(s, d):
    """The accuracy of each line number's golden rows, and whether it reaches the threshold."""
    tx = transactions(s, d)
    scored = _golden(tx).withColumn("line", F.col("golden_id") % 100)
    return matching.golden_accuracy(scored, tx.groupBy("line").agg(F.count("*").alias("n")), "line", 2)


def _golden(tx):
    made = tx.select(
        (F.col("filing") * 100 + F.col("line")).alias("golden_id"), "description", F.when(F.col("filing") % 3 == 0, F.date_add("date", 1)).otherwise(F.col("date")).alias("date"), "type", F.when(F.col("filing") % 5 == 0, "Over $50,000,000").otherwise(F.col("amount")).alias("amount"), "late"
    )
    golden = made.groupBy("golden_id").agg(F.min(F.struct("description", "date", "type", "amount", "late")).alias("g")).select("golden_id", "g.*")
    return matching.golden_score(golden, tx.withColumn("ordinal", F.struct(*ROWS)), ["description", "date", "type"], ["amount", "late"])


@query(f"WITH {_GOLDEN_SQL} SELECT * FROM scored")
def j13_x46_golden_all(s, d):
    """A golden row for every filing and line."""
    return _golden(transactions(s, d))


@query(f"""WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_type, value FROM events WHERE event_id % 2 = 0),
b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, event_type, value FROM events WHERE event_id % 2 = 1),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.event_type IS NOT NULL AND b.event_type IS NOT NULL AS there, a.event_type IS NOT DISTINCT FROM b.event_type AS same FROM a FULL JOIN b ON a.user_id = b.user_id AND a.pos = b.pos)
SELECT user_id, {n_if("there AND same")} AS equal, {n_if("there AND NOT same")} AS different, {n_if("NOT there")} AS unpaired FROM j GROUP BY 1""")
def j14_positional(s, d):
    from pyspark.sql import Window

    e = table(s, d, "events").withColumn("side", F.col("event_id") % 2)
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("user_id", "side").orderBy("event_id"))).select("user_id", "side", "pos", "event_type")
    return matching.positional(e.filter("side = 0").drop("side"), e.filter("side = 1").drop("side"), "user_id", ["event_type"])


_PAIR = "concat(l_partkey, '-', l_suppkey)"


@query(f"""WITH a AS (SELECT DISTINCT {_PAIR} AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT {_PAIR} AS k FROM lineitem WHERE l_returnflag = 'A')
SELECT {n_if("a.k IS NOT NULL AND b.k IS NOT NULL")} AS matches, {n_if("b.k IS NULL")} AS missing, {n_if("a.k IS NULL")} AS extra FROM a FULL JOIN b ON a.k = b.k""")
def j15_u11_j22_sets(s, d):
    line = table(s, d, "lineitem").select(F.expr(_PAIR).alias("k"), "l_returnflag")
    return matching.compared_sets(line.filter("l_returnflag = 'R'"), line.filter("l_returnflag = 'A'"), "k")


@query(f"""WITH c AS (SELECT {_PAIR} AS k, {n_if("l_returnflag = 'R'")} AS ours, {n_if("l_returnflag = 'A'")} AS theirs FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1)
SELECT k, ours, theirs, CASE WHEN ours = theirs THEN 'Match' WHEN theirs = 0 THEN 'They''re missing it' WHEN ours = 0 THEN 'We''re missing it' WHEN ours > theirs THEN 'We have more' ELSE 'They have more' END AS status FROM c""")
def j22_count_status(s, d):
    line = table(s, d, "lineitem").select(F.expr(_PAIR).alias("k"), "l_returnflag")
    return matching.count_status(line.filter("l_returnflag = 'R'"), line.filter("l_returnflag = 'A'"), "k")


@query("""SELECT p_partkey AS id, coalesce(k.slug, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-')) AS slug, k.context FROM part
LEFT JOIN (VALUES ('Brand#1', 'first', 'makes firsts'), ('Brand#2', 'second', 'makes seconds')) k(brand, slug, context) ON p_brand = brand""")
def j16_j23_dimension(s, d):
    known = s.createDataFrame([("Brand#1", "first", "makes firsts"), ("Brand#2", "second", "makes seconds")], "p_brand string, known string, context string")
    rows = table(s, d, "part").join(known, "p_brand", "left")
    return rows.select(F.col("p_partkey").alias("id"), F.coalesce("known", scalars.slug(F.col("p_brand"))).alias("slug"), "context")


_PEOPLE = "SELECT c_custkey AS official_id, DATE '2000-01-01' + c_custkey % 60 AS confirmed, CASE WHEN c_custkey % 4 = 0 THEN DATE '2000-02-01' END AS took_office, CASE WHEN c_custkey % 3 > 0 THEN DATE '2000-01-20' END AS agreed FROM customer"


@query(f"""WITH p AS ({_PEOPLE.replace("c_custkey % 60", "CAST(c_custkey % 60 AS INTEGER)")}), e AS (SELECT official_id, confirmed, 'confirmed' AS event, confirmed AS date FROM p UNION ALL SELECT official_id, confirmed, 'took office', took_office FROM p
UNION ALL SELECT official_id, confirmed, 'agreement', agreed FROM p UNION ALL SELECT official_id, confirmed, 'deadline', agreed + 90 FROM p)
SELECT official_id, event, date FROM e WHERE date IS NOT NULL AND NOT (event = 'agreement' AND abs(date_diff('day', confirmed, date)) <= 7)""")
def j21_career_events(s, d):
    k = F.col("c_custkey")
    people = table(s, d, "customer").select(
        k.alias("official_id"), F.date_add(F.lit("2000-01-01").cast("date"), (k % 60).cast("int")).alias("confirmed"), F.when(k % 4 == 0, F.lit("2000-02-01").cast("date")).alias("took_office"), F.when(k % 3 > 0, F.lit("2000-01-20").cast("date")).alias("agreed")
    )
    return matching.career_events(people)


@query("""WITH r AS (SELECT user_id AS n, event_id % 2 AS age, max_by(value, event_id) AS value FROM events GROUP BY 1, 2) SELECT n, max_by(value, age) AS value FROM r GROUP BY 1""")
def j20_latest_per_key(s, d):
    rows = table(s, d, "events").groupBy(F.col("user_id").alias("n"), (F.col("event_id") % 2).alias("age")).agg(F.max_by("value", "event_id").alias("value"))
    return matching.latest_per_key(rows.filter("age = 0").drop("age"), rows.filter("age = 1").drop("age"), "n")


# -- merges ------------------------------------------------------------------------------

KEY_SQL = "lower(trim(description)) || '|' || CAST(date AS VARCHAR) || '|' || lower(type) || '|' || amount"
LOTS_SQL = f"""{TX_SQL}, lots AS (SELECT official_id % 50 AS filing, line, part, supplier, description, CAST(date_trunc('month', date) AS DATE) AS date, type, amount, {KEY_SQL.replace("CAST(date AS", "CAST(CAST(date_trunc('month', date) AS DATE) AS")} AS key FROM tx),
old AS (SELECT * FROM lots WHERE filing < 20), new AS (SELECT * FROM lots WHERE filing >= 20),
have AS (SELECT key, count(*) AS have FROM old GROUP BY 1), want AS (SELECT key, max(n) AS want FROM (SELECT key, filing, count(*) AS n FROM new GROUP BY 1, 2) GROUP BY 1)"""


def _lots(s, d):
    rows = transactions(s, d).select((F.col("official_id") % 50).alias("filing"), "line", "part", "supplier", "description", F.trunc("date", "month").alias("date"), "type", "amount")
    return rows.filter("filing < 20"), rows.filter("filing >= 20")


@query(f"""WITH {LOTS_SQL} SELECT key, coalesce(have, 0) AS have, coalesce(want, 0) AS want, greatest(coalesce(have, 0), coalesce(want, 0)) AS target, greatest(0, coalesce(want, 0) - coalesce(have, 0)) AS added FROM have FULL JOIN want USING (key)""")
def u1_r9_multiset_targets(s, d):
    return merging.multiset_targets(*_lots(s, d))


@query(f"""WITH {LOTS_SQL} SELECT filing, line, part, supplier, description, date, type, amount FROM (SELECT new.*, row_number() OVER (PARTITION BY key ORDER BY filing, line, part, supplier) AS nth, want - coalesce(have, 0) AS missing
FROM new JOIN want USING (key) LEFT JOIN have USING (key)) WHERE nth <= missing""")
def u1_multiset_rows(s, d):
    return merging.multiset_merge(*_lots(s, d))


@query(f"""WITH {LOTS_SQL}, f AS (SELECT key, count(*) AS filed, min(struct_pack(filing, line, part, supplier)) AS f FROM new WHERE key NOT IN (SELECT key FROM old) GROUP BY 1) SELECT key, filed, f.filing, f.line, f.part, f.supplier FROM f""")
def u2_u9_set_merge(s, d):
    return merging.set_merge(*_lots(s, d))


@query(f"WITH {LOTS_SQL} SELECT filing, line, part, supplier FROM lots QUALIFY row_number() OVER (PARTITION BY description, date, type ORDER BY filing DESC, line, part, supplier) = 1")
def u3_newest_filing_wins(s, d):
    old, new = _lots(s, d)
    return merging.keep_one(old.union(new), ["description", "date", "type"], [F.desc("filing"), F.asc("line"), F.asc("part"), F.asc("supplier")]).select(*ROWS)


@query(f"WITH {LOTS_SQL} SELECT filing, line, part, supplier FROM lots QUALIFY row_number() OVER (PARTITION BY description, date, type, amount ORDER BY filing DESC, line DESC, part DESC, supplier DESC) = 1")
def u4_keep_last(s, d):
    old, new = _lots(s, d)
    return merging.keep_one(old.union(new), ["description", "date", "type", "amount"], [F.desc(c) for c in ROWS]).select(*ROWS)


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value, min(event_id) AS first_place FROM events GROUP BY 1")
def u5_t7_last_write(s, d):
    return merging.last_write(table(s, d, "events"), "user_id", ["event_type", "value"], F.col("event_id"))


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def u6_keep_first(s, d):
    return merging.keep_first_text(table(s, d, "documents"), "text", "doc_id")


@query(f"""WITH {FILINGS_SQL}, t AS (SELECT coalesce(url, label) AS link, official_id, date, ordinal FROM filings WHERE coalesce(url, label) IS NOT NULL),
l AS (SELECT link, max_by(official_id, ordinal) AS official_id, max_by(date, ordinal) AS date FROM t GROUP BY 1)
SELECT link, date, c_name AS name, row_number() OVER (ORDER BY date DESC, c_name, link) AS place FROM l JOIN customer ON c_custkey = official_id""")
def t7_target_filings(s, d):
    """The last row of each link, in the order of dates, latest first, then of names."""
    rows = filings(s, d).withColumn("link", F.coalesce("url", "label")).filter("link IS NOT NULL")
    last = merging.last_write(rows, "link", ["official_id", "date"], F.col("ordinal")).drop("first_place")
    named = last.join(table(s, d, "customer").select(F.col("c_custkey").alias("official_id"), F.col("c_name").alias("name")), "official_id")
    return ordering.numbered(named, {"date": False}, [F.asc("name"), F.asc("link")], "place").select("link", "date", "name", "place")


@query(f"WITH {LOTS_SQL} SELECT filing, line, part, supplier, row_number() OVER (PARTITION BY key, filing ORDER BY line, part, supplier) AS occurrence FROM lots")
def w3_w5_occurrences(s, d):
    old, new = _lots(s, d)
    return merging.occurrences(old.union(new), ["line", "part", "supplier"]).select(*ROWS, "occurrence")


@query(f"WITH {TX_SQL} SELECT description, min(date) AS low, max(date) AS high, count(DISTINCT date) AS dates FROM tx GROUP BY 1")
def u10_dates(s, d):
    return transactions(s, d).groupBy("description").agg(F.min("date").alias("low"), F.max("date").alias("high"), F.countDistinct("date").alias("dates"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 2 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price, CASE WHEN o_orderkey % 5 IN (1, 2) THEN false ELSE o_orderkey % 2 = 0 END AS flagged FROM orders WHERE o_orderkey % 5 <> 3""")
def r11_k10_review(s, d):
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    old = o.select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), (k % 2 == 0).alias("flagged"))
    action = F.when(k % 5 == 1, "approve").when(k % 5 == 2, "edit").when(k % 5 == 3, "delete")
    changes = o.select(k.alias("id"), action.alias("action"), F.when(action == "edit", "X").alias("status")).filter("action IS NOT NULL")
    return merging.merge_rows(old, changes, "id", ["status"])


@query("""SELECT email, coalesce(o.status, n.status) AS status, CASE WHEN o.status IS NULL THEN n.slug WHEN n.status IS NULL OR (o.status = 'active' AND o.slug IS NULL) THEN o.slug ELSE n.slug END AS slug
FROM (SELECT c_name AS email, CASE WHEN c_custkey % 2 = 0 THEN 'active' ELSE 'pending' END AS status, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS slug FROM customer WHERE c_custkey % 7 < 5) o
FULL JOIN (SELECT c_name AS email, 'pending' AS status, 'new' AS slug FROM customer WHERE c_custkey % 7 > 2) n USING (email)""")
def k10_upsert(s, d):
    c, k = table(s, d, "customer"), F.col("c_custkey")
    old = c.filter(k % 7 < 5).select(F.col("c_name").alias("email"), F.when(k % 2 == 0, "active").otherwise("pending").alias("status"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("slug"))
    return merging.upsert_follow(old, c.filter(k % 7 > 2).select(F.col("c_name").alias("email"), F.lit("pending").alias("status"), F.lit("new").alias("slug")))


@query("""SELECT o_orderkey AS id, o_custkey AS source FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)""")
def k12_replace_source(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"))
    return merging.replace_source(o.filter("id % 2 = 0"), o.filter("id % 2 = 1"), "source")


# -- digests -----------------------------------------------------------------------------

SINCE, REFERENCE = "2001-05-01", "2001-07-20"
DIGEST_SQL = f"""{FILINGS_SQL}, people AS (SELECT o_custkey AS slug, 'n' || o_custkey AS name, CASE WHEN o_custkey % 9 > 0 THEN CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) END AS ingested, CAST(o_custkey % 8 AS BIGINT) AS new_count,
  CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS posted, o_custkey % 17 = 0 AS former FROM orders GROUP BY o_custkey),
pending AS (SELECT url, min(official_id) AS slug, max(date) AS date FROM filings WHERE url <> '' AND official_id IN (SELECT slug FROM people WHERE coalesce(ingested, '') >= '{SINCE}') AND url NOT IN (SELECT url FROM filings WHERE status = 'F' AND url IS NOT NULL) GROUP BY 1),
cards AS (SELECT slug, name, new_count, count(*) AS filings, max_by(url, struct_pack(date, url)) AS primary_url, max(date) AS posted, row_number() OVER (ORDER BY new_count DESC, slug) AS place FROM pending JOIN (SELECT slug, name, new_count FROM people WHERE new_count > 0) USING (slug) GROUP BY 1, 2, 3)"""


def _people(s, d):
    last = filings(s, d).groupBy(F.col("official_id").alias("slug")).agg(F.max("date").cast("string").alias("posted"))
    return last.select("slug", F.concat(F.lit("n"), F.col("slug").cast("string")).alias("name"), F.when(F.col("slug") % 9 > 0, F.col("posted")).alias("ingested"), (F.col("slug") % 8).cast("long").alias("new_count"), "posted", (F.col("slug") % 17 == 0).alias("former"))


def _pending(s, d):
    rows = filings(s, d).withColumnRenamed("official_id", "slug")
    return digest.pending_filings(_people(s, d), rows, rows.filter("status = 'F' AND url IS NOT NULL"), SINCE)


def _cards(s, d):
    return digest.items(_people(s, d), _pending(s, d), F.floor(F.col("slug") / 4096))


@query(f"WITH {DIGEST_SQL} SELECT * FROM pending")
def r10_r8_pending(s, d):
    return _pending(s, d)


@query(f"WITH {DIGEST_SQL} SELECT * FROM cards")
def r10_t9_items(s, d):
    return _cards(s, d)


@query(f"""WITH {TX_SQL}, {DIGEST_SQL} SELECT slug, filing, line, part, supplier, nth FROM (SELECT official_id AS slug, filing, line, part, supplier, row_number() OVER (PARTITION BY official_id ORDER BY date DESC, filing, line, part, supplier) AS nth FROM tx) JOIN cards USING (slug) WHERE nth <= least(6, new_count)""")
def t8_trades_shown(s, d):
    trades = transactions(s, d).select(F.col("official_id").alias("slug"), "date", *ROWS)
    return digest.trades_shown(_cards(s, d), trades, [F.asc(c) for c in ROWS]).select("slug", *ROWS, "nth")


_SHOWN_SQL = """shown AS (SELECT slug, nth, description || CASE WHEN coalesce(ticker, '') <> '' THEN ' (' || ticker || ')' ELSE '' END || ': ' || type || ', ' || amount || ', trade date ' || CAST(date AS VARCHAR) || CASE WHEN late THEN ', flagged late' ELSE '' END AS text
FROM (SELECT official_id AS slug, *, row_number() OVER (PARTITION BY official_id ORDER BY date DESC, filing, line, part, supplier) AS nth FROM tx) JOIN cards USING (slug) WHERE nth <= least(6, new_count))"""


@query(f"""WITH {TX_SQL}, {DIGEST_SQL}, {_SHOWN_SQL}, lines AS (SELECT slug, string_agg('    - ' || text, chr(10) ORDER BY nth) AS lines FROM shown GROUP BY 1)
SELECT slug, concat_ws(chr(10), '- ' || name || ': ' || new_count || ' new trades disclosed. Filing posted on ' || CAST(posted AS VARCHAR) || '.', CASE WHEN slug % 2 = 0 THEN '  Site summary: About ' || name END,
CASE WHEN lines IS NOT NULL THEN '  Most recent trades:' END, lines) AS text FROM cards LEFT JOIN lines USING (slug)""")
def j24_draft_lines(s, d):
    cards = _cards(s, d)
    tx = transactions(s, d).withColumn("slug", F.col("official_id"))
    shown = digest.trades_shown(cards, tx, [F.asc(c) for c in ROWS])
    ticker = F.when(F.coalesce("ticker", F.lit("")) != "", F.concat(F.lit(" ("), "ticker", F.lit(")"))).otherwise("")
    text = F.concat("description", ticker, F.lit(": "), "type", F.lit(", "), "amount", F.lit(", trade date "), F.col("date").cast("string"), F.when(F.col("late"), ", flagged late").otherwise(""))
    summaries = _people(s, d).select("slug", F.when(F.col("slug") % 2 == 0, F.concat(F.lit("About "), "name")).alias("summary"))
    return digest.draft_lines(cards, summaries, shown.select("slug", "nth", text.alias("text")))


@query(f"""WITH {DIGEST_SQL}, f AS (SELECT c_custkey % 400 AS slug, count(*) AS followers FROM customer WHERE c_custkey % 5 > 0 GROUP BY 1)
SELECT coalesce(string_agg(followers || ' for ' || name, ', ' ORDER BY place), '') AS text, count(*) AS cards FROM cards JOIN f USING (slug)""")
def j25_follower_text(s, d):
    follows = table(s, d, "customer").select(F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 400).alias("slug"))
    return digest.follower_text(_cards(s, d), follows)


@query(f"""WITH {DIGEST_SQL} SELECT slug, posted, CASE WHEN new_count > 0 THEN new_count END AS new_count, row_number() OVER (ORDER BY posted DESC, slug) AS place FROM people
WHERE NOT former AND coalesce(ingested, '') >= CAST(DATE '{REFERENCE}' - 14 AS VARCHAR) AND slug NOT IN (SELECT slug FROM cards) QUALIFY place <= 5""")
def j10_t10_also_new(s, d):
    return digest.also_new(_people(s, d), _cards(s, d), REFERENCE)


@query(f"WITH {DIGEST_SQL} SELECT sha256(string_agg(url, chr(10) ORDER BY url)) AS send_key, count(*) AS urls FROM pending")
def x39_send_key(s, d):
    return digest.send_key(_pending(s, d))


@query("SELECT c_custkey AS id, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS chunk FROM customer")
def x40_chunks(s, d):
    return digest.chunks(table(s, d, "customer").select(F.col("c_custkey").alias("id")))


@query(f"""WITH {DIGEST_SQL}, r AS (SELECT slug, slug % 3 = 0 AS is_new, new_count, row_number() OVER (ORDER BY slug % 3 = 0 DESC, new_count DESC, posted DESC, slug) AS place FROM people)
SELECT {n_if("is_new")} AS new, {n_if("NOT is_new")} AS updated, string_agg(CAST(slug AS VARCHAR), ',' ORDER BY place) FILTER (place <= 3) AS shown, CAST(sum(new_count) FILTER (place > 3) AS BIGINT) AS overflow FROM r""")
def a43_w6_banner(s, d):
    return digest.banner(_people(s, d).withColumn("is_new", F.col("slug") % 3 == 0).withColumn("slug", F.col("slug").cast("long")))


@query(f"""WITH {DIGEST_SQL} SELECT slug % 10 AS entry, {total("new_count")} AS rows, count(*) AS items FROM cards GROUP BY 1""")
def a34_a35_entry_totals(s, d):
    cards = _cards(s, d)
    nested = cards.groupBy((F.col("slug") % 10).alias("entry")).agg(F.collect_list(F.struct("slug", "new_count")).alias("items"))
    return nested.select("entry", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["new_count"]).alias("rows"), F.size("items").cast("long").alias("items"))


# -- subscribers -------------------------------------------------------------------------


def _limit_sql(seconds: int, most: int) -> str:
    window = f"RANGE BETWEEN INTERVAL '{seconds * 1_000_000 - 1} microseconds' PRECEDING AND CURRENT ROW"
    return f"""SELECT event_id, n AS in_window, n > {most} AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts {window}) - (count(*) OVER (PARTITION BY user_id, ts) - row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id)) AS n FROM events)"""


@query(_limit_sql(86_400, 3))
def r2_rate_limit(s, d):
    return subscribers.rate_limited(table(s, d, "events"), "user_id", 86_400, 3).select("event_id", "in_window", "limited")


@query(_limit_sql(6 * 3600, 1))
def r3_rate_limit(s, d):
    return subscribers.rate_limited(table(s, d, "events"), "user_id", 6 * 3600, 1).select("event_id", "in_window", "limited")


@query("""WITH a AS (SELECT user_id AS run, event_id % 7 AS chunk, event_id AS attempt, event_type <> 'error' AS ok FROM events), c AS (SELECT run, chunk, max(ok) AS ok, count(*) AS attempts FROM a GROUP BY 1, 2)
SELECT run, count(*) AS chunks, count(*) FILTER (ok) AS done, CAST(sum(attempts) AS BIGINT) AS attempts, CASE WHEN count(*) FILTER (ok) = 7 THEN 'sent' ELSE 'failed' END AS status FROM c GROUP BY 1""")
def r7_send_states(s, d):
    tries = table(s, d, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 7).alias("chunk"), F.col("event_id").alias("attempt"), (F.col("event_type") != "error").alias("ok"))
    return delivery.run_states(tries, F.lit(7))


@query("SELECT user_id, max_by(event_type, struct_pack(ts, event_id)) AS status, count(*) AS events FROM events GROUP BY 1")
def r6_delivery_status(s, d):
    return subscribers.latest_status(table(s, d, "events"), "user_id", "event_type")


def _actions(s, d):
    pairs = [F.lit(x) for pair in subscribers.ACTIONS.items() for x in pair]
    return table(s, d, "events").withColumn("action", F.create_map(*pairs)[F.col("event_type")])


_ACTION = "CASE event_type WHEN 'signup' THEN 'signup' WHEN 'click' THEN 'confirm' WHEN 'error' THEN 'bounce' WHEN 'view' THEN 'unsubscribe' ELSE 'complaint' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS at_us, {_ACTION} AS action FROM events),
s(user_id, k, status, reason, sent_at, sends) AS (SELECT DISTINCT user_id, 0::BIGINT, 'none', '', NULL::BIGINT, 0::BIGINT FROM e UNION ALL
SELECT user_id, k, CASE WHEN up THEN 'pending' WHEN action = 'confirm' AND status = 'pending' THEN 'active' WHEN action = 'unsubscribe' AND status <> 'none' AND NOT dead THEN 'unsubscribed' WHEN hit THEN 'suppressed' ELSE status END,
  CASE WHEN up THEN '' WHEN hit THEN action ELSE reason END, CASE WHEN sends_now THEN at_us ELSE sent_at END, sends + CASE WHEN sends_now THEN 1 ELSE 0 END
FROM (SELECT *, up AND (sent_at IS NULL OR at_us - sent_at >= 900000000) AS sends_now FROM (SELECT *, action = 'signup' AND NOT dead AND status <> 'active' AS up, action IN ('bounce', 'complaint') AND status NOT IN ('unsubscribed', 'none') AS hit
FROM (SELECT e.user_id, e.k, at_us, action, status, reason, sent_at, sends, status = 'suppressed' AND reason = 'bounce' AS dead FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))))
SELECT user_id, max_by(status, k) AS status, max_by(reason, k) AS reason, max_by(sends, k) AS sends FROM s GROUP BY 1""")
def r4_r5_lifecycle(s, d):
    return subscribers.lifecycle(_actions(s, d), "user_id")


# -- streams over whole tables -----------------------------------------------------------

_STORES, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _until_done(s, writer, folder):
    """Runs a query over all there is, with its checkpoint in a folder of the shared ones."""
    before = s.conf.get(_STORES)
    s.conf.set(_STORES, _ROCKS)
    try:
        query = writer.option("checkpointLocation", f"{folder}/query").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        s.conf.set(_STORES, before)


@query(f"SELECT event_id, user_id, least(in_window, 4) AS in_window, limited FROM ({_limit_sql(86_400, 3)}) JOIN events USING (event_id)")
def r2_limit_stream(s, d):
    """The events as a stream, in one batch."""
    folder = f"{checkpoint_dir(s)}/limits-{uuid.uuid4().hex}"
    events = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*")
    limited = limits.rate_limited_stream(events.select("event_id", "user_id", "ts"), "user_id", 86_400, 3)
    _until_done(s, limited.writeStream.format("parquet").option("path", f"{folder}/rows"), folder)
    return s.read.parquet(f"{folder}/rows")


@query(f"""WITH {LOTS_SQL} SELECT key, greatest(coalesce(have, 0), coalesce(want, 0)) AS n FROM have FULL JOIN want USING (key)""")
def r9_amended_stream(s, d):
    """Filings that are stored come as a stream in three batches, each of a third of the files, so that one filing is in several; then how often each key is there."""
    folder = f"{checkpoint_dir(s)}/amended-{uuid.uuid4().hex}"
    old, new = _lots(s, d)
    amendments.start(old, f"{folder}/store")
    # Each task that makes the rows writes a file for each line number, so nothing is shuffled for it and files are many where rows are.
    new.write.partitionBy("line").parquet(f"{folder}/filed")
    files = len(s.read.schema(new.schema).parquet(f"{folder}/filed").inputFiles())
    filed = s.readStream.schema(new.schema).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(f"{folder}/filed").select(*new.columns)
    _until_done(s, filed.writeStream.foreachBatch(amendments.writer(f"{folder}/store")), folder)
    return amendments.merged(s, f"{folder}/store").groupBy(merging.row_key().alias("key")).agg(F.count("*").alias("n"))
