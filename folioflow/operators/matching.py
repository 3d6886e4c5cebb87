"""Joins that carry the rules of the domain: as-of, reconciliation, promises, anti-joins and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import brackets
from folioflow.operators.rollups import n_if, total


def as_of(tx: DataFrame, filings: DataFrame, key: str) -> DataFrame:
    """For each transaction the earliest filing of its key on or after its date, or else the key's latest.

    filings: key, date, ordinal, url, label; those with neither a url nor a label don't count; of filings on one date
    the first by ordinal is taken. The answer depends on a transaction's key and date alone, so it is found once for
    each pair that occurs, in one linear pass over a key's days, and joined to the transactions by that pair: a key
    with very many transactions is dealt out by date. A transaction without a date gets the latest.
    """
    known = filings.filter((F.coalesce("url", F.lit("")) != "") | (F.coalesce("label", F.lit("")) != ""))
    filed = known.groupBy(key, "date").agg(F.min("ordinal").alias("ordinal"))
    asked = tx.select(key, "date").distinct().withColumn("ordinal", F.lit(None).cast(filed.schema["ordinal"].dataType))
    days = filed.unionByName(asked).groupBy(key, "date").agg(F.max("ordinal").alias("ordinal"))
    newest_first = Window.partitionBy(key).orderBy(F.desc("date"))
    so_far = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = newest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = F.when(F.col("date").isNotNull(), F.last("ordinal", ignorenulls=True).over(so_far))
    answers = days.select(F.col(key).alias("__key"), F.col("date").alias("__date"), F.coalesce(ahead, F.first("ordinal", ignorenulls=True).over(whole)).alias("filing_ordinal"))
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col("date").eqNullSafe(F.col("__date"))
    return tx.join(answers, same, "left").drop("__key", "__date")


def reconcile(holdings: DataFrame, sales: DataFrame, exempt: tuple[str, ...]) -> DataFrame:
    """Held and sold tickers side by side with a status: exempt first, then sold, then no sale on file."""
    held = holdings.filter(F.coalesce("ticker", F.lit("")) != "").groupBy("ticker").agg(F.min_by("description", "ordinal").alias("held_as"), total(F.col("value")).alias("entry_value"))
    sold = sales.filter(F.coalesce("ticker", F.lit("")) != "").groupBy("ticker").agg(F.count("*").alias("sales"))
    both = held.join(sold, "ticker", "full_outer")
    n = F.coalesce("sales", F.lit(0)).cast("long")
    status = F.when(F.col("ticker").isin(*exempt), "exempt").when(n > 0, "sold").otherwise("no-sale-on-file")
    note = (
        F.when(F.col("ticker").isin(*exempt), "exempt from reporting")
        .when((n > 0) & F.col("held_as").isNotNull(), F.concat(n.cast("string"), F.when(n == 1, " sale on file").otherwise(" sales on file")))
        .when(n > 0, "sold, not among the parsed entries")
        .otherwise("no sale on file")
    )
    return both.select("ticker", F.coalesce("held_as", F.concat(F.lit("Sold ("), "ticker", F.lit(")"))).alias("description"), n.alias("sales"), status.alias("status"), note.alias("note"), F.coalesce("entry_value", F.lit(0)).cast("long").alias("entry_value"))


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))))


#: Bytes up to which the runs that needles ask for are broadcast, after their size was asked.
BROADCAST_BYTES = 8 << 20


def _broadcast_if_small(df: DataFrame, *cols: str) -> DataFrame:
    size = sum((F.octet_length(F.col(c).cast("string")) for c in cols), F.lit(32))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def texts_with_tokens(texts: DataFrame, needles: DataFrame, gram: int = 3) -> DataFrame:
    """description, needle_id for every text that contains all tokens of a needle, whatever the case.

    texts: description, each once. needles: needle_id, tokens. They meet in an equi-join on the needle's rarest run of
    gram characters (fewer, where it has no longer token), and the tokens are tested after it. Runs are of the lengths
    that needles need, and go with a text's hash alone; only texts that have a needle's rarest run are fetched by it. A needle
    without tokens, or with an empty one alone, fits nothing.
    """
    low = needles.select("needle_id", F.transform("tokens", F.lower).alias("tokens"))
    longest = F.array_max(F.transform("tokens", lambda t: F.length(t)))
    low = low.withColumn("n", F.least(F.lit(gram), longest)).filter("n > 0")
    sized = lambda c: F.array_distinct(F.flatten(F.array_compact(F.transform("tokens", lambda t: _grams(t, c)))))
    own = F.coalesce(*(F.when(F.col("n") == k, sized(k)) for k in range(1, gram + 1)))
    asked = low.withColumn("gram", F.explode(own))
    lengths = sorted(r[0] for r in low.select("n").distinct().collect())
    hashed = texts.filter("description IS NOT NULL").select("description", F.xxhash64("description").alias("__h"))
    held = F.flatten(F.array_compact(F.array(*(_grams(F.lower("description"), k) for k in lengths)))) if lengths else F.array().cast("array<string>")
    postings = hashed.select("__h", F.explode(held).alias("gram"))
    often = postings.select("gram").join(_broadcast_if_small(asked.select("gram").distinct(), "gram"), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("often"))
    rarest = asked.join(often, "gram", "left").groupBy("needle_id", "tokens").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))
    candidates = postings.join(_broadcast_if_small(rarest.select("needle_id", "gram"), "needle_id", "gram"), "gram").select("__h", "needle_id").distinct()
    wanted = _broadcast_if_small(candidates.select("__h").distinct(), "__h")
    fetched = hashed.join(wanted, "__h", "left_semi").join(candidates, "__h").join(rarest.select("needle_id", "tokens"), "needle_id")
    return fetched.filter(F.expr("forall(tokens, t -> contains(lower(description), t))")).select("description", "needle_id")


def promise_evidence(promises: DataFrame, sales: DataFrame, key: list[str]) -> DataFrame:
    """For each promise the sales on or after its date whose ticker it lists, or whose description has all its tokens.

    promises: promise_id, confirmed, tickers, tokens. Each sale takes the promises of its ticker and those that its
    description fits, which distinct descriptions are asked for; found both ways it counts once.
    """
    one = F.struct("promise_id", "confirmed")
    by_ticker = promises.select(one.alias("p"), F.explode("tickers").alias("ticker")).groupBy("ticker").agg(F.collect_set("p").alias("by_ticker"))
    fits = texts_with_tokens(sales.select("description").distinct(), promises.select(F.col("promise_id").alias("needle_id"), "tokens"))
    named = fits.join(promises.select(F.col("promise_id").alias("needle_id"), one.alias("p")), "needle_id")
    by_text = named.groupBy("description").agg(F.collect_set("p").alias("by_text"))
    none = F.array().cast(by_text.schema["by_text"].dataType)
    met = sales.join(by_ticker, "ticker", "left").join(by_text, "description", "left")
    hits = met.select(*key, "date", "amount", F.explode(F.array_union(F.coalesce("by_ticker", none), F.coalesce("by_text", none))).alias("p")).filter(F.col("date") >= F.col("p.confirmed"))
    per = hits.groupBy("p.promise_id").agg(F.count("*").alias("sales"), F.min("date").alias("first_sale"), F.max("date").alias("last_sale"), total(brackets.midpoint(F.col("amount"))).alias("value"))
    out = promises.select("promise_id").join(per, "promise_id", "left")
    n = F.coalesce("sales", F.lit(0)).cast("long")
    return out.select("promise_id", n.alias("sales"), "first_sale", "last_sale", F.coalesce("value", F.lit(0)).cast("long").alias("value"), F.when(n > 0, "sales-on-file").otherwise("no-sales-on-file").alias("status"))


def unknown_rows(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows with a key that the known ones don't have; rows without a key are left out."""
    return rows.filter(F.col(key).isNotNull()).join(known.select(key).distinct(), key, "left_anti")


def routed(recipients: DataFrame, slugs: DataFrame) -> DataFrame:
    """Recipients that follow all, and those that follow one of the slugs."""
    everyone = recipients.filter("slug IS NULL")
    return everyone.unionByName(recipients.join(slugs.select("slug").distinct(), "slug", "left_semi").select(*everyone.columns))


def merged_documents(documents: DataFrame, filings: DataFrame) -> DataFrame:
    """Documents, and those filings whose url no document has."""
    more = filings.join(documents.select("url").filter("url IS NOT NULL").distinct(), "url", "left_anti")
    return documents.select("owner", "url", "date", F.lit("document").alias("origin")).unionByName(more.select("owner", "url", "date", F.lit("filing").alias("origin")))


def golden_score(golden: DataFrame, rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """For each golden row the first row with its key: whether there is one, and how many fields agree.

    Each row is shuffled once, by its key: asking first whether a golden row has it would shuffle the rows and the golden keys besides.
    """
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*fields), "ordinal").alias("found"))
    agree = sum((F.when(F.col(f"g.{f}").eqNullSafe(F.col(f"r.found.{f}")), 1).otherwise(0) for f in fields), F.lit(0))
    same = " AND ".join(f"g.{k} <=> r.{k}" for k in key)
    there = F.col("r.found").isNotNull()
    return golden.alias("g").join(first.alias("r"), F.expr(same), "left").select("g.golden_id", there.alias("present"), F.when(there, agree).otherwise(0).cast("long").alias("agreeing"))


def golden_accuracy(scored: DataFrame, counts: DataFrame, group: str, fields: int, threshold: int = 95) -> DataFrame:
    """Each group's share of agreeing fields in percent, and whether it reaches the threshold.

    scored: group, present, agreeing. counts: group, n, the rows there are. A golden row that isn't found has no field that
    agrees; a group without golden fields is all right; a count of rows that differs is told, and fails nothing.
    """
    per = scored.groupBy(group).agg(F.count("*").alias("golden"), n_if(F.col("present")).alias("present"), total(F.col("agreeing")).alias("agreeing"))
    asked = F.col("golden") * fields
    percent = F.when(asked > 0, F.col("agreeing") * 100.0 / asked).otherwise(100.0)
    passed = F.when(asked > 0, F.col("agreeing") * 100 >= asked * threshold).otherwise(True)
    differs = F.coalesce(F.col("n"), F.lit(0)) != F.col("golden")
    return per.join(counts.select(group, "n"), group, "left").select(group, "golden", "present", "agreeing", F.round(percent, 1).alias("accuracy"), passed.alias("passed"), differs.alias("count_differs"))


def positional(first: DataFrame, second: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Two parses of one group compared row by row: equal rows, different ones, and those that one side lacks."""
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    both = first.alias("a").join(second.alias("b"), [group, "pos"], "full_outer")
    there = F.col(f"a.{fields[0]}").isNotNull() & F.col(f"b.{fields[0]}").isNotNull()
    return both.groupBy(group).agg(n_if(there & same).alias("equal"), n_if(there & ~same).alias("different"), n_if(~there).alias("unpaired"))


def compared_sets(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Matches, missing and extra keys of two sets."""
    both = first.select(key).distinct().withColumn("in_a", F.lit(True)).join(second.select(key).distinct().withColumn("in_b", F.lit(True)), key, "full_outer")
    a, b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(n_if(a & b).alias("matches"), n_if(a & ~b).alias("missing"), n_if(~a & b).alias("extra"))


def count_status(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Counts of two sources side by side, and what their difference is called."""
    both = ours.groupBy(key).agg(F.count("*").alias("ours")).join(theirs.groupBy(key).agg(F.count("*").alias("theirs")), key, "full_outer")
    a, b = (F.coalesce(c, F.lit(0)).cast("long") for c in ("ours", "theirs"))
    status = F.when(a == b, "Match").when(b == 0, "They're missing it").when(a == 0, "We're missing it").when(a > b, "We have more").otherwise("They have more")
    return both.select(key, a.alias("ours"), b.alias("theirs"), status.alias("status"))


def career_events(people: DataFrame, near_days: int = 7, cooling_days: int = 90) -> DataFrame:
    """Dated events of each person; an agreement close to the confirmation is left out, its deadline follows it."""
    events = people.select(
        "official_id",
        "confirmed",
        F.expr(f"stack(4, 'confirmed', confirmed, 'took office', took_office, 'agreement', agreed, 'deadline', date_add(agreed, {cooling_days}))").alias("event", "date"),
    )
    near = F.col("event").eqNullSafe("agreement") & F.coalesce(F.abs(F.datediff("date", "confirmed")) <= near_days, F.lit(False))
    return events.filter(F.col("date").isNotNull() & ~near).select("official_id", "event", "date")


def latest_per_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, the new one's where both have it."""
    ranked = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    return ranked.groupBy(key).agg(F.max_by(F.struct(*[c for c in old.columns if c != key]), "__age").alias("__r")).select(key, "__r.*")
