"""Registry matching and plan normalization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import registry_text


CARD = "/widget/med-product/"


def tokens(query: Column) -> Column:
    """The different words of a query that have two characters or more."""
    return F.filter(F.array_distinct(F.split(registry_text(query), " ")), lambda t: F.length(t) >= 2)


def contains_all(name: Column, words: Column) -> Column:
    """Whether a normalized name contains all tokens, also as parts of words; there must be one."""
    return (F.size(words) > 0) & F.forall(words, lambda t: F.contains(name, t))


def choose(queries: DataFrame, answers: DataFrame, base_url: str = "") -> DataFrame:
    """(query, status, registration, name, card): what the records that a search answered with say about each query.

    answers: (query, id, registration, name, active). Of the active records those whose names contain all tokens count, or all of them if
    none does: one is FOUND, several are AMBIGUOUS; without an active one the same holds of the inactive ones: one is EXPIRED, several
    are AMBIGUOUS; a query without records is NOT_FOUND. Registrations have single blanks."""
    q = queries.select("query").distinct()
    exact = contains_all(registry_text(F.col("name")), tokens(F.col("query")))
    a = answers.select("query", "id", "registration", "name", F.coalesce("active", F.lit(False)).alias("active"), F.coalesce(exact, F.lit(False)).alias("exact"))
    record = F.struct("id", "registration", "name")
    per = a.groupBy("query", "active").agg(F.count(F.lit(1)).alias("all"), F.count_if("exact").alias("n"), F.max(record).alias("any"), F.max(F.when(F.col("exact"), record)).alias("best"))
    per = per.select("query", "active", F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("all")).alias("n"), F.coalesce("best", "any").alias("r"))
    return _decide(q, per, base_url)


def _decide(q: DataFrame, per: DataFrame, base_url: str) -> DataFrame:
    """What choose returns for queries q, from (query, active, n, r): how many records count, and one of them."""
    both = per.groupBy("query").agg(F.max(F.when(F.col("active"), F.struct("n", "r"))).alias("live"), F.max(F.when(~F.col("active"), F.struct("n", "r"))).alias("old"))
    one, used = F.coalesce("live", "old"), F.when(F.col("live").isNotNull(), "FOUND").otherwise("EXPIRED")
    status = F.when(one.isNull(), "NOT_FOUND").when(one["n"] == 1, used).otherwise("AMBIGUOUS")
    r = F.when(one["n"] == 1, one["r"])
    return q.join(both, "query", "left").select("query", status.alias("status"), F.btrim(F.regexp_replace(r["registration"], r"\s+", " ")).alias("registration"), r["name"].alias("name"), F.concat(F.lit(base_url + CARD), r["id"].cast("string")).alias("card"))


def search(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """(query, id, registration, name, active): the records of a registry table whose names contain all of a query's tokens.

    Candidates are joined by one gram of the query's longest token, of 3 characters or else the token of 2, that the fewest names
    have; the names are then searched for all tokens. Equal queries are looked up once."""
    q = queries.select("query").distinct().withColumn("tokens", tokens(F.col("query")))
    longest = F.element_at(F.array_sort(F.transform("tokens", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"]
    named = registry.select("id", "registration", "name", "active", registry_text(F.col("name")).alias("words"))
    by_gram = named.select("*", F.explode(F.array_distinct(F.concat(_grams(F.col("words"), 2), _grams(F.col("words"), 3)))).alias("key"))
    grams = q.where(F.size("tokens") > 0).select("query", "tokens", F.explode(_grams(longest, F.least(F.length(longest), F.lit(3)))).alias("key"))
    met = by_gram.groupBy("key").agg(F.count(F.lit(1)).alias("names"))
    rarest = grams.join(_shuffled(met), "key", "left").groupBy("query", "tokens").agg(F.min_by("key", F.struct(F.coalesce("names", F.lit(0)), "key")).alias("key"))
    return rarest.join(_shuffled(by_gram), "key").where(contains_all(F.col("words"), F.col("tokens"))).select("query", "id", "registration", "name", "active")


def lookup(queries: DataFrame, registry: DataFrame, base_url: str = "") -> DataFrame:
    """As choose, with a registry table in place of the search service; the result is that of choose on all that search finds.

    The records that answer a query are counted, not listed: queries with equal tokens are looked up once, and of the records that hold
    the same of all queries' tokens only their number and the greatest are kept. Sets of tokens meet these by the token that the
    fewest of them hold."""
    q = queries.select("query").distinct().withColumn("tokens", F.array_sort(tokens(F.col("query"))))
    sets = q.where(F.size("tokens") > 0).select("tokens").distinct()
    held = _by_tokens(registry, sets.select(F.explode("tokens").alias("token")).distinct())
    by_token = held.select("held", "active", "n", "r", F.explode("held").alias("token"))
    often = by_token.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    # a token that no record holds has no count, and its sets no answer
    rarest = sets.select("tokens", F.explode("tokens").alias("token")).join(_shuffled(often), "token", "left").groupBy("tokens").agg(F.min_by("token", F.struct(F.coalesce("often", F.lit(0)), "token")).alias("token"))
    met = rarest.join(_shuffled(by_token), "token").where(F.forall("tokens", lambda t: F.array_contains(F.col("held"), t)))
    per = met.groupBy("tokens", "active").agg(F.sum("n").alias("n"), F.max("r").alias("r"))
    return _decide(_shuffled(q.select("query")), q.join(_shuffled(per), "tokens").select("query", "active", "n", "r"), base_url)


def _by_tokens(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """(held, active, n, r): for the records whose names hold the same of the wanted tokens, and one at least, which these are, how many
    records there are, and the greatest of them. Tokens have no blanks, so that one is in a name if it is in one of its words."""
    record = F.struct("id", "registration", "name")
    named = registry.select(registry_text(F.col("name")).alias("words"), F.coalesce("active", F.lit(False)).alias("active"), record.alias("r")).where("words is not null")
    named = named.groupBy("words", "active").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"))
    word = F.explode(F.split("words", " ")).alias("word")
    by_gram = named.select(word).distinct().select("word", F.explode(F.array_distinct(F.concat(_grams(F.col("word"), 2), _grams(F.col("word"), 3)))).alias("key"))
    grams = wanted.select("token", F.explode(_grams(F.col("token"), F.least(F.length("token"), F.lit(3)))).alias("key"))
    common = by_gram.groupBy("key").agg(F.count(F.lit(1)).alias("words"))
    rarest = grams.join(_shuffled(common), "key").groupBy("token").agg(F.min_by("key", F.struct("words", "key")).alias("key"))
    holds = rarest.join(_shuffled(by_gram), "key").where(F.contains(F.col("word"), F.col("token"))).select("word", "token")
    held = named.select("words", "active", "n", "r", word).join(_shuffled(holds), "word").groupBy("words", "active").agg(F.array_sort(F.collect_set("token")).alias("held"), F.first("n").alias("n"), F.first("r").alias("r"))
    return held.groupBy("held", "active").agg(F.sum("n").alias("n"), F.max("r").alias("r"))


def expiry_notice(status: Column, expires: Column) -> Column:
    """Of an expired registration: that it is, and since when if that is known; else null."""
    since = F.concat(F.lit("Просрочено с "), F.date_format(expires, "dd.MM.yyyy"))
    return F.when(status == "EXPIRED", F.coalesce(since, F.lit("Просрочено")))


def enrich_rows(rows: DataFrame, found: DataFrame, plan: str = "plan") -> DataFrame:
    """Rows of plans with the registration of their plan's lookup (plan, status, registration, expires) where it is FOUND or EXPIRED, and the
    notice of an expired one in registrationNumberExpiryNotice; the rows of other plans keep what they have."""
    known = found.where(F.col("status").isin("FOUND", "EXPIRED")).select(F.col(plan).alias("known_plan"), F.col("registration").alias("known_number"), expiry_notice(F.col("status"), F.col("expires")).alias("known_notice"))
    joined = rows.join(known, F.col(plan) == F.col("known_plan"), "left")
    names = [c for c in rows.columns if c not in ("registrationNumber", "registrationNumberExpiryNotice")]
    before = F.col("registrationNumber") if "registrationNumber" in rows.columns else F.lit(None).cast("string")
    return joined.select(*names, F.when(F.col("known_plan").isNotNull(), F.col("known_number")).otherwise(before).alias("registrationNumber"), F.col("known_notice").alias("registrationNumberExpiryNotice"))


def _shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that is to be shuffled, never sent to the driver: Spark takes tables of parts of texts for as small as the texts'
    file, as it doesn't see how many rows come from one."""
    return side.hint("merge")


def _grams(text: Column, n: Column | int) -> Column:
    """The parts of n characters of a text."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def renumber(rows: DataFrame, plan: str, number: str) -> DataFrame:
    """Add new_number 1 .. n in the order of `number` within each plan, and whether the plan is valid (no number twice)."""
    from pyspark.sql import Window

    w = Window.partitionBy(plan)
    counted = rows.withColumn("new_number", F.row_number().over(w.orderBy(number))).withColumn("__twice", F.count(F.lit(1)).over(Window.partitionBy(plan, number)) > 1)
    return counted.withColumn("valid", ~F.max("__twice").over(w)).drop("__twice")


def remap_links(links: DataFrame, numbered: DataFrame, plan: str, number: str) -> DataFrame:
    """Replace the row numbers that consumables (plan, item, number) relate to; a plan with a dangling link is invalid."""
    joined = links.join(numbered.select(plan, number, "new_number"), [plan, number], "left")
    return joined.groupBy(plan, "item").agg(F.array_sort(F.collect_set("new_number")).alias("related"), (F.count_if(F.col("new_number").isNull()) == 0).alias("valid"))
