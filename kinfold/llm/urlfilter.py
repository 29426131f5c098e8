"""URL filters with dated lists, evaluated as of the time of each fetch.

List entries (domain, action, date) become validity intervals: an entry holds
until the next one for its domain, and a ``remove`` entry ends the one before.
Every capture is matched with the entries for its host and the host's parent
domains; those whose interval holds the fetch date are active, and the most
specific one gives the verdict.  DataFrame functions only; the join is an
equi-join on the domain.  A list of up to ``MOST_BROADCAST`` intervals, which
are counted first, is broadcast, so that captures are shuffled once, a row
each; with a longer one the join is shuffled and adaptive execution splits hot
hosts.

Cases: a null or hostless URL, or a null fetch date, matches nothing and is
allowed; several entries for a domain on one date count in the order remove,
allow, block (the last one holds); host names are compared in lower case,
without port, user or a trailing dot; URLs of any length are read whole; columns
may have any name; repeated captures each give a row; an empty table or list gives no row or no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of entries of one domain and date; the last one holds.
ACTIONS = ("remove", "allow", "block")
MOST_BROADCAST = 500_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, HOST, 1)
    return F.lower(F.regexp_replace(host, r"\.$", ""))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (domain, action, valid_from, valid_to) of entries (domain, action, day); ``valid_to`` is exclusive and null if open."""
    order = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    clean = entries.where(F.col("domain").isNotNull() & F.col("day").isNotNull() & (order > 0)).select(F.lower("domain").alias("domain"), "action", "day")
    latest = clean.groupBy("domain", "day").agg(F.max_by("action", order).alias("action"))
    span = latest.select("domain", "action", F.col("day").alias("valid_from"), F.lead("day").over(Window.partitionBy("domain").orderBy("day")).alias("valid_to"))
    return span.where(F.col("action") != "remove")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """Per capture: id, host, fetch day, the domain, action and start of the entry that decides, ``n_active`` and ``verdict``."""
    c = captures.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(host_of(F.col(f"`{url_col}`")), F.lit("")).alias("host"), F.col(f"`{day_col}`").alias("day"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = c.select("id", "host", "day", "__row", F.explode(suffixes).alias("domain"))
    spans = validity(entries)
    if spans.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        spans = F.broadcast(spans)
    active = keyed.join(spans, (keyed["domain"] == spans["domain"]) & (keyed["day"] >= spans["valid_from"]) & (spans["valid_to"].isNull() | (keyed["day"] < spans["valid_to"])), "left")
    hit = F.when(spans["domain"].isNotNull(), F.struct(F.length(spans["domain"]).alias("n"), spans["domain"].alias("domain"), spans["action"].alias("action"), spans["valid_from"].alias("since")))
    best = active.groupBy("__row", "id", "host", "day").agg(F.max(hit).alias("best"), F.count(spans["domain"]).alias("n_active"))
    return best.select("id", "host", F.col("day").alias("fetch_day"), F.col("best.domain").alias("matched_domain"), F.col("best.action").alias("action"), F.col("best.since").alias("active_since"), "n_active", F.when(F.col("best.action") == "block", "block").otherwise("allow").alias("verdict"))
