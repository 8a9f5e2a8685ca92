"""State that is kept between runs: a cache of answers, a crawl that goes on where it stopped, and leases that are closed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import checkpointed
from .ledger import latest_state, stale, upsert

CRAWL = "node string, depth int, state string, attempts int"


def address(columns: list[str]) -> Column:
    """The content address of a request: a hash of its columns as JSON, nulls too, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def cached(requests: DataFrame, by: list[str], cache: DataFrame, release: str, now: Column, max_age_seconds: int, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``requests`` with ``(address, outcome, result)``, and the cache ``(address, release, result, fetched_at)`` as it is then.

    HIT: an answer of this release that is young enough; STALE: one that is too old; MISS: none, or of
    another release only. What is not hit is fetched once for each address: ``fetch(address, *by)`` gives ``(address, result)``. Answers of other releases stay.
    """
    asked = requests.withColumn("address", address(by))
    pinned = cache.where(F.col("release") == release).select("address", F.col("result").alias("_kept"), (F.unix_timestamp(now) - F.unix_timestamp("fetched_at") <= max_age_seconds).alias("_fresh"))
    looked = asked.join(pinned, "address", "left").withColumn("outcome", F.when(F.col("_fresh"), "HIT").when(F.col("_fresh").isNotNull(), "STALE").otherwise("MISS"))
    wanted = looked.where("outcome <> 'HIT'").select("address", *by).dropDuplicates(["address"])
    fetched = checkpointed(fetch(wanted).select("address", F.col("result").alias("_new")))
    answers = looked.join(fetched, "address", "left").select(*requests.columns, "address", "outcome", F.when(F.col("outcome") == "HIT", F.col("_kept")).otherwise(F.col("_new")).alias("result"))
    new = fetched.select("address", F.lit(release).alias("release"), F.col("_new").alias("result"), now.alias("fetched_at"))
    return answers, upsert(cache, new, ["address", "release"]).select("address", "release", "result", "fetched_at")


def seeded(seeds: DataFrame) -> DataFrame:
    """A frontier of ``seeds(node)`` that are still to be read."""
    return seeds.select(F.col("node").cast("string"), F.lit(0).alias("depth"), F.lit("pending").alias("state"), F.lit(0).alias("attempts")).distinct()


def crawl(frontier: DataFrame, fetch: Callable[[DataFrame], DataFrame], steps: int | None = None, most_attempts: int = 3) -> DataFrame:
    """The frontier ``(node, depth, state, attempts)`` after so many steps, or, without a number, when nothing is pending.

    A step reads all pending nodes at once: ``fetch(node, attempts)`` gives ``(node, ok, children)``. A node that is read is done and its
    children, if new, are pending; one that fails is tried again, and is an error after ``most_attempts``. A node that fetch does not return has failed.
    Every step is checkpointed. What is returned can be written and handed in again: the crawl goes on where it stopped.
    """
    frontier, step = checkpointed(frontier), 0
    while (steps is None or step < steps) and frontier.where("state = 'pending'").head(1):
        step += 1
        pending = frontier.where("state = 'pending'")
        read = checkpointed(fetch(pending.select("node", "attempts")).select("node", F.col("ok").alias("_ok"), F.col("children").alias("_children")))
        tried = pending.join(read, "node", "left").withColumn("attempts", F.col("attempts") + 1)
        state = F.when(F.coalesce("_ok", F.lit(False)), "done").when(F.col("attempts") < most_attempts, "pending").otherwise("error")
        settled = tried.select("node", "depth", state.alias("state"), "attempts")
        children = tried.where("_ok").select(F.explode("_children").alias("node"), (F.col("depth") + 1).alias("depth")).groupBy("node").agg(F.min("depth").alias("depth"))
        new = children.join(frontier.select("node"), "node", "left_anti").select("node", "depth", F.lit("pending").alias("state"), F.lit(0).alias("attempts"))
        frontier = checkpointed(frontier.where("state <> 'pending'").unionByName(settled).unionByName(new))
    return frontier


def progress(frontier: DataFrame) -> DataFrame:
    """``(state, n, percent)`` of a frontier."""
    counted = frontier.groupBy("state").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.crossJoin(F.broadcast(total)).select("state", "n", F.round(F.col("n") * 100 / F.col("total"), 1).alias("percent"))


def closing_events(events: DataFrame, key: str, event_id: str, state: str, at: str, open_state: str, now: Column, lease_seconds: int, closed: str = "UNKNOWN") -> DataFrame:
    """The events that close leases that have run out: ``(transaction_id, key, state, at, closes)``.

    A transaction id is a hash of the key and the event that is closed, so the same closing has the same id however
    often it is made; with the events appended, a second run makes none, as the last state is closed then.
    """
    last = latest_state(events, key, state, [at, event_id])
    late = stale(last, open_state, at, now, lease_seconds)
    name = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col(event_id).cast("string"), F.lit(closed)).cast("binary"), 256)
    return late.select(name.alias("transaction_id"), key, F.lit(closed).alias("state"), now.alias("at"), F.col(event_id).alias("closes"))


def append_once(log: DataFrame, new: DataFrame, transaction: str = "transaction_id") -> DataFrame:
    """``log`` with those of ``new`` whose transaction it does not hold, each once."""
    return log.unionByName(new.dropDuplicates([transaction]).join(log.select(transaction), transaction, "left_anti").select(*log.columns))
