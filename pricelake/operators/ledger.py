"""Submission ledger: history caps, reputation, stakes, registry, USD prices, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricelake.functions import decimals as D
from pricelake.operators.chunks import CHUNK_ROWS, running, top_per_key

# Fixed values of the ledger rules.
HISTORY_CAP = 100
RING_SIZE = 200
ACCURACY_BPS = 2000
DECAY_SECONDS = 604800
DECAY_MAX_PERIODS = 40
DECAY_NUMERATOR, DECAY_DENOMINATOR = 95, 100
FULL_SCORE = 10000


def with_previous(
    df: DataFrame, keys: list[str], position: str, value: str, size: int = CHUNK_ROWS, shared: bool = False
) -> DataFrame:
    """Add `prev`: the value of the preceding row of the key."""
    return running(df, keys, position, {"prev": ("last", F.col(value))}, size, exclusive=["prev"], shared=shared)


def price_history_cap(submissions: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """The newest `cap` submissions per asset."""
    return top_per_key(submissions, ["asset"], [F.col("seq").desc()], cap)


def history_last_n(submissions: DataFrame, n: int, cap: int = HISTORY_CAP) -> DataFrame:
    """The last n of the capped history per asset (0 gives none)."""
    return price_history_cap(submissions, min(n, cap)) if n > 0 else submissions.limit(0)


def ring_buffer(messages: DataFrame, size: int = RING_SIZE) -> DataFrame:
    return top_per_key(messages, ["asset"], [F.col("seq").desc()], size)


def replay_since(messages: DataFrame, since: int, assets: list[str], size: int = RING_SIZE) -> DataFrame:
    """Buffered messages of the assets after `since`, in sequence order."""
    wanted = messages.filter(F.col("asset").isin(*assets))
    return ring_buffer(wanted, size).filter(F.col("seq") > since).orderBy("seq")


def reputation(submissions: DataFrame, *, limit_bps: int = ACCURACY_BPS, size: int = CHUNK_ROWS) -> DataFrame:
    """Running score per source: share of submissions near the asset's previous price.

    A move outside 38 digits cannot be near and counts as inaccurate.
    """
    seen = with_previous(submissions, ["asset"], "seq", "price", size, shared=True)
    far = F.coalesce(D.deviation_exceeds(F.col("price"), F.col("prev"), limit_bps), F.lit(True))
    seen = seen.withColumn("accurate", F.col("prev").isNull() | ~far)
    scored = running(seen, ["source"], "seq", {
        "total_submissions": ("sum", F.lit(1).cast("bigint")),
        "accurate_submissions": ("sum", F.col("accurate").cast("bigint")),
    }, size)
    return scored.withColumn("score", F.expr(f"accurate_submissions * {FULL_SCORE} div total_submissions"))


def reputation_decay(latest: DataFrame, *, now: Column) -> DataFrame:
    """Score after the idle time since `last_updated`, floored every period."""
    idle = F.floor((now - F.col("last_updated")) / DECAY_SECONDS)
    periods = F.greatest(F.least(idle, F.lit(DECAY_MAX_PERIODS)), F.lit(0)).cast("int")
    step = lambda s, _: F.floor(s * DECAY_NUMERATOR / DECAY_DENOMINATOR).cast("bigint")
    decayed = F.aggregate(F.sequence(F.lit(1), periods), F.col("score").cast("bigint"), step)
    return latest.withColumns({
        "periods": periods,
        "decayed_score": F.when(periods > 0, decayed).otherwise(F.col("score").cast("bigint")),
    })


def stake_balance(log: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Balance after every stake or slash; a slash takes at most what is there.

    With S the running sum of signed amounts the balance is S - min(0, min S so
    far). Amounts must be positive; other rows are left out (see bad_stakes).
    """
    good = log.filter(F.col("amount") > 0)
    slash = F.col("kind") == "slash"
    signed = F.when(slash, F.lit(0).cast(D.WIDE) - F.col("amount")).otherwise(F.col("amount").cast(D.WIDE))
    signed = signed.cast("decimal(28,0)")
    out = running(good, ["source"], "seq", {
        "__s": ("sum", signed), "__low": ("low", signed), "slash_count": ("sum", slash.cast("bigint"))}, size)
    floor = F.least(F.col("__low").cast(D.WIDE), F.lit(0).cast(D.WIDE))
    return out.withColumn("balance", (F.col("__s") - floor).cast(D.WIDE)).drop("__s", "__low")


def bad_stakes(log: DataFrame) -> DataFrame:
    return log.filter(~F.coalesce(F.col("amount") > 0, F.lit(False)))


def source_registry(log: DataFrame) -> DataFrame:
    """Registered sources after an add/remove log, with the name of the first add
    since the last removal."""
    removed = log.filter("kind = 'remove'").groupBy("source").agg(F.max("seq").alias("__gone"))
    adds = log.filter("kind = 'add'").join(removed, "source", "left")
    adds = adds.filter(F.col("seq") > F.coalesce("__gone", F.lit(-1)))
    return top_per_key(adds, ["source"], [F.col("seq").asc()], 1).select(
        "source", "name", F.col("seq").alias("registered_seq"))


def authorized_filter(submissions: DataFrame, registry: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Submissions whose source was registered when they arrived.

    The last registry event before a submission decides: an as-of join done as a
    running value over both logs, so a busy source stays spread over chunks.
    """
    marks = registry.select("source", (F.col("seq") * 2).alias("__pos"), (F.col("kind") == "add").alias("__on"))
    rows = submissions.withColumn("__pos", F.col("seq") * 2 + 1)
    both = rows.unionByName(marks, allowMissingColumns=True)
    known = running(both, ["source"], "__pos", {"__auth": ("last", F.col("__on"))}, 2 * size)
    return known.filter(F.col("__on").isNull() & F.coalesce("__auth", F.lit(False))).drop("__pos", "__on", "__auth")


def usd_anchors(latest: DataFrame) -> DataFrame:
    """Newest price of the two anchor assets, in one row."""
    pick = lambda asset, c: F.max(F.when(F.col("asset") == asset, F.col(c)))
    return latest.agg(
        pick("XLM", "price").alias("xlm_price"), pick("XLM", "decimals").alias("xlm_decimals"),
        pick("USDC", "price").alias("usdc_price"), pick("USDC", "decimals").alias("usdc_decimals"))


def usd_price(latest: DataFrame) -> DataFrame:
    """USD price per asset; null when an anchor is missing or 38 digits do not suffice."""
    anchors = usd_anchors(latest)
    xlm = anchors.select("xlm_price").scalar()
    usdc_decimals = anchors.select("usdc_decimals").scalar()
    value = D.whole_div(F.try_multiply(F.col("price"), xlm).cast(D.WIDE), D.pow10(usdc_decimals))
    return latest.withColumn(
        "price_usd",
        F.when(F.col("asset") == "XLM", F.col("price"))
        .when(usdc_decimals.isNull(), F.lit(None).cast(D.WIDE))
        .when(F.col("asset") == "USDC", D.pow10(F.col("decimals")))
        .when(xlm.isNotNull(), value))


def onchain_price_view(latest: DataFrame, *, num_sources: Column, trusted: list[str]) -> DataFrame:
    return usd_price(latest).withColumns({
        "num_sources": num_sources, "is_trusted": F.col("asset").isin(*trusted)})


def vote_tally(votes: DataFrame, proposals: DataFrame, *, now: Column, quorum: int, timelock: int) -> DataFrame:
    """Outcome per proposal: first vote per voter inside [start, end), weighted by power."""
    inside = votes.join(proposals, "proposal").filter(
        (F.col("ts") >= F.col("voting_start")) & (F.col("ts") < F.col("voting_end")))
    first = inside.groupBy("proposal", "voter").agg(
        F.min_by("support", "seq").alias("support"), F.min_by("power", "seq").alias("power"))
    tally = first.groupBy("proposal").agg(
        F.sum(F.when(F.col("support"), F.col("power")).otherwise(0)).alias("votes_for"),
        F.sum(F.when(~F.col("support"), F.col("power")).otherwise(0)).alias("votes_against"))
    out = proposals.join(tally, "proposal", "left").withColumns({
        "votes_for": F.coalesce("votes_for", F.lit(0)), "votes_against": F.coalesce("votes_against", F.lit(0))})
    passed = (F.col("votes_for") + F.col("votes_against") >= quorum) & (F.col("votes_for") > F.col("votes_against"))
    closed = now >= F.col("voting_end")
    return out.withColumns({
        "status": F.when(~closed, "Active").when(passed, "Queued").otherwise("Defeated"),
        "execution_time": F.when(closed & passed, F.col("voting_end") + timelock),
    })
