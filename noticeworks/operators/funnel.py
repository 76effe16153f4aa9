"""Hard filters between providers and tenders, and how many tenders pass each.

One provider profile is the special case of a one-row provider table. Matching
by code is an equi-join of exploded codes. No side is hinted for broadcast:
Spark picks that from measured sizes, and otherwise splits the partitions of a
code that many tenders share. Counts and pages leave no pairs at all: see `blocks`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.functions import codes
from noticeworks.operators import blocks

OPEN = "open_for_submission"


def still_biddable(as_of: Column) -> Column:
    """Open status and a deadline that has not passed; no deadline does not count."""
    return (F.col("status") == OPEN) & (F.col("submission_deadline") >= as_of)


def budget_fits(budget: Column, low: Column, high: Column) -> Column:
    """Each bound is optional; a missing budget fails as soon as one bound is set."""
    return F.coalesce(
        (low.isNull() | (budget >= low)) & (high.isNull() | (budget <= high)), F.lit(False)
    )


def location_fits(location: Column, allowed: Column) -> Column:
    """No list or an empty list means no restriction."""
    unrestricted = F.coalesce(F.size(allowed), F.lit(0)) <= 0
    return F.coalesce(unrestricted | F.array_contains(allowed, location), F.lit(False))


ANYWHERE = "*"


def _open_by_code(tenders: DataFrame, as_of: Column) -> DataFrame:
    """Biddable tenders, one row per normalized code."""
    return (
        tenders.filter(still_biddable(as_of))
        .withColumn("codes", codes.normalize_codes(F.col("cpv_codes")))
        .withColumn("code", F.explode("codes"))
    )


def _profiles_by_code(providers: DataFrame) -> DataFrame:
    """Providers, one row per normalized code; their columns are prefixed with `p_`."""
    return providers.select(
        "provider_id",
        codes.normalize_codes(F.col("cpv_codes")).alias("p_codes"),
        *[
            F.col(c).alias(f"p_{c}")
            for c in providers.columns
            if c not in ("provider_id", "cpv_codes", "codes")
        ],
    ).withColumn("p_code", F.explode("p_codes"))


def _on_first_shared_code() -> Column:
    """A pair that shares several codes meets on each; it is kept on the smallest.

    A row can decide that by itself, so no shuffle is spent on duplicates.
    """
    shared = F.array_min(F.array_intersect("codes", "p_codes"))
    return (F.col("code") == F.col("p_code")) & (shared == F.col("code"))


def fits_budget() -> Column:
    return budget_fits(F.col("budget_with_vat"), F.col("p_min_budget"), F.col("p_max_budget"))


def fits_location() -> Column:
    return location_fits(F.col("location"), F.col("p_locations"))


def candidate_pairs(tenders: DataFrame, providers: DataFrame, as_of: Column) -> DataFrame:
    """Provider and tender pairs that pass every hard filter.

    The place is part of the join key: a tender stands under its own place and
    under "anywhere", a provider under each place it accepts, or under
    "anywhere" if it accepts all. A code that very many share is thereby spread
    over the places, and pairs in a wrong place never meet.
    """
    placed = _open_by_code(tenders, as_of).withColumn(
        "place",
        F.explode(F.array_compact(F.array(F.lit(ANYWHERE), F.concat(F.lit("="), "location")))),
    )
    restricted = F.transform(
        F.array_distinct("p_locations"), lambda place: F.concat(F.lit("="), place)
    )
    accepted = F.when(F.size("p_locations") > 0, restricted).otherwise(F.array(F.lit(ANYWHERE)))
    profiles = _profiles_by_code(providers).withColumn("p_place", F.explode(accepted))
    met = (F.col("place") == F.col("p_place")) & fits_budget() & _on_first_shared_code()
    return placed.join(profiles, met).drop("code", "p_code", "place", "p_place")


def newest_matches(
    tenders: DataFrame, providers: DataFrame, as_of: Column, *, limit: int, offset: int = 0
) -> DataFrame:
    """One page per provider of the tenders that pass, newest first: keys, time and position."""
    newest = limit + offset

    def first(block: blocks.Block) -> pa.Table:
        rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Times as numbers, so that the latest come first and those without one last.
        times = np.array([]) if block.empty else block.tender("newest").fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.argsort(-times.astype(np.float64), kind="stable")
        for a, b in block.slices():
            passing = block.passing(a, b)[:, order]
            found, places = np.nonzero(passing & (np.cumsum(passing, axis=1, dtype=np.int32) <= newest))
            rows.append(found + a)
            columns.append(order[places])
        names, keys = np.concatenate(rows), np.concatenate(columns)
        return pa.table(
            {
                "provider_id": block.provider("provider_id").take(pa.array(names)),
                "expediente": block.tender("expediente").take(pa.array(keys)),
                "published_at": block.tender("published_at").take(pa.array(keys)),
            }
        )

    best = blocks.meet(
        blocks.tender_side(
            tenders.filter(still_biddable(as_of)), "published_at", F.unix_micros("published_at").alias("newest")
        ),
        blocks.provider_side(providers),
        first,
        "provider_id string, expediente string, published_at timestamp",
    )
    order = Window.partitionBy("provider_id").orderBy(F.desc("published_at"), "expediente")
    return (
        best.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= newest)
        .filter(F.col("position") > offset)
    )


def funnel_counts(tenders: DataFrame, providers: DataFrame, as_of: Column) -> DataFrame:
    """Five non-increasing counts per provider.

    The first two do not depend on the provider and are scalar subqueries; the
    other three are counted block by block, so no pair becomes a row.
    """
    stages = ("after_code", "after_budget", "after_location")

    def count(block: blocks.Block) -> pa.Table:
        found = np.zeros((len(stages), block.n_providers), np.int64)
        for a, b in block.slices():
            left = block.first_met(a, b)
            for stage, test in enumerate((None, block.in_budget, block.in_place)):
                left = left if test is None else left & test(a, b)
                found[stage, a:b] = np.count_nonzero(left, axis=1)
        return pa.table({"provider_id": block.provider("provider_id"), **dict(zip(stages, map(pa.array, found)))})

    per_provider = (
        blocks.meet(
            blocks.tender_side(tenders.filter(still_biddable(as_of))),
            blocks.provider_side(providers),
            count,
            "provider_id string, after_code bigint, after_budget bigint, after_location bigint",
        )
        .groupBy("provider_id")
        .agg(*[F.sum(stage).alias(stage) for stage in stages])
    )
    total = tenders.agg(F.count("*")).scalar()
    biddable = tenders.agg(F.count_if(still_biddable(as_of))).scalar()
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    return providers.select("provider_id").join(per_provider, "provider_id", "left").select(
        "provider_id",
        total.alias("total"),
        biddable.alias("after_status"),
        *[zero(stage) for stage in stages],
    )


def match_answer(counts: DataFrame, *, limit: int, offset: int = 0) -> DataFrame:
    """The envelope of each provider's matches: all that pass, the page, and the counts of the stages."""
    total = F.col("after_location")
    stages = ("after_status", "after_code", "after_budget", "after_location")
    return counts.select(
        "provider_id",
        total.alias("total"),
        F.greatest(F.lit(0), F.least(F.lit(limit), total - offset)).cast("bigint").alias("returned"),
        F.lit(limit).cast("bigint").alias("limit"),
        F.col("total").alias("funnel_total"),
        *[F.col(stage).alias(f"funnel_{stage}") for stage in stages],
    )


def empty_stage(counts: DataFrame) -> DataFrame:
    """The first stage that left a provider without tenders; null when some are left."""
    stage = (
        F.when(F.col("after_status") == 0, "status")
        .when(F.col("after_code") == 0, "code")
        .when(F.col("after_budget") == 0, "budget")
        .when(F.col("after_location") == 0, "location")
    )
    return counts.withColumn("empty_stage", stage)
