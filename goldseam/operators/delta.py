"""Comparing observed with Gold schemas, many datasets in one job.

Inputs are rows of ``observed_columns`` and ``gold_columns``: dataset, ordinal, column, dtype.
Positions are dense, as ``observe_schema`` writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from goldseam.functions.actions import parse_reorder, reorder_text

_ON = ["dataset", "column"]


def _names(df: DataFrame, alias: str) -> DataFrame:
    return df.groupBy("dataset").agg(F.sort_array(F.collect_list("column")).alias(alias))


def delta_missing(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """Gold columns that were not observed, sorted, per dataset."""
    absent = gold.select(*_ON).join(observed.select(*_ON), _ON, "left_anti")
    return _names(absent, "missing_columns")


def delta_new(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """Observed columns Gold does not have, sorted, per dataset."""
    added = observed.select(*_ON).join(gold.select(*_ON), _ON, "left_anti")
    return _names(added, "new_columns")


def delta_types(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """Shared columns whose type names differ."""
    wanted = gold.select(*_ON, F.col("dtype").alias("gold"))
    return (
        observed.select(*_ON, F.col("dtype").alias("observed"))
        .join(wanted, _ON, "inner")
        .where(F.col("observed") != F.col("gold"))
        .select("dataset", "column", "observed", "gold")
    )


def _side_by_side(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """Full outer join on (dataset, column): a hot dataset still spreads over its columns."""
    left = observed.select(*_ON, F.col("ordinal").alias("o_at"), F.col("dtype").alias("o_dtype"))
    right = gold.select(*_ON, F.col("ordinal").alias("g_at"), F.col("dtype").alias("g_dtype"))
    return left.join(right, _ON, "full_outer")


def delta_reorder(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """Whether the ordered names differ. True as well when a column came or went.

    Two dense orders are equal iff every column has the same place in both, which is a plain
    aggregate: no list of columns is built.
    """
    return (
        _side_by_side(observed, gold)
        .groupBy("dataset")
        .agg(F.bool_or(~F.col("o_at").eqNullSafe(F.col("g_at"))).alias("reorder_event"))
    )


def wide_delta(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """The complete delta plus both ordered schemas, one row per dataset.

    The lists hold schema-sized data: the columns of one dataset.
    """
    both = _side_by_side(observed, gold)
    has_o, has_g = F.col("o_at").isNotNull(), F.col("g_at").isNotNull()

    def ordered(when: Column, *fields: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(when, F.struct(*fields))))

    return both.groupBy("dataset").agg(
        ordered(
            has_g & ~has_o, F.col("column"), F.col("g_dtype").alias("dtype")
        ).alias("missing"),
        ordered(has_o & ~has_g, F.col("column"), F.col("o_dtype").alias("dtype")).alias("new"),
        ordered(
            has_o & has_g & (F.col("o_dtype") != F.col("g_dtype")),
            F.col("g_at").alias("ordinal"),
            F.col("column"),
            F.col("o_dtype").alias("observed"),
            F.col("g_dtype").alias("gold"),
        ).alias("mismatches"),
        F.bool_or(~F.col("o_at").eqNullSafe(F.col("g_at"))).alias("reorder_event"),
        ordered(has_o, F.col("o_at").alias("ordinal"), F.col("column")).alias("o_order"),
        ordered(has_g, F.col("g_at").alias("ordinal"), F.col("column")).alias("g_order"),
    )


def _column_of(array: str) -> Column:
    return F.transform(array, lambda c: c["column"])


def schema_delta(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """Missing, new, type mismatches (by Gold position) and reorder event, per dataset."""
    return wide_delta(observed, gold).select(
        "dataset",
        _column_of("missing").alias("missing_columns"),
        _column_of("new").alias("new_columns"),
        F.transform(
            "mismatches",
            lambda m: F.struct(
                m["column"].alias("column"), m["observed"].alias("observed"), m["gold"].alias("gold")
            ),
        ).alias("type_mismatches"),
        "reorder_event",
    )


def complete_match(observed: DataFrame, gold: DataFrame) -> DataFrame:
    """Per dataset, whether nothing at all remains to repair."""
    both = _side_by_side(observed, gold)
    return (
        both.groupBy("dataset")
        .agg(
            F.count_if(F.col("o_at").isNull()).alias("missing_count"),
            F.count_if(F.col("g_at").isNull()).alias("new_count"),
            F.count_if(F.col("o_dtype") != F.col("g_dtype")).alias("mismatch_count"),
            F.bool_or(~F.col("o_at").eqNullSafe(F.col("g_at"))).alias("reorder_event"),
        )
        .withColumn(
            "matches",
            (F.col("missing_count") + F.col("new_count") + F.col("mismatch_count") == 0)
            & ~F.col("reorder_event"),
        )
    )


# --- reorder-only proof -----------------------------------------------------------
def reorder_outcome(
    reorder_event: Column,
    missing: Column,
    new: Column,
    mismatches: Column,
    observed_order: Column,
    gold_order: Column,
    observed_types: Column,
    gold_types: Column,
) -> Column:
    """One of the sixteen outcomes; the first that applies, in their fixed order."""

    def invalid(order: Column) -> Column:
        return (
            order.isNull()
            | (F.size(order) == 0)
            | F.exists(order, lambda name: name.isNull())
        )

    def repeats(order: Column) -> Column:
        return F.size(F.array_distinct(order)) != F.size(order)

    def other_members(left: Column, right: Column) -> Column:
        return (F.size(F.array_except(left, right)) > 0) | (
            F.size(F.array_except(right, left)) > 0
        )

    def type_differs(name: Column) -> Column:
        seen, wanted = observed_types[name], gold_types[name]
        return seen.isNull() | wanted.isNull() | (seen != wanted)

    return (
        F.when(
            reorder_event.isNull() | missing.isNull() | new.isNull() | mismatches.isNull(),
            "INVALID_DELTA",
        )
        .when(~reorder_event, "NOT_REORDER_EVENT")
        .when(F.size(missing) > 0, "MISSING_COLUMNS")
        .when(F.size(new) > 0, "NEW_COLUMNS")
        .when(F.size(mismatches) > 0, "TYPE_MISMATCHES")
        .when(invalid(observed_order), "INVALID_OBSERVED_ORDER")
        .when(repeats(observed_order), "DUPLICATE_OBSERVED_COLUMN")
        .when(invalid(gold_order), "INVALID_GOLD_ORDER")
        .when(repeats(gold_order), "DUPLICATE_GOLD_COLUMN")
        .when(observed_order == gold_order, "ALREADY_ORDERED")
        .when(F.size(observed_order) != F.size(gold_order), "COLUMN_COUNT_MISMATCH")
        .when(other_members(observed_order, gold_order), "COLUMN_MEMBERSHIP_MISMATCH")
        .when(observed_types.isNull(), "OBSERVED_SCHEMA_INCONSISTENT")
        .when(gold_types.isNull(), "GOLD_SCHEMA_INCONSISTENT")
        .when(
            other_members(F.map_keys(observed_types), observed_order),
            "OBSERVED_SCHEMA_INCONSISTENT",
        )
        .when(other_members(F.map_keys(gold_types), gold_order), "GOLD_SCHEMA_INCONSISTENT")
        .when(F.exists(gold_order, type_differs), "DTYPE_MISMATCH")
        .otherwise("ELIGIBLE")
    )


def reorder_eligibility(schemas: DataFrame) -> DataFrame:
    """The outcome for rows that carry a delta and both schemas.

    Columns: dataset, reorder_event, missing_columns, new_columns, type_mismatches,
    observed_order, gold_order, observed_types and gold_types (maps from name to type).
    """
    outcome = reorder_outcome(
        *[
            F.col(c)
            for c in (
                "reorder_event", "missing_columns", "new_columns", "type_mismatches",
                "observed_order", "gold_order", "observed_types", "gold_types",
            )
        ]
    )
    return schemas.select(
        "dataset", outcome.alias("outcome"), (outcome == "ELIGIBLE").alias("eligible")
    )


def reorder_evidence(tickets: DataFrame) -> DataFrame:
    """Whether a stored reorder plan proves itself; the first failing check otherwise.

    Columns: dataset, action, has_decision, observed_order, gold_order, observed_types, gold_types,
    replay_order. The delta is derived here from the schemas, not taken from the ticket.
    """
    observed_order, gold_order = F.col("observed_order"), F.col("gold_order")
    observed_types, gold_types = F.col("observed_types"), F.col("gold_types")
    broken = (
        observed_order.isNull() | gold_order.isNull()
        | observed_types.isNull() | gold_types.isNull()
    )
    odd = (
        F.exists(observed_order, lambda n: n.isNull())
        | F.exists(gold_order, lambda n: n.isNull())
        | (F.size(F.array_distinct(observed_order)) != F.size(observed_order))
        | (F.size(F.array_distinct(gold_order)) != F.size(gold_order))
    )
    nothing = F.array().cast("array<string>")
    shared = F.array_intersect(gold_order, observed_order)
    outcome = reorder_outcome(
        F.when(odd, True).otherwise(~(observed_order == gold_order)),
        F.when(odd, nothing).otherwise(F.array_except(gold_order, observed_order)),
        F.when(odd, nothing).otherwise(F.array_except(observed_order, gold_order)),
        F.when(odd, nothing).otherwise(
            F.filter(shared, lambda n: observed_types[n] != gold_types[n])
        ),
        observed_order,
        gold_order,
        observed_types,
        gold_types,
    )
    parsed = parse_reorder(F.col("action"))
    replay = F.col("replay_order")
    verdict = (
        F.when(~F.col("action").startswith("REORDER_COLUMNS"), "NOT_A_REORDER")
        .when(parsed.isNull(), "MALFORMED_ACTION")
        .when(F.col("action") != reorder_text(parsed), "NOT_CANONICAL")
        .when(F.col("has_decision"), "UNEXPECTED_DECISION")
        .when(broken, "INVALID_SCHEMA_EVIDENCE")
        .when(outcome != "ELIGIBLE", F.concat(F.lit("NOT_REORDER_ONLY:"), outcome))
        .when(parsed != gold_order, "TARGET_NOT_GOLD_ORDER")
        .when(
            replay.isNull()
            | F.exists(replay, lambda n: n.isNull())
            | (F.size(F.array_distinct(replay)) != F.size(replay)),
            "INVALID_REPLAY_COLUMNS",
        )
        .when(replay != observed_order, "REPLAY_ORDER_MISMATCH")
        .otherwise("VALID")
    )
    return tickets.select("dataset", verdict.alias("outcome"))


# --- two observations of one dataset ---------------------------------------------
def schema_matches_data(
    provided: DataFrame, actual: DataFrame, trust_types: bool = False
) -> DataFrame:
    """Per dataset, whether the provided schema describes the data: order, names, nulls, types."""
    left = provided.select(
        *_ON,
        F.col("ordinal").alias("p_at"),
        F.col("dtype").alias("p_dtype"),
        F.col("null_count").alias("p_nulls"),
    )
    right = actual.select(
        *_ON,
        F.col("ordinal").alias("a_at"),
        F.col("dtype").alias("a_dtype"),
        F.col("null_count").alias("a_nulls"),
    )
    same = F.col("p_at").eqNullSafe(F.col("a_at")) & F.col("p_nulls").eqNullSafe(F.col("a_nulls"))
    if not trust_types:
        same = same & F.col("p_dtype").eqNullSafe(F.col("a_dtype"))
    return (
        left.join(right, _ON, "full_outer")
        .groupBy("dataset")
        .agg(F.bool_and(same).alias("matches"))
    )


def signature_compat(published: DataFrame, proposed: DataFrame) -> DataFrame:
    """Per target, whether a new version has exactly the published names, order, count and types.

    Both inputs: dataset, ordinal, column, database_type. A target never published before has no
    rows in ``published`` and is compatible with anything.
    """
    left = published.select(
        "dataset", "ordinal", F.struct("column", "database_type").alias("old")
    )
    right = proposed.select(
        "dataset", "ordinal", F.struct("column", "database_type").alias("new")
    )
    return (
        left.join(right, ["dataset", "ordinal"], "full_outer")
        .groupBy("dataset")
        .agg(
            F.count("old").alias("published_columns"),
            F.count("new").alias("proposed_columns"),
            F.bool_and(F.col("old").eqNullSafe(F.col("new"))).alias("same"),
        )
        .select(
            "dataset",
            "published_columns",
            "proposed_columns",
            (F.col("same") | (F.col("published_columns") == 0)).alias("compatible"),
        )
    )
