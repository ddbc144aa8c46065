"""Repair actions as text and as typed columns; identifiers and version names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from goldseam import constants as C

# A JSON array of strings and nothing else, white space included.
_JSON_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_JSON_STRINGS = rf"^[ \t\r\n]*\[[ \t\r\n]*{_JSON_STRING}(?:[ \t\r\n]*,[ \t\r\n]*{_JSON_STRING})*[ \t\r\n]*\][ \t\r\n]*\z"


def words(text: Column) -> Column:
    """Split on white space, empty parts dropped."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda word: word != "")


def rename_text(old: Column, new: Column) -> Column:
    return F.concat(F.lit("RENAME_COLUMN "), old, F.lit(" -> "), new)


def cast_text(column: Column, target: Column, drop_invalid: bool = False) -> Column:
    suffix = f" {C.DROP_INVALID_MARKER}" if drop_invalid else ""
    return F.concat(F.lit("CAST_COLUMN "), column, F.lit(" TO "), target, F.lit(suffix))


def reorder_text(order: Column) -> Column:
    """The one canonical text of a reorder action."""
    return F.concat(F.lit(C.REORDER_PREFIX), F.to_json(order))


def parse_reorder(action: Column) -> Column:
    """Target order of a reorder action, or null: a non-empty JSON array of distinct strings."""
    payload = F.substring(action, len(C.REORDER_PREFIX) + 1, 2_147_483_647)
    order = F.from_json(
        F.when(action.startswith(C.REORDER_PREFIX) & payload.rlike(_JSON_STRINGS), payload),
        "array<string>",
    )
    return F.when(F.size(F.array_distinct(order)) == F.size(order), order)


def parse_action(action: Column) -> Column:
    """Typed action: kind, column, target, target_order, drop_invalid, error (null when valid)."""
    parts = words(action)
    count = F.size(parts)

    def part(i: int) -> Column:
        return F.try_element_at(parts, F.lit(i))

    no_text, no_order = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    is_rename = action.startswith("RENAME_COLUMN")
    is_cast = action.startswith("CAST_COLUMN")
    is_reorder = action.startswith("REORDER_COLUMNS")
    rename_ok = (count == 4) & (part(1) == "RENAME_COLUMN") & (part(3) == "->")
    cast_ok = (
        count.isin(4, 5)
        & (part(1) == "CAST_COLUMN")
        & (part(3) == "TO")
        & ((count == 4) | (part(5) == C.DROP_INVALID_MARKER))
    )
    order = parse_reorder(action)
    error = (
        F.when(is_rename, F.when(~rename_ok, "INVALID_RENAME"))
        .when(is_cast, F.when(~cast_ok, "INVALID_CAST"))
        .when(is_reorder, F.when(order.isNull(), "INVALID_REORDER"))
        .otherwise("UNSUPPORTED_ACTION")
    )
    valid = error.isNull()
    return F.struct(
        F.when(is_rename, "RENAME").when(is_cast, "CAST").when(is_reorder, "REORDER").alias("kind"),
        F.when(valid & (is_rename | is_cast), part(2)).otherwise(no_text).alias("column"),
        F.when(valid & (is_rename | is_cast), part(4)).otherwise(no_text).alias("target"),
        F.when(valid & is_reorder, order).otherwise(no_order).alias("target_order"),
        F.coalesce(valid & is_cast & (count == 5), F.lit(False)).alias("drop_invalid"),
        error.alias("error"),
    )


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(C.IDENTIFIER), F.lit(False))


def version_name(target: Column, execution_hex: Column) -> Column:
    """Name of an immutable version: the target cut so that the suffix always fits."""
    room = C.MAX_IDENTIFIER_LENGTH - 2 - C.VERSION_SUFFIX_HEX
    return F.concat(
        F.substring(target, 1, room), F.lit("__"), F.substring(execution_hex, 1, C.VERSION_SUFFIX_HEX)
    )
