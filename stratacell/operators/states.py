"""The three states of a cell, and rules that derive columns from them.

A cell is coded, not_reported (documented as silent) or unresolved. Silence is
never a value, and unresolved cells leave every denominator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODED, SILENT, UNRESOLVED, MISSING = "coded", "not_reported", "unresolved", "missing"
STATES = (CODED, SILENT, UNRESOLVED)

#: Names that other producers give to the states.
SYNONYMS = {"value": CODED, "valued": CODED, "reported": CODED, "coded": CODED, "silent": SILENT, "not_reported": SILENT, "nr": SILENT, "unresolved": UNRESOLVED}


def three_state(value: Column, silent: Column, unresolved: Column, empty_is_unresolved: bool = True) -> Column:
    """The state of a cell; a value that is null (or empty, if so asked) without a flag is unresolved."""
    absent = value.isNull() | (F.trim(value.cast("string")) == "") if empty_is_unresolved else value.isNull()
    return F.when(F.coalesce(unresolved, F.lit(False)), UNRESOLVED).when(F.coalesce(silent, F.lit(False)), SILENT).when(absent, UNRESOLVED).otherwise(CODED)


def four_state(present: Column, value: Column, silent: Column, unresolved: Column) -> Column:
    """As three_state, with missing for a cell that the record doesn't have at all."""
    return F.when(~present, MISSING).otherwise(three_state(value, silent, unresolved))


def normal_state(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.try_element_at(known, F.lower(F.trim(name)))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "y", "t"), F.lit(False))


def cells(entities: DataFrame, key: str, values: dict[str, Column], silent: dict[str, Column], unresolved: Column) -> DataFrame:
    """One row an entity and dimension, from one pass over the entities: key, dimension, state, value (null unless coded)."""
    each = [F.struct(F.lit(d).alias("dimension"), three_state(v, silent[d], unresolved).alias("state"), v.cast("string").alias("value")) for d, v in values.items()]
    kept = [c for c in entities.columns if c != key]
    long = entities.select(key, *kept, F.explode(F.array(*each)).alias("cell"))
    return long.select(key, *kept, "cell.dimension", "cell.state", F.when(F.col("cell.state") == CODED, F.col("cell.value")).alias("value"))


def state_counts(long: DataFrame, *by: str) -> DataFrame:
    """Cells of each state in columns; the states are a fixed list, so that no extra job looks for them."""
    return long.groupBy(*by).agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def wide(long: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """One row an entity, with a value and a state column for each dimension."""
    parts = [F.max(F.when(F.col("dimension") == d, F.col(c))).alias(d if c == "value" else f"{d}_state") for d in dimensions for c in ("value", "state")]
    return long.groupBy(key).agg(*parts)


def value_label(values: Column, silent: Column | None = None) -> Column:
    """Values of a multi-valued cell as one label, whatever their order."""
    label = F.array_join(F.array_sort(values), "+")
    label = F.when(F.size(values) == 0, "(none)").otherwise(label)
    return label if silent is None else F.when(silent, "NR").otherwise(label)


def flags(*rules: tuple[str, Column]) -> Column:
    """The names of all rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, else null."""
    return F.coalesce(*[F.when(c, name) for name, c in rules])


def text_rank(query: str, labels: Column, other: Column) -> Column:
    """0 for a label that equals the query, 1 for one that begins with it, 2 for one that has it, 3 for a hit in another field, else null."""
    q = query.lower()
    low = F.transform(labels, F.lower)
    return (
        F.when(F.array_contains(low, q), 0).when(F.exists(low, lambda x: x.startswith(q)), 1).when(F.exists(low, lambda x: x.contains(q)), 2).when(F.lower(other).contains(q), 3)
    )


def date_window(date: Column, since: str, until: str) -> Column:
    """Partial dates (year, year and month, day) compared at their own precision; null passes."""
    at = lambda n: date.between(since[:n], until[:n])
    return date.isNull() | F.when(F.length(date) == 4, at(4)).when(F.length(date) == 7, at(7)).otherwise(at(10))


def value_predicate(kind: str, column: Column, text: str) -> Column:
    """A condition from text such as >=5: numbers by operator, dates by prefix, enums by membership, strings by substring."""
    for op in (">=", "<=", ">", "<", "="):
        if text.startswith(op):
            x = text[len(op) :].strip()
            break
    else:
        op, x = "=", text.strip()
    if kind == "integer":
        a, b = column, F.lit(int(x))
    elif kind == "date":
        a, b = F.substring(column, 1, len(x)), F.lit(x)
    elif kind == "enum":
        return F.lower(column) == x.lower()
    else:
        return F.lower(column).contains(x.lower())
    return {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b, "=": a == b}[op]
