"""Which columns of a statement mean what.

A statement's header is an array of strings. The layout is worked out once per
statement and stored as column positions, so reading a cell is an array lookup and
statements with different headers share one schema. Expressions here are SQL over a
column that holds the lower-case header.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.once import with_once
from tallyspark.functions.sqltext import case, quoted


def lowered(header: Column) -> Column:
    return F.transform(header, lambda h: F.lower(F.trim(h)))


def _position(header: str, names: list[str]) -> str:
    """Position of the first listed name found in the header, else null."""
    found = [f"nullif(cast(array_position({header}, {quoted(n)}) as int), 0)" for n in names]
    return f"coalesce({', '.join(found)})" if found else "cast(null as int)"


def layout_names(layout: tuple) -> dict[str, str | None]:
    return dict(zip(V.LAYOUT_FIELDS, layout[1:-1]))


def sniff(header: str) -> str:
    """(layout, score) of the best layout with at least two known columns, else null.

    The score counts the layout's columns, its type column aside. The first listed
    layout wins a tie: entries are compared by score, then by how early they come.
    """
    entries = []
    for i, layout in enumerate(V.LAYOUTS):
        names = ", ".join(quoted(name.lower()) for field, name in layout_names(layout).items()
                          if name and field != "type")
        entries.append(f"named_struct('score', size(array_intersect({header}, array({names}))), "
                       f"'order', {-i}, 'layout', {quoted(layout[0])})")
    best = f"array_max(array({', '.join(entries)}))"
    return (f"get(filter(array({best}), b -> b.score >= 2), 0)")


def _columns(found: dict[str, str], pattern: str | None, name: str) -> str:
    fields = ", ".join(f"'{field}', {found[field]}" for field in V.LAYOUT_FIELDS)
    return (f"named_struct({fields}, 'pattern', {quoted(pattern)}, "
            f"'layout', {quoted(name)})")


def named_positions(header: str, layout_name: str) -> str:
    """Positions of a layout's columns, null for a statement it does not fit.

    A layout fits only if the header has its date, description and amount columns;
    other statements are read by synonyms.
    """
    branches = []
    for layout in V.LAYOUTS:
        found = {field: _position(header, [name.lower()] if name else [])
                 for field, name in layout_names(layout).items()}
        amounts = ["amount"] if layout_names(layout)["amount"] else ["debit", "credit"]
        needed = " and ".join(f"{found[f]} is not null" for f in ["date", "desc", *amounts])
        branches.append((f"{layout_name} = {quoted(layout[0])} and {needed}",
                         _columns(found, layout[-1], layout[0])))
    return case(branches)


def synonym_positions(header: str, synonyms: dict[str, list[str]]) -> str:
    """Positions by synonyms, for statements no layout fits."""
    return _columns({field: _position(header, synonyms.get(field, []))
                     for field in V.LAYOUT_FIELDS}, None, "generic")


def with_positions(df: DataFrame) -> DataFrame:
    """Add column positions for a header: by layout if one fits, else by synonyms."""
    sniffed = with_once(df.withColumn("_low", lowered(F.col("header"))), "_layout",
                        F.expr(sniff("_low") + ".layout"))
    positions = (f"coalesce({named_positions('_low', '_layout')}, "
                 f"{synonym_positions('_low', V.GENERIC_SYNONYMS)})")
    return with_once(sniffed, "columns", F.expr(positions)).drop("_low", "_layout")


PROBLEM = """
    case when columns.date is null or columns.desc is null
              then 'Cannot determine date/description columns.'
         when columns.amount is null and (columns.debit is null or columns.credit is null)
              then 'Cannot find amount column in statement.' end"""
