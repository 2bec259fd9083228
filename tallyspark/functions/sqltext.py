"""Building blocks for long expressions written as SQL text.

A chain with hundreds of branches is parsed by Spark in one call, where the same
chain of Column calls would cross to the JVM once per piece.
"""

from string import Formatter


def quoted(value: str | None) -> str:
    """String literal (raw: backslashes stand for themselves)."""
    if value is None:
        return "cast(null as string)"
    if '"' not in value:
        return f'r"{value}"'
    return "r'" + value + "'"


def case(branches: list[tuple[str, str]], default: str = "null") -> str:
    whens = " ".join(f"when {condition} then {value}" for condition, value in branches)
    return f"case {whens} else {default} end"


def fill(template: str, **values: str) -> str:
    """A message template with its {names} replaced by SQL expressions."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(quoted(literal))
        if name:
            parts.append(values[name])
    return "concat(" + ", ".join(parts) + ")"


def naira(amount: str) -> str:
    return f"concat('₦', format_number({amount}, 2))"


def rounded(value: str, places: int) -> str:
    """Round by the exact value of the double, ties to even."""
    return f"cast({plain_number(value, places)} as double)"


def plain_number(value: str, places: int) -> str:
    """Fixed-point text without thousands separators, ties to even."""
    return f"replace(format_number({value}, {places}), ',', '')"
