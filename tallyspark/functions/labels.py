"""Labels read off a narration: bank, channel, category, known subscription.

Inputs are SQL expressions (usually a column name).
"""

from pyspark.sql import Column, functions as F

from tallyspark.functions import fixed_values as V
from tallyspark.functions.sqltext import case, quoted


def _holds(text: str, words: list[str]) -> str:
    """Byte searches: some four times faster a row than the alternation of the words."""
    return " or ".join(f"contains(lower({text}), {quoted(w)})" for w in words)


def detect_bank(text: str) -> Column:
    return F.expr(case([(_holds(text, words), quoted(bank))
                        for bank, words in V.BANK_KEYWORDS]))


def detect_channel(text: str) -> Column:
    return F.expr(case([(_holds(text, words), quoted(channel))
                        for channel, words in V.CHANNEL_KEYWORDS], quoted(V.DEFAULT_CHANNEL)))


def category_pattern(phrases: list[str]) -> str:
    """One case-insensitive pattern for all phrases of a category.

    Phrases share their first letter, and a look-ahead leaves every word that starts with
    another one at once.
    """
    by_letter = {}
    for phrase in phrases:
        wanted, _, forbidden = phrase.partition("!")
        by_letter.setdefault(wanted[0], []).append(
            wanted[1:] + (rf"\b(?!{forbidden})" if forbidden else ""))
    branches = [f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items()]
    return rf"(?i)\b(?=[{''.join(by_letter)}])(?:" + "|".join(branches) + r")\b"


def matched_category(description: str, tx_type: str) -> Column:
    """The first category whose pattern is found in the text, else null."""
    def chain(categories):
        return case([(f"{description} rlike {quoted(category_pattern(phrases))}",
                      quoted(category)) for category, phrases in categories])

    return F.expr(f"case when {tx_type} = 'credit' then {chain(V.CREDIT_CATEGORIES)} "
                  f"else {chain(V.DEBIT_CATEGORIES)} end")


def known_subscription(description: str) -> Column:
    """Display name of the last listed service found in the text, else null."""
    return F.expr(case([(f"contains(lower({description}), {quoted(word)})", quoted(name))
                        for word, name, _ in reversed(V.SUBSCRIPTIONS)]))


def subscription_advice(group: str) -> Column:
    """Advice of the first listed service found in a group name."""
    return F.expr(case([(f"contains(lower({group}), {quoted(word)})", quoted(advice))
                        for word, _, advice in V.SUBSCRIPTIONS], quoted(V.DEFAULT_ADVICE)))
