"""Rule labels, routes and guards: rules are small tables of labels and phrases, matched on folded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = list[tuple[str, list[str]]]


def labels(folded: Column, rules: Rules) -> Column:
    """Labels, in the rules' order, of which a phrase is part of the text. Phrases match inside words too.

    The folded text is bound to a one-element array, so it is worked out once and not for each phrase.
    """
    def found(t: Column) -> Column:
        return F.array(*[F.when(F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(t, p)), F.lit(label)) for label, phrases in rules])

    return F.array_compact(F.coalesce(F.transform(F.array(folded), found)[0], F.array().cast("array<string>")))


def signals(folded: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur."""
    each = F.array(*map(F.lit, phrases))
    return F.coalesce(F.transform(F.array(folded), lambda t: F.size(F.filter(each, lambda p: F.contains(t, p))))[0], F.lit(0))


def guard(folded: Column, phrases: list[str], reference: str, least: int) -> Column:
    """'reference' if the pattern occurs, 'signals' with at least that many phrases, else 'refused'."""
    return F.when(folded.rlike(reference), "reference").when(signals(folded, phrases) >= least, "signals").otherwise("refused")
