"""Money, confidence and clamping rules as Column builders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


@dataclass(frozen=True)
class BidPolicy:
    """Per cent of resale to bid at each confidence, each held to 5 to 95, and the retail value that makes an anchor (25 to 1000)."""

    high: int = 60
    medium: int = 50
    low: int = 35
    anchor: float = 100.0

    def percent(self, level: Column) -> Column:
        held = [min(max(p, 5), 95) for p in (self.high, self.medium, self.low)]
        return F.when(level == "High", held[0]).when(level == "Low", held[2]).otherwise(held[1])

    @property
    def anchor_at(self) -> float:
        return min(max(self.anchor, 25.0), 1000.0)


#: Words for high and low confidence; anything else is medium.
HIGH_WORDS = ("high", "h", "very high", "certain", "confident")
LOW_WORDS = ("low", "l", "very low", "guess", "uncertain", "speculative")


def confidence(text: Column) -> Column:
    """High, Med or Low; unknown, empty and null text are Med."""
    word = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(word.isin(*HIGH_WORDS), "High").when(word.isin(*LOW_WORDS), "Low").otherwise("Med")


def confidence_rank(level: Column) -> Column:
    return F.when(level == "High", 0).when(level == "Med", 1).otherwise(2)


def level_of_rank(rank: Column) -> Column:
    return F.when(rank == 0, "High").when(rank == 1, "Med").otherwise("Low")


def max_bid(resale: Column, level: Column, policy: BidPolicy = BidPolicy()) -> Column:
    """The ceiling: a level's share of resale, rounded half away from zero; 0 where resale is not positive."""
    return F.when(resale > 0, F.round(resale * policy.percent(level) / 100.0)).otherwise(F.lit(0.0))


def is_anchor(retail: Column, policy: BidPolicy = BidPolicy()) -> Column:
    return (retail > 0) & (retail >= policy.anchor_at)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is not positive."""
    return F.when(whole > 0, part / whole)


def unit_value(total: Column, quantity: Column) -> Column:
    """The value of one of several, null for one and for no value."""
    return F.when((quantity > 1) & (total > 0), total / quantity)


def quantity(number: Column) -> Column:
    """A count from an answer: rounded, 0 to 10,000; 0 where it is no number."""
    return F.when(number.isNull() | F.isnan(number), F.lit(0)).otherwise(clamped(F.round(number), 0, 10_000)).cast("int")


def price(number: Column) -> Column:
    """A unit price from an answer, 0 to 1,000,000; 0 where it is no number."""
    return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(clamped(number, 0.0, 1_000_000.0))


def currency(value: Column, cents: bool = True) -> Column:
    """`$1,234.56` or `$1,235`."""
    digits = F.format_number(F.abs(value), 2 if cents else 0)
    return F.concat(F.when(value < 0, "-$").otherwise("$"), digits)


def percent_text(share: Column) -> Column:
    return F.concat(F.format_number(F.round(share * 100), 0), F.lit("%"))


def progress(pages_read: Column, landed: Column, on_page: Column, target: Column) -> Column:
    """The share of a walk that is done, null without a target: pages read and the part of the page that landed."""
    rows = F.when(on_page > 0, F.least(F.greatest(landed, F.lit(0)), on_page) / on_page).otherwise(0.0)
    return F.when(target > 0, F.least(F.lit(1.0), (F.greatest(pages_read, F.lit(0)) + rows) / target))


def page_target(budget: Column, every_page: Column, listed: Column) -> Column:
    """How many pages a walk promises; null where it walks all and the listing names no count."""
    pages = F.greatest(budget, F.lit(1))
    return F.when(every_page, listed).otherwise(F.least(pages, F.coalesce(listed, pages)))


def step_share(step: Column, answered: Column, of: Column) -> Column:
    """What a step has done of a row."""
    n = F.greatest(of, F.lit(1))
    return (
        F.when(step == "readingPage", 0.1)
        .when(step == "evaluatingText", 0.2)
        .when(step == "photograph", 0.2 + 0.7 * (F.least(F.greatest(answered, F.lit(0)), n) / n))
        .when(step == "wholeGallery", 0.6)
        .when(step.isin("reconciling", "pricingManifest"), 0.9)
    )
