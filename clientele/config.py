"""Business definitions the analyses depend on, in one place."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction


@dataclass(frozen=True)
class AnalysisConfig:
    """Definitions shared by every analysis.

    The defaults are fixed values: results only agree between runs and between
    engines when all of them are the same.
    """

    # Orders in these states count neither for value, nor recency, nor growth.
    excluded_statuses: tuple[str, ...] = ("canceled", "unavailable")
    # Orders in this state receive a review when sample reviews are derived.
    delivered_status: str = "delivered"
    # Last month offset shown as a column of the retention matrix.
    retention_horizon: int = 12
    # Months of constant behaviour added to the revenue seen so far.
    projection_months: int = 12
    # Mean length of a calendar month.
    days_per_month: Decimal = Decimal("30.4375")
    clv_bands: int = 4
    rfm_bands: int = 5
    # False: rank 1 goes to the most recent, most frequent, highest spender.
    # True: that person gets the highest score instead.
    best_is_high: bool = False
    # "ntile" splits ties by person id, "percent_rank" keeps them together.
    rfm_scoring: str = "ntile"
    # Expected days between orders of a person who has ordered once only.
    single_order_gap_days: int = 180
    # A silence of up to this many expected gaps is "At Risk", beyond "Churned".
    at_risk_multiple: Decimal = Decimal("1.5")
    unknown_category: str = "Unknown"

    @property
    def month_fraction(self) -> Fraction:
        return Fraction(self.days_per_month)

    @property
    def at_risk_fraction(self) -> Fraction:
        return Fraction(self.at_risk_multiple)
