"""Which column plays which part. Every operator takes its names from here."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


def _numbered(pattern: str, n: int = 8) -> tuple[str, ...]:
    return tuple(pattern.format(i) for i in range(1, n + 1))


@dataclass(frozen=True)
class Roles:
    query: str = "srch_id"
    item: str = "prop_id"
    market: str = "srch_destination_id"
    visitor_country: str = "visitor_location_country_id"
    item_country: str = "prop_country_id"

    time: str = "date_time"
    position: str = "position"
    random_flag: str = "random_bool"
    click: str = "click_bool"
    book: str = "booking_bool"

    price: str = "price_usd"
    star: str = "prop_starrating"
    review: str = "prop_review_score"
    loc1: str = "prop_location_score1"
    loc2: str = "prop_location_score2"
    log_hist_price: str = "prop_log_historical_price"
    promo: str = "promotion_flag"

    stay: str = "srch_length_of_stay"
    window: str = "srch_booking_window"
    adults: str = "srch_adults_count"
    children: str = "srch_children_count"
    rooms: str = "srch_room_count"
    affinity: str = "srch_query_affinity_score"
    distance: str = "orig_destination_distance"
    hist_star: str = "visitor_hist_starrating"
    hist_price: str = "visitor_hist_adr_usd"

    comp_rate: tuple[str, ...] = field(default_factory=lambda: _numbered("comp{}_rate"))
    comp_inv: tuple[str, ...] = field(default_factory=lambda: _numbered("comp{}_inv"))
    comp_diff: tuple[str, ...] = field(
        default_factory=lambda: _numbered("comp{}_rate_percent_diff")
    )

    # Columns that together tell the rows of one query apart. Spark has no row
    # order, so ordinal ranks break ties by these, in this order.
    ties: tuple[str, ...] = ("position", "prop_id")

    def with_(self, **changes) -> "Roles":
        return replace(self, **changes)

    @property
    def frequency_keys(self) -> tuple[str, ...]:
        return (self.item, self.market, self.visitor_country, self.item_country)
