"""Small panels for the tests."""

import datetime as dt


def weekdays(count, start=dt.date(2024, 1, 1)):
    days, day = [], start
    while len(days) < count:
        if day.weekday() < 5:
            days.append(day)
        day += dt.timedelta(days=1)
    return days


def bar_rows(security, days, price=lambda i: 100.0 + i, volume=lambda i: 1000.0 + i):
    rows = []
    for i, day in enumerate(days):
        p = price(i)
        v = volume(i)
        rows.append((security, security.upper(), day, p, p * 1.01, p * 0.99, p * 1.002, v, p * v, 1.0, "r1"))
    return rows


BAR_COLUMNS = (
    "security_id string, symbol string, trade_date date, open double, high double, low double, "
    "close double, volume double, dollar_volume double, adj_factor double, source_revision string"
)
UNIVERSE_COLUMNS = (
    "security_id string, symbol string, trade_date date, listed_days long, exchange string, "
    "security_type string, is_primary_listing boolean, is_listed boolean, is_delisted boolean, "
    "is_halted boolean, industry_code string, float_market_cap double, close double, "
    "adv20_usd double, eligible boolean"
)


def universe_rows(security, days, eligible=True, industry="tech", cap=1e9):
    return [
        (security, security.upper(), day, i + 1, "XNAS", "common_stock", True, True, False, False,
         industry, cap, 100.0 + i, 1e6, eligible)
        for i, day in enumerate(days)
    ]


def rows(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]
