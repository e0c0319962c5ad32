import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larkspur.functions import dates, lists, numbers, text

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("day", "soon", "late", "verdict"),
    [
        (D(2026, 9, 12), D(2026, 9, 17), D(2026, 9, 24), "ok"),
        (D(2026, 9, 17), D(2026, 9, 23), D(2026, 9, 30), "ok"),
        (D(2026, 9, 18), D(2026, 9, 24), D(2026, 10, 1), "tight"),
        (D(2026, 9, 24), D(2026, 9, 30), D(2026, 10, 7), "tight"),
        (D(2026, 9, 25), D(2026, 10, 1), D(2026, 10, 8), "late"),
    ],
)
def test_delivery_golden(spark, day, soon, late, verdict):
    d = dates.delivery(F.lit(day))
    row = one(spark, F.struct(d["soon"], d["late"], dates.verdict(d["soon"], d["late"], F.lit(D(2026, 10, 1)))))
    assert tuple(row) == (soon, late, verdict)


def test_business_days_against_a_loop(spark):
    days = [D(2026, 1, 1) + dt.timedelta(k) for k in range(21)]
    rows = spark.createDataFrame([(d,) for d in days], "d date")
    for n in range(0, 14):
        for r in rows.select("d", dates.add_business_days(F.col("d"), n).alias("x")).collect():
            want, left = r["d"], n
            while left:
                want += dt.timedelta(1)
                left -= want.weekday() < 5
            assert r["x"] == want, (r["d"], n)


def test_holidays_are_skipped(spark):
    holidays = F.array(F.lit(D(2026, 9, 7)))
    assert one(spark, dates.add_business_days(F.lit(D(2026, 9, 4)), 1, holidays)) == D(2026, 9, 8)
    assert one(spark, dates.add_business_days(F.lit(D(2026, 9, 4)), 1)) == D(2026, 9, 7)


@pytest.mark.parametrize(("rrp", "price", "pct"), [("66.00", "52.80", 20), ("85.00", "68.00", 20), ("12.00", "8.70", 28), ("61.00", "49.00", 20), ("96.00", "76.80", 20), ("52.00", "41.60", 20)])
def test_discount_golden(spark, rrp, price, pct):
    assert one(spark, numbers.save_percent(numbers.money(F.lit(rrp)), numbers.money(F.lit(price)))) == pct


def test_discount_of_nothing_is_null(spark):
    assert one(spark, numbers.save_percent(numbers.money(F.lit("0")), numbers.money(F.lit("0")))) is None


@pytest.mark.parametrize(("cart", "pct", "away"), [("51.80", "69", "23.20"), ("75", "100", "0.00"), ("200", "100", "0.00")])
def test_gift_golden(spark, cart, pct, away):
    c, t = numbers.money(F.lit(cart)), numbers.money(F.lit("75"))
    assert one(spark, text.fixed(numbers.gift_percent(c, t), 0)) == pct
    assert one(spark, numbers.gift_left(c, t)) == Decimal(away)


def test_funnel_golden(spark):
    found = [one(spark, F.round(numbers.ratio(F.lit(a), F.lit(b)), 1)) for a, b in ((311, 110), (3, 0.018), (10000, 110), (91, 0.018))]
    assert found == [2.8, 166.7, 90.9, 5055.6]
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0))) is None


def test_history_golden(spark):
    entry = lambda u: F.struct(F.lit(u).alias("url"), *[F.lit("").alias(c) for c in ("name", "img", "price", "brand")])
    history = lists.parse_list(F.lit(None).cast("string"))
    for u in ("B", "A", "A"):
        history = lists.visited(history, entry(u))
    urls = lambda c: F.array_join(F.transform(c, lambda x: x["url"]), "")
    assert one(spark, urls(lists.shown(history, F.lit("C")))) == "AB"
    assert one(spark, urls(lists.visited(history, entry("C")))) == "CAB"
    many = history
    for k in range(14):
        many = lists.visited(many, entry(f"u{k}"))
    assert one(spark, F.size(many)) == 12


def test_broken_list_is_empty(spark):
    assert one(spark, F.size(lists.parse_list(F.lit("{oops")))) == 0


@pytest.mark.parametrize(("n", "want"), [(0, "00"), (9, "09"), (10, "10"), (123, "123")])
def test_pad2(spark, n, want):
    assert one(spark, text.pad2(F.lit(n))) == want


def test_countdown_and_days_left_differ(spark):
    ms = F.lit(2 * 86_400_000 + 5 * 3_600_000 + 7 * 60_000 + 1)
    assert tuple(one(spark, dates.countdown(ms))) == (2, 5, 7)
    assert one(spark, dates.days_left(ms)) == 3


def test_text_pieces(spark):
    assert one(spark, text.word_count(F.lit("  a\tb\n c "))) == 3
    assert one(spark, text.word_count(F.lit(None).cast("string"))) == 0
    assert one(spark, text.permalink(F.lit("/2024/05/06/some-post/"))) == "/blog/some-post/"
    assert one(spark, text.permalink(F.lit("/about/"))) == "/about/"
    assert one(spark, text.canonical(F.lit("http://www.Shop.example/a?x=1#y"))) == "https://shop.example/a/"
    assert one(spark, text.canonical(F.lit("https://shop.example"))) == "https://shop.example/"
    assert one(spark, text.escape(F.lit("<a href=\"x\">'&"))) == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;"
    assert one(spark, text.fill_tokens(F.lit("{{A}}-{{B}}"), {"A": F.lit(1), "B": F.lit(None)})) == "1-{{B}}"
    assert one(spark, text.unfilled(F.lit("{{B}}"))) is True
    assert one(spark, text.falsy(F.lit(""), F.lit("x"))) == "x"
    assert one(spark, text.fixed(F.lit(Decimal("2.345")), 2)) == "2.35"


def test_season_over_new_year(spark):
    for day, open_ in ((D(2026, 9, 26), True), (D(2027, 2, 7), True), (D(2027, 2, 8), False), (D(2026, 9, 25), False)):
        assert one(spark, dates.yearly_season(F.lit(day), "09-26", "02-07")) is open_
        assert one(spark, dates.in_season(F.lit(day), F.lit(D(2026, 9, 26)), F.lit(D(2027, 2, 7)))) is open_
    assert one(spark, dates.in_season(F.lit(D(2030, 1, 1)), F.lit(D(2026, 1, 1)), F.lit(None).cast("date"))) is True


def test_instants(spark):
    assert one(spark, dates.epoch_ms(dates.parse_instant(F.lit("2026-10-01T00:00:00-04:00")))) == 1_790_827_200_000
    assert one(spark, dates.parse_instant(F.lit("soon"))) is None


def test_gates(spark):
    assert one(spark, numbers.scroll_percent(F.lit(5), F.lit(0))) == 100.0
    assert one(spark, numbers.engaged(F.lit(15.0), F.lit(5000), 15, 5000)) is True
    assert one(spark, numbers.price_band(F.lit(25.0), [25, 50, 100])) == 1
    assert one(spark, numbers.parse_number(F.lit("x"), 7, "bigint")) == 7
    assert one(spark, numbers.at_least_one(F.lit(None).cast("int"))) == 1
    assert one(spark, text.starts_with_any(F.lit("/cart/x"), ["/cart", "/checkout"])) is True
