"""Scalar functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import dates, lists, numbers, text
from larkspur.operators import joins
from larkspur.plans.registry import Tables, query

#: The opener against which delivery is judged, in the years of the order table.
OPENER = "1998-10-01"


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")


#: Business days by counting: the days after one's own that are Monday to Friday, numbered.
_BUSINESS = """
(WITH b AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT unnest(generate_series(DATE '1994-12-01', DATE '2002-12-31', INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) < 6),
o AS (SELECT o_orderkey, o_orderdate::DATE AS day FROM orders),
s AS (SELECT o.o_orderkey, o.day, max(b.k) AS k FROM o JOIN b ON b.d <= o.day AND b.d > o.day - 4 GROUP BY 1, 2)
SELECT s.o_orderkey, s.day, x.d AS soon, y.d AS late FROM s JOIN b x ON x.k = s.k + 4 JOIN b y ON y.k = s.k + 9)
"""


@query("dt1_add_business_days", f"SELECT o_orderkey, strftime(soon, '%Y-%m-%d') AS soon FROM {_BUSINESS}")
def business_days(t: Tables) -> DataFrame:
    return _orders(t).select("o_orderkey", dates.add_business_days(F.col("day"), 4).cast("string").alias("soon"))


@query("dt2_delivery_range", f"SELECT o_orderkey, strftime(soon, '%Y-%m-%d') AS soon, strftime(late, '%Y-%m-%d') AS late FROM {_BUSINESS}")
def delivery(t: Tables) -> DataFrame:
    d = dates.delivery(F.col("day"))
    return _orders(t).select("o_orderkey", d["soon"].cast("string").alias("soon"), d["late"].cast("string").alias("late"))


@query("dt3_delivery_verdict", f"SELECT o_orderkey, CASE WHEN late < DATE '{OPENER}' THEN 'ok' WHEN soon < DATE '{OPENER}' THEN 'tight' ELSE 'late' END AS verdict FROM {_BUSINESS} WHERE day < DATE '{OPENER}'")
def verdicts(t: Tables) -> DataFrame:
    d = dates.delivery(F.col("day"))
    opener = F.lit(OPENER).cast("date")
    return _orders(t).where(dates.open_before(F.col("day"), opener)).select("o_orderkey", dates.verdict(d["soon"], d["late"], opener).alias("verdict"))


@query("fl26_time_gate", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'")
def time_gate(t: Tables) -> DataFrame:
    return t.events.where(dates.open_before(F.col("ts"), F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'"))).select("event_id")


@query("fl30_still_valid", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'")
def still_valid(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderdate") > F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")).select("o_orderkey")


@query("dt4_short_date", "SELECT o_orderkey, strftime(o_orderdate, '%a, %b %-d') AS label FROM orders")
def short_date(t: Tables) -> DataFrame:
    return _orders(t).select("o_orderkey", dates.short_date(F.col("day")).alias("label"))


_LEFT = "epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts) // 1000"


def _left() -> F.Column:
    return F.unix_millis(F.lit("2024-02-01 00:00:00").cast("timestamp")) - dates.epoch_ms(F.col("ts"))


@query("dt5_countdown", f"SELECT event_id, l // 86400000 AS d, l % 86400000 // 3600000 AS h, l % 3600000 // 60000 AS m FROM (SELECT event_id, {_LEFT} AS l FROM events)")
def countdown(t: Tables) -> DataFrame:
    return t.events.select("event_id", dates.countdown(_left()).alias("c")).select("event_id", "c.*")


@query("dt6_days_left", f"SELECT event_id, ceil(({_LEFT}) / 86400000.0)::BIGINT AS days FROM events")
def days_left(t: Tables) -> DataFrame:
    return t.events.select("event_id", dates.days_left(_left()).alias("days"))


@query("dt7_snooze_until", "SELECT event_id, epoch_us(ts) // 1000 + CASE WHEN event_type = 'signup' THEN 180 ELSE 7 END::BIGINT * 86400000 AS until_ms FROM events")
def snooze(t: Tables) -> DataFrame:
    return t.events.select("event_id", dates.snooze_until(dates.epoch_ms(F.col("ts")), F.when(F.col("event_type") == "signup", 180).otherwise(7).cast("long")).alias("until_ms"))


@query("dt8_parse_instant", "SELECT event_id, (epoch_us(date_trunc('second', ts)) // 1000 + 14400000) AS instant_ms FROM events")
def instants(t: Tables) -> DataFrame:
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-04:00"))
    return t.events.select("event_id", dates.epoch_ms(dates.parse_instant(written)).alias("instant_ms"))


@query("dt9_season_over_new_year", "SELECT o_orderkey, strftime(o_orderdate, '%m-%d') >= '09-26' OR strftime(o_orderdate, '%m-%d') <= '02-07' AS open, o_orderdate BETWEEN DATE '1998-09-26' AND DATE '1999-02-07' AS that_year FROM orders")
def seasons(t: Tables) -> DataFrame:
    return _orders(t).select("o_orderkey", dates.yearly_season(F.col("day"), "09-26", "02-07").alias("open"), dates.in_season(F.col("day"), F.lit("1998-09-26").cast("date"), F.lit("1999-02-07").cast("date")).alias("that_year"))


_WINDOWS = """
SELECT n_name AS state, 'north' AS zone, 'archery' AS weapon, DATE '1998-09-26' + n_nationkey::INT AS open, DATE '1999-02-07' AS close FROM nation
UNION ALL SELECT n_name, 'south', 'firearm', DATE '1998-11-21', DATE '1999-01-03' FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_name, 'all', 'hog', DATE '1999-06-01', NULL FROM nation WHERE n_nationkey % 5 = 0
"""


@query(
    "dt9_season_windows",
    f"SELECT state, zone, weapon, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN ({_WINDOWS}) w ON w.state = n_name AND CAST(o_orderdate AS DATE) >= w.open AND (w.close IS NULL OR CAST(o_orderdate AS DATE) <= w.close) GROUP BY 1, 2, 3",
)
def season_windows(t: Tables) -> DataFrame:
    """Orders by the seasons open in the customer's state on their day: several windows a state, over New Year, and with an open end."""

    def window(zone: str, weapon: str, opens: F.Column, close: str | None, where: str) -> DataFrame:
        return t.nation.where(where).select(F.col("n_name").alias("state"), F.lit(zone).alias("zone"), F.lit(weapon).alias("weapon"), opens.alias("open"), F.lit(close).cast("date").alias("close"))

    day = lambda text: F.lit(text).cast("date")
    seasons = window("north", "archery", F.date_add(day("1998-09-26"), F.col("n_nationkey").cast("int")), "1999-02-07", "true")
    seasons = seasons.unionByName(window("south", "firearm", day("1998-11-21"), "1999-01-03", "n_nationkey % 2 = 0")).unionByName(window("all", "hog", day("1999-06-01"), None, "n_nationkey % 5 = 0"))
    customers = t.customer.join(joins.small(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("state"))
    days = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("day")).join(customers, F.col("o_custkey") == F.col("c_custkey")).select("state", "day")
    return joins.open_seasons(days, seasons, "state", "day").groupBy("state", "zone", "weapon").agg(F.count(F.lit(1)).alias("n_orders"))


# -- money and scores ------------------------------------------------------------------------------------------


@query("ma1_gift_percent", "SELECT o_orderkey, least(100.0, o_totalprice / 250000 * 100) AS pct FROM orders")
def gift(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", numbers.gift_percent(F.col("o_totalprice"), F.lit(250000)).alias("pct"))


@query("ma2_gift_left", "SELECT o_orderkey, greatest(250000 - o_totalprice::DECIMAL(12,2), 0)::DOUBLE AS away, o_totalprice::DECIMAL(12,2) >= 250000 AS unlocked FROM orders")
def gift_left(t: Tables) -> DataFrame:
    cart, threshold = numbers.money(F.col("o_totalprice")), F.lit(250000).cast(numbers.MONEY)
    return t.orders.select("o_orderkey", numbers.gift_left(cart, threshold).cast("double").alias("away"), (cart >= threshold).alias("unlocked"))


@query("ma3_save_percent", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, round(l_discount::DECIMAL(6,4) * 100, 0)::BIGINT AS pct FROM lineitem")
def save(t: Tables) -> DataFrame:
    rrp = F.lit(100).cast(numbers.MONEY)
    price = (F.lit(100) - F.col("l_discount").cast("decimal(6,4)") * 100).cast(numbers.MONEY)
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_suppkey", numbers.save_percent(rrp, price).alias("pct"))


@query("ma4_ma5_funnel", "SELECT revenue / 110.0 AS orders, revenue / 110.0 / 0.018 AS sessions, month FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1)")
def funnel(t: Tables) -> DataFrame:
    by = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")), 2).cast("double").alias("revenue"))
    orders = numbers.ratio(F.col("revenue"), F.lit(110.0))
    return by.select("month", orders.alias("orders"), numbers.ratio(orders, F.lit(0.018)).alias("sessions"))


@query("ma6_click_rate", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0)::DOUBLE AS ctr FROM events GROUP BY user_id")
def click_rate(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(numbers.ratio(F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")).alias("ctr"))


@query("ma7_return_on_spend", "SELECT o_orderstatus, round(sum(o_totalprice::DECIMAL(20,2)) / nullif(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice::DECIMAL(20,2) ELSE 0 END), 0), 6)::DOUBLE AS roas FROM orders GROUP BY 1")
def return_on_spend(t: Tables) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(20,2)")
    return t.orders.groupBy("o_orderstatus").agg(F.round(numbers.ratio(F.sum(price), F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", price).otherwise(0))), 6).alias("roas"))


@query("ma8_sku_score", "SELECT p_partkey AS sku, CASE WHEN p_size % 3 > 0 THEN 1.0 ELSE 0.0 END * (p_retailprice - 900) * p_size AS score FROM part")
def sku_score(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("sku"), numbers.sku_score(F.col("p_size") % 3 > 0, F.col("p_retailprice") - 900, F.col("p_size")).alias("score"))


@query("ma9_scroll_percent", "SELECT event_id, CASE WHEN k > 20 THEN value / (k - 20) * 100 ELSE 100.0 END AS pct FROM (SELECT event_id, value, (props->>'$.k')::BIGINT AS k FROM events)")
def scroll(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", numbers.scroll_percent(F.col("value"), k - 20).alias("pct"))


@query("fl32_engagement_gate", "SELECT event_id FROM events WHERE value >= 15 AND event_id % 100 * 100 >= 5000")
def engagement(t: Tables) -> DataFrame:
    return t.events.where(numbers.engaged(F.col("value"), F.col("event_id") % 100 * 100, 15, 5000)).select("event_id")


@query("fl31_scoring_gate", "SELECT p_partkey AS sku FROM part WHERE p_size % 3 > 0 AND p_retailprice > 905 AND p_size >= 10")
def scoring_gate(t: Tables) -> DataFrame:
    return t.part.where(numbers.worth_listing(F.col("p_size") % 3 > 0, F.col("p_retailprice"), F.col("p_size"), 905, 10)).select(F.col("p_partkey").alias("sku"))


# -- text ------------------------------------------------------------------------------------------------------


@query("st1_template", "SELECT p_partkey AS sku, '<p>' || p_name || ' (' || p_brand || ')</p>' AS html FROM part")
def template(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("sku"), text.template("<p>{name} ({brand})</p>", name=F.col("p_name"), brand=F.col("p_brand")).alias("html"))


@query("st2_upper", "SELECT n_nationkey::BIGINT AS n_nationkey, upper(n_name || ' knives') AS head FROM nation")
def upper(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.upper(F.concat("n_name", F.lit(" knives"))).alias("head"))


@query("st3_separator_join", "SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' &middot; ') AS links FROM pages")
def separator(t: Tables) -> DataFrame:
    return t.pages.select("page_id", lists.join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), " &middot; ", lambda x: x).alias("links"))


@query("st4_fill_tokens", "SELECT p_partkey AS sku, '<h1>' || p_name || '</h1><p>' || CASE WHEN p_size > 25 THEN p_type ELSE '{{STEEL}}' END || '</p>' AS html FROM part")
def tokens(t: Tables) -> DataFrame:
    page = text.fill_tokens(F.lit("<h1>{{NAME}}</h1><p>{{STEEL}}</p>"), {"NAME": F.col("p_name"), "STEEL": F.when(F.col("p_size") > 25, F.col("p_type"))})
    return t.part.select(F.col("p_partkey").alias("sku"), page.alias("html"))


@query("fl29_unfilled_tokens", "SELECT p_partkey AS sku FROM part WHERE p_size <= 25")
def unfilled(t: Tables) -> DataFrame:
    return tokens(t).where(text.unfilled(F.col("html"))).select("sku")


@query("fl25_path_prefixes", "SELECT url FROM pages WHERE NOT (starts_with(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/en/') OR starts_with(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/de/'))")
def prefixes(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    return t.pages.where(~text.starts_with_any(path, ["/en/", "/de/"])).select("url")


@query("st6_fixed_places", "SELECT o_orderkey, CAST(round(o_totalprice::DECIMAL(20,2) / 3, 2)::DECIMAL(20,2) AS VARCHAR) AS two FROM (SELECT o_orderkey, round(o_totalprice * 3) AS o_totalprice FROM orders)")
def fixed(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", text.fixed(F.round(F.col("o_totalprice") * 3).cast("decimal(20,2)") / 3, 2).alias("two"))


@query("st7_zero_pad", "SELECT event_id, CASE WHEN k < 10 THEN '0' || k ELSE k::VARCHAR END AS two FROM (SELECT event_id, (props->>'$.k')::BIGINT * 3 AS k FROM events)")
def pad(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.pad2(F.get_json_object("props", "$.k").cast("long") * 3).alias("two"))


@query("st8_parse_with_default", "SELECT doc_id, coalesce(try_cast(regexp_extract(source, '[0-9]+$') AS BIGINT), 1) AS n FROM documents")
def parse(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", numbers.parse_number(F.regexp_extract("source", "[0-9]+$", 0), 1, "bigint").alias("n"))


@query("st9_clamp_quantity", "SELECT event_id, greatest((props->>'$.k')::BIGINT - 50, 1) AS qty FROM events")
def clamp(t: Tables) -> DataFrame:
    return t.events.select("event_id", numbers.at_least_one(F.get_json_object("props", "$.k").cast("long") - 50).alias("qty"))


@query("st10_title", "SELECT p_partkey AS sku, p_brand || ' ' || p_name || ' ' || p_size || '\" ' || p_type || ' — In Stock' AS title FROM part")
def title(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("sku"), text.title(F.col("p_brand"), F.col("p_name"), F.col("p_size"), F.col("p_type")).alias("title"))


@query("st11_permalink", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '/blog/post-' || o_orderkey || '/' ELSE '/about/' END AS path FROM orders")
def permalink(t: Tables) -> DataFrame:
    old = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "/yyyy/MM/dd/"), F.lit("post-"), "o_orderkey", F.lit("/"))).otherwise("/about/")
    return t.orders.select("o_orderkey", text.permalink(old).alias("path"))


@query("st12_canonical_url", "SELECT page_id, 'https://' || lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www[.]', '')) || CASE WHEN p = '' THEN '/' WHEN ends_with(p, '/') THEN p ELSE p || '/' END AS url FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages)")
def canonical(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.canonical(F.col("url")).alias("url"))


@query("st13_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS safe_md5 FROM pages")
def escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.escape(F.col("html")).cast("binary")).alias("safe_md5"))


@query("fl28_word_count", "SELECT doc_id, n AS words FROM (SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END::BIGINT AS n FROM documents) WHERE n BETWEEN 150 AND 250")
def word_count(t: Tables) -> DataFrame:
    return t.documents.where(text.within_words(F.col("text"))).select("doc_id", text.word_count(F.col("text")).alias("words"))


# -- arrays, maps, JSON ----------------------------------------------------------------------------------------


@query("ar1_ar2_ar3_arrays", "SELECT c_custkey, len(list_filter([c_custkey % 2, c_custkey % 3, c_custkey % 5], lambda x: x > 0))::BIGINT AS n, list_transform([c_custkey % 2, c_custkey % 3, c_custkey % 5], lambda x: x * 10)[2] AS second FROM customer")
def arrays(t: Tables) -> DataFrame:
    a = F.array(*[F.col("c_custkey") % k for k in (2, 3, 5)])
    return t.customer.select("c_custkey", F.size(F.filter(a, lambda x: x > 0)).cast("long").alias("n"), F.element_at(F.transform(a, lambda x: x * 10), 2).alias("second"))


@query("mp1_map_lookup", "SELECT p_partkey AS sku, CASE p_type WHEN 'PROMO' THEN 'ok' WHEN 'LARGE' THEN 'warn' WHEN 'SMALL' THEN 'no' END AS verdict FROM part")
def lookup(t: Tables) -> DataFrame:
    verdicts = F.create_map(*[F.lit(x) for x in ("PROMO", "ok", "LARGE", "warn", "SMALL", "no")])
    return t.part.select(F.col("p_partkey").alias("sku"), F.try_element_at(verdicts, F.col("p_type")).alias("verdict"))


@query("mp1_map_items", "SELECT p_type AS key, count(*) AS n FROM part GROUP BY 1")
def items(t: Tables) -> DataFrame:
    one = F.create_map("p_type", F.lit(1).cast("long"))
    return t.part.select(F.explode(one).alias("key", "one")).groupBy("key").agg(F.sum("one").alias("n"))


@query("js1_js2_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS doc FROM events")
def json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("doc"))


@query("m19_json_ld", "SELECT '{\"@type\":\"ListItem\",\"position\":' || (n_nationkey + 1) || ',\"name\":\"' || n_name || '\"}' AS item FROM nation")
def json_ld(t: Tables) -> DataFrame:
    return t.nation.select(F.to_json(F.struct(F.lit("ListItem").alias("@type"), (F.col("n_nationkey") + 1).alias("position"), F.col("n_name").alias("name"))).alias("item"))


@query("cn1_cn2_conditionals", "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL ELSE event_type END, ''), 'none') AS kind FROM events")
def conditionals(t: Tables) -> DataFrame:
    v = F.col("value")
    stored = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    return t.events.select("event_id", F.when(v > 100, "high").when(v > 10, "mid").otherwise("low").alias("band"), text.falsy(stored, F.lit("none")).alias("kind"))


@query("st5_prefix_test", "SELECT p_partkey AS sku, starts_with(p_name, 'red') AS red FROM part")
def prefix(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("sku"), text.starts_with_any(F.col("p_name"), ["red"]).alias("red"))
