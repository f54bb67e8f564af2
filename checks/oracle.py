"""The same queries in DuckDB SQL, written independently of the Spark code."""

from __future__ import annotations

from checks import fixed as S
from checks.fixed import BOOK_AS_OF, DEFAULT_CONFIG, GRADE_TEXT, HIGH_YIELD, LOG_AS_OF


def text(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def rounded(x: str, digits: int) -> str:
    scale = f"{10 ** digits}::DOUBLE"
    return f"(round_even(({x}) * {scale}, 0) / {scale} + 0::DOUBLE)"


def case(key: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


r = rounded
CITY_LIST = text(S.CITIES)
LOCALITY_LIST = text([x for _, _, names in S.CITIES.values() for x in names])
TYPE_LIST = text(S.PROPERTY_TYPES)
AMENITY_LIST = text(S.AMENITIES)
STATUS_LIST = text(S.ENQUIRY_STATUSES + ["archived"])
PREMIUM = ", ".join(f"'{x}'" for x in S.PREMIUM_LOCALITIES)

RAW_LISTINGS = f"""raw_listings AS (
  SELECT 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS property_id,
    {CITY_LIST}[CAST(s_nationkey % 10 + 1 AS INT)] AS city,
    {LOCALITY_LIST}[CAST((s_nationkey % 10) * 5 + l_suppkey % 5 + 1 AS INT)] AS locality,
    {TYPE_LIST}[CAST(p_size % 5 + 1 AS INT)] AS property_type,
    CAST(1 + l_linenumber % 5 AS INTEGER) AS bedrooms,
    CAST(least(1 + l_linenumber % 5 + l_partkey % 2, 5) AS INTEGER) AS bathrooms,
    300::DOUBLE + l_quantity * 40::DOUBLE AS area_sqft,
    CASE WHEN l_orderkey % 33 <> 0 THEN (l_orderkey % 30)::DOUBLE END AS age_years,
    CASE WHEN l_partkey % 50 <> 0 THEN (l_partkey % 25)::DOUBLE END AS floor_number,
    (l_partkey % 25 + 1 + l_suppkey % 9)::DOUBLE AS total_floors,
    CASE WHEN l_partkey % 97 <> 0 THEN array_to_string(list_slice({AMENITY_LIST}, 1, 2 + p_size % 9), '|') END AS amenities,
    4::DOUBLE + (l_suppkey % 60)::DOUBLE / 10::DOUBLE AS location_score,
    (l_extendedprice + 10000::DOUBLE) * CASE WHEN l_partkey % 40 = 0 THEN 800::DOUBLE ELSE 100::DOUBLE END AS price,
    CAST(l_shipdate AS DATE) AS listed_at
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
LISTINGS = f"""{RAW_LISTINGS}, listings AS (
  SELECT *, {r('price / area_sqft', 2)} AS price_per_sqft,
    CASE WHEN coalesce(amenities, '') = '' THEN 0 ELSE len(string_split(amenities, '|')) END AS amenities_count
  FROM raw_listings)"""
SCORE10 = "least(greatest(amenities_count::DOUBLE / 10::DOUBLE * 10::DOUBLE, 0::DOUBLE), 10::DOUBLE)"
FLOOR_RATIO = r("floor_number / CASE WHEN total_floors = 0 THEN 1::DOUBLE ELSE total_floors END", 3)
AGE_GROUP = "CASE WHEN age_years IS NULL THEN 'Unknown' WHEN age_years <= 3 THEN 'New' WHEN age_years <= 12 THEN 'Mid' ELSE 'Old' END"
ENRICHED = f"""{LISTINGS}, part1 AS (
  SELECT *, {SCORE10} AS amenities_score,
    {r('bedrooms::DOUBLE / CASE WHEN bathrooms = 0 THEN 1::DOUBLE ELSE bathrooms::DOUBLE END', 2)} AS bed_bath_ratio,
    {FLOOR_RATIO} AS floor_ratio,
    {r('area_sqft / CASE WHEN bedrooms = 0 THEN 1::DOUBLE ELSE bedrooms::DOUBLE END', 2)} AS area_per_bedroom,
    {case('city', {c: f'{v}::DOUBLE' for c, v in S.CITY_PRICE_INDEX.items()}, '0.5::DOUBLE')} AS city_price_index,
    CASE WHEN locality IN ({PREMIUM}) THEN 1 ELSE 0 END AS is_premium_locality,
    {AGE_GROUP} AS property_age_group
  FROM listings), part2 AS (
  SELECT *, {r('''location_score * 0.4::DOUBLE + amenities_score * 0.3::DOUBLE
      + least(greatest(1::DOUBLE - coalesce(age_years, 15::DOUBLE) / 30::DOUBLE, 0::DOUBLE), 1::DOUBLE) * 10::DOUBLE * 0.2::DOUBLE
      + floor_ratio * 10::DOUBLE * 0.1::DOUBLE''', 2)} AS raw_score FROM part1), enriched AS (
  SELECT *, CASE WHEN raw_score IS NOT NULL THEN least(greatest(raw_score, 0::DOUBLE), 10::DOUBLE) END AS value_score FROM part2)"""
VALUED = f"""{LISTINGS}, rated AS (
  SELECT *, CAST(trunc({case('city', {c: f'{v}::DOUBLE' for c, v in S.CITY_BASE.items()}, 'NULL')}
    * {case('property_type', {t: f'{v}::DOUBLE' for t, v in S.TYPE_FACTORS.items()}, 'NULL')}
    * greatest(0::DOUBLE, 1::DOUBLE - coalesce(age_years, 0::DOUBLE) * 0.01::DOUBLE)
    * (1::DOUBLE + amenities_count::DOUBLE * 0.02::DOUBLE)
    * (1::DOUBLE + (location_score - 5::DOUBLE) * 0.05::DOUBLE)) AS BIGINT) AS fair_ppsf
  FROM listings), valued AS (
  SELECT *, CAST(trunc(fair_ppsf::DOUBLE * area_sqft) AS BIGINT) AS fair_price FROM rated)"""


def invest_cte(config: dict, source: str, adjustment: str) -> str:
    c = {**DEFAULT_CONFIG, **config}
    d = {k: f"{float(v)!r}::DOUBLE" for k, v in c.items()}
    months = c["loan_tenure_years"] * 12
    rate = c["mortgage_rate_pct"] / 100 / 12
    if rate > 0:
        m, comp = f"{rate!r}::DOUBLE", f"{(1 + rate) ** months!r}::DOUBLE"
        emi = f"loan * {m} * {comp} / ({comp} - 1::DOUBLE)"
    else:
        emi = f"loan / {months}::DOUBLE"
    return f"""i1 AS (
  SELECT *, greatest(1::DOUBLE, {d['gross_rental_yield_pct']} + {adjustment}) AS gp FROM {source}), i2 AS (
  SELECT *, price * gp / 100::DOUBLE AS gr FROM i1), i3 AS (
  SELECT *, gr * {1 - c['vacancy_rate_pct'] / 100!r}::DOUBLE AS eff, price * {d['maintenance_pct']} / 100::DOUBLE AS upkeep FROM i2), i4 AS (
  SELECT *, eff - upkeep - eff * {d['tax_rate_pct']} / 100::DOUBLE AS nr,
    price * pow({1 + c['annual_appreciation_pct'] / 100!r}::DOUBLE, 5) AS v5,
    price * pow({1 + c['annual_appreciation_pct'] / 100!r}::DOUBLE, 10) AS v10,
    price * {d['down_payment_pct']} / 100::DOUBLE AS down FROM i3), i5 AS (
  SELECT *, price - down AS loan, CASE WHEN nr > 0 THEN down / nr ELSE 999.9::DOUBLE END AS be,
    (v5 - price + nr * 5) / price * 100 AS r5, (v10 - price + nr * 10) / price * 100 AS r10,
    {r('nr / price * 100', 2)} AS net_rental_yield FROM i4), i6 AS (
  SELECT *, (CASE WHEN net_rental_yield >= 3 THEN 3 WHEN net_rental_yield >= 2 THEN 2 WHEN net_rental_yield >= 1 THEN 1 ELSE 0 END
    + CASE WHEN r10 >= 200 THEN 3 WHEN r10 >= 150 THEN 2 WHEN r10 >= 100 THEN 1 ELSE 0 END
    + CASE WHEN be <= 10 THEN 2 WHEN be <= 18 THEN 1 ELSE 0 END) AS points FROM i5), graded AS (
  SELECT *, {r('gr', 2)} AS gross_annual_rent, {r('nr', 2)} AS net_annual_rent, {r('gr / price * 100', 2)} AS gross_rental_yield,
    {r('r5', 2)} AS roi_5yr_pct, {r('r10', 2)} AS roi_10yr_pct, {r('v5', 2)} AS projected_value_5yr,
    {r('v10', 2)} AS projected_value_10yr, {r('loan', 2)} AS loan_amount, {r(emi, 2)} AS monthly_emi,
    {r('be', 1)} AS break_even_years,
    CASE WHEN points >= 7 THEN 'A+' WHEN points >= 5 THEN 'A' WHEN points >= 3 THEN 'B' ELSE 'C' END AS investment_grade FROM i6)"""


CITY_ADJUST = case("city", {c: f"{v}::DOUBLE" for c, v in S.CITY_YIELD_ADJUSTMENT.items()}, "0::DOUBLE")
RECOMMENDATION = case("investment_grade", {k: "'" + v + "'" for k, v in GRADE_TEXT.items()}, "NULL")
GRADES_BY_CITY = f"""SELECT city, investment_grade, count(*) AS listings, {r('avg(net_rental_yield)', 4)} AS avg_net_yield,
  {r('avg(monthly_emi)', 2)} AS avg_monthly_emi, {r('min(break_even_years)', 1)} AS best_break_even FROM graded GROUP BY ALL"""

P = "'P' || "
CATALOGUE = f"""catalogue AS (
  SELECT 'P' || p_partkey AS id, p_name AS title, {CITY_LIST}[CAST(p_partkey % 10 + 1 AS INT)] AS city,
    {LOCALITY_LIST}[CAST((p_partkey % 10) * 5 + p_size % 5 + 1 AS INT)] AS locality, p_brand AS builder,
    CAST(round(p_retailprice * 10000) AS BIGINT) AS price,
    array_to_string(list_slice({AMENITY_LIST}, 1, 2 + p_size % 9), '|') AS amenities,
    CASE WHEN p_size % 3 <> 0 THEN 'Metro ' || (p_partkey % 7) || 'km' END AS metro FROM part)"""


def unit(i: int) -> str:
    return (f"{{'type': '{i} BHK', 'area': CAST({300 + 400 * i} + p_size AS INTEGER), "
            f"'price': CAST(round(p_retailprice * 10000) * {i} AS BIGINT), 'floor_range': '1-' || (p_size + {i}), "
            f"'available': CAST(p_partkey % {i + 2} AS INTEGER), 'total': CAST(p_partkey % {i + 2} + {i} AS INTEGER)}}")


INVENTORY = f"""inventory AS (
  SELECT 'P' || p_partkey AS property_id, CAST(12 + p_size % 40 AS INTEGER) AS total_units,
    CAST(12 + p_size % 40 - p_partkey % 7 - p_size % 5 AS INTEGER) AS available_units,
    CAST(p_partkey % 7 AS INTEGER) AS booked_units, CAST(p_size % 5 AS INTEGER) AS sold_units, '2024-04-01' AS last_updated,
    CASE WHEN p_size % 6 <> 0 THEN CAST(round(p_retailprice * 10000) AS BIGINT) END AS price_min,
    CASE WHEN p_size % 6 <> 0 THEN CAST(round(p_retailprice * 12000) AS BIGINT) END AS price_max,
    list_slice([{unit(1)}, {unit(2)}, {unit(3)}], 1, p_partkey % 4) AS unit_types,
    CASE WHEN p_partkey % 4 <> 0 THEN 'Under Construction' END AS construction_status,
    CASE WHEN p_size % 5 <> 0 THEN '2026-06-30' END AS rera_validity,
    CASE WHEN p_partkey % 3 <> 0 THEN 'note ' || p_partkey END AS manager_notes,
    CAST(p_partkey % 30 AS INTEGER) AS enquiries_this_month, CAST(p_partkey % 13 AS INTEGER) AS site_visits_this_month,
    CASE WHEN p_size % 4 <> 0 THEN CAST(p_partkey % 4 AS INTEGER) END AS conversions_this_month
  FROM part WHERE p_type <> 'ECONOMY')"""
UNITS = f"""{INVENTORY}, units AS (
  SELECT property_id, CAST(i - 1 AS INTEGER) AS position, u.type AS type, u.area AS area, u.price AS price,
    u.available AS available, u.total AS total, u.floor_range AS floor_range FROM (
    SELECT property_id, unnest(unit_types) AS u, generate_subscripts(unit_types, 1) AS i FROM inventory))"""


def inr(p: str) -> str:
    def one(x: str) -> str:
        return f"printf('%.1f', floor({x} * 10 + 0.5::DOUBLE) / 10)"
    return (f"CASE WHEN {p} >= 10000000 THEN {one(f'({p})::DOUBLE / 10000000')} || 'Cr' "
            f"WHEN {p} >= 100000 THEN {one(f'({p})::DOUBLE / 100000')} || 'L' "
            f"ELSE {indian(p)} END")


def indian(p: str) -> str:
    """Up to three decimals; below a thousand lakhs: the last three digits, then pairs."""
    t = f"CAST(floor(abs(({p})::DOUBLE) * 1000 + 0.5::DOUBLE) AS BIGINT)"
    n = f"({t} // 1000)"
    whole = (f"CASE WHEN {n} >= 10000000 THEN ({n} // 10000000) || ',' || lpad(CAST({n} // 100000 % 100 AS VARCHAR), 2, '0') || ',' || "
             f"lpad(CAST({n} // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') "
             f"WHEN {n} >= 100000 THEN ({n} // 100000) || ',' || lpad(CAST({n} // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') "
             f"WHEN {n} >= 1000 THEN ({n} // 1000) || ',' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END")
    part = f"CASE WHEN {t} % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST({t} % 1000 AS VARCHAR), 3, '0'), '0') END"
    return f"(CASE WHEN ({p}) < 0 AND {t} > 0 THEN '-' ELSE '' END || {whole} || {part})"


VIEW = f"""WITH {CATALOGUE}, {INVENTORY} SELECT id, substr(title, 1, 45) AS title, city, locality, coalesce(builder, '—') AS builder,
  coalesce(metro, '—') AS metro, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (
      'total_units', 'available_units', 'booked_units', 'sold_units', 'enquiries_this_month', 'site_visits_this_month',
      'conversions_this_month'))},
  coalesce(construction_status, 'Ready to Move') AS construction_status, coalesce(rera_validity, '') AS rera_validity,
  coalesce(manager_notes, '') AS manager_notes,
  coalesce('₹' || {inr('price_min')} || ' – ₹' || {inr('price_max')}, '') AS price_label
  FROM catalogue LEFT JOIN inventory ON id = property_id"""

ENQUIRIES = f"""enquiries AS (
  SELECT 'P' || o_custkey AS prop_id, o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, c_name AS name,
    CASE WHEN o_orderkey % 5 <> 0 THEN lower(replace(c_name, '#', '.') || '@mail.example') END AS email,
    o_totalprice * 100::DOUBLE AS budget, o_orderpriority AS source,
    {STATUS_LIST}[CAST(o_orderkey % 7 + 1 AS INT)] AS status,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 2 END AS followup
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
BADGE = case("status", {k: f"'{v}'" for k, v in S.STATUS_BADGES.items()}, "'badge-gray'")
SIGNUPS = """signups AS (
  SELECT c_custkey AS form_id, trim(CASE WHEN c_custkey % 17 = 0 THEN '  ' ELSE ' ' || split_part(c_name, '#', 1) END) AS first_name,
    split_part(c_name, '#', 2) AS last_name,
    lower(trim(' User' || c_custkey || CASE WHEN c_custkey % 11 = 0 THEN '.at.' ELSE '@' END || 'Mail.Example ')) AS email,
    3 + c_custkey % 9 AS password_length FROM customer), checked AS (
  SELECT form_id, first_name, last_name, email, CASE WHEN first_name = '' OR last_name = '' THEN 'name'
    WHEN NOT contains(email, '@') THEN 'email' WHEN password_length < 6 THEN 'password' END AS problem FROM signups)"""
EDITS = """edits AS (
  SELECT 'P' || l_partkey AS property_id, l_shipdate AS edited_at, l_orderkey * 10 + l_linenumber AS sequence,
    CAST(20 + l_quantity AS INTEGER) AS total_units, CAST(l_quantity AS INTEGER) AS available_units,
    CASE WHEN l_linestatus = 'F' THEN 'Ready to Move' END AS construction_status, 'mgr' || l_suppkey AS last_updated_by
  FROM lineitem), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY edited_at DESC, sequence DESC, total_units DESC,
    available_units DESC, construction_status DESC NULLS LAST, last_updated_by DESC) AS rn FROM edits), last_edit AS (
  SELECT * FROM ordered WHERE rn = 1)"""
UPSERT = f"""WITH {INVENTORY}, {EDITS} SELECT coalesce(e.property_id, i.property_id) AS property_id,
  coalesce(e.total_units, i.total_units) AS total_units, coalesce(e.available_units, i.available_units) AS available_units,
  booked_units, coalesce(e.construction_status, i.construction_status) AS construction_status,
  coalesce(strftime(e.edited_at, '%Y-%m-%d'), i.last_updated) AS last_updated, e.last_updated_by
  FROM inventory i FULL JOIN last_edit e ON i.property_id = e.property_id"""
BOOKED = f"""WITH {INVENTORY}, counts AS (
  SELECT 'P' || l_partkey AS property_id, count(*) AS n_edits, count(DISTINCT l_orderkey) AS n_enquiries
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""

STATS_ONLY = """stats AS (SELECT avg(price) AS m, stddev_samp(price) + 1e-9::DOUBLE AS s FROM listings), long AS (
  UNPIVOT (SELECT price, area_sqft, price_per_sqft, bedrooms::DOUBLE AS bedrooms, bathrooms::DOUBLE AS bathrooms, location_score
    FROM listings) ON price, area_sqft, price_per_sqft, bedrooms, bathrooms, location_score INTO NAME "column" VALUE v), fences AS (
  SELECT "column", quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY 1)"""
STATS = f"{LISTINGS}, {STATS_ONLY}"


def outside(column: str) -> str:
    f = f"(SELECT {{}} FROM fences WHERE \"column\" = '{column}')"
    low, high = f.format("q1 - 3 * (q3 - q1)"), f.format("q3 + 3 * (q3 - q1)")
    return f"({column} < {low} OR {column} > {high})"


def flags(source: str, bounds_known: str) -> str:
    return f"""f1 AS (
  SELECT *, {r('(price - (SELECT m FROM stats)) / (SELECT s FROM stats)', 4)} AS z_score_price FROM {source}), f2 AS (
  SELECT *, CAST(abs(z_score_price) > 3 AS INTEGER) AS is_anomaly_zscore,
    CAST(coalesce({bounds_known}, false) AS INTEGER) AS is_anomaly_iqr,
    CAST(price_per_sqft < 1000 OR price_per_sqft > 100000 AS INTEGER) AS is_anomaly_domain FROM f1), flagged AS (
  SELECT *, greatest(is_anomaly_zscore, is_anomaly_iqr, is_anomaly_domain) AS anomaly_flag,
    CASE WHEN is_anomaly_zscore + is_anomaly_iqr + is_anomaly_domain = 0 THEN 'normal' ELSE concat_ws('; ',
      CASE WHEN is_anomaly_zscore = 1 THEN printf('price Z=%.1f', round_even(z_score_price * 10, 0) / 10) END,
      CASE WHEN is_anomaly_iqr = 1 THEN 'IQR outlier' END,
      CASE WHEN is_anomaly_domain = 1 THEN 'price/sqft extreme' END) END AS anomaly_reason FROM f2)"""


ANY_OUTSIDE = " OR ".join(outside(c) for c in ("price", "area_sqft", "price_per_sqft", "bedrooms", "bathrooms", "location_score"))
FLAGGED = f"{STATS}, {flags('listings', ANY_OUTSIDE)}"
SUMMARY = f"""SELECT count(*) AS total_records, CAST(sum(anomaly_flag) AS BIGINT) AS total_anomalies, CAST(0 AS BIGINT) AS if_count,
  CAST(sum(is_anomaly_zscore) AS BIGINT) AS zscore_count, CAST(sum(is_anomaly_iqr) AS BIGINT) AS iqr_count,
  CAST(sum(is_anomaly_domain) AS BIGINT) AS domain_count, {r('sum(anomaly_flag)::DOUBLE * 100 / count(*)', 2)} AS anomaly_pct"""


def histogram(source: str, value: str) -> str:
    return f"""v AS (SELECT {value} AS x FROM {source}), e AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 60 AS w FROM v),
  c AS (SELECT CAST(least(floor((x - (SELECT lo FROM e)) / (SELECT w FROM e)), 59) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1)
  SELECT CAST(b AS INTEGER) AS bin, {r('(SELECT lo FROM e) + b * (SELECT w FROM e)', 6)} AS low,
    {r('(SELECT lo FROM e) + (b + 1) * (SELECT w FROM e)', 6)} AS high, coalesce(n, 0) AS count
  FROM range(60) t(b) LEFT JOIN c ON c.bin = b"""


NUMERIC = ["bedrooms", "bathrooms", "area_sqft", "age_years", "floor_number", "total_floors", "location_score", "price"]
TEXTS = ["property_id", "city", "locality", "property_type", "amenities"]


def describe() -> str:
    parts = []
    for c in TEXTS:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS "unique",
          (SELECT {c} FROM listings WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
          (SELECT count(*) FROM listings WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq,
          NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS p25, NULL::DOUBLE AS p50,
          NULL::DOUBLE AS p75, NULL::DOUBLE AS max FROM listings""")
    for c in NUMERIC + ["price_per_sqft", "amenities_count"]:
        x = f"{c}::DOUBLE"
        parts.append(f"""SELECT '{c}', count({c}), NULL, NULL, NULL, {r(f'avg({x})', 2)}, {r(f'stddev_samp({x})', 2)}, min({x}),
          {r(f'quantile_cont({x}, 0.25)', 4)}, {r(f'quantile_cont({x}, 0.5)', 4)}, {r(f'quantile_cont({x}, 0.75)', 4)}, max({x}) FROM listings""")
    return f"WITH {LISTINGS} " + " UNION ALL ".join(parts)


def correlations() -> str:
    names = NUMERIC + ["amenities_count"]
    parts = [
        f"SELECT '{b}' AS \"row\", '{a}' AS col, {r(f'corr({b}::DOUBLE, {a}::DOUBLE)', 6)} AS corr FROM listings"
        for i, a in enumerate(names) for b in names[i + 1:]]
    return f"WITH {LISTINGS} " + " UNION ALL ".join(parts)


def metrics(label: str, prediction: str, library: bool = False) -> str:
    base = f"greatest(abs({label}), 2.220446049250313e-16::DOUBLE)" if library else f"({label} + 1e-9::DOUBLE)"
    return (f"{r(f'1 - sum(({prediction} - {label}) * ({prediction} - {label})) / (var_pop({label}) * count(*))', 4)} AS r2, "
            f"{r(f'sqrt(avg(({prediction} - {label}) * ({prediction} - {label})))', 2)} AS rmse, "
            f"{r(f'avg(abs({prediction} - {label}))', 2)} AS mae, "
            f"{r(f'avg(abs(({prediction} - {label}) / {base})) * 100', 2)} AS mape")


RIVALS = f"""{VALUED}, rivals AS (
  SELECT 'Fair price' AS model, 0 AS position, price AS y, fair_price::DOUBLE AS p FROM valued UNION ALL
  SELECT 'City rate', 1, price, {case('city', {c: f'{v}::DOUBLE' for c, v in S.CITY_BASE.items()}, 'NULL')} * area_sqft FROM valued UNION ALL
  SELECT 'Flat rate', 2, price, area_sqft * 6000::DOUBLE FROM valued), scored AS (
  SELECT model, position, {metrics('y', 'p')} FROM rivals GROUP BY ALL)"""

FEATURES = ["bedrooms::DOUBLE", "bathrooms::DOUBLE", "area_sqft", "location_score", "amenities_count::DOUBLE",
            "coalesce(floor_number, 0)", "coalesce(age_years, 0)", "cc", "tc"]
CODED = f"""{LISTINGS}, cities AS (SELECT city, (row_number() OVER (ORDER BY city) - 1)::DOUBLE AS cc FROM listings GROUP BY city),
  kinds AS (SELECT property_type, (row_number() OVER (ORDER BY property_type) - 1)::DOUBLE AS tc FROM listings GROUP BY property_type),
  coded AS (SELECT l.*, cc, tc, {', '.join(f'{f} AS f{i}' for i, f in enumerate(FEATURES))}
    FROM listings l JOIN cities USING (city) JOIN kinds USING (property_type)),
  span AS (SELECT {', '.join(f'min(f{i}) AS lo{i}, CASE WHEN max(f{i}) = min(f{i}) THEN 1 ELSE max(f{i}) - min(f{i}) END AS w{i}' for i in range(9))} FROM coded),
  scaled AS (SELECT coded.*, {', '.join(f'(f{i} - lo{i}) / w{i} AS x{i}' for i in range(9))} FROM coded, span),
  asked AS (SELECT *, list_position({CITY_LIST}, city) * 10 + list_position({TYPE_LIST}, property_type) AS request_id FROM scaled
    QUALIFY row_number() OVER (PARTITION BY city, property_type ORDER BY listed_at DESC, property_id DESC) = 1)"""


def recommend(condition: str, n: int) -> str:
    dot = " + ".join(f"q.x{i} * c.x{i}" for i in range(9))
    nq = " + ".join(f"q.x{i} * q.x{i}" for i in range(9))
    nc = " + ".join(f"c.x{i} * c.x{i}" for i in range(9))
    norms = f"(sqrt({nq}) * sqrt({nc}))"
    return f"""WITH {CODED}, pairs AS (
  SELECT CAST(q.request_id AS BIGINT) AS request_id, c.property_id, c.city, c.locality, c.price,
    {r(f'CASE WHEN {norms} > 0 THEN ({dot}) / {norms} ELSE 0 END', 4)} AS similarity_score
  FROM asked q JOIN scaled c ON {condition})
  SELECT request_id, CAST(row_number() OVER w AS INTEGER) AS rank, property_id, city, locality, price, similarity_score FROM pairs
  WINDOW w AS (PARTITION BY request_id ORDER BY similarity_score DESC, property_id) QUALIFY row_number() OVER w <= {n}"""


def recommend_many() -> str:
    asked = ["c_custkey % 5 + 1", "c_custkey % 3 + 1", "400 + c_custkey % 40 * 50", "4::DOUBLE + (c_custkey % 60)::DOUBLE / 10::DOUBLE",
             "c_custkey % 9", "c_custkey % 20", "c_custkey % 30", "cc", "tc"]
    head, tail = recommend("q.city = c.city AND (q.price IS NULL OR c.price BETWEEN q.price * (1 - 0.3::DOUBLE) AND q.price * (1 + 0.3::DOUBLE))", 5).split(", pairs AS", 1)
    head = head[:head.rindex("asked AS (")]
    return f"""{head}
  wished AS (SELECT 'C' || c_custkey AS request_id, {CITY_LIST}[CAST(c_custkey % 10 + 1 AS INT)] AS city,
    {TYPE_LIST}[CAST(c_custkey % {len(S.PROPERTY_TYPES)} + 1 AS INT)] AS property_type,
    CASE WHEN c_custkey % 10 <> 0 THEN 1000000::DOUBLE + (c_custkey % 97)::DOUBLE * 100000::DOUBLE END AS price, c_custkey FROM customer),
  asked AS (SELECT request_id, w.city, w.price, {', '.join(f'(({x})::DOUBLE - lo{i}) / w{i} AS x{i}' for i, x in enumerate(asked))}
    FROM wished w JOIN cities USING (city) JOIN kinds USING (property_type), span), pairs AS{tail}""".replace(
        "CAST(q.request_id AS BIGINT) AS request_id", "q.request_id").replace(
        "SELECT request_id, CAST(row_number() OVER w AS INTEGER) AS rank, property_id, city, locality, price, similarity_score",
        "SELECT request_id, CAST(row_number() OVER w AS INTEGER) AS rank, property_id, similarity_score")


BAND = "c.price BETWEEN q.price * (1 - 0.3::DOUBLE) AND q.price * (1 + 0.3::DOUBLE)"
CARD_PRICE = "CAST(round_even(price, 0) AS BIGINT)"
CARDS = f"""{LISTINGS}, cards AS (
  SELECT property_id AS card_id, trim(' ' || bedrooms || ' BHK ' || property_type || ' in ' || locality || ' ') AS title,
    {CARD_PRICE} AS price,
    CASE WHEN day(listed_at) % 10 = 0 AND area_sqft >= 1000 THEN NULL ELSE CAST(area_sqft AS INTEGER) END AS area_sqft, locality FROM listings)"""
INTAKE = f"""{LISTINGS}, intake AS (
  SELECT property_id, CASE WHEN day(listed_at) <> 1 THEN city END AS city, locality, property_type,
    CASE WHEN day(listed_at) = 2 THEN 0 WHEN day(listed_at) = 3 THEN 11 ELSE bedrooms END AS bedrooms,
    CASE WHEN day(listed_at) <> 4 THEN bathrooms END AS bathrooms,
    CASE WHEN day(listed_at) = 5 THEN 0::DOUBLE ELSE area_sqft END AS area_sqft,
    CASE WHEN month(listed_at) = 2 THEN 11::DOUBLE ELSE location_score END AS location_score,
    CASE WHEN day(listed_at) <> 6 THEN price END AS price FROM listings), checked AS (
  SELECT *, concat_ws(',', CASE WHEN city IS NULL THEN 'city_missing' END,
    CASE WHEN bedrooms NOT BETWEEN 1 AND 10 THEN 'bedrooms_range' END,
    CASE WHEN bathrooms IS NULL THEN 'bathrooms_missing' END,
    CASE WHEN area_sqft <= 0 THEN 'area_not_positive' END,
    CASE WHEN location_score NOT BETWEEN 0 AND 10 THEN 'location_range' END,
    CASE WHEN price IS NULL THEN 'price_missing' END) AS violations FROM intake)"""
SPLIT_KEY = "CAST('0x' || substr(md5(property_id || '42'), 1, 13) AS BIGINT)"


def windows(length: str, slide: str, steps: int) -> str:
    """Tumbling windows are the case of one step."""
    return f"""SELECT window_start, window_start + INTERVAL {length} AS window_end, event_type, count(*) AS events FROM (
    SELECT event_type, time_bucket(INTERVAL {slide}, ts) - k * INTERVAL {slide} AS window_start, ts
    FROM events, range({steps}) s(k)) WHERE ts < window_start + INTERVAL {length} GROUP BY ALL"""


TUMBLING = windows("1 HOUR", "1 HOUR", 1)
SLIDING = windows("2 HOUR", "30 MINUTE", 4)
LOGINS = "SELECT user_id, count(*) AS login_count, max(ts) AS last_login FROM events WHERE event_type = 'view' GROUP BY 1"

SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR
  THEN 0 ELSE 1 END AS fresh FROM events), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
  SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS events FROM n GROUP BY user_id, s"""
ORACLE: dict[str, str] = {
    "listings_scan": f"WITH {LISTINGS} SELECT * EXCLUDE (amenities_count) FROM listings",
    "csv_roundtrip": f"WITH {LISTINGS} SELECT * EXCLUDE (amenities_count, listed_at) FROM listings",
    "csv_quarantine": f"""WITH {LISTINGS}, k AS (SELECT property_id, price, string_split(property_id, '-')[3]::BIGINT % 9 IN (4, 5) AS bad FROM listings)
        SELECT property_id, CASE WHEN bad THEN 0 ELSE 1 END::INTEGER AS readable, CASE WHEN NOT bad THEN price END AS price FROM k""",
    "request_quarantine": """SELECT 'C' || c_custkey AS request_id, CASE WHEN c_custkey % 11 IN (3, 5) THEN 0 ELSE 1 END::INTEGER AS readable,
        CASE WHEN c_custkey % 11 NOT IN (3, 5) AND c_custkey % 10 <> 0 THEN 1e6::DOUBLE + c_custkey % 97 * 1e5::DOUBLE END AS price FROM customer""",
    "partitioned_sink": f"WITH {ENRICHED} SELECT city, property_age_group, count(*) AS listings, {r('sum(value_score)', 2)} AS value_score_sum FROM enriched GROUP BY ALL",
    "anomaly_sink": f"WITH {FLAGGED} SELECT property_id, anomaly_reason, price FROM flagged WHERE anomaly_flag = 1",
    "inventory_by_id_scan": f"WITH {INVENTORY} SELECT property_id, total_units, available_units, construction_status, price_max, len(unit_types)::INTEGER AS unit_types FROM inventory",
    "inventory_file_scan": f"WITH {INVENTORY} SELECT property_id, total_units, available_units, construction_status, price_max, len(unit_types)::INTEGER AS unit_types FROM inventory",
    "json_roundtrip": f"WITH {CATALOGUE} SELECT id, title, price, amenities, metro, 'available' AS status FROM catalogue",
    "catalogue_file_scan": f"WITH {CATALOGUE} SELECT id, title, price, amenities, metro, 'available' AS status FROM catalogue",
    "unit_types_explode": f"WITH {UNITS} SELECT *, '' AS facing, 'Included' AS parking FROM units",
    "unit_types_keep_empty": f"WITH {UNITS} SELECT i.property_id, position, type, 'Included' AS parking FROM inventory i LEFT JOIN units u ON i.property_id = u.property_id",
    "page_extract": """SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
        trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS h1, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM pages""",
    "listing_cards": f"WITH {CARDS} SELECT * FROM cards WHERE area_sqft IS NOT NULL",
    "listing_cards_quarantine": f"WITH {CARDS} SELECT 'area' AS problem, locality, count(*) AS cards FROM cards WHERE area_sqft IS NULL GROUP BY ALL",
    "supported_cities": f"""WITH {LISTINGS}, known AS (SELECT unnest({CITY_LIST}) AS city, unnest(range(10)) AS position)
        SELECT k.city, CAST(position AS INTEGER) AS position, (SELECT count(*) FROM listings l WHERE l.city = k.city) AS listings FROM known k""",
    "display_projection": f"WITH {LISTINGS} SELECT property_id, city, locality, property_type, bedrooms, area_sqft, price, location_score FROM listings",
    "feature_frame": f"""WITH {ENRICHED} SELECT property_id, {', '.join(f'{c}::DOUBLE AS {c}' for c in NUMERIC[:-1] + [
        'amenities_count', 'amenities_score', 'bed_bath_ratio', 'floor_ratio', 'area_per_bedroom', 'city_price_index',
        'is_premium_locality', 'value_score'])}, 0::DOUBLE AS absent_feature FROM enriched""",
    "price_band_same_city": f"""WITH {LISTINGS} SELECT property_id, city, property_type, area_sqft, location_score, price, bedrooms FROM listings
        WHERE city = 'Pune' AND price BETWEEN 6000000 * 0.7::DOUBLE AND 6000000 * 1.3::DOUBLE""",
    "price_band_disabled": f"WITH {LISTINGS} SELECT property_id, price FROM listings WHERE city = 'Surat'",
    "validate_listings": f"WITH {INTAKE} SELECT property_id, violations FROM checked",
    "valid_listings": f"WITH {INTAKE} SELECT * EXCLUDE (violations) FROM checked WHERE violations = ''",
    "validate_requests": f"""WITH {LISTINGS} SELECT property_id, concat_ws(',',
        CASE WHEN day(listed_at) - 2 NOT BETWEEN 1 AND 20 THEN 'top_n_range' END,
        CASE WHEN month(listed_at) * 10 - 5 NOT BETWEEN 0 AND 100 THEN 'tolerance_range' END,
        CASE WHEN day(listed_at) = 31 THEN 'price_not_positive' END) AS violations FROM listings""",
    "signup_checks": f"WITH {SIGNUPS} SELECT * FROM checked",
    "signup_dedupe": f"""WITH {SIGNUPS} SELECT * EXCLUDE (problem) FROM checked WHERE problem IS NULL AND email NOT IN (
        SELECT 'user' || user_id || '@mail.example' FROM events WHERE event_type = 'signup')""",
    "followup_overdue": f"WITH {ENQUIRIES} SELECT id, prop_id, followup FROM enquiries WHERE followup < DATE '{BOOK_AS_OF}'",
    "property_lookup": f"SELECT * FROM ({VIEW}) WHERE id = 'P7'",
    "features_enriched": f"""WITH {ENRICHED} SELECT property_id, amenities_count::INTEGER AS amenities_count, amenities_score, bed_bath_ratio,
        floor_ratio, area_per_bedroom, city_price_index, is_premium_locality, property_age_group, value_score, price_per_sqft FROM enriched""",
    "amenities_features": f"WITH {ENRICHED} SELECT property_id, amenities_count::INTEGER AS amenities_count, amenities_score FROM enriched",
    "ratio_features": f"WITH {ENRICHED} SELECT property_id, bed_bath_ratio, floor_ratio, area_per_bedroom FROM enriched",
    "location_features": f"WITH {ENRICHED} SELECT city, locality, max(city_price_index) AS city_price_index, CAST(sum(is_premium_locality) AS BIGINT) AS premium_listings FROM enriched GROUP BY ALL",
    "age_group_counts": f"WITH {ENRICHED} SELECT property_age_group, count(*) AS listings FROM enriched GROUP BY ALL",
    "value_score": f"""WITH {ENRICHED} SELECT city, {r('avg(value_score)', 6)} AS avg_score, min(value_score) AS low, max(value_score) AS high,
        count(*) FILTER (value_score IS NULL) AS unscored FROM enriched GROUP BY ALL""",
    "fair_price": f"WITH {VALUED} SELECT property_id, fair_ppsf, fair_price, {r('price - fair_price::DOUBLE', 2)} AS price_gap FROM valued",
    "sql_function_features": f"""WITH {ENRICHED} SELECT property_id, amenities_count::INTEGER AS amenities_count, property_age_group, is_premium_locality,
        {inr('price')} AS price_label, value_score FROM enriched""",
    "investment_bulk": f"""WITH {LISTINGS}, {invest_cte({}, 'listings', CITY_ADJUST)} SELECT property_id, gross_annual_rent, net_annual_rent,
        gross_rental_yield, net_rental_yield, roi_5yr_pct, roi_10yr_pct, projected_value_5yr, projected_value_10yr, loan_amount,
        monthly_emi, break_even_years, investment_grade, {RECOMMENDATION} AS recommendation FROM graded""",
    "investment_sink": f"""WITH {LISTINGS}, {invest_cte({}, 'listings', CITY_ADJUST)} SELECT investment_grade, count(*) AS listings,
        {r('avg(monthly_emi)', 2)} AS mean_emi FROM graded GROUP BY 1""",
    "investment_preview": f"""WITH {LISTINGS}, {invest_cte({}, 'listings', CITY_ADJUST)} SELECT property_id, break_even_years, investment_grade
        FROM graded ORDER BY break_even_years, property_id LIMIT 10""",
    "price_per_area": f"WITH {LISTINGS} SELECT property_id, {r('price / area_sqft', 6)} AS price_per_sqft FROM listings",
    "added_columns": f"WITH {ENRICHED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"values\" FROM enriched" for c in (
            "amenities_count", "amenities_score", "bed_bath_ratio", "floor_ratio", "area_per_bedroom", "city_price_index",
            "is_premium_locality", "property_age_group", "value_score")),
    "isolation_forest": "SELECT count(*) AS rows, true AS near_contamination, true AS dear_score_lower, 0 AS unexplained FROM lineitem",
    "investment_grade_by_city": f"WITH {LISTINGS}, {invest_cte({}, 'listings', CITY_ADJUST)} {GRADES_BY_CITY}",
    "investment_custom_config": f"WITH {LISTINGS}, {invest_cte(HIGH_YIELD, 'listings', CITY_ADJUST)} {GRADES_BY_CITY}",
    "investment_city_yields": f"""WITH {LISTINGS}, yields AS (
        SELECT city, {r('1 - avg(price / area_sqft) / 20000::DOUBLE', 2)} AS ya FROM listings GROUP BY 1),
        joined AS (SELECT l.*, ya FROM listings l JOIN yields USING (city)), {invest_cte({}, 'joined', 'ya')}
        SELECT city, investment_grade, count(*) AS listings, {r('avg(gross_rental_yield)', 4)} AS avg_gross_yield FROM graded GROUP BY ALL""",
    "describe_all": describe(),
    "null_counts": f"""WITH {RAW_LISTINGS} SELECT 'age_years' AS "column", count(*) AS nulls FROM raw_listings WHERE age_years IS NULL UNION ALL
        SELECT 'floor_number', count(*) FROM raw_listings WHERE floor_number IS NULL UNION ALL
        SELECT 'amenities', count(*) FROM raw_listings WHERE amenities IS NULL""",
    "median_price_by_city": f"WITH {LISTINGS} SELECT city, {r('median(price)', 2)} AS median_price FROM listings GROUP BY 1",
    "boxplot_by_city": f"""WITH {LISTINGS}, q AS (SELECT city, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b,
        quantile_cont(price, 0.75) AS c FROM listings GROUP BY 1)
        SELECT city, {r('any_value(a)', 2)} AS q1, {r('any_value(b)', 2)} AS median, {r('any_value(c)', 2)} AS q3,
          {r('min(price) FILTER (price >= a - 1.5::DOUBLE * (c - a))', 2)} AS whisker_low,
          {r('max(price) FILTER (price <= c + 1.5::DOUBLE * (c - a))', 2)} AS whisker_high
        FROM listings JOIN q USING (city) GROUP BY city""",
    "mean_price_by_type": f"WITH {LISTINGS} SELECT property_type, {r('avg(price / 1000000::DOUBLE)', 6)} AS mean_price_m FROM listings GROUP BY 1",
    "city_stats_lakhs": f"""WITH {LISTINGS} SELECT city, {r('avg(price)', 2)} AS mean_price, {r('median(price)', 2)} AS median_price,
        count(*) AS listings, {r('avg(price) / 100000', 1)} AS mean_lakhs, {r('median(price) / 100000', 1)} AS median_lakhs FROM listings GROUP BY 1""",
    "bedroom_counts": f"WITH {LISTINGS} SELECT bedrooms, count(*) AS listings FROM listings GROUP BY 1",
    "price_histogram": f"WITH {LISTINGS}, {histogram('listings', 'price / 1000000::DOUBLE')}",
    "log_price_histogram": f"WITH {LISTINGS}, {histogram('listings', 'ln(1::DOUBLE + price)')}",
    "price_corr": correlations(),
    "location_trend": f"""WITH {LISTINGS} SELECT {r('regr_slope(price / 1000000::DOUBLE, location_score)', 6)} AS slope,
        {r('regr_intercept(price / 1000000::DOUBLE, location_score)', 6)} AS intercept, min(location_score) AS x_min, max(location_score) AS x_max FROM listings""",
    "trend_points": f"""WITH {LISTINGS}, t AS (SELECT regr_slope(price / 1000000::DOUBLE, location_score) AS m,
        regr_intercept(price / 1000000::DOUBLE, location_score) AS b, min(location_score) AS lo, max(location_score) AS hi FROM listings)
        SELECT CAST(i AS INTEGER) AS i, {r('lo + i * (hi - lo) / 99', 6)} AS x, {r('m * (lo + i * (hi - lo) / 99) + b', 6)} AS y FROM t, range(100) g(i)""",
    "area_price_series": f"WITH {LISTINGS} SELECT property_id, area_sqft, {r('price / 1000000::DOUBLE', 6)} AS price_m, bedrooms, location_score FROM listings",
    "area_price_grid": f"""WITH {LISTINGS} SELECT floor(area_sqft / 100) * 100 AS area_from, floor(price / 1000000::DOUBLE) AS price_from_m, bedrooms,
        count(*) AS listings FROM listings GROUP BY ALL""",
    "iqr_bounds": f"""WITH {STATS} SELECT "column", {r('q1', 4)} AS q1, {r('q3', 4)} AS q3, {r('q3 - q1', 4)} AS iqr,
        {r('q1 - 3 * (q3 - q1)', 4)} AS lower, {r('q3 + 3 * (q3 - q1)', 4)} AS upper FROM fences""",
    "price_moments": f"WITH {LISTINGS} SELECT {r('avg(price)', 2)} AS price_mean, {r('stddev_samp(price)', 2)} AS price_std FROM listings",
    "anomaly_stat_flags": f"WITH {FLAGGED} SELECT property_id, z_score_price, is_anomaly_zscore, is_anomaly_iqr, is_anomaly_domain, anomaly_flag FROM flagged",
    "anomaly_reasons": f"WITH {FLAGGED} SELECT property_id, anomaly_reason FROM flagged",
    "anomaly_listings": f"WITH {FLAGGED} SELECT property_id, city, price, anomaly_reason FROM flagged WHERE anomaly_flag = 1",
    "anomaly_summary": f"WITH {FLAGGED} {SUMMARY} FROM flagged",
    "anomaly_batch_mode": f"""WITH {STATS.replace('FROM listings), long', "FROM listings WHERE listed_at >= DATE '1999-01-01'), long").replace(
        'FROM listings) ON', "FROM listings WHERE listed_at < DATE '1999-01-01') ON")},
        late AS (SELECT * FROM listings WHERE listed_at >= DATE '1999-01-01'), {flags('late', ANY_OUTSIDE)} {SUMMARY} FROM flagged""",
    "label_encode": f"""WITH {LISTINGS}, a AS (SELECT city, row_number() OVER (ORDER BY city) - 1 AS n FROM listings GROUP BY 1),
        b AS (SELECT locality, row_number() OVER (ORDER BY locality) - 1 AS n FROM listings GROUP BY 1),
        c AS (SELECT property_type, row_number() OVER (ORDER BY property_type) - 1 AS n FROM listings GROUP BY 1)
        SELECT property_id, a.n::INTEGER AS city, b.n::INTEGER AS locality, c.n::INTEGER AS property_type
        FROM listings JOIN a USING (city) JOIN b USING (locality) JOIN c USING (property_type)""",
    "encode_unseen": f"""WITH {LISTINGS}, early AS (SELECT * FROM listings WHERE city <> 'Surat' AND property_type <> 'Villa'),
        a AS (SELECT city, row_number() OVER (ORDER BY city) - 1 AS n FROM early GROUP BY 1),
        c AS (SELECT property_type, row_number() OVER (ORDER BY property_type) - 1 AS n FROM early GROUP BY 1)
        SELECT coalesce(a.n, 0)::INTEGER AS city, coalesce(c.n, 0)::INTEGER AS property_type, count(*) AS listings
        FROM listings LEFT JOIN a USING (city) LEFT JOIN c USING (property_type) GROUP BY 1, 2""",
    "impute_median": f"""WITH {LISTINGS}, m AS (SELECT median(age_years) AS a, median(floor_number) AS f FROM listings)
        SELECT property_id, coalesce(age_years, a) AS age_years, coalesce(floor_number, f) AS floor_number, total_floors FROM listings, m""",
    "standard_scale": f"""WITH {LISTINGS}, p AS (SELECT avg(area_sqft) AS a, stddev_pop(area_sqft) AS sa, avg(location_score) AS b,
        stddev_pop(location_score) AS sb, avg(bedrooms) AS c, stddev_pop(bedrooms::DOUBLE) AS sc FROM listings)
        SELECT property_id, {r('(area_sqft - a) / sa', 6)} AS area_sqft, {r('(location_score - b) / sb', 6)} AS location_score,
        {r('(bedrooms - c) / sc', 6)} AS bedrooms FROM listings, p""",
    "minmax_scale": f"""WITH {CODED} SELECT property_id, {', '.join(f'{r(f"x{i}", 6)} AS {c}' for i, c in enumerate([
        "bedrooms", "bathrooms", "area_sqft", "location_score", "amenities_count", "floor_number", "age_years", "city_encoded",
        "property_type_encoded"]))} FROM scaled""",
    "train_test_split": f"""WITH {LISTINGS}, k AS (SELECT property_id, {SPLIT_KEY} AS h FROM listings),
        t AS (SELECT h FROM k QUALIFY row_number() OVER (ORDER BY h) = (SELECT ceil(0.2::DOUBLE * count(*)) FROM k))
        SELECT property_id, CAST(h <= (SELECT h FROM t) AS INTEGER) AS is_test FROM k""",
    "share_split": f"WITH {LISTINGS} SELECT property_id, CAST({SPLIT_KEY} < {int(0.2 * 16 ** 13)} AS INTEGER) AS is_test FROM listings",
    "recommend_batch": recommend(f"q.city = c.city AND {BAND}", 5),
    "recommend_no_city": recommend(BAND, 5),
    "recommend_unfiltered": recommend("true", 10),
    "recommend_many": recommend_many(),
    "embedding_topk": f"""WITH asked AS (SELECT label::BIGINT AS request_id, label, embedding FROM embeddings QUALIFY row_number() OVER (
        PARTITION BY label ORDER BY vec_id) = 1), pairs AS (SELECT request_id, vec_id, e.label,
        {r('list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])', 4)} AS similarity_score FROM asked q JOIN embeddings e USING (label))
        SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank FROM pairs
        WINDOW w AS (PARTITION BY request_id ORDER BY similarity_score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "inventory_join": VIEW,
    "latest_edit": f"WITH {EDITS} SELECT * EXCLUDE (rn) FROM last_edit",
    "inventory_upsert": UPSERT,
    "inventory_audit": """SELECT 'inventory_update' AS type, 'mgr' || l_suppkey AS manager, count(*) AS edits, max(l_shipdate) AS last_edit
        FROM lineitem GROUP BY ALL""",
    "array_edit": f"""WITH {INVENTORY}, u AS (SELECT property_id, list_append([[x.type, x.available::VARCHAR] FOR x IN unit_types],
        ['New Unit Type', '5']) AS l FROM inventory)
        SELECT property_id, array_to_string(list_transform(list_filter(list_transform(l, lambda x, i: {{'t': x[1],
          'a': CASE WHEN i = 1 THEN '99' ELSE x[2] END, 'i': i}}), lambda y: y.i <> 2), lambda z: z.t || ':' || z.a), ',') AS units FROM u""",
    "unit_remove": f"WITH {UNITS} SELECT property_id, position, type, available FROM units WHERE available <> 0",
    "booking_transitions": f"""{BOOKED} SELECT property_id, CAST(booked_units + coalesce(n_enquiries, 0) AS INTEGER) AS booked_units,
        CAST(greatest(available_units - coalesce(n_enquiries, 0), 0) AS INTEGER) AS available_units,
        CAST(booked_units + coalesce(n_edits, 0) AS INTEGER) AS booked_each_edit,
        CAST(greatest(available_units - coalesce(n_edits, 0), 0) AS INTEGER) AS available_each_edit
        FROM inventory LEFT JOIN counts USING (property_id)""",
    "funnel_unpivot": f"""WITH {INVENTORY}, f AS (SELECT property_id, enquiries_this_month AS e, site_visits_this_month AS v,
        coalesce(conversions_this_month, 0) AS c FROM inventory)
        SELECT property_id, 0 AS step, 'Enquiries' AS stage, e AS value, NULL::DOUBLE AS share FROM f UNION ALL
        SELECT property_id, 1, 'Site Visits', v, CASE WHEN e <> 0 THEN {r('v::DOUBLE / e', 6)} END FROM f UNION ALL
        SELECT property_id, 2, 'Conversions', c, CASE WHEN v <> 0 THEN {r('c::DOUBLE / v', 6)} END FROM f""",
    "enquiry_union": f"""WITH {ENQUIRIES}, {SIGNUPS} SELECT prop_id, id, date, name, email, status, followup FROM enquiries UNION ALL
        SELECT 'P0', form_id, DATE '{BOOK_AS_OF}', first_name, email, 'new', DATE '{BOOK_AS_OF}' + 2 FROM signups WHERE first_name <> ''""",
    "enquiry_table": f"""WITH {ENQUIRIES} SELECT prop_id, id, strftime(date, '%d %b %Y') AS date_label, name, coalesce(email, '—') AS email,
        {inr('budget')} AS budget_label, source, status, {BADGE} AS badge, coalesce(followup::VARCHAR, '—') AS followup,
        CAST(coalesce(followup < DATE '{BOOK_AS_OF}', false) AS INTEGER) AS overdue FROM enquiries""",
    "enquiry_counts": f"WITH {ENQUIRIES} SELECT prop_id, strftime(date, '%Y-%m') AS month, count(*) AS enquiries FROM enquiries GROUP BY ALL",
    "offers_edit": """SELECT 'P' || p_partkey AS prop_id, 0 AS position, p_name AS title, p_type AS "desc", '2024-06-30' AS valid
        FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT 'P' || p_partkey, 1, p_brand, '', 'Ongoing' FROM part WHERE p_size > 10""",
    "price_label": f"""SELECT o_orderkey, {inr('o_totalprice * 40::DOUBLE')} AS label, {inr('(o_totalprice % 100000 - 30000)')} AS small_label FROM orders""",
    "date_label": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%d %b %Y') ELSE '—' END AS label,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) + 2 ELSE DATE '1970-01-01' END AS followup FROM orders""",
    "status_lookup": f"WITH {ENQUIRIES} SELECT status, {BADGE} AS badge, count(*) AS enquiries FROM enquiries GROUP BY ALL",
    "text_numbers": f"""WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0::DOUBLE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)
        SELECT c_custkey, {r('v', 2)} AS value, {r('greatest(0::DOUBLE, v)', 2)} AS floored FROM t""",
    "text_fields": """SELECT p_partkey, replace(lower(p_name), ' ', '_') AS slug, substr(p_name, 1, 6) AS short,
        (p_size % 5) || ' BHK ' || p_type || ' by ' || p_brand AS title, CAST(contains(p_name, 'red') AS INTEGER) AS mentions_red FROM part""",
    "login_state": LOGINS,
    "session_valid": f"""WITH l AS (SELECT user_id, max(ts) AS last_login FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '{LOG_AS_OF}' GROUP BY 1)
        SELECT user_id, last_login, {r(f"(epoch_us(TIMESTAMP '{LOG_AS_OF}') - epoch_us(last_login))::DOUBLE / 3.6e9::DOUBLE", 6)} AS age_hours,
        CAST(last_login > TIMESTAMP '{LOG_AS_OF}' - INTERVAL 24 HOUR AS INTEGER) AS is_valid FROM l""",
    "session_windows": SESSIONS,
    "stream_sessions": SESSIONS,
    "event_counts_tumbling": TUMBLING,
    "event_counts_sliding": SLIDING,
    "event_log_append": "SELECT 'user_login' AS type, user_id::VARCHAR AS user_id, ts AS timestamp FROM events",
    "metrics_fixed_predictions": f"WITH {VALUED} SELECT city, {metrics('price', 'fair_price::DOUBLE')} FROM valued GROUP BY city",
    "evaluation_fixed_predictions": f"""WITH {VALUED}, c AS (SELECT city, price, greatest(fair_price::DOUBLE - 5000000, 0::DOUBLE) AS p FROM valued)
        SELECT city, {metrics('price', 'p', True)} FROM c GROUP BY city""",
    "residual_histogram": f"WITH {VALUED}, {histogram('valued', '(fair_price::DOUBLE - price) / 1000000::DOUBLE')}",
    "actual_vs_predicted": f"""WITH {VALUED} SELECT property_id, {r('price / 1000000::DOUBLE', 6)} AS actual_m,
        {r('fair_price::DOUBLE / 1000000::DOUBLE', 6)} AS predicted_m FROM valued""",
    "predicted_band": f"""WITH {VALUED}, c AS (SELECT property_id, area_sqft, greatest(fair_price::DOUBLE - 5000000, 0::DOUBLE) AS p FROM valued)
        SELECT property_id, 'Fair price' AS model_used, {r('p', 2)} AS predicted_price, {r('p * 0.9::DOUBLE', 2)} AS price_range_low,
        {r('p * 1.1::DOUBLE', 2)} AS price_range_high, {r('p / area_sqft', 2)} AS predicted_ppsf FROM c""",
    "model_metrics_long": f"WITH {RIVALS} SELECT model, metric, value FROM (UNPIVOT scored ON r2, rmse, mae, mape INTO NAME metric VALUE value)",
    "metrics_file": f"WITH {RIVALS} SELECT model, metric, value FROM (UNPIVOT scored ON r2, rmse, mae, mape INTO NAME metric VALUE value)",
    "best_model_argmax": f"WITH {RIVALS} SELECT * FROM scored ORDER BY r2 DESC, position LIMIT 1",
    "stream_event_counts": TUMBLING,
    "stream_final_counts": f"SELECT * FROM ({TUMBLING}) WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR",
    "stream_closed_sessions": f"""SELECT * FROM ({SESSIONS})
        WHERE last_event + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR""",
    "stream_booking_redelivered": "SELECT 'P' || l_partkey AS property_id, count(*) AS booked_edits FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
    "stream_event_counts_sliding": SLIDING,
    "stream_login_state": LOGINS,
    "stream_booking": f"""{BOOKED} SELECT property_id, CAST(booked_units + coalesce(n_enquiries, 0) AS INTEGER) AS booked_units,
        CAST(greatest(available_units - coalesce(n_enquiries, 0), 0) AS INTEGER) AS available_units FROM inventory LEFT JOIN counts USING (property_id)""",
    "stream_inventory_upsert": UPSERT,
    "stream_event_log": "SELECT 'user_login' AS type, user_id::VARCHAR AS user_id, ts AS timestamp FROM events",
    "stream_scoring": f"""WITH {ENRICHED}, {STATS_ONLY},
        {flags('enriched', ANY_OUTSIDE)}, {invest_cte({}, 'flagged', CITY_ADJUST)}
        SELECT property_id, value_score, z_score_price, anomaly_flag, anomaly_reason, monthly_emi, investment_grade FROM graded""",
}

ORACLE["profile_suite"] = " UNION ALL ".join(
    f"SELECT '{part}' AS part, count(*) AS rows FROM ({ORACLE[name]})" for part, name in {
        "summary": "describe_all", "price_histogram": "price_histogram", "log_price_histogram": "log_price_histogram",
        "price_by_city": "boxplot_by_city", "price_by_type": "mean_price_by_type", "correlations": "price_corr",
        "area_price": "area_price_grid", "bedrooms": "bedroom_counts", "location_trend": "location_trend"}.items())

# ---- models: trained on prices that follow the valuation rule ------------------------------------------------
CODED_FEATURES = ["city", "locality", "property_type"]
NUMBER_FEATURES = [
    "bedrooms", "bathrooms", "area_sqft", "age_years", "floor_number", "total_floors", "location_score", "amenities_count",
    "amenities_score", "bed_bath_ratio", "floor_ratio", "area_per_bedroom", "city_price_index", "is_premium_locality", "value_score"]
ORACLE["prepared_features"] = f"""WITH {ENRICHED}, {VALUED.replace(LISTINGS + ', ', '').replace('FROM listings', 'FROM enriched')}, base AS (
  SELECT *, fair_price::DOUBLE AS label, {SPLIT_KEY} AS h FROM valued),
t AS (SELECT h FROM base QUALIFY row_number() OVER (ORDER BY h) = (SELECT ceil(0.2::DOUBLE * count(*)) FROM base)),
filled AS (SELECT property_id, label, h <= (SELECT h FROM t) AS is_test,
  {', '.join(f"(dense_rank() OVER (ORDER BY {c}) - 1)::DOUBLE AS {c}" for c in CODED_FEATURES)},
  {', '.join(f"coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM enriched)) AS {c}" for c in NUMBER_FEATURES)} FROM base),
moments AS (SELECT {', '.join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in CODED_FEATURES + NUMBER_FEATURES)}
  FROM filled WHERE NOT is_test)
SELECT property_id, CAST(is_test AS INTEGER) AS is_test, label, {', '.join(r(f'({c} - m_{c}) / s_{c}', 4) + f' AS {c}' for c in CODED_FEATURES + NUMBER_FEATURES)}
FROM filled, moments"""
ORACLE["preparation_stage"] = ORACLE["prepared_features"].replace("FROM filled WHERE NOT is_test", "FROM filled").replace(
    "CAST(is_test AS INTEGER) AS is_test, ", "")
NO_GRADIENT = "SELECT CAST(i AS INTEGER) AS position, 0::DOUBLE AS gradient FROM range(19) t(i)"
HELD = "CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT)"
MODELS = ["Linear Regression", "Ridge Regression", "Random Forest", "Gradient Boosting", "Neural Network"]
ORACLE |= {
    "model_linear": NO_GRADIENT,
    "model_ridge": NO_GRADIENT,
    **{query: f"SELECT '{name}' AS model, {HELD} AS scored, true AS above_half, true AS beats_linear FROM lineitem"
       for query, name in (("model_forest", "Random Forest"), ("model_gbt", "Gradient Boosting"), ("model_mlp", "Neural Network"))},
    "model_huber": "SELECT true AS explains, true AS mae_below_rmse",
    "model_comparison": " UNION ALL ".join(
        f"SELECT '{name}' AS model, CAST({i} AS INTEGER) AS position, true AS explains, true AS ranked" for i, name in enumerate(MODELS)),
    "model_registry": "SELECT true AS best_is_active, 'loaded' AS status, CAST(5 AS INTEGER) AS models",
    "model_reevaluation": " UNION ALL ".join(f"SELECT '{name}' AS model, true AS agrees" for name in MODELS),
    "predict_batch": f"""WITH {LISTINGS}, k AS (SELECT property_id, {SPLIT_KEY} AS h FROM listings),
        t AS (SELECT h FROM k QUALIFY row_number() OVER (ORDER BY h) = (SELECT ceil(0.2::DOUBLE * count(*)) FROM k))
        SELECT property_id, true AS best_used, true AS band FROM k WHERE h <= (SELECT h FROM t)""",
    "feature_importance": " UNION ALL ".join(
        f"SELECT '{name}' AS model, CAST(18 AS BIGINT) AS features, 1::DOUBLE AS total" for name in MODELS[2:4]),
    "training_history": "SELECT 'Robust Regression' AS model, 'loss' AS metric, true AS several, true AS falls UNION ALL "
                        + " UNION ALL ".join(f"SELECT 'Neural Network', '{m}', true, true" for m in ("loss", "val_loss", "mae")),
    "market_report": f"""WITH {LISTINGS}, {invest_cte({}, 'listings', CITY_ADJUST)} SELECT 'grade' AS section, investment_grade AS name,
        count(*)::DOUBLE AS value FROM graded GROUP BY 2 UNION ALL SELECT 'model', 'lines', 20 UNION ALL SELECT 'best', 'lines', 1
        UNION ALL SELECT 'anomaly', 'lines', 7""",
}
