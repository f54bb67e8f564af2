"""Schemas and the fixed dimension values of the listing domain."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------
# city -> base price per square foot, rental-yield adjustment, localities
CITIES = {
    "Mumbai": (25000.0, -0.5, ["Bandra", "Andheri", "Worli", "Juhu", "Powai"]),
    "Pune": (9000.0, 0.3, ["Koregaon Park", "Hinjewadi", "Kothrud", "Viman Nagar", "Baner"]),
    "Bangalore": (12000.0, 0.5, ["Whitefield", "Koramangala", "Indiranagar", "HSR Layout", "Marathahalli"]),
    "Hyderabad": (8500.0, 0.8, ["Gachibowli", "Hitech City", "Banjara Hills", "Jubilee Hills", "Madhapur"]),
    "Chennai": (9500.0, 0.2, ["Anna Nagar", "Velachery", "OMR", "Adyar", "T.Nagar"]),
    "Delhi": (18000.0, -0.3, ["Dwarka", "Vasant Kunj", "Rohini", "Saket", "Lajpat Nagar"]),
    "Kolkata": (7000.0, 0.6, ["Salt Lake", "New Town", "Alipore", "Ballygunge", "Park Street"]),
    "Ahmedabad": (6500.0, 0.9, ["Bodakdev", "Satellite", "Prahlad Nagar", "Navrangpura", "Thaltej"]),
    "Jaipur": (6000.0, 1.0, ["C-Scheme", "Vaishali Nagar", "Malviya Nagar", "Tonk Road", "Jagatpura"]),
    "Surat": (5500.0, 1.1, ["Adajan", "Vesu", "Piplod", "City Light", "Katargam"]),
}
PREMIUM_LOCALITIES = [
    "Bandra", "Juhu", "Worli", "Koregaon Park", "Koramangala", "Indiranagar", "Banjara Hills",
    "Jubilee Hills", "Adyar", "Vasant Kunj", "Alipore", "C-Scheme", "Vesu", "Satellite",
]
PROPERTY_TYPES = ["Apartment", "Villa", "Independent House", "Studio", "Penthouse"]
TYPE_FACTORS = {"Penthouse": 1.8, "Villa": 1.5, "Independent House": 1.2, "Apartment": 1.0, "Studio": 0.85}
AMENITIES = [
    "Swimming Pool", "Gym", "Parking", "Security", "Lift",
    "Garden", "Club House", "Power Backup", "CCTV", "Children Play Area",
]
ENQUIRY_STATUSES = ["new", "contacted", "site_visit", "negotiation", "booked", "lost"]
STATUS_BADGES = {
    "new": "badge-blue", "contacted": "badge-gold", "site_visit": "badge-gold",
    "negotiation": "badge-gold", "booked": "badge-green", "lost": "badge-red",
}
MAX_AMENITIES = 10
UNKNOWN_CITY_INDEX = 0.5
# ---- end of fixed values ------------------------------------------------

TOP_BASE = max(base for base, _, _ in CITIES.values())
CITY_BASE = {city: base for city, (base, _, _) in CITIES.items()}
CITY_PRICE_INDEX = {city: round(base / TOP_BASE, 4) for city, base in CITY_BASE.items()}
CITY_YIELD_ADJUSTMENT = {city: adj for city, (_, adj, _) in CITIES.items()}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D, _DATE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType()

LISTING = _struct(
    property_id=_S, city=_S, locality=_S, property_type=_S, bedrooms=_I, bathrooms=_I,
    area_sqft=_D, age_years=_D, floor_number=_D, total_floors=_D, amenities=_S,
    location_score=_D, price_per_sqft=_D, price=_D,
)
LISTING_COLUMNS = LISTING.names

REQUEST = _struct(
    city=_S, locality=_S, property_type=_S, bedrooms=_I, bathrooms=_I, area_sqft=_D,
    age_years=_D, floor_number=_D, total_floors=_D, location_score=_D, amenities=_S, price=_D,
)

CATALOGUE = _struct(
    id=_S, title=_S, city=_S, locality=_S, property_type=_S, bedrooms=_I, bathrooms=_I,
    area_sqft=_I, age_years=_I, floor_number=_I, total_floors=_I, location_score=_D,
    price=_L, price_per_sqft=_L, amenities=T.ArrayType(_S), status=_S, possession=_S,
    builder=_S, rera_id=_S, description=_S, images=T.ArrayType(_S),
    nearby=_struct(school=_S, hospital=_S, metro=_S, mall=_S),
    investment=_struct(rental_yield=_D, appreciation_5yr=_I, monthly_rent=_L),
)

UNIT_TYPE = _struct(
    type=_S, area=_I, price=_L, floor_range=_S, available=_I, total=_I, facing=_S, parking=_S,
)
INVENTORY = _struct(
    property_id=_S, total_units=_I, available_units=_I, booked_units=_I, sold_units=_I,
    last_updated=_S, price_range=_struct(min=_L, max=_L), unit_types=T.ArrayType(UNIT_TYPE),
    construction_status=_S, rera_validity=_S, manager_notes=_S, enquiries_this_month=_I,
    site_visits_this_month=_I, conversions_this_month=_I, last_updated_by=_S,
)
INVENTORY_BY_ID = T.MapType(_S, INVENTORY)

ENQUIRY = _struct(
    prop_id=_S, id=_L, date=_DATE, name=_S, phone=_S, email=_S, unit=_S, budget=_S,
    source=_S, status=_S, followup=_DATE, notes=_S,
)

EVENT = _struct(
    type=_S, data=T.MapType(_S, _S), timestamp=T.TimestampType(),
)
