"""Names, word lists, patterns and rates that the data format and the results depend on.

Everything here is a plain value, not a tuning choice. Tuning choices are arguments of the operators.
"""

# --- fixed values: raw listing table ---------------------------------------------------------
LISTING_COLUMNS = [
    "name", "price", "pricing_details", "currency", "reviews", "ratings", "location", "lat", "long", "guests",
    "category_rating", "host_number_of_reviews", "host_rating", "host_response_rate", "property_number_of_reviews",
    "details", "amenities", "description", "location_details",
]
LISTING_RENAMES = {"is_supperhost": "is_superhost", "hosts_year": "host_year"}

PRICING_DETAILS_TYPE = (
    "struct<airbnb_service_fee:double,cleaning_fee:double,initial_price_per_night:double,num_of_nights:double,"
    "price_per_night:double,price_without_fees:double,special_offer:string,taxes:string>"
)
LISTING_JSON_TYPES = {
    "reviews": "array<string>",
    "details": "array<string>",
    "category_rating": "array<struct<name:string,value:string>>",
    "pricing_details": PRICING_DETAILS_TYPE,
}
LISTING_SCALAR_TYPES = {
    "name": "string", "price": "double", "currency": "string", "ratings": "double", "location": "string",
    "lat": "double", "long": "double", "guests": "double", "host_number_of_reviews": "double",
    "host_rating": "double", "host_response_rate": "string", "property_number_of_reviews": "double",
    "is_superhost": "boolean", "host_year": "double", "description": "string", "location_details": "string",
}
AMENITIES_TYPE = "array<struct<group_name:string,items:array<struct<name:string,value:string>>>>"
EXCLUDED_AMENITY_GROUP = "Not included"
LONGEST_STAY_NIGHTS = 30

# --- fixed values: room counts in listing details --------------------------------------------
BEDS_PATTERN = r"(?i)\b(\d+\.?\d*)\s+beds?\b"
BEDROOMS_PATTERN = r"(?i)\b(\d+\.?\d*)\s+bedrooms?\b"
# The digit guard keeps "shared 1.5 baths" from yielding its fraction as a private count.
BATHS_PATTERN = r"(?i)(?<!shared\s)(?<![\d.])(\d+\.?\d*)\s+bath(?:s|rooms?)?\b"

# --- fixed values: season index ----------------------------------------------------------------
SEASON_ANCHOR_DAY = "09-25"
SEASON_MIN_PRICES_EXCLUSIVE = 10
SEASON_MIN_DAYS = 365
SEASON_COLOURS = ["green", "yellow", "orange", "red"]
DAY_CLASS_PREFIX = "airbnb-day-"
CALENDAR_SPAN_DAYS = 730

# --- fixed values: city names ------------------------------------------------------------------
CITY_SUFFIXES = [", united kingdom", ", uk", ", usa", ", us", ", ca", ", tx", ", fl", ", ny"]
CITY_PREFIX = "greater "

# --- fixed values: geography -------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0
CLUSTERED_CITY_RADIUS_KM = 50.0
MIN_CLUSTER_SIZE = 10
CLUSTER_MERGE_RADIANS = 0.0000005
OUTLIER_IQR_FACTOR = 3.0
NO_CLUSTER = -1

# --- fixed values: US dollars per unit of currency ---------------------------------------------
USD_RATES = {
    "USD": 1.0, "EUR": 1.1704, "GBP": 1.3428, "CAD": 0.7238, "AUD": 0.6763, "NZD": 0.4975, "MXN": 0.0567,
    "SGD": 0.6648, "HKD": 0.1282, "TWD": 0.0312, "BRL": 0.1878, "CHF": 1.2609, "PHP": 0.0144, "KRW": 0.000577,
    "JPY": 0.00633, "CNY": 0.1436, "INR": 0.0110, "TRY": 0.0197, "VND": 0.000039, "ILS": 0.3152, "SEK": 0.1093,
    "NOK": 0.0851, "DKK": 0.1567, "PLN": 0.2773, "CZK": 0.0481, "THB": 0.0322, "MYR": 0.2103, "ZAR": 0.0608,
}

# --- fixed values: currency symbols in page text -----------------------------------------------
CURRENCY_OF_SYMBOL = {
    "$": "USD", "US$": "USD", "CA$": "CAD", "A$": "AUD", "C$": "CAD", "NZ$": "NZD", "MX$": "MXN", "S$": "SGD",
    "HK$": "HKD", "NT$": "TWD", "R$": "BRL", "CHF": "CHF", "₱": "PHP", "₩": "KRW", "¥": "JPY", "₹": "INR",
    "₺": "TRY", "₫": "VND", "₪": "ILS", "€": "EUR", "£": "GBP", "kr": "SEK",
}
SYMBOL_PATTERN = r"(US\$|CA\$|A\$|C\$|NZ\$|MX\$|S\$|HK\$|NT\$|R\$|CHF|₱|₩|¥|₹|₺|₫|kr|₪|€|£|\$)"

# --- fixed values: page text -------------------------------------------------------------------
FEE_WORDS = [
    "parking", "valet", "cleaning", "service fee", "service fees", "deposit", "pet fee", "resort fee", "amenity fee",
]
FEE_REACH_CHARS = 50
SECTION_HEADINGS = [
    "Where you'll sleep", "Where you'll be", "What this place offers", "Meet your Host", "Reviews",
]
FEE_LABELS = {
    "cleaning_fee": "Cleaning fee",
    "airbnb_service_fee": "Airbnb service fee",
    "taxes": "Taxes",
    "price_without_fees": "Total before taxes",
}
FOR_NIGHTS = r"(?<!\s)\s++for\s+(\d+)\s+nights?"
LONGEST_SYMBOL = 3
PRICE_PER_NIGHT = SYMBOL_PATTERN + r"\s?([\d,.]+)\s*(?:per|a)?\s*night"
PRICE_ANYWHERE = SYMBOL_PATTERN + r"\s?([\d,.]+)"
RATING_AND_REVIEWS = r"([0-5](?:\.\d+)?)\s*·\s*(\d+)\s+reviews"
REVIEW_COUNT = r"(\d{1,4})\s+reviews?"
HOSTING_SINCE = r"Hosting since\s+(\d{4})"
RESPONSE_RATE = r"Response rate:\s*(\d+%)"
HOST_REVIEWS = r"(\d+)\s+reviews?\s+·\s+Superhost"
HOST_RATING = r"(\d+\.\d+)\s*out\s*of\s*5\s*average\s*rating"
AMENITY_COUNT = r"Show\s+all\s+(\d+)\s+amenities?"
CAPACITY = r"(\d+(?:\.\d+)?)\s+(guests?|bedrooms?|beds?|bathrooms?|baths?)"
GUEST_COUNT = r"(\d+)\s+guests?"
MAX_GUESTS = 50
LATITUDE_IN_HTML = r'"lat"\s*:?\s*(-?\d+\.\d+)'
LONGITUDE_IN_HTML = r'"(?:lng|long|lon)"\s*:?\s*(-?\d+\.\d+)'
LD_TYPE = "application/ld+json"
LODGING_TYPES = r"Product|House|Lodging|Accommodation|Apartment|Residence"
PAGE_REVIEW_LIMIT = 10
SECTION_REVIEW_MIN_CHARS = 30

# --- fixed values: elements of a listing page, tried in this order ------------------------------
PAGE_ELEMENTS = {
    "title": ["[data-testid='title']", "[data-testid='listing-page-title']", "header h1", "h1"],
    "subtitle": ["[data-testid='title-subtitle']", "[data-testid='breadcrumb']", "header h2"],
    "description": ["[data-section-id='DESCRIPTION_DEFAULT']", "[data-testid='pdp-description-text']"],
    "price": ["[data-testid='price-string']", "[data-testid='book-it-default'] [data-testid='price']",
              "[data-testid='price']"],
    "summary": ["[data-testid='pdp-section-summary']", "[data-testid='title'] + div"],
}
REVIEW_ELEMENTS = ["[data-testid='review-item'] p", "[data-testid='pdp-section-reviews'] p"]
OVERVIEW_HEADING = {"tag": "h2", "attribute": "elementtiming", "value": "LCP-target"}
OVERVIEW_LIST_CLASS = "lgx66tx"

# --- fixed values: captured pages --------------------------------------------------------------
LISTING_URL = r"(?i)https?://(?:www\.)?airbnb\.[^/]+/rooms/"
LISTING_ID_IN_URL = r"(?i)rooms/([^/?#]+)"
MIN_PAGE_CHARS = 1000
RECAPTURE_SECONDS = 60

# --- fixed values: model -----------------------------------------------------------------------
CONTINUOUS_FEATURES = [
    "num_baths", "num_bedrooms", "num_beds", "ratings", "bed_to_bedroom_ratio", "review_volume_quality",
    "host_rating", "rooms_per_guest", "total_rooms", "cluster_median", "host_year", "beds_per_guest",
    "superhost_rating_interaction", "amenities_count", "host_number_of_reviews", "bedrooms_per_guest",
    "property_number_of_reviews", "guest_capacity_ratio", "guests",
]
BINARY_FEATURES = ["is_superhost_binary", "is_studio_binary"]
FEATURE_CATEGORY = {
    "guests": "Raw Property", "num_beds": "Raw Property", "num_bedrooms": "Raw Property",
    "num_baths": "Raw Property", "ratings": "Raw Property", "property_number_of_reviews": "Raw Property",
    "host_rating": "Raw Host", "host_year": "Raw Host", "host_number_of_reviews": "Raw Host",
    "cluster_median": "Geospatial",
    "beds_per_guest": "Engineered", "bedrooms_per_guest": "Engineered", "guest_capacity_ratio": "Engineered",
    "superhost_rating_interaction": "Engineered", "review_volume_quality": "Engineered",
    "total_rooms": "Engineered", "bed_to_bedroom_ratio": "Engineered", "rooms_per_guest": "Engineered",
    "amenities_count": "Text Features",
    "is_superhost_binary": "Binary", "is_studio_binary": "Binary",
}
TREE_ITERATIONS, TREE_DEPTH, TREE_STEP = 40, 7, 0.05
REQUIRED_FOR_SCORING = ["city", "lat", "long", "price", "currency"]
DEAL_MARGIN_PERCENT = 10
SEASON_MARGIN_USD = 10
