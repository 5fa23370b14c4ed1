"""Fixed values. They must equal the published ones for results to agree, so they are stated plainly."""

import datetime as dt

# --- fixed values: cleaning rules ---
BOROUGHS = ("Manhattan", "Bronx", "Brooklyn", "Queens", "Staten Island")
DEFAULT_BOROUGH = "Brooklyn"
UNIT_TYPES = ("Condo", "Cooperative")
PRICE_FLOOR = 100_000.0
PRICE_CEILING = 10_000_000.0
SQFT_FLOOR = 100.0
SQFT_CEILING = 20_000.0
UNIT_SQFT_CEILING = 10_000.0
PRICE_PER_SQFT_FLOOR = 100.0
AGE_REFERENCE_DATE = dt.date(2026, 7, 2)

# --- fixed values: columns a raw listing export carries that no later step reads ---
RAW_METADATA_COLUMNS = (
    "web-scraper-start-url",
    "listing-link",
    "results-for",
    "public_tax_history_property_taxes_percentage_change",
    "public_tax_history_tax_assessment_percentage_change",
    "price_history_percentage_change",
    "price",
    "price_history_merged",
)

# --- fixed values: lot table fields ---

LOT_FLAG_FIELDS = ("histdist", "landmark")
LOT_CODE_FIELDS = (
    "schooldist", "policeprct", "sanitboro", "sanitsub", "sanitdistrict", "landuse", "tract2010",
    "areasource", "bldgclass", "overlay1", "overlay2", "spdist1", "spdist2", "spdist3",
    "ltdheight", "ext",
)
# boundary date (latest source data in the release), release label
LOT_VERSIONS = (
    (dt.date(2025, 6, 23), "25v2"),
    (dt.date(2025, 9, 25), "25v3"),
    (dt.date(2026, 1, 26), "25v4"),
    (dt.date(2026, 4, 14), "26v1"),
)

# --- fixed values: places ---
POI_RADIUS_M = 600.0
POI_REQUEST_ROWS = 500
POI_CATEGORIES = {
    "dining": (
        "amenity=restaurant", "amenity=cafe", "amenity=ice_cream", "shop=ice_cream",
        "amenity=food_court", "shop=coffee", "shop=tea",
    ),
    "fast_food": ("amenity=fast_food",),
    "nightlife": ("amenity=bar", "amenity=pub", "amenity=biergarten", "amenity=nightclub"),
    "groceries": (
        "shop=supermarket", "shop=convenience", "shop=deli", "shop=greengrocer", "shop=butcher",
        "shop=seafood", "shop=bakery", "shop=pastry", "shop=confectionery", "shop=chocolate",
        "shop=cheese", "shop=health_food", "shop=beverages", "shop=wine", "shop=alcohol",
        "shop=grocery", "shop=farm", "amenity=marketplace",
    ),
    "retail": (
        "shop=clothes", "shop=shoes", "shop=jewelry", "shop=gift", "shop=books",
        "shop=electronics", "shop=mobile_phone", "shop=furniture", "shop=hardware",
        "shop=florist", "shop=cosmetics", "shop=department_store", "shop=toys", "shop=sports",
        "shop=bicycle", "shop=pet", "shop=stationery", "shop=art", "shop=music",
        "shop=variety_store", "shop=second_hand", "shop=optician",
    ),
    "personal_svc": (
        "shop=hairdresser", "shop=beauty", "shop=laundry", "shop=dry_cleaning", "shop=massage",
        "shop=tattoo", "shop=nail",
    ),
    "health": (
        "amenity=pharmacy", "healthcare=pharmacy", "shop=chemist", "amenity=doctors",
        "healthcare=doctor", "amenity=clinic", "healthcare=clinic", "amenity=dentist",
        "healthcare=dentist", "amenity=hospital", "healthcare=hospital",
        "healthcare=physiotherapist", "healthcare=psychotherapist", "amenity=veterinary",
    ),
    "education": (
        "amenity=school", "amenity=kindergarten", "amenity=childcare", "amenity=college",
        "amenity=university", "amenity=prep_school", "amenity=music_school",
        "amenity=language_school",
    ),
    "parks_rec": (
        "leisure=park", "leisure=playground", "leisure=pitch", "leisure=nature_reserve",
        "leisure=dog_park", "leisure=track", "leisure=picnic_table", "leisure=recreation_centre",
        "leisure=stadium", "tourism=picnic_site",
    ),
    "fitness": (
        "leisure=fitness_centre", "leisure=fitness_station", "leisure=sports_centre",
        "leisure=sports_hall", "amenity=dojo", "leisure=dance",
    ),
    "culture": (
        "tourism=museum", "tourism=gallery", "tourism=artwork", "tourism=attraction",
        "amenity=theatre", "amenity=cinema", "amenity=arts_centre", "amenity=concert_hall",
        "amenity=music_venue", "amenity=library",
    ),
    "civic_finance": (
        "amenity=bank", "amenity=atm", "amenity=post_office", "amenity=townhall",
        "amenity=police", "amenity=fire_station", "amenity=courthouse",
        "amenity=community_centre", "office=government",
    ),
    "mobility": (
        "amenity=bicycle_rental", "amenity=ferry_terminal", "amenity=bus_station", "amenity=taxi",
    ),
    "transit": ("railway=station", "railway=subway_entrance", "public_transport=station"),
    "disamenity": (
        "amenity=fuel", "amenity=car_wash", "shop=car_repair", "shop=tyres", "shop=car_parts",
        "shop=car", "amenity=waste_disposal", "amenity=waste_dump_site",
        "amenity=waste_transfer_station", "man_made=wastewater_plant", "man_made=storage_tank",
        "man_made=works", "man_made=chimney", "amenity=prison", "amenity=crematorium",
        "amenity=slaughterhouse",
    ),
}
POI_KEYS = (
    "amenity", "shop", "leisure", "tourism", "office", "craft", "healthcare", "historic",
    "emergency", "man_made",
)

# --- fixed values: photo taxonomy and scales ---
SCORED_ROOMS = ("kitchen", "bathroom", "bedroom", "living_room")
PHOTO_LABELS = SCORED_ROOMS + ("floorplan", "other")
ROOM_TOP_LEVEL = {"kitchen": 7, "bathroom": 8, "bedroom": 8, "living_room": 8}
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "gif")
MIME_BY_SUFFIX = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp",
    "gif": "image/gif",
}
SUFFIX_BY_MIME = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif",
    "image/webp": "webp",
}

# --- fixed values: batch requests ---
CHUNK_MAX_ROWS = 20_000
CHUNK_MAX_BYTES = 1_500_000_000
CHUNK_BYTES_PER_ITEM = 130_000
BATCH_DISCOUNT = 0.5
PHOTO_PRICE_INPUT = 1.50
PHOTO_PRICE_OUTPUT = 9.00
# $ per million tokens: input, output, cached input, cache write
TOKEN_PRICES = {
    "gpt-4o": (2.50, 10.00, 1.25, 2.50),
    "gemini-3.5-flash": (1.50, 9.00, 0.15, 1.50),
    "gemini-2.5-flash": (0.30, 2.50, 0.075, 0.30),
    "claude-haiku-4-5": (1.00, 5.00, 0.10, 1.25),
    "claude-sonnet-4-6": (3.00, 15.00, 0.30, 3.75),
}

# --- fixed values: sold-listing search address ---
SEARCH_URL_PREFIX = "https://www.zillow.com/brooklyn-new-york-ny-"
SEARCH_URL_MIDDLE = "/sold/?searchQueryState="

# fixed values: where a street name ends, and the flags of the sold-homes search
UNIT_DESIGNATOR = r"(?is)\s+(#|apt\b|unit\b|ph\b|penthouse\b|fl\b|floor\b|ste\b|suite\b|rm\b|room\b).*"
SEARCH_FLAGS = (
    ("rs", True), ("fsba", False), ("fsbo", False), ("nc", False), ("cmsn", False), ("auc", False), ("fore", False),
    ("mf", False), ("land", False), ("apa", False), ("manu", False),
)
