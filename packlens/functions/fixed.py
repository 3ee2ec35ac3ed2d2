"""Tables, patterns, formats and texts that results must agree with.

Everything in this module is data. The logic that uses it is elsewhere.
"""

# Licence economies by three-digit prefix (low, high, economy).
PREFIX_ECONOMIES = [
    (0, 19, "United States / Canada"),
    (20, 29, "Restricted distribution"),
    (30, 39, "United States (drugs)"),
    (40, 49, "Restricted distribution"),
    (50, 59, "Coupons"),
    (60, 139, "United States / Canada"),
    (200, 299, "Restricted distribution (internal)"),
    (300, 379, "France & Monaco"),
    (380, 380, "Bulgaria"),
    (383, 383, "Slovenia"),
    (385, 385, "Croatia"),
    (387, 387, "Bosnia and Herzegovina"),
    (389, 389, "Montenegro"),
    (400, 440, "Germany"),
    (450, 459, "Japan"),
    (460, 469, "Russia"),
    (470, 470, "Kyrgyzstan"),
    (471, 471, "Taiwan"),
    (474, 474, "Estonia"),
    (475, 475, "Latvia"),
    (476, 476, "Azerbaijan"),
    (477, 477, "Lithuania"),
    (478, 478, "Uzbekistan"),
    (479, 479, "Sri Lanka"),
    (480, 480, "Philippines"),
    (481, 481, "Belarus"),
    (482, 482, "Ukraine"),
    (484, 484, "Moldova"),
    (485, 485, "Armenia"),
    (486, 486, "Georgia"),
    (487, 487, "Kazakhstan"),
    (488, 488, "Tajikistan"),
    (489, 489, "Hong Kong"),
    (490, 499, "Japan"),
    (500, 509, "United Kingdom"),
    (520, 521, "Greece"),
    (528, 528, "Lebanon"),
    (529, 529, "Cyprus"),
    (530, 530, "Albania"),
    (531, 531, "North Macedonia"),
    (535, 535, "Malta"),
    (539, 539, "Ireland"),
    (540, 549, "Belgium & Luxembourg"),
    (560, 560, "Portugal"),
    (569, 569, "Iceland"),
    (570, 579, "Denmark, Faroe Islands & Greenland"),
    (590, 590, "Poland"),
    (594, 594, "Romania"),
    (599, 599, "Hungary"),
    (600, 601, "South Africa"),
    (603, 603, "Ghana"),
    (604, 604, "Senegal"),
    (608, 608, "Bahrain"),
    (609, 609, "Mauritius"),
    (611, 611, "Morocco"),
    (613, 613, "Algeria"),
    (615, 615, "Nigeria"),
    (616, 616, "Kenya"),
    (618, 618, "Ivory Coast"),
    (619, 619, "Tunisia"),
    (620, 620, "Tanzania"),
    (621, 621, "Syria"),
    (622, 622, "Egypt"),
    (623, 623, "Brunei"),
    (624, 624, "Libya"),
    (625, 625, "Jordan"),
    (626, 626, "Iran"),
    (627, 627, "Kuwait"),
    (628, 628, "Saudi Arabia"),
    (629, 629, "United Arab Emirates"),
    (640, 649, "Finland"),
    (690, 699, "China"),
    (700, 709, "Norway"),
    (729, 729, "Israel"),
    (730, 739, "Sweden"),
    (740, 740, "Guatemala"),
    (741, 741, "El Salvador"),
    (742, 742, "Honduras"),
    (743, 743, "Nicaragua"),
    (744, 744, "Costa Rica"),
    (745, 745, "Panama"),
    (746, 746, "Dominican Republic"),
    (750, 750, "Mexico"),
    (754, 755, "Canada"),
    (759, 759, "Venezuela"),
    (760, 769, "Switzerland & Liechtenstein"),
    (770, 771, "Colombia"),
    (773, 773, "Uruguay"),
    (775, 775, "Peru"),
    (777, 777, "Bolivia"),
    (778, 779, "Argentina"),
    (780, 780, "Chile"),
    (784, 784, "Paraguay"),
    (786, 786, "Ecuador"),
    (789, 790, "Brazil"),
    (800, 839, "Italy, San Marino & Vatican City"),
    (840, 849, "Spain"),
    (850, 850, "Cuba"),
    (858, 858, "Slovakia"),
    (859, 859, "Czech Republic"),
    (860, 860, "Serbia"),
    (865, 865, "Mongolia"),
    (867, 867, "North Korea"),
    (868, 869, "Turkey"),
    (870, 879, "Netherlands"),
    (880, 880, "South Korea"),
    (884, 884, "Cambodia"),
    (885, 885, "Thailand"),
    (888, 888, "Singapore"),
    (890, 890, "India"),
    (893, 893, "Vietnam"),
    (896, 896, "Pakistan"),
    (899, 899, "Indonesia"),
    (900, 919, "Austria"),
    (930, 939, "Australia"),
    (940, 949, "New Zealand"),
    (955, 955, "Malaysia"),
    (958, 958, "Macau"),
]

# Reserved prefixes (low, high, reason), first match wins.
RESERVED_PREFIXES = [
    (20, 29, "Restricted distribution (retailer in-store number)"),
    (40, 49, "Restricted distribution (retailer in-store number)"),
    (50, 59, "Coupons"),
    (200, 299, "Restricted distribution (in-store / variable measure)"),
    (977, 977, "ISSN (serial publications)"),
    (978, 979, "ISBN / ISMN (Bookland)"),
    (980, 980, "Refund receipts"),
    (981, 984, "GS1 coupon identification"),
    (99, 99, "Coupons"),
]

# Names of the valid code lengths.
GTIN_NAMES = {8: "GTIN-8", 12: "UPC-A (GTIN-12)", 13: "EAN-13 (GTIN-13)", 14: "GTIN-14 / ITF-14"}
INDIA_PREFIX = "890"

# Notes on a code, in order.
NOTE_LENGTH = "%d digits is not a valid GTIN length (expected 8, 12, 13 or 14)."
NOTE_CHECK = "GS1 mod-10 check digit does not match — the number is mistyped or misprinted."
NOTE_RESERVED = "Prefix %s is reserved: %s. This is not a consumer product GTIN."
NOTE_INDIA = "Prefix 890 is allocated by GS1 India — the brand owner holds an Indian GS1 licence."

# Patterns over label text (Python re; matched with Unicode classes and without case).
DEVANAGARI = "०१२३४५६७८९"
DATE_TOKEN = (
    r"\d{1,2}[/\-.][A-Za-z0-9]{3,9}[/\-.]\d{2,4}|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{1,2}[/\-.]\d{2,4}|"
    r"[A-Za-z]{3,9}\.?\s*[/\-.]?\s*\d{2,4}"
)
MRP = (
    r"(?:(?:M\.?\s*R\.?\s*P\.?[a-z\d]?|MAX(?:IMUM)?\s*RETAIL\s*PRICE)[\s\S]{0,80}?(?:[:.?\-₹z|]+|\bRs\.?|\bINR)?\s*"
    r"(\d+(?:[.,]\d{1,2})?)(?!\s*(?:mg|g|gm|kg|ml|ltr|tabs?|tablets?|caps?))"
    r"|(?:₹|Rs\.?|INR)\s*(\d+(?:[.,]\d{1,2})?)(?!\s*(?:mg|g|gm|kg|ml|ltr|tabs?|tablets?|caps?|\d{3,})))"
)
DECIMAL_PRICE = r"\b(\d{2,5}\.\d{2})\b"
NET_QUANTITY = (
    r"(?:(?:NET\s*(?:WT|WEIGHT|QTY|QUANTITY|CONTENT|CONTENTS?|VOLUME|VOL)?[\s:.\-|]*)(\d+(?:\.\d+)?)\s*"
    r"(g|gm|gms|grams?|kg|kgs|ml|l|ltr|ltrs|litre|litres|liter|liters|cm|m|mm|nos|units?|pieces?|pcs|N|tablets?|capsules?|sachets?|strips?|vials?)\b"
    r"|(?:(\d+)\s*[xX×]\s*(\d+)\s*(tablets?|capsules?|sachets?|strips?|vials?|pcs|pieces?)|(\d+)\s*(tablets?|capsules?|sachets?|strips?|vials?|pcs|pieces?))"
    r"|\b(\d+(?:\.\d+)?)\s*(g|gm|gms|grams?|kg|kgs|ml|l|ltr|ltrs|litre|litres|liter|liters)\b)"
)
LICENCE = r"(?:FSSAI|Lic\.?\s*(?:No\.?)?|Licence?\s*No\.?)\s*[,:.\-]?\s*([0-9]{14})"
LICENCE_ALONE = r"\b(\d{14})\b"
MADE_ON = r"(?:MFD|PKD|MFG|PACKED|MANUFACTURED|DATE\s*OF\s*(?:MFG|MANUFACTURE|PACKING)|[Il1]lg\s*Date)[\s:.\-]*(" + DATE_TOKEN + ")"
EXPIRES_ON = r"(?:EXP(?:IRY)?|USE\s*BY|BEST\s*BEFORE|BB|USE\s*BEFORE|EXPIRY\s*DATE|EXP\.?\s*DATE|bpty|Eyplry)[\s:.\-]*(" + DATE_TOKEN + r"|\d+\s*(?:months?|days?|years?))"
DURATION = r"\d+\s*(?:months?|days?|years?)"
ANY_DATE = r"\b(\d{1,2}[/\-.][A-Za-z]{3,9}[/\-.]\d{2,4}|\d{1,2}[/\-.](?:0[1-9]|1[0-2])[/\-.](?:19|20)\d{2}|(?:0[1-9]|1[0-2])[/\-.](?:\d{4}|\d{2}))\b"
PHONE = (
    r"(?:1800[\s\-]?\d{3}[\s\-]?\d{3,4}|\+?91[\s\-]?[6-9]\d{3}[\s\-]?\d{2}[\s\-]?\d{2}[\s\-]?\d{2}|\+?91[\s\-]?[6-9]\d{4}[\s\-]?\d{5}|"
    r"\+?91[\s\-]?[6-9]\d{9}|[6-9]\d{3}[\s\-]?\d{2}[\s\-]?\d{2}[\s\-]?\d{2}|[6-9]\d{9}|\d{3,5}[\s\-]?\d{6,8})"
)
EMAIL = r"[\w.+\-]+@[\w\-]+\.[\w.]+"
CARE = r"(?:consumer|customer)\s*(?:care|complaint|helpline|service)"
PARTY = {
    "manufacturer": r"(?:Mfd\.?\s*by|Manufactured\s*by|Manufacturer)\s*[:.\-]?\s*",
    "packer": r"(?:Packed\s*by|Packer|Pkd\.?\s*by)\s*[:.\-]?\s*",
    "importer": r"(?:Imported\s*by|Importer)\s*[:.\-]?\s*",
    "marketer": r"(?:Mktd\.?\s*by|Marketed\s*by)\s*[:.\-]?\s*",
}
PARTY_END = r"(?:Mfd\.?\s*by|Packed\s*by|Imported\s*by|Mktd\.?\s*by|Net\s*(?:Wt|Qty|Weight)|MRP|M\.R\.P|FSSAI|Customer\s*Care|Consumer\s*(?:Care|Complaint))"
NOT_A_NAME = r"^(?:\d+|MRP|M\.R\.P|Rs|NET|FSSAI|Mfd|Pkg|Exp|Best|Before|ingredients?|nutrition|contains?)$"
REGISTRY_QUANTITY = r"(\d+(?:[.,]\d+)?)\s*(kg|kgs|g|gm|gms|gram|grams|mg|l|lt|ltr|litre|liter|liters|ml|cl|pcs|pc|piece|pieces|n|nos|units?|u|m|cm|mm)\b"
REGISTRY_PRICE = r"(?:₹|rs\.?|inr|mrp)\s*[:\-]?\s*(\d+(?:\.\d{1,2})?)"

# Units as labels write them, as registries write them, and as packages keep them with their category.
LABEL_UNITS = {
    "g": "g", "gm": "g", "gms": "g", "gram": "g", "grams": "g", "kg": "kg", "kgs": "kg", "ml": "ml",
    "l": "l", "ltr": "l", "ltrs": "l", "litre": "l", "litres": "l", "liter": "l", "liters": "l", "cm": "cm", "m": "m", "mm": "mm",
    "nos": "nos", "unit": "nos", "units": "nos", "piece": "nos", "pieces": "nos", "pcs": "nos", "n": "nos",
    "tablet": "tablets", "tablets": "tablets", "capsule": "capsules", "capsules": "capsules", "sachet": "sachets", "sachets": "sachets",
    "strip": "strips", "strips": "strips", "vial": "vials", "vials": "vials",
}
REGISTRY_UNITS = {
    "kg": "kg", "kgs": "kg", "g": "g", "gm": "g", "gms": "g", "gram": "g", "grams": "g", "mg": "mg",
    "l": "l", "lt": "l", "ltr": "l", "litre": "l", "liter": "l", "liters": "l", "ml": "ml", "cl": "cl",
    "pcs": "U", "pc": "U", "piece": "U", "pieces": "U", "u": "U", "n": "N", "nos": "N", "unit": "U", "units": "U", "m": "m", "cm": "cm", "mm": "mm",
}
PACKAGE_UNITS = {
    "weight": {"g": "g", "gm": "g", "gms": "g", "gram": "g", "grams": "g", "kg": "kg", "kgs": "kg", "kilogram": "kg", "kilograms": "kg", "mg": "mg", "milligram": "mg"},
    "volume": {"l": "l", "lt": "l", "ltr": "l", "liter": "l", "liters": "l", "litre": "l", "ml": "ml", "milliliter": "ml"},
    "length": {"m": "m", "meter": "m", "cm": "cm", "centimeter": "cm", "mm": "mm"},
    "area": {"sqm": "sqm", "sqcm": "sqcm"},
    "number": {"u": "U", "n": "N", "unit": "U", "units": "U", "piece": "U", "pieces": "U", "nos": "N", "no": "N"},
}

# Registries in order of trust, and the fields merged from them.
TRUST = ["gs1_india_datakart", "open_food_facts", "open_beauty_facts", "open_products_facts", "open_pet_food_facts", "upcitemdb", "wikidata"]
UNKNOWN_TRUST = 99
MERGED_FIELDS = [
    "product_name", "brand", "manufacturer_name", "manufacturer_address", "packer_name", "packer_address", "importer_name", "importer_address",
    "country_of_origin", "net_quantity_raw", "net_quantity_value", "net_quantity_unit", "mrp_value", "mrp_currency", "manufacture_date",
    "expiry_date", "best_before", "fssai_license", "veg_non_veg", "consumer_care", "consumer_care_phone", "consumer_care_email", "ingredients",
]
NUMBER_FIELDS = {"net_quantity_value", "mrp_value"}
#: Registry field -> package field that a language model's reading may fill.
GAP_FIELDS = {
    "product_name": "commodity_name", "manufacturer_name": "manufacturer_name", "manufacturer_address": "manufacturer_address",
    "importer_name": "importer_name", "importer_address": "importer_address", "country_of_origin": "country_of_origin",
    "net_quantity_value": "net_quantity_value", "net_quantity_unit": "net_quantity_unit", "mrp_value": "mrp_value",
    "manufacture_date": "manufacture_date", "expiry_date": "expiry_date", "best_before": "best_before",
    "fssai_license": "fssai_license_number", "consumer_care_phone": "consumer_care_phone", "consumer_care_email": "consumer_care_email",
}
GAP_SOURCE = "gemini_llm"

# Least letter height in mm by panel area up to so many cm2 (normal, small quantity); beyond: the last row.
LETTER_HEIGHTS = [(50.0, 1.0, 1.0), (100.0, 1.5, 1.0), (500.0, 2.5, 2.0), (2500.0, 4.0, 4.0), (None, 6.0, 6.0)]
SMALL_QUANTITY = 200
BARCODE_WIDTH_MM = 37.29

# Standard quantities by commodity.
STANDARD_QUANTITIES = {
    "baby_food": [25.0, 50.0, 100.0, 200.0, 250.0, 500.0, 1000.0],
    "biscuits": [25.0, 50.0, 75.0, 100.0, 150.0, 200.0, 250.0, 300.0, 400.0, 500.0, 750.0, 1000.0],
    "bread": [100.0, 200.0, 400.0, 500.0, 700.0, 800.0],
    "cereals_pulses": [100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0],
    "coffee": [25.0, 50.0, 100.0, 200.0, 500.0],
    "tea": [25.0, 50.0, 100.0, 200.0, 250.0, 500.0, 1000.0],
    "edible_oils": [100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 15000.0],
    "milk_powder": [50.0, 100.0, 200.0, 500.0, 1000.0],
    "detergents": [50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0],
    "rice_flour_atta": [100.0, 200.0, 500.0, 1000.0, 2000.0, 5000.0, 10000.0],
    "salt": [100.0, 200.0, 500.0, 1000.0, 2000.0],
    "soaps": [25.0, 50.0, 75.0, 100.0, 125.0, 150.0],
    "soft_drinks": [100.0, 150.0, 200.0, 250.0, 300.0, 500.0, 600.0, 1000.0, 1500.0, 2000.0],
    "mineral_water": [200.0, 250.0, 300.0, 500.0, 1000.0, 2000.0, 5000.0],
    "cement": [1.0, 5.0, 10.0, 25.0, 50.0],
    "paints": [50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0, 4000.0, 10000.0, 20000.0],
}

# Maximum permissible error by category: (up to, factor, fixed, text); the last row of a category has no limit.
PERMITTED_ERRORS = {
    "mass": [
        (50, 0.09, None, "9% of declared quantity"),
        (200, None, 4.5, "4.5 g/ml"),
        (300, None, 9.0, "9 g/ml"),
        (500, 0.03, None, "3% of declared quantity"),
        (1000, None, 15.0, "15 g/ml"),
        (10000, 0.015, None, "1.5% of declared quantity"),
        (15000, None, 150.0, "150 g/ml"),
        (None, 0.01, None, "1% of declared quantity"),
    ],
    "length": [(10, 0.02, None, "2% of declared length"), (None, 0.01, None, "1% of declared length")],
    "area": [(10, 0.04, None, "4% of declared area"), (None, 0.01, None, "1% of declared area")],
    "number": [(None, 0.02, None, "2% of declared number")],
}
UNKNOWN_ERROR = "Unknown category, 0 error allowed"

# Star bands of the score (at least, stars, label), and of scores that a language model gives (percent).
STAR_BANDS = [
    (0.95, 5, "Fully Compliant"),
    (0.80, 4, "Mostly Compliant"),
    (0.60, 3, "Partially Compliant"),
    (0.40, 2, "Largely Non-Compliant"),
    (None, 1, "Critically Non-Compliant"),
]
MODEL_STAR_BANDS = [
    (85, 5, "Fully Compliant"),
    (70, 4, "Substantially Compliant"),
    (50, 3, "Partially Compliant"),
    (35, 2, "Non-Compliant"),
    (None, 1, "Critical Violations"),
]
MODEL_SHARE = 0.3
COMPLIANT_FROM = 0.70

# Characters that a report transliterates.
REPORT_CHARACTERS = {
    "—": "-", "–": "-", "‒": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...",
    " ": " ", "°": "deg", "₹": "Rs", "→": "->", "≤": "<=", "≥": ">=",
}
NOTHING_FOUND = "No compliance issues found. Maintain current packaging standards."
UNVERIFIED = "[ACTION] %d mandatory declaration(s) could not be verified from registry data — physically inspect the pack for: %s."
NOT_REGISTERED = (
    "[INFO] This GTIN was not found in any public product registry. The findings above reflect only what could be verified "
    "from the bar code itself — confirm every mandatory declaration against the physical package."
)

# Model features in order: presence bits, measures, and one more bit.
PRESENCE_FEATURES = [
    "has_commodity_name", "has_manufacturer_name", "has_manufacturer_address", "has_packer_info", "has_net_quantity", "has_mrp",
    "has_mfg_date", "has_expiry_date", "has_consumer_care_phone", "has_consumer_care_email", "has_fssai", "has_veg_nonveg_symbol",
    "has_barcode", "has_hindi", "has_english", "on_principal_panel",
]
MEASURE_FEATURES = [
    "mrp_font_height_mm", "net_qty_font_height_mm", "min_font_height_mm", "mrp_contrast_ratio", "qty_clear_space_ratio",
    "panel_area_mm2", "net_quantity_value", "mrp_value", "avg_ocr_confidence", "num_declarations_found",
]
FEATURES = [*PRESENCE_FEATURES, *MEASURE_FEATURES, "is_imported"]
#: Ranges of the measures of synthetic rows.
SYNTHETIC_RANGES = {
    "mrp_font_height_mm": (0.5, 8.0), "net_qty_font_height_mm": (0.5, 8.0), "mrp_contrast_ratio": (1.0, 21.0), "qty_clear_space_ratio": (0.1, 2.0),
    "panel_area_mm2": (1000.0, 50000.0), "net_quantity_value": (10.0, 5000.0), "mrp_value": (5.0, 5000.0), "avg_ocr_confidence": (0.3, 1.0),
}
#: Fixed value: how the detail of a rule begins that can't be evaluated.
RULE_FAILED = "Rule evaluation failed with error: "
