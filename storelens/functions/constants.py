"""Fixed values that must equal the reference's for identical results.

FIXED VALUES — do not edit to make a test pass; they define the semantics.
"""

# Canonical column names of the line-item (purchases) fact.
PRICE = "purchase_price_w_discount"
COST = "unit_cost"
QUANTITY = "quantity"
INVOICE = "invoice_id"
CATEGORY = "disp_category"
SUBCATEGORY = "revenue_subcategory"
PRODUCT = "product_name"
VENDOR = "vendor_name"

# Substrings that mark role columns (matched on the lower-cased name).
DATE_WORD = "date"
LOCATION_WORDS = ("location", "store", "shop", "site")
# The store ranking looks the location column up without "site".
RANKING_LOCATION_WORDS = ("location", "store", "shop")
NUMBER_WORDS = ("price", "amount")

# Table-name needles used to pick the purchases / checkins tables.
PURCHASES_NEEDLE = "purchase"
CHECKINS_NEEDLE = "checkin"

# Benefit (member reward) lines and the category analysed against them.
BENEFIT_PATTERN = "Member Bennies"
FOCUS_CATEGORY = "Food"
BENEFIT_HOME_CATEGORY = "ProShop"

# Day-part labels by hour: [5,12) morning, [12,17) afternoon, [17,21) evening, else night.
MORNING = "Morning (5AM-12PM)"
AFTERNOON = "Afternoon (12PM-5PM)"
EVENING = "Evening (5PM-9PM)"
NIGHT = "Night (9PM-5AM)"

# Default number of pre-selected filter options.
DEFAULT_SELECTION_SIZE = 5

# Text date formats tried in order when a string date column is coerced,
# after "T" between date and time, a zone suffix and slashes are evened out.
DATE_FORMATS = (
    "yyyy-M-d[ H:mm[:ss[.SSSSSSSSS]]]",
    "M-d-yyyy[ H:mm[:ss[.SSSSSSSSS]]]",
    "M-d-yyyy h:mm[:ss] a",
)

# Partition column of the written fact: the first day of the purchase's month.
MONTH = "purchase_month"
