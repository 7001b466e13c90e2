"""Names and constants of the credit tables."""

# Keys and label.
CUSTOMER = "SK_ID_CURR"
BUREAU_LOAN = "SK_ID_BUREAU"
PREVIOUS_LOAN = "SK_ID_PREV"
LABEL = "TARGET"

# Cleaning of the application table.
DAYS_PER_YEAR = 365
EMPLOYED_SENTINEL = 365243
UNKNOWN_CATEGORY = "XNA"
SOCIAL_CIRCLE_COLUMNS = ("OBS_30_CNT_SOCIAL_CIRCLE", "OBS_60_CNT_SOCIAL_CIRCLE")
SOCIAL_CIRCLE_LIMIT = 30
RATING_COLUMNS = ("REGION_RATING_CLIENT", "REGION_RATING_CLIENT_W_CITY")

# Weight of a monthly loan status.
STATUS_WEIGHTS = {"C": 0, "0": 1, "1": 2, "2": 3, "X": 4, "3": 5, "4": 6, "5": 7}

# Denominator guards.
GUARD_ONE = 1
GUARD_SMALL = 0.00001
GUARD_MIN_PAYMENT = 0.0001

# Months in the two years of the interest rate.
INTEREST_MONTHS = 24

# Column prefixes of the history tables.
PREFIXES = {
    "bureau": "Bureau",
    "bureau_balance": "Bureau_bal",
    "previous_application": "PREV_APP",
    "POS_CASH_balance": "POS",
    "installments_payments": "INSTPAY",
    "credit_card_balance": "CREDITBAL",
}

# Accepted request ids, decision threshold, verdict texts.
REQUEST_IDS = (100002, 456255)
THRESHOLD = 0.5
VERDICTS = {
    0: "Customer having good Credit history, capabale to repay a debt ",
    1: "Customer having bad Credit history, risky customer ",
}
