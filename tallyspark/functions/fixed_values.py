"""Word lists, patterns, thresholds and message texts.

Results depend on these literals, so they are stated once, as data, in the
order in which they apply. Everything else in the package reads them from here
(the DuckDB checks included).
"""

# Banks in order of precedence, each with the lower-case
# substrings that identify it.
BANK_KEYWORDS = [
    ("GTBank", ["gtbank", "guaranty trust", "gtb", "0013", "058"]),
    ("Zenith", ["zenith", "zenith bank", "057"]),
    ("UBA", ["uba", "united bank for africa", "033"]),
    ("Access", ["access bank", "access diamond", "044"]),
    ("First Bank", ["first bank", "firstbank", "fbn", "011"]),
    ("Sterling", ["sterling bank", "232"]),
    ("FCMB", ["fcmb", "first city monument", "214"]),
    ("Stanbic", ["stanbic", "stanbic ibtc", "221"]),
    ("Fidelity", ["fidelity", "070"]),
    ("Union", ["union bank", "032"]),
    ("Ecobank", ["ecobank", "050"]),
    ("WEMA", ["wema", "035"]),
    ("OPay", ["opay", "o-pay", "paycom", "100004"]),
    ("PalmPay", ["palmpay", "palm pay", "100033"]),
    ("Kuda", ["kuda", "kuda bank", "090267"]),
    ("Moniepoint", ["moniepoint", "teamapt", "50515"]),
    ("Carbon", ["carbon", "one finance", "100026"]),
    ("Chipper", ["chipper", "chipper cash"]),
    ("Flutterwave", ["flutterwave", "rave"]),
    ("Paystack", ["paystack"]),
    ("VBank", ["vbank", "v bank", "090110"]),
    ("Brass", ["brass"]),
]

# Channels in order of precedence, with identifying substrings.
CHANNEL_KEYWORDS = [
    ("POS", ["pos ", "/pos/", "point of sale", "pos purchase", "debit purchase"]),
    ("ATM", ["atm ", "atm/", "cash withdrawal", "atm withdrawal"]),
    ("Transfer", ["trf", "transfer", "nip", "neft", "rtgs", "interbank", "ussd trf"]),
    ("USSD", ["ussd", "*737*", "*770*", "*919*", "*966*"]),
    ("Card Online", ["web", "online", "e-commerce", "card payment", "purchase online",
                     "netflix", "spotify", "google", "apple", "amazon", "paypal"]),
    ("Mobile App", ["mobile", "app", "kuda app", "opay app", "palmpay app"]),
    ("Direct Debit", ["direct debit", "standing order", "mandate"]),
    ("Cheque", ["cheque", "check", "chq"]),
    ("Cash", ["cash deposit", "cash lodgement", "over the counter"]),
]
DEFAULT_CHANNEL = "Bank Transfer"

# The narration prefix and the trailing reference removed from a merchant.
MERCHANT_PREFIX = (
    r"(?i)^(trf from|trf to|transfer from|transfer to|payment to|payment from|"
    r"pos purchase at|atm withdrawal at|via|nip|neft|ussd|web purchase|"
    r"internet banking|mobile banking|debit card purchase)\s*[:\-]?\s*"
)
MERCHANT_REFERENCE = r"(?i)[\|/\\]\s*(ref|ref#|trans|trn|rrn|session)?[\s#:]?\w{5,}.*$"

# Statement layouts. Columns absent from a layout are None; the
# date pattern is the Spark spelling of the layout's day format.
LAYOUT_FIELDS = ["date", "desc", "debit", "credit", "amount", "type", "balance"]
LAYOUTS = [
    # name, date, description, debit, credit, amount, type, balance, date pattern
    ("GTBank", "Date", "Details", "Debit", "Credit", None, None, "Balance", "d/M/yyyy"),
    ("Zenith", "Trans. Date", "Remarks", "Debit", "Credit", None, None, "Balance", "d-MMM-yyyy"),
    ("UBA", "Transaction Date", "Transaction Details", None, None, "Amount",
     "Transaction Type", "Ledger Balance", "yyyy-M-d"),
    ("Access", "Trans Date", "Narration", "Withdrawals", "Deposits", None, None, "Balance",
     "d/M/yyyy"),
    ("OPay", "Date", "Remark", None, None, "Amount", "Type", "Balance", "yyyy-M-d H:m:s"),
    ("Kuda", "Date", "Description", "Debit", "Credit", None, None, "Balance", "d MMM yyyy"),
]

# Header synonyms for statements of unknown layout, in order.
GENERIC_SYNONYMS = {
    "date": ["date", "trans date", "transaction date", "value date", "posting date"],
    "desc": ["description", "narration", "details", "remarks", "particulars"],
    "balance": ["balance", "ledger balance", "available balance", "closing balance"],
    "debit": ["debit", "withdrawals", "dr"],
    "credit": ["credit", "deposits", "cr"],
    "amount": ["amount", "transaction amount"],
}

# Header synonyms of the late mapping (rows of extracted tables).
TABLE_SYNONYMS = {
    "date": ["date", "trans date", "transaction date", "value date", "posting date"],
    "desc": ["description", "narration", "details", "remarks", "particulars"],
    "balance": ["balance", "ledger balance", "closing balance"],
    "debit": ["debit", "withdrawals", "dr"],
    "credit": ["credit", "deposits", "cr"],
    "amount": ["amount", "transaction amount"],
}

# A line is a header when it shares two cells with this set.
HEADER_CELLS = [
    "date", "trans date", "transaction date", "value date",
    "details", "description", "narration", "remarks", "particulars",
    "debit", "credit", "amount", "balance", "withdrawals", "deposits",
]
HEADER_SCAN_LINES = 15

# A table row is a header when two cells contain one of these.
TABLE_HEADER_WORDS = [
    "date", "trans date", "transaction date", "value date", "posting date",
    "narration", "description", "details", "remarks", "particulars", "reference",
    "debit", "credit", "withdrawal", "deposit", "withdrawals", "deposits",
    "amount", "dr", "cr", "balance", "ledger balance", "closing balance",
    "type", "transaction type", "channel",
]
TABLE_SUMMARY_PHRASES = [
    "opening balance", "closing balance", "brought forward", "carried forward", "total",
    "sub total", "page total", "transaction count", "statement of account",
]

# A data row of a statement shows a date or an amount.
DATA_ROW_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}"
DATA_ROW_AMOUNT = r"[\d,]+\.\d{2}"

# A transaction printed on one text line
# (date, description, amount with optional DR/CR, optional balance).
TEXT_LINE = (
    r"(?i)(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{2}[/\-]\d{2})"
    r"[ \t]+(.+?)[ \t]+"
    r"([\d,]+\.?\d*(?:\s*(?:DR|CR))?)\s*"
    r"([\d,]+\.?\d*)?"
)
TEXT_LINE_MIN_CHARS = 15

# Why an upload without transactions failed.
NO_TRANSACTIONS = "No transactions found in the uploaded file."
ALL_REMOVED = ("All transactions were removed during cleaning. "
               "Check that the file is a standard bank statement.")

# Uploads above this size are refused.
MAX_UPLOAD_BYTES = 10 * 1024 * 1024

# Descriptions that are statement furniture, whatever their case.
NOISE_PATTERNS = [
    r"^opening balance$",
    r"^closing balance$",
    r"^brought forward$",
    r"^carried forward$",
    r"^balance b/f",
    r"^balance c/f",
    r"^total (debit|credit|transactions)",
    r"^statement of account",
    r"^account summary",
    r"^\s*$",
]

# Ordered, case-insensitive rewrites of descriptions.
DESCRIPTION_REWRITES = [
    (r"\bVIA\s+PAYSTACK\b", "via Paystack"),
    (r"\bVIA\s+FLUTTERWAVE\b", "via Flutterwave"),
    (r"\bPOS\s+PURCHASE\s+AT\b", "POS —"),
    (r"\bATM\s+WITHDRAWAL\s+AT\b", "ATM —"),
    (r"\bTRF\s+FROM\b", "Transfer from"),
    (r"\bTRF\s+TO\b", "Transfer to"),
    (r"\bNIP\s+\w+\s+TRF", "NIP Transfer"),
    (r"\bUSSD\b", "USSD"),
    (r"\s{2,}", " "),
]
CREDIT_WORDS = ["cr", "credit", "deposit", "in"]
TYPE_COLUMN_CREDIT = "cr|credit|deposit"

# Spending categories with their phrases, in order of precedence.
# A phrase matches as whole words, whatever the case; text after "!" is a
# phrase that must not follow.
CREDIT_CATEGORIES = [
    ("income", [
        "salary", "payroll", r"pay(ment)?\s+from", "wage", r"monthly\s+pay", "income",
        "remuneration", "bonus", "allowance",
    ]),
    ("freelance", [
        "freelance", "consultancy", r"consulting\s+fee", r"project\s+pay(ment)?", "upwork",
        "fiverr", r"contract\s+fee",
    ]),
    ("investment", [
        "dividend", r"interest\s+credit", r"coupon\s+payment", "cowrywise", "risevest",
        r"stanbic\s+investment", "piggyvest", r"investment\s+return",
    ]),
]
DEBIT_CATEGORIES = [
    ("subscriptions", [
        "netflix", "spotify", r"apple\s+(music|tv|icloud|one)",
        r"google\s+(one|play|workspace|storage)", r"amazon\s+(prime|aws)", "dstv", "gotvmax",
        "starplus", "showmax", "chatgpt", "openai", "midjourney", "canva", "adobe",
        r"microsoft\s+(365|office)", "zoom", "slack", "notion", r"linkedin\s+premium",
        "antivirus", "vpn", r"web\s+hosting", r"domain\s+renewal", "subscription",
        r"monthly\s+(plan|package|charge)",
    ]),
    ("rent", [
        "rent", "houserent", r"house\s+rent", "apartment", r"service\s+charge", "facilities",
        r"property\s+(payment|charge)", "landlord",
    ]),
    ("utilities", [
        "ekedc", "ikedc", r"abeokuta\s+electricity", "phcn", "electric(ity)?",
        r"prepaid\s+token", r"power\s+(bill|token)", "nepa", "lawma", "waste", "garbage",
        r"water\s+(bill|board)", "lwsc", "internet", "spectranet", "smile", r"airtel\s+home",
        r"mtn\s+home", r"gas\s+(bill|supply)", "airgaz", r"service\s+bill", "utility",
    ]),
    ("food", [
        "shoprite", "spar", "novare", "coldstone", r"park\s+'n\s+shop", "leventis", "market",
        "dominos", r"pizza\s+hut", "kfc", "suburban", r"chicken\s+republic", r"eat\s+'n\s+go",
        "electim", r"mr\s+biggs", "tantalizers", r"funky\s+fresh", r"mama\s+cass",
        r"burger\s+king", r"hard\s+rock\s+cafe", r"jumia\s+food", r"glovo!\s+payment",
        "chowdeck", "foodcourt", "oluwole", "restaurant", "cafe", r"food!\s+bank",
        r"eating\s+out", "dining", "lunch", "breakfast", "snack", "bakery", "canteen",
        "grocery", "drink", "beer",
    ]),
    ("transport", [
        "uber", r"bolt!\s+bank", "indriver", "gokada", "cab", "taxi",
        r"ride\s+(sharing|hailing)", "danfo", "brt", "bike", "okada", "fuel", "petrol",
        "diesel", r"gas\s+station", r"total\s+(oil|filling)", "conoil", r"oando\s+filling",
        "flight", "airline", "arik", r"air\s+peace", "over(seas|flight)", "airport",
        r"bus\s+(ticket|fare)", "train", "ferr(y|ies)", "parking", "toll",
    ]),
    ("business", [
        "invoice", r"purchase\s+order", "wholesale", "supplier", "vendor", "cac",
        r"tax!\s+refund", "vat", "firs", r"business\s+(expense|payment)",
        r"office\s+(supplies|rent)", r"payroll\s+(run|payment)", "shipping", "logistics",
        "waybill", r"jumia\s+(seller|merchant)", r"paystack\s+(settlement|payout)",
        r"flutterwave\s+settlement",
    ]),
    ("transfers", [
        r"transfer\s+(to|from)", r"trf\s+(to|from)", r"nip\s+transfer", "neft", "rtgs",
        r"send\s+money", "recharge", "airtime", "opay", "palmpay", "kuda", "moniepoint",
        "chipper", r"cash\s+transfer",
    ]),
]
MATCHED_CONFIDENCE = 0.95
CREDIT_DEFAULT = ("income", 0.70)
DEBIT_DEFAULT = ("miscellaneous", 0.50)

# Category table (id, name, slug, is_income).
CATEGORIES = [
    (1, "Food & Dining", "food", False),
    (2, "Transport", "transport", False),
    (3, "Rent", "rent", False),
    (4, "Utilities", "utilities", False),
    (5, "Subscriptions", "subscriptions", False),
    (6, "Transfers", "transfers", False),
    (7, "Business", "business", False),
    (8, "Miscellaneous", "miscellaneous", False),
    (9, "Salary / Income", "income", True),
    (10, "Freelance / Side", "freelance", True),
    (11, "Investment Return", "investment", True),
]

# Known subscription services (substring, display name, advice).
# A later entry overrides an earlier one.
SUBSCRIPTIONS = [
    ("netflix", "Netflix", "review"),
    ("spotify", "Spotify", "review"),
    ("apple music", "Apple Music", "review"),
    ("apple tv", "Apple TV+", "review"),
    ("dstv", "DStv", "review"),
    ("gotv", "GOtv", "review"),
    ("showmax", "Showmax", "review"),
    ("starplus", "Star+", "review"),
    ("chatgpt", "ChatGPT Plus", "keep"),
    ("openai", "OpenAI", "keep"),
    ("adobe", "Adobe CC", "review"),
    ("canva", "Canva Pro", "review"),
    ("microsoft 365", "Microsoft 365", "keep"),
    ("google one", "Google One", "keep"),
    ("google workspace", "Google Workspace", "keep"),
    ("amazon prime", "Amazon Prime", "review"),
    ("dropbox", "Dropbox", "review"),
    ("notion", "Notion", "keep"),
    ("slack", "Slack", "keep"),
    ("zoom", "Zoom", "keep"),
    ("linkedin", "LinkedIn Premium", "review"),
    ("vpn", "VPN Service", "keep"),
    ("antivirus", "Antivirus", "keep"),
]
DEFAULT_ADVICE = "review"

# Words left out of a merchant key, and its greatest length.
MERCHANT_KEY_NOISE = (
    r"\b(pos|atm|trf|transfer|payment|purchase|via|from|to|online|card|web|mobile)\b"
)
MERCHANT_KEY_CHARS = 40

# Billing cycles in days, and how far gaps may stray from them.
CYCLES = [7, 14, 28, 30, 31, 90, 365]
CYCLE_MEAN_TOLERANCE = 0.35
CYCLE_STD_TOLERANCE = 0.4

# Fixed values: (greatest mean gap, monthly factor or label); None is the rest.
MONTHLY_FACTORS = [(10, 4.33), (20, 2.0), (40, 1.0), (100, 1 / 3.0), (None, 1 / 12.0)]
FREQUENCY_LABELS = [(9, "Weekly"), (19, "Bi-weekly"), (40, "Monthly"), (100, "Quarterly"),
                    (None, "Annual")]

# Weights of the health dimensions, grades and essentials.
HEALTH_WEIGHTS = [("savings_rate", 0.30), ("expense_stability", 0.20), ("debt_ratio", 0.20),
                  ("emergency_coverage", 0.20), ("income_stability", 0.10)]
GRADES = [(80, "Excellent"), (65, "Good"), (45, "Fair"), (None, "At Risk")]
ESSENTIAL_CATEGORIES = ["rent", "utilities", "food", "transport"]

# Health insight texts.
INSIGHTS = {
    "savings_critical": "Critical: savings rate below 10%. Immediate budget review needed.",
    "savings_low": "Savings rate under 20% — increase by reducing discretionary spending.",
    "expense_swings":
        "High expense variability — spending spikes are hurting your stability score.",
    "debt": "High debt ratio. Prioritize debt repayment before new goals.",
    "emergency": "Emergency fund covers only {months} months. Target is 6.",
    "income_swings":
        "Variable income detected. Build a larger buffer for low-income months.",
    "default": "Your finances are on a healthy trajectory. Keep it up!",
}

# Greatest recommended share of income per category, in order.
CATEGORY_TARGETS = [("food", 0.15), ("transport", 0.10), ("subscriptions", 0.05),
                    ("utilities", 0.08), ("rent", 0.30), ("transfers", 0.15),
                    ("miscellaneous", 0.05)]
MIN_SAVINGS_RATE = 0.20
GOOD_SAVINGS_RATE = 0.30
EMERGENCY_MONTHS = 6
SUBSCRIPTION_SHARE = 0.05

# Words of the food-habit check.
EAT_OUT_WORDS = ["restaurant", "dominos", "kfc", "chicken republic", "mr biggs", "cafe",
                 "glovo", "chowdeck", "jumia food", "pizza", "fast food"]
GROCERY_WORDS = ["shoprite", "spar", "market", "grocery", "supermarket", "park n shop"]

# Recommendations as (type, title, body, priority).
ADVICE = {
    "cash_negative": (
        "alert", "⚠ Negative Cash Flow This Month",
        "You spent {gap} more than you earned. Immediate action needed: identify and cut "
        "non-essential spending.", 1),
    "savings_low": (
        "warning", "↓ Savings Rate Too Low ({rate}%)",
        "Your savings rate is below the 20% minimum. To reach 20%, save an additional {gap} "
        "this month. Start by cutting discretionary spending.", 2),
    "savings_boost": (
        "tip", "↑ Boost Savings to 30% (currently {rate}%)",
        "You're close to the 30% target. Saving {gap} more per month would put you in the "
        "'healthy finances' zone.", 5),
    "savings_strong": (
        "opportunity", "✓ Strong Savings Rate ({rate}%)",
        "You're saving above 30% — excellent discipline. Consider putting the surplus into a "
        "goal fund or investment.", 8),
    "burn": (
        "warning", "🔥 High Burn Rate",
        "You're spending {share}% of your income. At this rate, one unexpected expense could "
        "push you negative. Build a {buffer} buffer.", 2),
    "overspend": (
        "warning", "↑ Overspending on {title}",
        "You spent {actual} on {category} ({share}% of income). Target is {target}%. Reducing "
        "by 15% saves {saving}/month.", 3),
    "over_budget": (
        "warning", "Over Budget: {title}",
        "You've exceeded your {category} budget by {over} ({actual} spent vs {budget} "
        "budgeted).", 3),
    "subscription_load": (
        "warning", "↺ Subscription Overload ({n} services, {total}/mo)",
        "Your {n} subscriptions cost {total}/month ({share}% of income). Cancelling 2 "
        "lowest-used could save ~{saving}/month.", 3),
    "subscription_count": (
        "tip", "📱 {n} Active Subscriptions Detected",
        "You're paying {total}/month across {n} services. Review which you use less than once "
        "a week.", 6),
    "fund_critical": (
        "alert", "🆘 Emergency Fund Critical (< 1 Month Coverage)",
        "Your emergency fund covers only {months} months of expenses. You need {gap} more to "
        "reach the 6-month target. Prioritize this above all non-essential spending.", 2),
    "fund_low": (
        "warning", "🛡 Emergency Fund Below Target ({months} of 6 months)",
        "Target: {target}. Current: {fund}. Save {monthly}/month to close the gap in 6 "
        "months.", 3),
    "fund_building": (
        "tip", "🛡 Keep Building Emergency Fund ({months}/6 months)",
        "You're making progress. {gap} more to fully fund.", 7),
    "eating_out": (
        "tip", "🍔 Eating Out {ratio}x More Than Groceries",
        "You spent {out} on restaurants vs {groceries} on groceries. Cooking 3 extra meals per "
        "week could save ~{saving}/month.", 5),
    "weekend": (
        "tip", "📅 Weekend Spending is {share}% of Total Expenses",
        "You spend {weekend} on weekends vs {weekday} on weekdays. Plan weekend activities "
        "with a spending cap to reduce impulse purchases.", 6),
    "variable_income": (
        "tip", "📊 Variable Income Detected",
        "Your monthly income varies significantly (CV={cv}%). Budget based on your lowest "
        "income month ({lowest}) to avoid shortfalls.", 5),
    "goals": (
        "warning", "◈ Goal Contributions Exceed Monthly Savings",
        "Your active goals require {needed}/month, but you're only saving {net}. Consider "
        "extending goal timelines or reducing non-essential spending by {gap}.", 4),
}

# Forecast.
LOW_BALANCE = 50_000
EWM_SPAN = 14
HORIZON_DAYS = 30

# Assistant intents in order, with trigger words and replies.
CHAT_INTENTS = [
    ("overspend", ["overspend", "spend too much", "where did my money go"],
     "Your top expense categories this month drove most of the spending. With {rate}% savings "
     "rate, there's room to tighten food and subscription costs. Cutting food by 15% alone "
     "could save ₦{food_cut}."),
    ("save", ["save", "how to save", "save more"],
     "To hit a 30% savings rate, you'd save ₦{goal}/month. You're currently at ₦{savings}. "
     "Close the ₦{gap} gap by cutting subscriptions and reducing eating out."),
    ("health", ["health", "score", "how am i doing"],
     "You're saving {rate}% of your income. Your emergency fund and subscription costs are the "
     "areas pulling your health score down. Prioritize building 6 months of emergency savings."),
    ("income", ["income", "earn", "salary"],
     "Your total income this period was ₦{income}. Consider diversifying income sources to "
     "improve stability."),
    ("default", [],
     "This month: income ₦{income}, expenses ₦{expenses}, savings ₦{savings} ({rate}%). Ask me "
     "about overspending, how to save more, or your health score for specific advice."),
]
CHAT_FOOD_CUT = (0.15, 0.23)
CHAT_GOAL_SHARE = 0.30

# Warnings of the validation report.
VALIDATION_WARNINGS = {
    "empty": "No transactions found after cleaning.",
    "dates": "{n} rows have unparseable dates — dropped.",
    "amounts": "{n} rows have zero or negative amounts.",
    "all_credits": "All transactions parsed as credits — check tx_type column mapping.",
}

# Learned classifier settings.
ML_MIN_DOC_FREQ = 2
ML_MAX_FEATURES = 10_000
ML_MAX_ITERATIONS = 1000
#: How near a classifier's loss comes to the least one, in proportion.
ML_TOLERANCE = 1e-8
ML_FOLDS = 5
#: Hash digits of a sample's key that name its bucket when folds are dealt: 4,096 buckets a label.
ML_FOLD_BUCKET_DIGITS = 3
ML_MIN_CONFIDENCE = 0.65

# Widths of the stored transaction columns.
STORED_WIDTHS = {"description": 500, "raw_desc": 500, "channel": 100, "merchant": 200,
                 "bank": 100, "fingerprint": 64}
HISTORY_LENGTH = 20
