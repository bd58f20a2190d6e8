"""Word lists, patterns and constants that results depend on."""

# Fixed value: prices from which a run counts as done.
ENOUGH_PRICES = 3

# Words dropped from titles.
STOPWORDS = "the a an and or for with in on at to of by from new free shipping".split()

# Phrases that mark an accessory unless the query has them.
ACCESSORY_PHRASES = [
    "laptop bag", "laptop briefcase", "briefcase", "notebook bag", "shoulder bag", "carrying case", "case for", "cover for",
    "folio for", "phone case", "tablet case", "keyboard case", "charging case", "protective case", "screen protector",
    "tempered glass", "charger only", "cable only", "replacement part", "replacement earpad", "replacement earpads",
    "earpads replacement", "ear pads replacement", "ear pad replacement", "earpad for", "earpads for", "ear pads for",
    "ear pad for", "ear cushions", "ear pads cushions", "replacement cups", "sheepskin replacement", "leather ear pads",
    "leather earpads", "velour earpads", "velour ear pads", "velour pads", "memory foam earpads", "memory foam ear pads",
    "earmuff replacement", "replacement earmuffs", "replacement ear", "noise isolation foam", "tv mount", "dash mount",
    "monitor mount", "tripod mount", "desk mount", "stand only", "case compatible", "cover compatible", "sleeve for",
    "holder for", "shell for",
]

# Bundle words (8 points each) and bundle markers of listings (12 points each).
BUNDLE_WORDS = ["bundle", "2-pack", "3-pack", "combo", "+ keyboard", "with keyboard"]
BUNDLE_MARKERS = [
    "bundle", "soundbar", "sound bar", "wireless-speaker", "wireless-speakers", "wireless-soundbar", "matching sound",
    "with soundbar", "channel matching", "protection bundle",
]
BUNDLE_QUERY_WORDS = ["bundle", "soundbar", "sound bar", "combo", "with soundbar"]

# Words of queries for devices, and of listings for their peripherals.
DEVICE_WORDS = [
    "macbook", "laptop", "notebook", "tablet", "ipad", "chromebook", "surface pro", "surface laptop", "airpods", "earbuds",
    "headphone", "headphones", "earphones", "speaker", "soundbar", "monitor", "keyboard", "mouse", "webcam", "microphone",
]
PERIPHERAL_WORDS = [
    "charger", "power adapter", "usb-c adapter", "usb c adapter", "charging cable", "charging adapter", "replacement battery",
    "docking station", "usb c hub", "hub adapter",
]
EARBUD_WORDS = ["earbud", "earbuds", "in-ear", "in ear", "true wireless"]
OVER_EAR_WORDS = ["over-ear", "over ear", "over the ear", "around-ear", "around ear"]
EARBUD_ASINS = ["B0D6WCQWJS", "B0D6WBKCPD"]

# Patterns over normalised titles.
ALIASES = [
    (r"\bgb\b", "gigabyte"),
    (r"\btb\b", "terabyte"),
    (r"\bgen\s*(\d+)\b", "generation $1"),
    (r"\b(\d{1,2})\s*inch\b", "$1 inch"),
    (r'\b(\d{1,2})"\b', "$1 inch"),
]
MODEL_TOKEN = r"\b([a-z]{1,3}[0-9]{2,5}|[0-9]{4}|[a-z]+[0-9]+[a-z]*[0-9]*|m[1-9])\b"
YEAR = r"\b((?:19|20)[0-9]{2})\b"
VARIANT_WORD = r"\b(ultra|plus|se|lite|neo|go|mini|max|pro|elite|air|slim)\b"
NON_NEW = r"\b(renewed(?:\s+premium)?|refurb(?:ished)?|open[-\s]?box|pre[-\s]?owned|used\s*[-–]?\s*|certified\s+refurbished)\b"
USED_QUERY = r"\b(renewed|refurb(?:ished)?|open[-\s]?box|pre[-\s]?owned|used)\b"

# Patterns of pages that block robots, in general and by retailer.
BOT_PATTERNS = [
    "captcha", r"robot\s*check", r"unusual\s+traffic", r"access\s+denied", r"are\s+you\s+a\s+human", r"verify\s+you\s+are\s+human",
    "cf-browser-verification", "challenge-platform", r"please\s+enable\s+javascript", r"automated\s+access",
]
SITE_BOT_PATTERNS = {"Amazon.com": [r"api-services-support@amazon\.com", "/errors/validatecaptcha"], "Walmart.com": ["px-captcha", "robot or human"]}
GENERIC_TITLES = ["amazon.com", "best buy", "walmart.com", "newegg.com", "access denied"]

# Words of accessory URLs, of add-on price blocks, and made-up item ids.
ACCESSORY_SLUGS = ["case", "keyboard", "cover", "folio", "protector", "charger", "cable", "mount", "bag", "sleeve", "backpack", "carrying-case", "screen-protector"]
ADD_ON_WORDS = [
    "trade-in", "tradein", "protect", "insurance", "warranty-", "warranty_", "subscription", "monthly", "protection-plan",
    "applecare", "installment", "financing", "coupon", "promo",
]
MADE_UP_ITEM_IDS = ["12345678", "123456789", "1234567890", "0123456789"]

# Retailers in output order: website, domain, search URL before the query.
RETAILERS = [
    (0, "Amazon.com", "amazon.com", "https://www.amazon.com/s?k="),
    (1, "BestBuy.com", "bestbuy.com", "https://www.bestbuy.com/site/searchpage.jsp?st="),
    (2, "Walmart.com", "walmart.com", "https://www.walmart.com/search?q="),
    (3, "Newegg.com", "newegg.com", "https://www.newegg.com/p/pl?d="),
]

# Checks in pipeline order and what results lack without them.
COMPONENTS = [
    (0, "search plan", "per-retailer search terms fell back to the raw query"),
    (1, "listing extract", "listings parsed by selectors only, with no LLM fallback"),
    (2, "title verify", "listings accepted without checking they are the same product"),
    (3, "price verify", "prices accepted without checking they are the buy-box amount"),
    (4, "price benchmark", "no reference prices, so no outlier rescrape"),
    (5, "trust scoring", "review-trust labels come from the heuristic, not the model"),
]
OTHER_CONSEQUENCE = "this check did not run"

# Weights and thresholds.
WEIGHTS = {"wratio": 0.55, "token_set": 0.25, "recall": 0.15, "year": 0.05}
MIN_SCORE, SOFT_FLOOR = 48.0, 42.0
MAX_SERP_ROWS, MAX_ATTEMPTS, MAX_REFINEMENTS = 15, 5, 2
PRICE_GAP, MAX_TEXT_CHARS, SITE_TIMEOUT_S = 0.20, 20_000, 240
