"""Fixed values.

Everything in this file is data that results depend on: word lists, labels,
patterns, thresholds and texts. It holds no logic. Words are lower case; the
functions lower-case (and where stated fold) the text before they look for them.
Entries are regular-expression fragments.
"""

# ---- fixed values: brands of the default profile, in profile order ------------
BRANDS = [
    "Arc'teryx", "Norrøna", "Haglöfs", "Fjällräven", "Klättermusen", "Bergans",
    "Lundhags", "Mammut", "Ortovox", "Dynafit", "La Sportiva", "Patagonia", "Rab",
    "Mountain Equipment", "Montura", "Houdini", "Peak Performance", "66°North",
    "Goldwin", "Tilak", "Odlo",
]
WAIST_INCHES = [33, 34]
INSEAM_MAX = 32
MIN_DISCOUNT_PCT = 40
NEAR_MIN_PCT = 30
NEAR_LIMIT = 12
IMPLAUSIBLE_PCT = 85
EXCLUDED_PRODUCT_TERMS = [
    "rain pant", "waterproof pant", "hardshell pant", "winter pant", "ski pant",
    "zip-off", "convertible pant", "bib", "insulated pant",
]

# ---- fixed values: product words ---------------------------------------------
TROUSER_WORDS = [
    "hosen?", "pants?", "trousers?",
    "(?:trekking|wander|outdoor|softshell|stretch|funktions|reise|travel|walking|hiking|kletter|langlauf|ski|regen)hosen?",
    "pantalon(?:s|e|i|es)?", "calzoni", "byxor", "bukser", "broek", "housut",
    "kalhoty", "nohavice", "spodnie",
]
EXCLUDED_WORDS = [
    "damen", "frauen", "women", "womens", "woman", "ladies", "femme", "femmes",
    "ws", "w's", "wmns", "donna", "mujer", "dames", "dam", "naiset", "naisten",
    "damske", "damsky", "damskie", "dame", "casual", "chinos?", "jeans", "denim",
    "sweat", "lounge", "wide", "warm(?:er)?", "kinder", "kids", "junior", "mädchen",
    "girls", "shorts?", "kurze hose", "tights?", "leggings?", "joggers?",
    "sweatpants?", "cross.country", "snowboard", "winter", "insulated", "thermal",
    "gefüttert", "fleece", "rain pants?", "waterproof pants?", "hardshell",
    "überhose", "overtrousers?", "zip[ -]?off", "convertible", "bermuda", "bib",
    "salopette",
]
EXCLUDED_COMPOUNDS = [
    "(?:freizeit|fleece|rad|bike|lauf|jogging|touren)hosen?",
    "skitour(?:en)?(?:hose|hosen|pants?)?", "langlauf(?:hose|hosen|pants?)?",
    "winter(?:hose|hosen|pants?)?", "regen(?:hose|hosen|pants?)?",
    "kletter(?:hose|hosen|pants?)?",
]
OTHER_WEARER_WORDS = [
    "damen", "frauen", "women'?s?", "ladies", "femmes?", "kinder", "kids", "junior",
    "mädchen", "girls",
]
OTHER_SPORT_COMPOUNDS = [
    "skitour(?:en)?(?:hose|hosen|pants?)?", "langlauf(?:hose|hosen|pants?)?",
    "winter(?:hose|hosen|pants?)?", "regen(?:hose|hosen|pants?)?",
]
# Structured feeds (category, gender and tag columns).
CATEGORY_TROUSER_WORDS = ["hose", "hosen", "pants?", "trousers?"]
CATEGORY_TROUSER_PATHS = [
    r"outdoor-bekleidung\s*>\s*hosen", r"bekleidung\s*>\s*hosen", "trekkinghosen", "wanderhosen",
]
CATEGORY_EXCLUDED = [
    "gürtel|belt", "funktionsunterwäsche|unterwäsche|brief|boxer", "tights?|leggings?",
    "shorts?|kurze hose", "regenhose|hardshell", "skihose|ski hose|skitour|langlauf",
    "zip[- ]?off|convertible", "latzhose", "kids?|kinder|junior|mädchen|jungen",
    "fahrrad|bike|mtb|cycling|dirt craft",
]
CATEGORY_EXCLUDED_WORD_END = ["bib"]
# Listing texts.
LISTING_TROUSER_PARTS = ["hose", "hosen", "pant", "pants", "trouser", "jogger"]
LISTING_EXCLUDED_PARTS = [
    "damen", "women", "girl", "kinder", "zip[- ]?off", "regenhose", "hardshell",
    "skihose", "ski pants",
]
LISTING_EXCLUDED_WORD_END = ["shorts?", "bib"]
# Links to product pages.
PRODUCT_LINK_WORDS = [
    "hose", "pants?", "trousers?", "bukser", "byxor", "housut", "kalhoty", "broek", "pantalon",
]
PRODUCT_LINK_EXCLUDED = [
    "damen", "women", "womens", "dame", "naiset", "damske", "dámské", "kids", "kinder",
    "shorts", "tights", "leggings",
]
PRODUCT_PATH_PATTERN = r"\d{3,}|/p/|\.html?$|_z\d+|-p\d+"
# Collected page addresses.
SITEMAP_CATEGORY_WORDS = [
    "herren", "men", "pants", "hose", "hosen", "trousers", "outdoor", "trekking", "wandern",
    "sale", "outlet", "kalhoty", "panske", "spodnie", "meskie", "pantaloni", "pantalon",
]
URL_TROUSER_WORDS = [
    "hosen?", "pants?", "trousers?", "softshell", "trekking", "wander", "stretch",
    "pantalon", "calzoni", "spodnie", "kalhoty",
]
URL_UNWANTED_WORDS = [
    "damen", "women", "womens", "kinder", "kids", "shorts?", "zip.off", "winter", "ski",
    "regen", "rain", "waterproof", "hardshell",
]
URL_CATEGORY_PARTS = [
    "/category/", "/kategorie/", "/outlet/?$", "/sale/?$", "/hosen/?$",
]
URL_POINTS = {"brand": 8, "word": 5, "unwanted": -16, "category": -3}
CLAIM_LINK_WORDS = [
    "product", "artikel", "produkt", "hose", "pants", "trouser", "trekking", "outdoor",
    "shop", r"p/\d", "kalhoty", "pantalon",
]

# ---- fixed values: fit and colour ----------------------------------------------
FIT_BASE = 55
FIT_PLUS_WORDS = [
    "stretch", "lightweight", "leicht", "packable", "schnelltrock", "quick dry", "abrasion",
    "robust", "travel", "trekking", "hiking", "regular fit",
]
FIT_MINUS_WORDS = [
    "heavyweight", "reinforced knee", "alpine", "mountaineering", "expedition", "gaiter", "snow",
]
FIT_HEAVY_WORDS = ["heavyweight", "schwere winterhose", "extra thick", "dick gefüttert"]
FIT_PLUS, FIT_MINUS, COLOUR_BONUS = 5, 10, 5
EXCLUDED_COLOURS = ["white", "weiß", "weiss", "blanc", "bianco", "neon", "fluorescen", "knall"]
PREFERRED_COLOURS = [
    "navy", "dark blue", "light blue", "blue", "black", "schwarz", "blau", "grey", "gray", "grau",
]

# ---- fixed values: availability --------------------------------------------------
SOLD_OUT_PATTERN = "out.of.stock|sold.out|ausverkauft|nicht.verfügbar"
CARD_SOLD_OUT_PATTERN = "ausverkauft|sold out|out of stock|nicht verfügbar|épuisé|esaurito"
LISTING_SOLD_OUT_PATTERN = "ausverkauft|nicht verfügbar|sold out"
DETAIL_SOLD_OUT_PATTERN = "outofstock|soldout|discontinued"
IN_STOCK_PATTERN = "instock|limitedavailability"
FEED_IN_STOCK_PATTERN = "sofort lieferbar"
EXPIRED_POST_WORDS = ["abgelaufen", "expired"]

# ---- fixed values: size labels (upper case) ----------------------------------------
SIZE_PREFIX_PATTERN = r"^(?:GR(?:\.|ÖSSE|OESSE)?|SIZE|TAILLE|TALLA|TAGLIA|STORLEK|KOKO)\s*:?\s*"
SIZE_INCH_SUFFIX_PATTERN = r'\s*(?:IN(?:CH)?|")$'
SIZE_REGION_SUFFIX_PATTERN = r"\s*\((?:EU|DE|EUR)\)$"
SIZE_CUTS = ["REGULAR", "REG", "SHORT", "KURZ", "LONG", "LANG", "TALL"]
SIZE_LONG_CUTS = ["LONG", "LANG", "TALL"]
SIZE_LETTERS = ["XXS", "XS", "S", "M", "L", "XL", "XXL", "XXXL", "[2-6]XL"]
SIZE_TARGET_LETTER = (
    r"^(?:L|LARGE)(?:\s*[-/]?\s*(?:REG(?:ULAR)?|R|SHORT|S|KURZ|K|STANDARD|NORMAL))?$")
SIZE_LONG_LETTER = r"^(?:L|LARGE)\s*[-/]?\s*(?:LONG|LANG|TALL|T)$"
SIZE_NEAR_LETTER = r"^(?:M\s*/\s*L|L\s*/\s*XL|M-L|L-XL)$"
SIZE_OTHER_LETTER = (
    r"^(?:XXS|XS|S|SMALL|M|MEDIUM|XL|X-LARGE|XXL|XXXL|[2-6]XL|[2-6]X)"
    r"(?:\s*[-/]?\s*(?:REG(?:ULAR)?|R|SHORT|S|LONG|L|KURZ|LANG|T|TALL))?$")
SIZE_WAIST_WORDS = ["W", "WAIST"]
SIZE_PAIR_MARKS = ["/", "X", "-"]
SIZE_LENGTH_WORDS = ["", "L", "LENGTH", "LÄNGE"]
SIZE_SHORT_MARKS = {
    "before": ["K", "KURZ", "KURZGRÖSSE", "KURZGROESSE"],
    "after": ["K", "KURZ", "KURZGRÖSSE", "KURZGROESSE", "SHORT FIT", "UNTERSETZT"],
}
SIZE_WAIST_CUTS = ["R", "REG", "REGULAR", "S", "SHORT", "K", "KURZ", "L", "LONG", "LANG", "T", "TALL"]
SIZE_WAIST_LONG_CUTS = ["L", "LONG", "LANG", "T", "TALL"]
SIZE_LONG_MARKS = ["LANG", "LANGGRÖSSE", "LANGGROESSE"]
SIZE_EU_MARKS = ["EU", "DE", "D", "GER"]
SIZE_SHAPED_PATTERN = (
    r"^(?:W?\d{2,3}(?:\s*[/X]\s*L?\d{2})?|(?:EU|DE)\s*\d{2}|XXS|XS|S|M|L|XL|XXL|[2-5]XL)$")
# Letters of a range like "S-4XL", in order.
RANGE_LETTERS = ["XXS", "XS", "S", "M", "L", "XL", "XXL", "3XL", "4XL", "5XL"]
SIZE_OPTION_NAMES = [
    "size", "sizes", "größe", "groesse", "grösse", "taille", "taglia", "taglia_id", "taglie",
    "talla", "maat", "storlek", "størrelse", "koko", "rozmiar", "velikost", "waist",
    "bundweite", "länge", "inseam",
]
SIZE_ATTRIBUTE_NAMES = [
    "size", "größe", "groesse", "grösse", "taglia", "talla", "taille", "storlek", "koko",
    "maat", "velikost", "rozmiar", "bundweite",
]
SIZE_ATTRIBUTE_CODE_PATTERN = "size|groesse|taglia|talla"
BRAND_ATTRIBUTE_CODES = ["manufacturer", "brand", "marca", "merk", "marke"]

# ---- fixed values: keys -------------------------------------------------------------
TRACKING_PARAMETER_PATTERN = (
    r"^(?:utm_.*|gclid|fbclid|ref|source|campaign|aid|affiliate(?:_?id)?|affid|clickid)$")
GENERIC_TITLE_PATTERN = (
    r"^(?:herren |men s? )?(?:wanderhose|trekkinghose|outdoorhose|softshellhose|pants?|trousers?|hose)$")
HIDE_GENERIC_WORD_PATTERN = (
    r"^(?:pants?|trousers?|hosen?|\p{L}*hosen?|herren|men|mens|ms|m|man|uomo|homme|hombre|"
    r"pantalon[eis]?|pantalones|byxor|bukser|broek)$")

# ---- fixed values: prices and badges ---------------------------------------------------
REFERENCE_LABELS = [
    r"\buvp\b", r"\bstatt\b", r"\blistino\b", "prezzo di listino", r"\badviesprijs\b", r"\brrp\b",
    "originalpreis", "ursprünglich", r"\bprix conseillé\b",
]
COMPARISON_LABELS = ["pvg", "vgp", "vergleichspreis", "nächstbester preis"]
UP_TO_WORDS = [r"bis(?:\s+zu)?", r"up\s+to", r"jusqu'?\s*[àa]", r"fino\s+al", "hasta"]
BADGE_MIN_PCT, BADGE_MAX_PCT = 40, 80
CURRENCY_TOKENS = {"€": "EUR", "EUR": "EUR", "CHF": "CHF", "£": "GBP", "GBP": "GBP",
                   "KČ": "CZK", "CZK": "CZK", "ZŁ": "PLN", "PLN": "PLN"}
FOREIGN_CURRENCY_PATTERN = r"\$|£|USD|GBP|SEK|NOK|DKK|CHF|PLN|CZK|zł|Kč"
CLAIM_REFERENCE_LABEL_PATTERN = r"uvp|listenpreis|statt|original|regular|previous|before|was\s|vorher"
CLAIM_PRICE_LABEL_PATTERN = (
    "sale|special|current|offer|price|preis|rabatt|reduziert|jetzt|angebot|prezzo|offerta|prix|"
    "actuel|aktuálně|nyní|cena")

# ---- fixed values: scores ------------------------------------------------------------------
SIZE_POINTS = {"confirmed": 100, "probable": 75, "unconfirmed": 45, "no": 0}
SCORE_WEIGHTS = {"size": 0.30, "fit": 0.25, "market": 0.20, "discount": 0.15, "merchant": 0.10}
RETURN_POINTS_UNKNOWN, RETURN_POINTS_FREE, RETURN_POINTS_PAID = 70, 85, 60
UNKNOWN_MARKET_DIVISOR = 0.8

# ---- fixed values: texts of near misses and coverage groups ------------------------------------
NEAR_REASONS = {
    "implausible": "Rabatt über 85 % – vermutlich falsch gelesen, im Shop prüfen.",
    "up_to": "Rabatt gilt laut Shop nur „bis“ – für deine Größe im Shop prüfen.",
    "no_evidence": "Referenzpreis oder Händler-Rabattangabe nicht hinreichend belegt.",
    "below_minimum": "Rabatt unter der Deal-Schwelle.",
    "check": "Rabattbeleg oder Produktdaten im Shop prüfen.",
}
COVERAGE_GROUPS = {
    "deals": "Mit Deals",
    "eligible": "Passende Hosen, aber kein Deal",
    "products": "Produkte, aber keine passenden Hosen",
    "blocked": "Blockiert",
    "empty": "Keine Produkte gelesen",
}

# ---- fixed values: limits and ages ----------------------------------------------------------------
SNAPSHOT_MAX_AGE_HOURS = 30
POST_MAX_AGE_DAYS = 10
BATCH_SIZE = 6

# ---- fixed values: page elements ---------------------------------------------------
# (attribute, text it contains); attribute "tag" compares the tag name, text None means
# that the attribute is present.
CARD_ELEMENTS = [
    ("tag", "article"), ("itemtype", "Product"), ("data-e2e-test", "product-card-container"),
    ("class", "product-card"), ("class", "productCard"), ("class", "product-tile"),
    ("class", "productTile"), ("class", "product-item"), ("class", "productItem"),
    ("data-testid", "product"), ("data-product-id", None), ("data-product-sku", None),
]
PRICE_ELEMENTS = [
    ("itemprop", "price"), ("data-price", None), ("data-testid", "price"), ("class", "product-price"),
]
STRUCK_ELEMENTS = [
    ("tag", "del"), ("tag", "s"), ("data-testid", "original-price"), ("class", "oldPrice"),
    ("class", "originalPrice"), ("class", "old-price"), ("class", "line-through"), ("class", "strike"),
    ("class", "was-price"), ("class", "price--pseudo"), ("class", "price--line-through"),
]
NAME_SECTION_ELEMENTS = [("data-e2e-test", "product-card-info-name-section")]
NAME_ELEMENTS = [
    ("data-e2e-test", "product-card-info-name-section"), ("itemprop", "name"), ("data-testid", "name"),
    ("data-testid", "title"), ("tag", "h2"), ("tag", "h3"), ("tag", "h4"), ("class", "title"), ("class", "name"),
]
BRAND_ELEMENTS = [("itemprop", "brand"), ("data-testid", "brand"), ("class", "brand")]
# Compared without regard to case.
BADGE_ELEMENTS = [
    ("data-testid", "discount"), ("data-testid", "badge"), ("class", "discount"), ("class", "rabatt"),
    ("class", "percent"), ("class", "badge"), ("class", "sale-badge"), ("data-e2e-test", "discount"),
]
LISTING_CARD_ELEMENTS = [
    ("tag", "article"), ("tag", "li"), ("data-testid", "product"), ("class", "product"), ("class", "tile"),
    ("class", "card"),
]
HEADING_ELEMENTS = [("tag", "h2"), ("tag", "h3"), ("tag", "h4"), ("class", "name"), ("class", "title")]
CLAIM_CARD_ELEMENTS = [
    ("tag", "article"), ("itemtype", "Product"), ("class", "product"), ("class", "Product"),
    ("data-product-id", None), ("data-product-sku", None), ("data-testid", "product"), ("tag", "li"),
]
CLAIM_SKIPPED_TAGS = ["script", "style", "noscript", "svg", "header", "footer", "nav", "form", "iframe"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
# Card rules of shops whose cards the general rules miss: source -> element -> class names.
CARD_RULES = {
    "barrabes": {"card": "card--product", "name": "card-product-name", "price": "price", "reference": "is__old"},
    "biwak": {"card": "productData", "name": "productsTitle", "brand": "manufacturer", "reference": "old"},
    "varuste": {"card": "item", "name": "item_name", "brand": "product_listing_brand_name"},
    "trekking-koenig": {"card": "product-box", "name": "product-name", "price": "product-price"},
}
NEXT_LABEL_PATTERN = r"\bnext\b|\bnächste\b|\bweiter\b|[→›»]"
PAGE_PARAMETERS = ["page", "p", "currentpage", "pagenumber"]
STATE_MARKER = "elementsList:"
