"""Fixed values.

These lists, keys and patterns must equal the reference's for identical
results; they are stated here plainly, in their natural order, together.
Only the numeric size ranges are generated from their rule.
"""

# --- whitespace (Python's str.isspace set, spelled out so Java and DuckDB agree)
WHITESPACE_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)

# --- currency symbols, checked in this list order (not text order)
CURRENCY_SYMBOLS = [("€", "EUR"), ("$", "USD"), ("£", "GBP"), ("¥", "JPY")]

# --- title heuristic: class keywords of h1/h2
TITLE_CLASS_KEYWORDS = ["product", "title", "name", "heading", "detail"]

# --- price heuristics
TESTID_PRICE_RX = "(?i)(?:current)?price"
LU_TARGET_PRICE_RX = "(?i)price"
OLD_PRICE_MARKER_RX = "(?i)initial|original|old|was|strike|before|list|compare"
PRICE_CLASS_RX = (
    "(?i)(?:\\b(?:pricing|amount|money|cost|value|amt|currency|a-offscreen)\\b"
    "|price(?:-(?:current|sale|special|regular|old|new|final|our|offer|discount"
    "|actual|item|value|box|wrapper|container|label|text)|__(?:\\w+)|--(?:\\w+))?)"
)
LEAF_TAGS = ["span", "div", "p", "strong", "b", "td", "li"]
LEAF_MAX_CHARS = 20
LEAF_EXCLUDED_TOKENS = ["sku", "stock", "review", "avis", "livraison", "retour"]
OLD_PRICE_TAGS = ["del", "s"]
OLD_PRICE_CLASS_RX = (
    "(?i)(apex-basisprice-value|old-price|compare-price|regular-price|list-price"
    "|strike|original-price)"
)

# --- stock
OUT_OF_STOCK_KEYWORDS = ["rupture de stock", "épuisé", "out of stock"]
BUY_KEYWORDS = ["acheter", "ajouter au panier", "panier", "add to cart", "buy now", "sélectionner"]

# --- images
GALLERY_IMG_ATTRS = ["product", "gallery", "carousel", "main", "featured", "zoom", "thumb"]
META_IMAGE_KEYS = ["og:image", "og:image:secure_url", "twitter:image", "twitter:image:src"]

# --- meta tag precedence per field
META_KEYS = {
    "title": ["og:title", "twitter:title", "title"],
    "description": ["og:description", "twitter:description", "description", "keywords"],
    "price": ["product:price:amount", "og:price:amount", "twitter:data1", "price"],
    "currency": ["product:price:currency", "og:price:currency", "currency"],
    "brand": ["product:brand", "og:brand", "brand"],
    "sku": ["product:retailer_item_id", "product:sku", "sku"],
    "availability": ["product:availability", "og:availability", "availability"],
}

# --- JSON-LD
JSONLD_SKU_KEYS = ["sku", "mpn", "gtin13", "gtin8", "gtin14", "productID"]

# --- characteristics
CHAR_KEY_MAX = 80
CHAR_BRAND_VALUE_MAX = 100

# --- variants
SIZE_LETTERS = ["XL", "XXL", "XXS", "2XS", "XS", "S", "M", "L", "XXXL", "2XL", "3XL",
                "4XL", "5XL", "ONE SIZE", "OSFA"]
SIZE_NUMBERS = [str(n) for n in range(15, 53)]            # 15 .. 52
SIZE_HALVES = [f"{n}.5" for n in range(15, 53)]           # 15.5 .. 52.5
SIZES = SIZE_LETTERS + SIZE_NUMBERS + SIZE_HALVES
COLORS = [
    "NOIR", "BLANC", "GRIS", "ROUGE", "BLEU", "VERT", "JAUNE", "ROSE",
    "VIOLET", "MARRON", "BEIGE", "ORANGE", "OR", "ARGENT", "BLEU MARINE",
    "OLIVE", "BORDEAUX", "TURQUOISE", "SARCELLE", "IVOIRE", "CRÈME",
    "MULTICOLORE", "MOTIF", "BLACK", "WHITE", "GREY", "GRAY", "RED", "BLUE",
    "GREEN", "YELLOW", "PINK", "PURPLE", "BROWN", "BEIGE", "ORANGE", "GOLD",
    "SILVER", "NAVY", "OLIVE", "MAROON", "TURQUOISE", "TEAL", "IVORY", "CREAM",
    "MULTICOLOR", "PATTERN",
]
SELECT_SIZE_KEYWORDS = ["size", "taille", "format", "dimension"]
SELECT_COLOR_KEYWORDS = ["color", "couleur", "teinte", "pattern"]
OPTION_PLACEHOLDERS = ["choisir", "sélectionner", "select", "choose"]
VARIANT_DIMENSIONS = ["size", "color", "style", "pattern"]

# --- reviews
RATING_SELECTORS = ["[itemprop=ratingValue]", "[itemprop=reviewRating]", ".rating", ".stars",
                    "[data-rating-value]"]
REVIEW_COUNT_SELECTORS = ["[itemprop=reviewCount]", ".review-count", "[data-review-count]",
                          "#reviewCount"]

# --- sku / brand / category selectors
SKU_SELECTORS = ["[data-sku]", "[data-asin]", "[itemprop=sku]", "#sku", "#asin"]
BRAND_SELECTORS = ["[itemprop=brand]", "[data-brand]", ".brand", ".product-brand"]
BREADCRUMB_SELECTORS = [".breadcrumb", ".breadcrumbs", "nav[aria-label=breadcrumb]"]

# --- requests
STRATEGIES = ["HTTPX", "PLAYWRIGHT"]
DEFAULT_STRATEGY = "HTTPX"
