"""Word, phrase and topic lists that results depend on.

Every list is only a default; each scoring operator takes its own lists as arguments.
"""

# Opinion words of the short lexicon (12 positive, 11 negative).
POSITIVE_WORDS = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic",
    "love", "perfect", "best", "awesome", "happy", "satisfied",
]
NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "horrible", "worst", "poor",
    "hate", "disappointed", "useless", "waste", "regret",
]

# Opinion words of the long lexicon (17 positive, 16 negative).
POSITIVE_WORDS_LONG = POSITIVE_WORDS + ["beautiful", "outstanding", "superb", "brilliant", "delightful"]
NEGATIVE_WORDS_LONG = NEGATIVE_WORDS + ["dreadful", "appalling", "abysmal", "atrocious", "dismal"]

# Aspect candidates of the phrase scorer, in order (the first three are the fallback).
ASPECT_CANDIDATES = [
    "Product Quality", "Shipping", "Packaging", "Battery", "Price", "Customer Service", "Performance", "Durability",
]

# Phrases per aspect: (positive, negative).
ASPECT_PHRASES = {
    "product_quality": (
        ["high quality", "well made", "durable", "sturdy", "solid"],
        ["poor quality", "cheap", "flimsy", "broken", "defective"],
    ),
    "shipping": (
        ["fast shipping", "quick delivery", "arrived early", "well packaged"],
        ["slow shipping", "late delivery", "damaged", "lost package"],
    ),
    "packaging": (
        ["well packaged", "secure", "protected", "nice packaging"],
        ["poor packaging", "damaged box", "broken package"],
    ),
    "battery": (
        ["long battery", "good battery", "battery lasts"],
        ["short battery", "battery dies", "poor battery"],
    ),
    "price": (
        ["great price", "good value", "affordable", "worth"],
        ["overpriced", "too expensive", "not worth", "overpaid"],
    ),
    "customer_service": (
        ["great service", "helpful support", "excellent customer"],
        ["poor service", "bad support", "terrible customer", "rude"],
    ),
    "performance": (
        ["works great", "excellent performance", "fast", "smooth"],
        ["poor performance", "slow", "laggy", "does not work"],
    ),
    "durability": (
        ["long lasting", "durable", "built to last", "strong"],
        ["broke quickly", "falls apart", "cheap material", "worn out"],
    ),
}

# Keywords per aspect of the five-aspect taxonomy.
ASPECT_TAXONOMY = {
    "quality": [
        "quality", "durable", "sturdy", "well-made", "poor quality", "cheap", "broken", "defective", "material",
        "build", "solid", "reliable", "craftsmanship", "finish",
    ],
    "shipping": [
        "shipping", "delivery", "arrived", "package", "shipment", "fast shipping", "slow shipping", "shipping time",
        "delivered", "tracking", "packaging", "arrival",
    ],
    "customer_service": [
        "customer service", "support", "refund", "return", "helpful", "response", "contacted", "representative",
        "replacement", "complaint", "warranty", "assistance",
    ],
    "value": [
        "price", "worth", "expensive", "cheap", "overpriced", "value", "bargain", "cost", "affordable", "reasonable",
        "pricey", "deal", "paid", "spent",
    ],
    "usability": [
        "easy", "difficult", "setup", "install", "use", "user-friendly", "intuitive", "confusing", "complicated",
        "instruction", "manual", "guide", "interface",
    ],
}

# Opinion words counted near a taxonomy keyword.
OPINION_WORDS_POSITIVE = [
    "great", "excellent", "amazing", "wonderful", "fantastic", "love", "perfect", "best", "awesome", "outstanding",
    "satisfied", "happy", "impressed", "recommend", "superb",
]
OPINION_WORDS_NEGATIVE = [
    "terrible", "awful", "horrible", "worst", "disappointed", "frustrating", "useless", "waste", "regret", "poor",
    "bad", "dreadful", "unacceptable", "defective", "hate",
]

# Keywords per rule topic.
TOPIC_KEYWORDS = {
    "product_quality": ["quality", "durable", "sturdy", "well made", "solid", "craftsmanship"],
    "customer_service": ["customer service", "support", "refund", "return", "helpful", "response"],
    "shipping_delivery": ["shipping", "delivery", "arrived", "package", "shipment", "delivered"],
    "price_value": ["price", "worth", "expensive", "cheap", "value", "cost", "affordable"],
    "usability": ["easy", "difficult", "setup", "install", "use", "user friendly", "intuitive"],
    "battery": ["battery", "charge", "power", "lasts", "battery life"],
    "performance": ["fast", "slow", "performance", "speed", "works great", "efficient"],
    "design": ["design", "look", "appearance", "style", "color", "size", "compact"],
}

# Names tried when looking for the target column of an unknown table.
TARGET_NAMES = ["sentiment", "Score", "label", "target", "class", "rating"]
TARGET_HINTS = ["sentiment", "score", "rating", "label"]
