"""Fixed values the results depend on.

FIXED VALUES: these must equal the surveyed project's values for its results
to be reproduced. They are stated here once, in their natural order.
"""

from __future__ import annotations

# --- FIXED VALUES: reviewer trait families and their declared values -------
# (family name, review column, declared values, output label per value)
AGE_VALUES = ["13to17", "18to24", "25to34", "35to44", "45to54", "over54"]
COUNTRY_VALUES = ["en_CA", "en_US"]
COUNTRY_LABELS = {"en_US": "United State", "en_CA": "Canada"}
RECOMMENDED_LABELS = {"false": "NotRecomended", "true": "Recomended"}
FEATURED_LABELS = {"false": "NotFeatured", "true": "Featured"}
SYNDICATED_LABELS = {"false": "NotSyndicated", "true": "Syndicated"}
EYE_COLOR_VALUES = ["Grey", "blue", "brown", "gray", "green", "hazel"]
HAIR_COLOR_VALUES = ["auburn", "black", "blonde", "brown", "brunette", "gray", "red"]
HAIR_CONDITION_VALUES = ["chemicallyTreated", "coarse", "curly", "dry", "fine",
                         "normal", "oily"]
SKIN_TONE_VALUES = ["dark", "deep", "ebony", "fair", "fairLight", "light",
                    "lightMedium", "medium", "mediumTan", "notSureST", "olive",
                    "porcelain", "rich", "tan"]
SKIN_TYPE_VALUES = ["combination", "dry", "normal", "oily"]
SENTIMENT_LABELS = {0.0: "BadSentiment", 1.0: "GoodSentiment"}

# Root category → trait family shown on the product page; anything else
# shows the recommended / not recommended split.
CATEGORY_FAMILY = {"Skincare": "skin_type", "Hair": "hair_condition",
                   "Makeup": "skin_tone"}
OTHER_CATEGORY_FAMILY = "recommended"

# --- FIXED VALUES: sizes and model settings -------------------------------
REVIEW_PAGE_SIZE = 100          # reviews per API page
RECOMMENDATIONS_PER_PRODUCT = 10
TRAIN_ROW_CAP = 100_000         # rows kept for training (ordered by product)
HASHED_FEATURES = 10_000
TRAIN_FRACTION = 0.8
SPLIT_SEED = 42
LOGREG_MAX_ITER = 10
TOPIC_COUNT = 5
LOW_RATING, HIGH_RATING = 1, 5  # extreme ratings used as labels 0 / 1

# Context attributes of a review that the profile counts.
ATTRIBUTE_KEYS = ["age", "eyeColor", "hairColor", "hairCondition", "skinTone", "skinType"]

# Product id inside a review API URL.
API_PRODUCT_ID_PATTERN = r"ProductId%3A(\w+)"

# --- FIXED VALUES: English stopwords used to clean descriptions -----------
# The published English stopword corpus (179 words), in its own order.
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "you're", "you've", "you'll", "you'd", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "she's", "her",
    "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this",
    "that", "that'll", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there",
    "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "don't", "should", "should've", "now", "d", "ll", "m",
    "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn",
    "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
]
