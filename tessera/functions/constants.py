"""Fixed values that are part of the results."""

from __future__ import annotations

# Source weights of the three unions, with their defaults.
YEAR_UNION_WEIGHTS = {
    "billboard_hot_100": 1.0,
    "billboard_rap": 1.0,
    "billboard_country": 1.0,
    "billboard_latin": 1.0,
    "billboard_rnb": 1.0,
    "billboard_dance": 1.0,
    "billboard_rock": 1.0,
    "spotify_global": 0.5,
    "spotify_uk": 0.5,
    "spotify_us": 0.4,
    "apple_music": 0.4,
    "youtube_music": 0.4,
}
YEAR_UNION_DEFAULT = 0.4
GENRE_UNION_WEIGHTS = {"rolling_stone": 1.0, "grammy": 0.7, "gaon": 0.5, "latin_grammy": 0.7, "wiki_list": 0.5}
GENRE_UNION_DEFAULT = 0.5
VIRAL_UNION_WEIGHTS = {"tiktok_year": 1.0, "spotify_viral": 0.8, "billboard_trending": 0.7, "wiki_viral": 0.5}
VIRAL_YEAR_PRIORITY = {"tiktok_year": 3, "billboard_trending": 2, "wiki_viral": 1, "spotify_viral": 0}
VIRAL_UNION_DEFAULT = 0.5

TOP_PER_YEAR = 420
DECADE_TARGETS = {"1960s": 150, "1970s": 150, "1980s": 170, "1990s": 180, "2000s": 180, "2010s": 170}
ARTIST_CAP = 500
TIERS = ("canonical", "decades", "recent", "genre", "viral", "favorites")

# Passages.
WINDOW_LINES, STEP_LINES, MIN_CHARS, MIN_LAST_LINES = 8, 6, 50, 4

# Search.
LANGUAGE_BOOST = 0.1
MULTILINGUAL = ("pl", "de", "es")
QUERY_LANGUAGES = ("en", "pl", "de", "es")
PASSAGE_LANGUAGES = ("en", "pl", "de", "es", "fr", "it", "pt", "ko", "ja")
RRF_K, RRF_TOP = 60, 10
LIST_DEPTH = 100
MIN_K, MAX_K, DEFAULT_K = 1, 25, 10

# Evaluation.
RELEVANT, MAX_GRADE = 2, 3
RECALL_AT, NDCG_AT = (1, 5, 10), 10
BANDS = (("top", 1, 3), ("mid", 4, 10), ("deep", 15, 30))
EVAL_LANGUAGES = ("en", "pl", "de", "es")
SMALL_SLICE = 10
QUERY_MIX = {"en": 70, "pl": 15, "de": 10, "es": 5}
OVER_GENERATE, LEAST_CANDIDATES, CATEGORIES = 1.4, 5, 5
TOKEN_BUDGETS = (150, 150, 400)
