"""Product-name text functions, all as JVM-side column expressions.

Word boundaries are written out as look-arounds over letters, digits and the
underscore, so accented words are handled alike on every Java version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}_]"
_START = rf"(?<!{_WORD})"
_END = rf"(?!{_WORD})"

# Word lists, units and patterns of the product-name rules.
CLEAN_UNITS = ["oz", "lb", "mg", "g", "kg", "ml", "l", "ct", "count", "pack", "pk"]
CLEAN_FILLERS = [
    "organic", "natural", "premium", "classic", "original", "fresh", "pure",
    "select", "choice", "quality", "perfect", "great", "best",
]
GENERIC_FIRST_WORDS = [
    "organic", "fresh", "premium", "select", "choice", "great", "perfect",
    "classic", "original", "natural", "pure",
]
CATEGORY_KEYWORDS = {
    "dairy": ["milk", "cheese", "yogurt", "butter", "cream", "dairy"],
    "meat": ["chicken", "beef", "pork", "turkey", "ham", "bacon", "sausage", "meat"],
    "produce": ["apple", "banana", "orange", "lettuce", "tomato", "potato", "onion", "carrot"],
    "beverages": ["juice", "soda", "water", "tea", "coffee", "drink", "beverage"],
    "bakery": ["bread", "bagel", "muffin", "cake", "cookie", "bakery"],
    "frozen": ["frozen", "ice", "cream"],
    "pantry": ["pasta", "rice", "cereal", "sauce", "oil", "vinegar"],
    "snacks": ["chips", "crackers", "nuts", "snack"],
    "cleaning": ["detergent", "soap", "cleaner", "paper", "towel"],
    "personal_care": ["shampoo", "toothpaste", "lotion", "deodorant"],
}
KEY_TERM_STOP_WORDS = [
    "the", "and", "or", "of", "in", "to", "a", "an", "with", "for", "on", "at", "by",
    "organic", "natural", "fresh", "premium", "select", "choice", "great", "best",
    "value", "pack", "count", "size", "oz", "lb", "lbs", "ct", "piece", "pieces",
]
KEY_TERM_GROUPS = [
    ["chocolate", "vanilla", "strawberry", "berry", "fruit", "apple", "orange", "banana"],
    ["cheese", "cheddar", "swiss", "mozzarella", "milk", "cream", "butter"],
    ["chicken", "beef", "pork", "turkey", "fish", "salmon", "tuna"],
    ["whole", "skim", "fat", "free", "low", "reduced", "diet"],
    ["spicy", "mild", "hot", "sweet", "sour", "salty"],
]
COMPARISON_UNITS = ["oz", "lb", "lbs", "ct", "count", "pack", "piece", "pieces", "size"]
COMPARISON_REMOVED = ["organic", "natural", "premium", "select", "choice", "great value"]


def _whole_words(words: list[str]) -> str:
    return f"{_START}({'|'.join(words)}){_END}"


def _collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"[\s\p{Z}]+", " "))


def _words(col: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.filter(F.split(_collapse(col), " "), lambda w: w != "")


def clean_product_name(name: Column) -> Column:
    """Lower-case name without sizes, multi-packs and filler words; NULL gives ''."""
    text = F.lower(F.coalesce(name, F.lit("")))
    text = F.regexp_replace(
        text, rf"{_START}\d+(\.\d+)?\s*({'|'.join(CLEAN_UNITS)}){_END}", ""
    )
    text = F.regexp_replace(text, rf"{_START}\d+\s*x\s*\d+{_END}", "")
    return _collapse(F.regexp_replace(text, _whole_words(CLEAN_FILLERS), ""))


def extract_brand(name: Column) -> Column:
    """The first word in lower case, unless generic or shorter than three letters."""
    first = F.lower(F.get(_words(F.coalesce(name, F.lit(""))), 0))
    usable = (F.length(first) > 2) & ~first.isin(GENERIC_FIRST_WORDS)
    return F.when(usable, first).otherwise(F.lit(""))


def extract_category_keywords(name: Column) -> Column:
    """[category, keyword] for the first keyword of each category inside the name."""
    text = F.lower(F.coalesce(name, F.lit("")))
    found = []
    for category, keywords in CATEGORY_KEYWORDS.items():
        hit = F.coalesce(*[F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords])
        found.append(F.when(hit.isNotNull(), F.array(F.lit(category), hit)))
    return F.flatten(F.array_compact(F.array(*found)))


def product_text(name: Column, department: Column, aisle: Column) -> Column:
    """The weighted text of a product: name x3, department, aisle, brand x2, keywords."""
    clean = clean_product_name(name)
    brand = extract_brand(name)

    def present(col: Column) -> Column:
        return F.when(F.coalesce(col, F.lit("")) != "", F.array(F.lower(col))).otherwise(
            F.array().cast("array<string>")
        )

    parts = F.concat(
        F.array_repeat(clean, 3),
        present(department),
        present(aisle),
        F.when(brand != "", F.array_repeat(brand, 2)).otherwise(F.array().cast("array<string>")),
        extract_category_keywords(name),
    )
    return F.array_join(parts, " ")


def extract_key_terms(name: Column) -> Column:
    """Up to three descriptive terms: last word, second-last word, pattern hits."""
    text = F.trim(F.lower(name))
    runs = F.regexp_extract_all(text, F.lit(rf"{_WORD}+"), 0)
    words = F.filter(
        runs,
        lambda w: w.rlike("^[a-zA-Z]+$") & (F.length(w) > 2) & ~w.isin(KEY_TERM_STOP_WORDS),
    )
    tail = F.slice(F.reverse(words), 1, 2)

    def hits_of(group: list[str]) -> Column:
        return F.filter(runs, lambda w: w.isin(group))

    hits = [hits_of(group) for group in KEY_TERM_GROUPS]
    terms = F.slice(F.array_distinct(F.concat(tail, *hits)), 1, 3)
    return F.when(F.size(words) == 0, F.array(text)).otherwise(terms)


def smart_sort_key(name: Column, key_terms: Column) -> Column:
    """Two leading key terms and the whole name, so similar products sort together."""
    return F.concat_ws("_", F.slice(key_terms, 1, 2), F.lower(name))


def clean_for_comparison(name: Column) -> Column:
    """Lower-case name without pack sizes and six terms removed as plain substrings."""
    text = F.regexp_replace(
        F.lower(name), rf"{_START}\d+\s*({'|'.join(COMPARISON_UNITS)}){_END}", ""
    )
    for term in COMPARISON_REMOVED:
        text = F.replace(text, F.lit(term), F.lit(""))
    return _collapse(text)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(
                F.upper(F.left(r, F.lit(1))), F.lower(F.right(r, F.length(r) - 1))
            ),
        ),
        "",
    )
