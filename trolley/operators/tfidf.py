"""TF-IDF term weights and the combined product similarity vectors, all sparse.

Vectors stay in long form (id, idx, weight); a dense row of thousands of zeros
is never built.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trolley.operators.catalogue import with_product_text
from trolley.storage import balanced, written

# Substrings that set the categorical flags, in vector order.
DEPARTMENT_FLAGS = ["produce", "dairy", "meat", "bakery", "frozen", "beverages", "snacks"]
AISLE_FLAGS = ["fresh", "frozen", "canned", "packaged", "organic"]
TEXT_WEIGHT = 0.8
# terms of so many texts are counted in one task before they are shuffled
TEXTS_PER_TASK = 4_000

# A short default; pass the list of your choice for another stop vocabulary.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he",
    "her", "his", "i", "in", "is", "it", "its", "my", "no", "not", "of", "on", "or", "our",
    "she", "so", "that", "the", "their", "them", "they", "this", "to", "was", "we", "were",
    "which", "who", "will", "with", "you", "your",
]


class TermVectors(NamedTuple):
    """``vocabulary``: term, idx, df, idf; ``weights``: id, idx, weight at unit length."""

    vocabulary: DataFrame
    weights: DataFrame


def tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-case tokens: a letter followed by letters or digits, stop words dropped."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.filter(
        runs, lambda w: w.rlike("^[a-zA-Z][a-zA-Z0-9]*$") & ~w.isin(stop_words)
    )


def with_bigrams(words: Column) -> Column:
    """The words followed by their neighbouring pairs."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(words, pairs)


def document_terms(
    docs: DataFrame, id_col: str, text_col: str, stop_words: list[str]
) -> DataFrame:
    """(id, terms): all words and word pairs of each text, repeats included."""
    words = docs.select(
        F.col(id_col).alias("id"), tokens(F.col(text_col), stop_words).alias("_words")
    )
    return words.select("id", with_bigrams(F.col("_words")).alias("terms"))


def term_statistics(documents: DataFrame) -> DataFrame:
    """(term, df, total_tf) with one shuffle, by term.

    A text's terms are sorted in place, so the first of equal ones marks the
    document and no (document, term) pair has to be shuffled. The outer explode
    keeps the planner from adding a not-empty filter that tokenises again.
    """
    ordered = documents.select(F.sort_array("terms").alias("t"))
    marked = ordered.select(
        F.explode_outer(
            F.transform(
                "t",
                lambda term, i: F.struct(
                    term.alias("term"),
                    ((i == 0) | (F.get(F.col("t"), i - 1) != term)).alias("is_first"),
                ),
            )
        ).alias("m")
    )
    present = marked.where(F.col("m").isNotNull())
    return present.groupBy(F.col("m.term").alias("term")).agg(
        F.count_if("m.is_first").alias("df"), F.count("*").alias("total_tf")
    )


def term_vocabulary(
    statistics: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.8, max_terms: int = 5000
) -> DataFrame:
    """(term, idx, df, idf): the most frequent admissible terms, indexed alphabetically."""
    admissible = (
        statistics.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs)))
        .orderBy(F.desc("total_tf"), "term")
        .limit(max_terms)
    )
    # at most max_terms rows from here on
    idf = F.log((1 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    return admissible.select(
        "term",
        (F.row_number().over(W.orderBy("term")) - 1).alias("idx"),
        "df",
        idf.alias("idf"),
    )


def unit_length(weights: DataFrame) -> DataFrame:
    """Scale each id's weights to unit length."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(W.partitionBy("id")))
    return weights.withColumn("weight", F.try_divide("weight", length)).where("weight <> 0")


def tfidf(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    stop_words: list[str] = STOP_WORDS,
    min_df: int = 2,
    max_df: float = 0.8,
    max_terms: int = 5000,
) -> TermVectors:
    """Unit-length TF-IDF vectors over words and word pairs, with smoothed idf plus one.

    The texts are read twice, for the vocabulary and for the weights: the second
    pass only keeps vocabulary terms, which is far less than a stored table of all
    (document, term) pairs.
    """
    texts, n_docs = balanced(docs.select(id_col, text_col), id_col, most=TEXTS_PER_TASK)
    documents = document_terms(texts, id_col, text_col, stop_words)
    vocab = written(
        term_vocabulary(term_statistics(documents), n_docs, min_df, max_df, max_terms),
        "term-vocabulary",
    )
    weights = (
        documents.select("id", F.explode_outer("terms").alias("term"))
        .join(F.broadcast(vocab.select("term", "idx", "idf")), "term")
        .groupBy("id", "idx", "idf")
        .agg(F.count("*").alias("tf"))
        .select("id", "idx", (F.col("tf") * F.col("idf")).alias("weight"))
    )
    return TermVectors(vocab, unit_length(weights))


def categorical_flags(department: Column, aisle: Column) -> Column:
    """Twelve 0/1 flags from substrings of the department and aisle names."""

    def flags(col: Column, words: list[str]) -> list[Column]:
        text = F.lower(F.coalesce(col, F.lit("unknown")))
        return [F.contains(text, F.lit(w)).cast("int") for w in words]

    return F.array(*flags(department, DEPARTMENT_FLAGS), *flags(aisle, AISLE_FLAGS))


def categorical_weights(products: DataFrame, first_idx: int) -> DataFrame:
    """The flags as unit-length sparse rows, indexed from ``first_idx`` on."""
    flags = F.posexplode(categorical_flags(F.col("department"), F.col("aisle")))
    return unit_length(
        products.select(F.col("product_id").alias("id"), flags.alias("flag", "on"))
        .where("on = 1")
        .select("id", (F.col("flag") + first_idx).alias("idx"), F.lit(1.0).alias("weight"))
    )


def combine_vectors(
    text: TermVectors, products: DataFrame, text_weight: float = TEXT_WEIGHT
) -> DataFrame:
    """Text and categorical vectors side by side, weighted and re-normalised."""
    n_terms = text.vocabulary.count()
    flags = categorical_weights(products, n_terms)
    both = text.weights.withColumn("weight", F.col("weight") * text_weight).unionByName(
        flags.withColumn("weight", F.col("weight") * (1 - text_weight))
    )
    return unit_length(both)


def similarity_vectors(
    products: DataFrame, stop_words: list[str] = STOP_WORDS, text_weight: float = TEXT_WEIGHT
) -> tuple[TermVectors, DataFrame]:
    """Term vectors of the product texts, and the combined vectors (id, idx, weight)."""
    docs = with_product_text(products)
    text = tfidf(docs, "product_id", "text", stop_words)
    return text, combine_vectors(text, products, text_weight)
