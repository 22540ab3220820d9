"""End-to-end jobs composed of the operators; each writes its result at the end."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from trolley.functions.similarity import METRICS
from trolley.operators import composites as comp
from trolley.operators import neighbours
from trolley.operators.baskets import Baskets
from trolley.operators.catalogue import enrich_products
from trolley.operators.encode import hide_baskets, mask_ragged, pad_sequences, ragged_sequences
from trolley.operators.families import Families, fuzzy_families
from trolley.operators.linalg import SvdModel, project, truncated_svd
from trolley.operators.ranking import (
    Evaluation,
    compare,
    evaluate,
    evaluation_cases,
    rank_embedding,
    rank_frequency,
    rank_random,
    sample_candidates,
    skipped_cases,
)
from trolley.operators.split import assign_split
from trolley.operators.tfidf import STOP_WORDS, TermVectors, similarity_vectors
from trolley.operators.vocab import max_basket_size, vocabulary
from trolley.sinks.tables import (
    write_families,
    write_prepared,
    write_similarity_vectors,
    write_svd,
    write_vocabulary,
)
from trolley.storage import written


class Prepared(NamedTuple):
    """Vocabulary, prepared rows with their split, the widths used, and the ragged rows."""

    vocab: DataFrame
    rows: DataFrame
    max_seq: int
    max_basket: int
    ragged: DataFrame


def prepare_sequences(
    baskets: Baskets,
    max_seq: int = 50,
    max_basket: int | None = None,
    mask_prob: float = 0.15,
    val_fraction: float = 0.2,
    seed: int = 42,
    path: str | None = None,
) -> Prepared:
    """Vocabulary, padded sequences, masked copies and the train/val split.

    What is written are ragged rows; ``rows`` pads them as they are read.
    """
    vocab = written(vocabulary(baskets.items), "vocabulary")
    largest = max_basket_size(baskets)
    width = max_basket or largest
    ragged = written(
        ragged_sequences(baskets, vocab, max_seq, width if width < largest else None), "ragged"
    )
    ragged = assign_split(mask_ragged(ragged, mask_prob, seed), "user_id", val_fraction, seed)
    if path:
        write_vocabulary(vocab, f"{path}/vocabulary")
        write_prepared(ragged, vocab, path, max_seq, width)
    rows = hide_baskets(pad_sequences(ragged, width, max_seq))
    return Prepared(vocab, rows, max_seq, width, ragged)


def group_products(
    products: DataFrame,
    aisles: DataFrame | None = None,
    departments: DataFrame | None = None,
    metric: str = "jaccard_words",
    threshold: int = 80,
    min_size: int = 2,
    max_size: int = 15,
    path: str | None = None,
) -> Families:
    """Fuzzy product families of a catalogue."""
    enriched = enrich_products(products, aisles, departments)
    found = fuzzy_families(enriched, METRICS[metric], threshold, min_size, max_size)
    if path:
        write_families(found, path, threshold, min_size, max_size, metric)
    return found


class Reduction(NamedTuple):
    """SVD model, composites, members with reduced vectors and the quality report."""

    model: SvdModel
    composites: DataFrame
    members: DataFrame
    quality: DataFrame


def reduce_products(
    vectors: DataFrame,
    families: DataFrame,
    members: DataFrame,
    r: int = 50,
    id_map: DataFrame | None = None,
    path: str | None = None,
) -> Reduction:
    """Truncated SVD of (item_id, embedding) and composite products of the families."""
    model = truncated_svd(vectors, r)
    placed = written(comp.family_vectors(members, vectors, id_map), "family-vectors")
    composite = written(comp.composites(families, placed, model), "composites")
    reduced = comp.member_reductions(placed, composite, model)
    quality = comp.separation(
        comp.intra_distances(reduced, "component_reduced", "composite_reduced"),
        comp.inter_distances(composite, "composite_reduced"),
    )
    if path:
        write_svd(model, vectors, composite, path)
    return Reduction(model, composite, reduced, quality)


class SimilarityVectors(NamedTuple):
    """Term vectors, combined vectors, sample neighbours and their statistics."""

    text: TermVectors
    vectors: DataFrame
    neighbours: DataFrame
    statistics: DataFrame
    examples: DataFrame


def build_similarity_vectors(
    products: DataFrame,
    aisles: DataFrame | None = None,
    departments: DataFrame | None = None,
    stop_words: list[str] = STOP_WORDS,
    sample_size: int = neighbours.SAMPLE_SIZE,
    seed: int = 42,
    path: str | None = None,
) -> SimilarityVectors:
    """Product similarity vectors with a quality report on a random sample."""
    enriched = enrich_products(products, aisles, departments)
    text, combined = similarity_vectors(enriched, stop_words)
    vectors = written(combined, "similarity-vectors")
    names = enriched.select(enriched["product_id"].alias("id"), "product_name")
    sample = written(neighbours.random_sample(names, "id", sample_size, seed), "sample")
    near = written(neighbours.sample_neighbours(vectors, sample, 9), "neighbours")
    if path:
        write_similarity_vectors(text, vectors, products.count(), path)
    return SimilarityVectors(
        text,
        vectors,
        near,
        neighbours.similarity_statistics(near),
        neighbours.good_examples(near, sample),
    )


def compare_rankers(
    baskets: Baskets,
    vectors: DataFrame,
    reduced_width: int = 10,
    n_negatives: int = 99,
    k: int = 10,
    max_users: int | None = None,
    seed: int = 42,
) -> tuple[Evaluation, DataFrame]:
    """Random, frequency, full and reduced embedding rankers on the same candidates."""
    cases = evaluation_cases(baskets, vectors, max_users=max_users)
    candidates = sample_candidates(cases, vectors, n_negatives, seed)
    model = truncated_svd(vectors, reduced_width)
    reduced = project(vectors, model).select("item_id", "reduced")
    rankers = {
        "random": rank_random(seed),
        "frequency": rank_frequency(cases.history),
        "embedding": rank_embedding(cases.history, vectors),
        "reduced": rank_embedding(cases.history, reduced, "reduced"),
    }
    skipped = skipped_cases(cases, vectors, n_negatives)
    return cases, compare(evaluate(candidates, rankers, k, skipped))
