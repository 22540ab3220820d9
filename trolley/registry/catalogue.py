"""Queries over product names and fuzzy families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trolley.functions import similarity as sim
from trolley.functions import text as tx
from trolley.operators import families as fam
from trolley.operators.catalogue import with_key_terms, with_product_text
from trolley.plans.jobs import group_products
from trolley.registry.base import query, rounded
from trolley.registry.inputs import PRODUCTS_SQL, aisles, departments, enriched, products
from trolley.sinks.tables import family_metadata, write_families
from trolley.sources.tables import FAMILY_SCHEMA, family_members, read_families, read_large_families
from trolley.storage import new_path, written

WITH = f"WITH {PRODUCTS_SQL}"


def _alternatives(words: list[str]) -> str:
    return "|".join(words)


def _sql_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _clean_sql(name: str) -> str:
    units, fillers = _alternatives(tx.CLEAN_UNITS), _alternatives(tx.CLEAN_FILLERS)
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({name}),
      '\b\d+(\.\d+)?\s*({units})\b', '', 'g'), '\b\d+\s*x\s*\d+\b', '', 'g'),
      '\b({fillers})\b', '', 'g'), '\s+', ' ', 'g'))"""


def _brand_sql(name: str) -> str:
    first = f"lower(string_split(trim({name}), ' ')[1])"
    generic = _sql_list(tx.GENERIC_FIRST_WORDS)
    return f"CASE WHEN len({first}) > 2 AND {first} NOT IN ({generic}) THEN {first} ELSE '' END"


def _keywords_sql(name: str) -> str:
    parts = []
    for category, words in tx.CATEGORY_KEYWORDS.items():
        hits = " ".join(f"WHEN contains(lower({name}), '{w}') THEN ['{category}', '{w}']" for w in words)
        parts.append(f"CASE {hits} ELSE []::VARCHAR[] END")
    return f"flatten([{', '.join(parts)}])"


def _compare_sql(name: str) -> str:
    units = _alternatives(tx.COMPARISON_UNITS)
    out = rf"regexp_replace(lower({name}), '\b\d+\s*({units})\b', '', 'g')"
    for term in tx.COMPARISON_REMOVED:
        out = f"replace({out}, '{term}', '')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


_KEY_GROUPS = ", ".join(
    f"list_filter(runs, lambda w: w IN ({_sql_list(g)}))" for g in tx.KEY_TERM_GROUPS
)
# first-seen de-duplication: keep an element whose first position is its own
TERMS_SQL = rf"""{PRODUCTS_SQL},
runs AS (SELECT *, regexp_extract_all(lower(trim(product_name)), '[a-z0-9_]+') AS runs FROM enriched),
words AS (SELECT *, list_filter(runs, lambda w: regexp_full_match(w, '[a-z]+') AND len(w) > 2
  AND w NOT IN ({_sql_list(tx.KEY_TERM_STOP_WORDS)})) AS words FROM runs),
bags AS (SELECT *, flatten([list_reverse(words)[1:2], {_KEY_GROUPS}]) AS bag FROM words),
named AS (SELECT product_id, product_name, aisle_id, department_id, aisle, department,
  CASE WHEN len(words) = 0 THEN [lower(trim(product_name))]
    ELSE list_filter(bag, lambda t, i: list_position(bag, t) = i)[1:3] END AS key_terms FROM bags),
keyed AS (SELECT *, array_to_string(list_append(key_terms[1:2], lower(product_name)), '_') AS sort_key,
  {_compare_sql('product_name')} AS cmp FROM named),
placed AS (SELECT *, row_number() OVER (ORDER BY sort_key, product_id) - 1 AS pos,
  list_distinct(list_filter(string_split(cmp, ' '), lambda w: w <> '')) AS word_set FROM keyed)
"""


@query("enriched_products", f"{WITH} SELECT product_id, product_name, aisle, department FROM enriched")
def enriched_products(spark: SparkSession, sf: str) -> DataFrame:
    return enriched(spark, sf).select("product_id", "product_name", "aisle", "department")


@query(
    "clean_names",
    f"{WITH} SELECT product_id, {_clean_sql('product_name')} AS clean_name FROM products",
)
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    return products(spark, sf).select(
        "product_id", tx.clean_product_name(F.col("product_name")).alias("clean_name")
    )


@query("brands", f"{WITH} SELECT product_id, {_brand_sql('product_name')} AS brand FROM products")
def brands(spark: SparkSession, sf: str) -> DataFrame:
    return products(spark, sf).select(
        "product_id", tx.extract_brand(F.col("product_name")).alias("brand")
    )


@query(
    "category_keywords",
    f"""{WITH} SELECT product_id, array_to_string({_keywords_sql('product_name')}, ' ') AS keywords
    FROM products""",
)
def category_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return products(spark, sf).select(
        "product_id",
        F.array_join(tx.extract_category_keywords(F.col("product_name")), " ").alias("keywords"),
    )


TEXT_SQL = f"""array_to_string(flatten([
  list_resize([{_clean_sql('product_name')}], 3, {_clean_sql('product_name')}),
  [lower(department), lower(aisle)],
  CASE WHEN {_brand_sql('product_name')} = '' THEN []
    ELSE [{_brand_sql('product_name')}, {_brand_sql('product_name')}] END,
  {_keywords_sql('product_name')}]), ' ')"""


@query("product_texts", f"{WITH} SELECT product_id, {TEXT_SQL} AS text FROM enriched")
def product_texts(spark: SparkSession, sf: str) -> DataFrame:
    return with_product_text(enriched(spark, sf)).select("product_id", "text")


@query(
    "key_terms",
    f"""WITH {TERMS_SQL} SELECT product_id, array_to_string(key_terms, ',') AS key_terms,
    sort_key FROM placed""",
)
def key_terms(spark: SparkSession, sf: str) -> DataFrame:
    return with_key_terms(enriched(spark, sf)).select(
        "product_id", F.array_join("key_terms", ",").alias("key_terms"), "sort_key"
    )


@query(
    "comparison_names",
    f"{WITH} SELECT product_id, {_compare_sql('product_name')} AS cmp FROM products",
)
def comparison_names(spark: SparkSession, sf: str) -> DataFrame:
    return products(spark, sf).select(
        "product_id", tx.clean_for_comparison(F.col("product_name")).alias("cmp")
    )


@query("sorted_positions", f"WITH {TERMS_SQL} SELECT product_id, pos FROM placed")
def sorted_positions(spark: SparkSession, sf: str) -> DataFrame:
    return fam.sort_products(enriched(spark, sf)).select("product_id", "pos")


def _bits_sql(side: int) -> str:
    tests = []
    for rule, sides in enumerate(sim.NAME_CONFLICTS):
        hit = " OR ".join(f"contains(lower(product_name), '{t}')" for t in sides[side])
        tests.append(f"CASE WHEN {hit} THEN {1 << rule} ELSE 0 END")
    return " + ".join(tests)


_APART = " OR ".join(
    f"(a.department = '{x}' AND b.department = '{y}') OR (a.department = '{y}' AND b.department = '{x}')"
    for x, y in sim.SEPARATE_DEPARTMENTS
)


def _pairs_sql(threshold: int) -> str:
    return f"""{TERMS_SQL},
flagged AS (SELECT *, {_bits_sql(0)} AS bits1, {_bits_sql(1)} AS bits2 FROM placed),
near AS (
  SELECT a.pos AS i, b.pos AS j, len(list_intersect(a.word_set, b.word_set)) AS common,
    len(a.word_set) + len(b.word_set) AS words
  FROM flagged a JOIN flagged b ON b.pos > a.pos AND b.pos <= a.pos + 100
  WHERE a.bits1 & b.bits2 = 0 AND NOT ({_APART})),
scored AS (SELECT i, j, CASE WHEN words = common THEN 0
  ELSE floor(common::DOUBLE / (words - common) * 100)::INTEGER END AS score FROM near),
pairs AS (SELECT i, j, score FROM scored WHERE score >= {threshold})
"""


def _families_sql(threshold: int, max_size: int = 15, min_size: int = 2) -> str:
    """The sequential rule as a recursive query: one product per step."""
    return f"""WITH RECURSIVE {_pairs_sql(threshold)},
links AS (
  SELECT p.pos, coalesce(list(j ORDER BY j) FILTER (j IS NOT NULL), []) AS js
  FROM placed p LEFT JOIN pairs ON i = p.pos GROUP BY p.pos),
walk AS (
  SELECT -1::BIGINT AS pos, []::BIGINT[] AS used, []::BIGINT[] AS family
  UNION ALL
  SELECT pos, list_filter(list_concat(used, family), lambda u: u > pos), family FROM (
    SELECT l.pos, w.used,
      CASE WHEN list_contains(w.used, l.pos) THEN []::BIGINT[]
        ELSE list_concat([l.pos], list_filter(l.js, lambda j: j < coalesce(
          list_min(list_filter(w.used, lambda u: u > l.pos)), 9000000000))[1:{max_size - 1}])
      END AS family
    FROM walk w JOIN links l ON l.pos = w.pos + 1) step),
kept AS (
  SELECT row_number() OVER (ORDER BY pos) - 1 AS family_id, family FROM walk
  WHERE len(family) >= {min_size}),
spread AS (
  SELECT family_id, unnest(family) AS pos, generate_subscripts(family, 1) - 1 AS member_no
  FROM kept),
members AS (
  SELECT family_id, member_no::INTEGER AS member_no, placed.* FROM spread JOIN placed USING (pos)),
similarity AS (
  SELECT a.family_id, avg(CASE WHEN len(a.word_set) + len(b.word_set) = 0 THEN 0 ELSE
      floor(len(list_intersect(a.word_set, b.word_set))::DOUBLE / (len(a.word_set)
        + len(b.word_set) - len(list_intersect(a.word_set, b.word_set))) * 100) END)
      AS avg_similarity
  FROM members a JOIN members b ON a.family_id = b.family_id AND a.member_no < b.member_no
  GROUP BY a.family_id),
terms AS (
  SELECT family_id, member_no, unnest(key_terms) AS term,
    generate_subscripts(key_terms, 1) AS term_no FROM members),
counted AS (
  SELECT family_id, term, count(*) AS n, min(member_no * 10 + term_no) AS seen
  FROM terms GROUP BY family_id, term),
top_terms AS (
  SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY n DESC, seen) AS r FROM counted),
common AS (
  SELECT family_id, list(upper(term[1]) || lower(term[2:]) ORDER BY r) AS t FROM top_terms
  WHERE r <= 3 AND n > 1 GROUP BY family_id),
families AS (
  SELECT family_id, count(*) AS size,
    max(product_name) FILTER (member_no = 0) AS representative_product,
    max(key_terms[1]) FILTER (member_no = 0) AS lead,
    list_sort(list(DISTINCT department)) AS departments, list_sort(list(DISTINCT aisle)) AS aisles
  FROM members GROUP BY family_id),
summary AS (
  SELECT f.family_id, size, representative_product, departments, aisles,
    coalesce(avg_similarity, 100.0::DOUBLE) AS avg_similarity,
    CASE WHEN len(t) >= 2 THEN t[1] || ' ' || t[2] || ' Family'
      WHEN len(t) = 1 THEN t[1] || ' Products Family'
      ELSE upper(lead[1]) || lower(lead[2:]) || ' Family' END AS family_name
  FROM families f LEFT JOIN common c ON c.family_id = f.family_id
  LEFT JOIN similarity s ON s.family_id = f.family_id)
"""


@query("candidate_pairs", f"WITH {_pairs_sql(80)} SELECT i, j, score FROM pairs")
def candidate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fam.candidate_pairs(fam.sort_products(enriched(spark, sf)))


@query("candidate_pairs_50", f"WITH {_pairs_sql(50)} SELECT i, j, score FROM pairs")
def candidate_pairs_50(spark: SparkSession, sf: str) -> DataFrame:
    return fam.candidate_pairs(fam.sort_products(enriched(spark, sf)), threshold=50)


_INDEL_SQL = f"""WITH RECURSIVE {_pairs_sql(0)},
texts AS (
  SELECT DISTINCT a.cmp AS s, b.cmp AS t FROM near JOIN placed a ON a.pos = i
  JOIN placed b ON b.pos = j),
table_rows AS (
  SELECT s, t, 0::BIGINT AS k, list_resize([0], len(t) + 1, 0) AS best FROM texts
  UNION ALL
  SELECT s, t, k + 1, list_transform(range(len(t) + 1), lambda n:
      list_max(list_transform(range(n + 1), lambda m: CASE WHEN m > 0 AND t[m] = s[k + 1]
        THEN greatest(best[m + 1], best[m] + 1) ELSE best[m + 1] END)))
  FROM table_rows WHERE k < len(s)),
lengths AS (SELECT s, t, best[len(t) + 1] AS common FROM table_rows WHERE k = len(s)),
ratios AS (
  SELECT s, t, CASE WHEN len(s) + len(t) = 0 THEN 100
    ELSE round_even(200.0 * common / (len(s) + len(t)), 0) END::INTEGER AS score FROM lengths)
SELECT near.i, near.j, score FROM near JOIN placed a ON a.pos = near.i
JOIN placed b ON b.pos = near.j JOIN ratios ON s = a.cmp AND t = b.cmp WHERE score >= 80
"""


@query("candidate_pairs_indel", _INDEL_SQL)
def candidate_pairs_indel(spark: SparkSession, sf: str) -> DataFrame:
    placed = fam.sort_products(enriched(spark, sf), sim.INDEL)
    return fam.candidate_pairs(placed, sim.INDEL)


def _found(spark: SparkSession, sf: str, **options) -> fam.Families:
    return fam.fuzzy_families(enriched(spark, sf), **options)


@query("family_members", f"{_families_sql(80)} SELECT family_id, member_no, product_id FROM members")
def family_members_query(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf).members.select("family_id", "member_no", "product_id")


@query(
    "family_members_50",
    f"{_families_sql(50, 12)} SELECT family_id, member_no, product_id FROM members",
)
def family_members_50(spark: SparkSession, sf: str) -> DataFrame:
    found = _found(spark, sf, threshold=50, max_size=12)
    return found.members.select("family_id", "member_no", "product_id")


_SUMMARY_COLUMNS = """family_id, family_name, size, representative_product,
  array_to_string(departments, ',') AS departments, array_to_string(aisles, ',') AS aisles,
  round(avg_similarity, 6) AS avg_similarity"""


def _flat_summary(families: DataFrame) -> DataFrame:
    return families.select(
        "family_id",
        "family_name",
        "size",
        "representative_product",
        F.array_join("departments", ",").alias("departments"),
        F.array_join("aisles", ",").alias("aisles"),
        rounded("avg_similarity").alias("avg_similarity"),
    )


@query("family_summary", f"{_families_sql(80)} SELECT {_SUMMARY_COLUMNS} FROM summary")
def family_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_summary(_found(spark, sf).families)


@query("family_summary_50", f"{_families_sql(50)} SELECT {_SUMMARY_COLUMNS} FROM summary")
def family_summary_50(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_summary(_found(spark, sf, threshold=50).families)


@query(
    "family_common_terms",
    f"{_families_sql(50)} SELECT family_id, term, n, r::INTEGER AS place FROM top_terms WHERE r <= 3 AND n > 1",
)
def family_common_terms(spark: SparkSession, sf: str) -> DataFrame:
    members = _found(spark, sf, threshold=50).members
    terms = fam.common_terms(members).select(
        "family_id", F.posexplode("terms").alias("place", "term")
    )
    counts = (
        members.select("family_id", F.explode("key_terms").alias("term"))
        .groupBy("family_id", "term")
        .agg(F.count("*").alias("n"))
    )
    return terms.withColumn("place", F.col("place") + 1).join(counts, ["family_id", "term"])


@query(
    "family_overview",
    f"""{_families_sql(80)} SELECT (SELECT count(*) FROM part) AS total_products,
      sum(size)::BIGINT AS grouped_products,
      round(sum(size) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS grouped_percent,
      count(*) AS total_families, round(avg(size), 6) AS avg_family_size,
      max(size) AS largest_family, round(avg(avg_similarity), 6) AS avg_similarity FROM summary""",
)
def family_overview(spark: SparkSession, sf: str) -> DataFrame:
    items = enriched(spark, sf)
    report = fam.family_overview(fam.fuzzy_families(items).families, items.count())
    return report.withColumns(
        {c: rounded(c) for c in ("grouped_percent", "avg_family_size", "avg_similarity")}
    )


@query("family_sizes", f"{_families_sql(80)} SELECT size, count(*) AS families FROM summary GROUP BY size")
def family_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return fam.family_sizes(_found(spark, sf).families)


@query(
    "department_families",
    f"""{_families_sql(80)} SELECT department, count(*) AS families
    FROM (SELECT DISTINCT family_id, department FROM members)
    GROUP BY department ORDER BY families DESC, department LIMIT 10""",
)
def department_families(spark: SparkSession, sf: str) -> DataFrame:
    return fam.department_families(_found(spark, sf).families)


@query(
    "largest_families",
    f"""{_families_sql(80)} SELECT family_id, family_name, size,
      round(avg_similarity, 6) AS avg_similarity FROM summary
    ORDER BY size DESC, summary.avg_similarity DESC, family_id LIMIT 15""",
)
def largest_families(spark: SparkSession, sf: str) -> DataFrame:
    return fam.largest_families(_found(spark, sf).families).select(
        "family_id", "family_name", "size", rounded("avg_similarity").alias("avg_similarity")
    )


@query(
    "family_search",
    f"""{_families_sql(80)}, hits AS (
      SELECT family_id, product_id AS match_id, product_name AS match FROM members
      WHERE contains(lower(product_name), 'apple') ORDER BY family_id, member_no LIMIT 10)
    SELECT h.family_id, match_id, match, m.product_id AS related_id, m.product_name AS related,
      family_name, size, round(avg_similarity, 6) AS avg_similarity
    FROM hits h JOIN summary s USING (family_id)
    LEFT JOIN members m ON m.family_id = h.family_id AND m.product_id <> match_id""",
)
def family_search(spark: SparkSession, sf: str) -> DataFrame:
    return fam.search_families(_found(spark, sf), "Apple").withColumn(
        "avg_similarity", rounded("avg_similarity")
    )


@query(
    "family_metadata",
    f"""{_families_sql(80)} SELECT count(*) AS total_families,
      sum(size)::BIGINT AS total_products_grouped, 80::INTEGER AS similarity_threshold,
      2::INTEGER AS min_family_size, 15::INTEGER AS max_family_size,
      'fuzzy_matching_with_smart_sorting' AS method, round(avg(size), 6) AS avg_family_size,
      round(avg(avg_similarity), 6) AS avg_similarity, 'jaccard_words' AS metric FROM summary""",
)
def family_metadata_query(spark: SparkSession, sf: str) -> DataFrame:
    row = family_metadata(_found(spark, sf).families, 80, 2, 15, "jaccard_words")
    return row.withColumns({c: rounded(c) for c in ("avg_family_size", "avg_similarity")})


@query(
    "family_files",
    f"""{_families_sql(80)} SELECT m.family_id, member_no, product_id, product_name, department,
      aisle, family_name, size, round(avg_similarity, 6) AS avg_similarity
    FROM members m JOIN summary USING (family_id)""",
)
def family_files(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grouping job, written as JSON lines and read back."""
    path = new_path(spark, "families")
    group_products(
        products(spark, sf), aisles(spark, sf), departments(spark, sf), path=path
    )
    saved = spark.read.schema(FAMILY_SCHEMA).json(f"{path}/families")
    return family_members(saved).join(
        saved.select(
            "family_id", "family_name", "size", rounded("avg_similarity").alias("avg_similarity")
        ),
        "family_id",
    )


@query(
    "family_documents",
    f"""{_families_sql(80)} SELECT family_id, family_name, size, representative_product,
      size AS products FROM summary""",
)
def family_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Families in the document form ``{families: {id: {...}}}``, one document per line."""
    path, nested = new_path(spark, "families"), new_path(spark, "document")
    write_families(_found(spark, sf), path)
    saved = written(spark.read.schema(FAMILY_SCHEMA).json(f"{path}/families"), "saved")
    saved.select(
        F.map_from_arrays(
            F.array(F.col("family_id").cast("string")), F.array(F.struct(*saved.columns))
        ).alias("families")
    ).write.json(nested)
    return read_families(spark, nested, multi_line=False).select(
        "family_id", "family_name", "size", "representative_product",
        F.size("products").cast("bigint").alias("products"),
    )


@query(
    "family_documents_large",
    f"""{_families_sql(80)} SELECT family_id, family_name, size, representative_product,
      size AS products FROM summary""",
)
def family_documents_large(spark: SparkSession, sf: str) -> DataFrame:
    """The same documents, cut into families by many tasks instead of parsed whole."""
    path, nested = new_path(spark, "families"), new_path(spark, "document")
    write_families(_found(spark, sf), path)
    saved = written(spark.read.schema(FAMILY_SCHEMA).json(f"{path}/families"), "saved")
    family = F.struct(*[F.col(c) for c in T.StructType.fromDDL(FAMILY_SCHEMA).names])
    # documents of a thousand families
    saved.groupBy(F.floor(F.col("family_id") / 1000).alias("doc")).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("family_id").cast("string"), family))
        ).alias("families")
    ).select("families").write.json(nested)
    return read_large_families(spark, nested).select(
        "family_id", "family_name", "size", "representative_product",
        F.size("products").cast("bigint").alias("products"),
    )
