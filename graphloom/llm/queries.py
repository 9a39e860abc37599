"""Registered queries of the training-data operators and their SQL.

Each query imports its operator when it runs, so a package that one of them needs and that is absent stops no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import leaks

    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p9_tolerant(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import leaks

    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), max_substituted=2)


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import spans

    return spans.shared_chars(table(spark, d, "documents"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import canonical

    return canonical.collapse(table(spark, d, "relationships"))


@query
def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import packing

    return packing.pack(table(spark, d, "documents"))


@query
def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import packing

    return packing.invariants(table(spark, d, "documents"))


ORACLE["p8_invariants"] = """
SELECT count(*) AS texts, 0::BIGINT AS lost_texts, 0::BIGINT AS lost_tokens, 0::BIGINT AS split_short, 0::BIGINT AS over_capacity, 0::BIGINT AS overlapping, 0::BIGINT AS uneven_steps
FROM documents WHERE doc_id IS NOT NULL
"""


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import groups

    return groups.linked_groups(table(spark, d, "entity_matches"))


ORACLE["p6_found"] = """
WITH RECURSIVE links AS (
  SELECT DISTINCT left_id AS a, right_id AS b FROM entity_matches WHERE left_id IS NOT NULL AND right_id IS NOT NULL
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)
SELECT min(seen) AS group_id, id AS member_id FROM reach GROUP BY id
"""


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import neighbours

    return neighbours.nearest(table(spark, d, "entities")).select("id", "neighbour_id")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import names

    return names.same_entity_pairs(table(spark, d, "entities"))


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import language

    return language.corrected_labels(table(spark, d, "chat_requests"), table(spark, d, "parallel_pairs"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.llm import pairs

    return pairs.defective_pairs(table(spark, d, "parallel_pairs")).select("pair_id", "defect").distinct()


ORACLE["p2_found"] = """
WITH v AS (
  SELECT id, any_value(embedding)::DOUBLE[] AS v FROM entities WHERE id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id
), s AS (SELECT a.id, b.id AS neighbour_id, round(list_cosine_similarity(a.v, b.v), 9) AS similarity FROM v a JOIN v b ON a.id <> b.id)
SELECT id, neighbour_id FROM s WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour_id) <= 5
"""


def _folded(c: str) -> str:
    """Lower case; decimal points and minus signs before digits as D and M; all else but letters and digits dropped."""
    kept = f"lower({c})"
    for _ in range(2):
        kept = rf"regexp_replace({kept}, '([0-9])\.([0-9])', '\1D\2', 'g')"
    return rf"regexp_replace(regexp_replace({kept}, '-([0-9])', 'M\1', 'g'), '[^a-z0-9DM]', '', 'g')"


ORACLE["p5_found"] = f"""
WITH f AS (
  SELECT edge_no, upper(trim(coalesce(source, ''))) AS s, upper(trim(coalesce(target, ''))) AS t, {_folded("coalesce(predicate, '')")} AS p, {_folded("coalesce(name, '')")} AS n,
    list_sort(list_transform(json_keys(custom), lambda k: {_folded("k")} || '=' || {_folded("json_extract_string(custom, '$.' || k)")})) AS c FROM relationships
), g AS (SELECT edge_no, min(edge_no) OVER (PARTITION BY s, t, p, n, c) AS kept_no FROM f)
SELECT kept_no, edge_no AS copy_no FROM g WHERE edge_no > kept_no
"""

ORACLE["p9_found"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram FROM w WHERE len(w) >= 10),
f AS (SELECT item_id, unnest([question, gold_answer, context]) AS text FROM eval_items),
x AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM f WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram FROM x WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (gram)
"""

ORACLE["p10_found"] = """
WITH g AS (SELECT doc_id, i, substring(text, i, 240) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 238)) AS i FROM documents WHERE length(text) >= 240)),
s AS (SELECT gram FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
h AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM g JOIN s USING (gram))
SELECT doc_id, sum(least(240, coalesce(next - i, 240)))::BIGINT AS shared_chars FROM h GROUP BY doc_id
"""

# every stretch of ten or eleven words of an item whose inner words, at most two and not next to each other, are left open; a
# longer overlap with two substitutions holds one of ten or eleven words
ORACLE["p9_tolerant"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT item_id, unnest([question, gold_answer, context]) AS text FROM eval_items),
x AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM f WHERE text IS NOT NULL),
m(n, a, b) AS (SELECT n, a, b FROM range(10, 12) r(n), range(1, 13) s(a), range(1, 13) t(b) WHERE (a = 1 AND b = 1) OR (1 < a AND a = b AND a < n) OR (1 < a AND a + 1 < b AND b < n)),
g AS (SELECT item_id, n, a, b, array_to_string(list_transform(range(1, n + 1), lambda j: CASE WHEN j > 1 AND j IN (a, b) THEN '?' ELSE w[i + j] END), ' ') AS gram FROM x, m, range(0, 10000) p(i) WHERE i + n <= len(w)),
v AS (SELECT DISTINCT w[i + 1] || ' ' || w[i + 2] AS two FROM x, range(0, 10000) p(i) WHERE i + 2 <= len(w)),
d AS (SELECT doc_id, w, i FROM (SELECT doc_id, w, unnest(range(0, len(w) - 9)) AS i FROM w WHERE len(w) >= 10)),
e AS (SELECT DISTINCT doc_id, n, a, b, array_to_string(list_transform(range(1, n + 1), lambda j: CASE WHEN j > 1 AND j IN (a, b) THEN '?' ELSE w[i + j] END), ' ') AS gram FROM d, m WHERE i + n <= len(w) AND w[i + 1] IN (SELECT split_part(two, ' ', 1) FROM v) AND w[i + n] IN (SELECT split_part(two, ' ', 2) FROM v))
SELECT DISTINCT doc_id, item_id FROM e JOIN g USING (n, a, b, gram)
"""
