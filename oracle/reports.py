"""DuckDB statements for the reports, written out row by row.

They join rows with rows where the Spark side aggregates first, so agreement
also checks those rewrites.
"""

from __future__ import annotations

from oracle.parameters import BLUE, PERIOD, RED

KIND = "CASE length({0}) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'LOC' END"

MENTIONS = f"""
n AS (
  SELECT p_name AS entity_name, {KIND.format('p_name')} AS entity_type,
         CAST(l_orderkey AS VARCHAR) AS source_uri, o_orderpriority AS source_title,
         'order ' || l_orderkey AS source_description, 'order/' || l_orderkey AS source_url,
         n_name AS source_name, o_orderdate AS ts,
         p_name || ' == line ' || l_linenumber AS match_details,
         round(80 + 200 * l_discount, 1) AS match_score
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN part ON p_partkey = l_partkey
  JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey
)"""

CUSTOMER_MENTIONS = f"""
n AS (
  SELECT c_name AS entity_name, {KIND.format('c_mktsegment')} AS entity_type,
         CAST(o_orderkey AS VARCHAR) AS source_uri, o_orderpriority AS source_title,
         'order ' || o_orderkey AS source_description, 'order/' || o_orderkey AS source_url,
         n_name AS source_name, o_orderdate AS ts, 'buyer' AS match_details, 100.0::DOUBLE AS match_score
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)"""

SUPPLIER_MENTIONS = f"""
n AS (
  SELECT s_name AS entity_name, {KIND.format('CAST(s_suppkey AS VARCHAR)')} AS entity_type,
         CAST(l_orderkey AS VARCHAR) AS source_uri, o_orderpriority AS source_title,
         'order ' || l_orderkey AS source_description, 'order/' || l_orderkey AS source_url,
         n_name AS source_name, o_orderdate AS ts, 'line ' || l_linenumber AS match_details,
         round(80 + 200 * l_discount, 1) AS match_score
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)"""

SENTIMENT = """
s AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS uri, floor(o_totalprice) / 524288.0::DOUBLE AS score,
         CASE o_orderstatus WHEN 'F' THEN 'POSITIVE' WHEN 'O' THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS label
  FROM orders
)"""


def similar(texts: str, others: str | None = None, threshold: int = 80) -> str:
    """CTEs ``cand``, ``dp`` and ``sim``: all pairs of ``texts(text)`` (and ``others``) that match.

    Levenshtein distance never exceeds the insert/delete distance, so the first
    step only leaves out pairs that cannot match. DuckDB measures it in bytes:
    characters beyond ASCII are first folded to one, which can only lower it.
    ``dp`` fills the LCS table row by row.
    """
    return f"""
cand AS (
  SELECT x.text AS a, y.text AS b
  FROM (SELECT text, regexp_replace(text, '[^ -~]', '?', 'g') AS flat FROM {texts}) x,
       (SELECT text, regexp_replace(text, '[^ -~]', '?', 'g') AS flat FROM {others or texts}) y
  WHERE CASE WHEN abs(length(x.text) - length(y.text)) * 100 <= {100 - threshold} * (length(x.text) + length(y.text))
    THEN levenshtein(x.flat, y.flat) * 100 <= {100 - threshold} * (length(x.text) + length(y.text)) ELSE false END
),
dp(a, b, i, line) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM cand
  UNION ALL
  SELECT a, b, i + 1,
         list_reduce(range(1, length(b) + 1),
                     lambda acc, j: list_append(acc,
                       CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN line[j] + 1
                            ELSE greatest(line[j + 1], acc[len(acc)]) END), [0])
  FROM dp WHERE i < length(a)
),
sim AS (
  SELECT a, b, (1.0::DOUBLE - (length(a) + length(b) - 2 * line[len(line)])::DOUBLE
                / (length(a) + length(b))) * 100.0 AS score
  FROM dp
  WHERE i = length(a)
    AND 100 * (length(a) + length(b) - 2 * line[len(line)]) <= {100 - threshold} * (length(a) + length(b))
)"""


STAR_MAPPING = f"""
known AS (
  SELECT name, {KIND.format('name')} AS kind, sha256(name || {KIND.format('name')}) AS uri
  FROM (SELECT DISTINCT p_name AS name FROM part)
),
ment AS (
  SELECT DISTINCT uri, unnest(list_append(string_split(name, ' '), name)) AS text FROM known
),
texts AS (SELECT DISTINCT text FROM ment),
{similar('texts')},
mapping AS (
  SELECT m1.uri AS uri1, m2.uri AS uri2, a || ' == ' || b AS match_string, score
  FROM sim JOIN ment m1 ON m1.text = a JOIN ment m2 ON m2.text = b
  WHERE m1.uri <> m2.uri
)"""

AFFILIATIONS = f"""
{STAR_MAPPING},
fwd AS (
  SELECT e.name AS n1, e.kind AS k1, f.name AS n2, f.kind AS k2, score
  FROM mapping JOIN known e ON e.uri = uri1 JOIN known f ON f.uri = uri2
),
a AS (
  SELECT n1 AS entity_name, k1 AS entity_type, n2 AS aff_name, k2 AS aff_type, score AS match_score FROM fwd
  UNION ALL
  SELECT n2, k2, n1, k1, score FROM fwd
)"""

NS = "n JOIN s ON s.uri = n.source_uri"
IN_PERIOD = f"ts >= DATE '{PERIOD['date_from']}' AND ts <= DATE '{PERIOD['date_to']}'"


def counts(noun: str, label: str = "label") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {label} = '{name.upper()}') AS {name}_{noun}"
        for name in ("positive", "neutral", "negative")
    )


def shares(label: str = "label") -> str:
    return ", ".join(
        f"round(count(*) FILTER (WHERE {label} = '{name.upper()}') / count(*)::DOUBLE * 100, 2) AS {name}_percentage"
        for name in ("positive", "neutral", "negative")
    )


PAIR = """
pair AS (
  SELECT x.entity_name AS entity1, x.entity_type AS type1, y.entity_name AS entity2,
         y.entity_type AS type2, x.source_uri, x.ts, score, label
  FROM n x JOIN n y ON x.source_uri = y.source_uri AND x.entity_name < y.entity_name
  JOIN s ON s.uri = x.source_uri
)"""

MEANS = """
means AS (
  SELECT entity_name, entity_type, source_name, avg(score) AS m
  FROM n JOIN s ON s.uri = n.source_uri GROUP BY ALL
)"""


def top(n: int, kind: str | None = None) -> str:
    where = f"WHERE entity_type = '{kind}'" if kind else ""
    return (
        f"(SELECT entity_name FROM n {where} GROUP BY entity_name "
        f"ORDER BY count(*) DESC, entity_name LIMIT {n})"
    )


# name -> (CTEs, statement, columns to round to six decimals, columns to cut to dates)
_REPORTS: dict[str, tuple[list[str], str, str, str]] = {
    "entity_information": (
        [AFFILIATIONS],
        "SELECT DISTINCT entity_name, entity_type, entity_name AS entity_description FROM a WHERE entity_name LIKE 'red%'",
        "", "",
    ),
    "entity_affiliations": (
        [AFFILIATIONS],
        f"""SELECT DISTINCT aff_name AS affiliated_entity_name, aff_type AS affiliated_entity_type,
                   aff_name AS affiliated_entity_description, match_score
            FROM a WHERE entity_name = '{RED}' AND aff_type = 'PERSON'""",
        "match_score", "",
    ),
    "affiliations_by_type": (
        [AFFILIATIONS],
        f"""SELECT aff_type AS affiliated_entity_type, count(aff_name) AS total_affiliations
            FROM a WHERE entity_name = '{RED}' GROUP BY 1""",
        "", "",
    ),
    "affiliations_over_time": (
        [MENTIONS],
        f"""SELECT date_trunc('month', ts) AS month, count(*) AS total_mentions,
                   avg(match_score) AS avg_match_score
            FROM n WHERE entity_name = '{RED}' AND ts IS NOT NULL GROUP BY 1""",
        "avg_match_score", "month",
    ),
    "entity_news_sources": (
        [MENTIONS],
        f"""SELECT DISTINCT source_name, source_title, source_description, source_url,
                   ts AS source_published_at, match_score
            FROM n WHERE entity_name = '{RED}' AND {IN_PERIOD}""",
        "match_score", "source_published_at",
    ),
    "top_entities_by_mentions": (
        [MENTIONS],
        """SELECT entity_name, entity_type, count(DISTINCT source_uri) AS mention_count
           FROM n GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""",
        "", "",
    ),
    "relationship_network": (
        [AFFILIATIONS],
        f"""SELECT entity_name AS source_entity, entity_type AS source_type, aff_name AS target_entity,
                   aff_type AS target_type, match_score AS relationship_strength
            FROM a WHERE '{BLUE}' IN (entity_name, aff_name)""",
        "relationship_strength", "",
    ),
    "news_relevance_over_time": (
        [MENTIONS],
        f"""SELECT date_trunc('week', ts) AS week, count(*) AS mention_count, avg(match_score) AS avg_relevance
            FROM n WHERE entity_name = '{RED}' AND {IN_PERIOD} GROUP BY 1""",
        "avg_relevance", "week",
    ),
    "related_entities": (
        [MENTIONS],
        """SELECT x.entity_name AS entity1, y.entity_name AS entity2,
                  count(DISTINCT x.source_uri) AS co_occurrence_count
           FROM n x JOIN n y ON x.source_uri = y.source_uri AND x.entity_name < y.entity_name
           GROUP BY 1, 2 HAVING count(DISTINCT x.source_uri) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 20""",
        "", "",
    ),
    "entity_type_distribution": (
        [AFFILIATIONS],
        "SELECT entity_type, count(DISTINCT entity_name) AS entity_count FROM a GROUP BY 1",
        "", "",
    ),
    "match_quality_distribution": (
        [AFFILIATIONS],
        """SELECT CASE WHEN match_score >= 95 THEN 'Excellent (95-100)'
                       WHEN match_score >= 90 THEN 'Very Good (90-94)'
                       WHEN match_score >= 85 THEN 'Good (85-89)'
                       WHEN match_score >= 80 THEN 'Acceptable (80-84)'
                       ELSE 'Below Threshold (<80)' END AS match_quality,
                  count(*) AS match_count
           FROM a GROUP BY 1""",
        "", "",
    ),
    "news_source_timeline": (
        [MENTIONS],
        f"""SELECT entity_name, source_name, source_title, ts AS source_published_at, match_score
            FROM n WHERE entity_name = '{BLUE}' AND {IN_PERIOD}""",
        "match_score", "source_published_at",
    ),
    "source_distribution_by_type": (
        [MENTIONS],
        """SELECT entity_type, source_name, count(*) AS mention_count
           FROM n WHERE entity_type = 'ORG' GROUP BY 1, 2""",
        "", "",
    ),
    "affiliation_network_metrics": (
        [AFFILIATIONS],
        """SELECT entity_name, count(DISTINCT aff_name) AS connection_count,
                  avg(match_score) AS avg_connection_strength, max(match_score) AS strongest_connection,
                  min(match_score) AS weakest_connection
           FROM a WHERE entity_type = 'LOC' GROUP BY 1 ORDER BY 2 DESC, round(avg(match_score), 6) DESC, 1 LIMIT 20""",
        "avg_connection_strength strongest_connection weakest_connection", "",
    ),
    "mention_frequency_over_time": (
        [MENTIONS],
        f"""SELECT date_trunc('week', ts) AS week, entity_name, count(*) AS mention_count
            FROM n WHERE entity_name IN {top(5, 'PERSON')} AND {IN_PERIOD} GROUP BY 1, 2""",
        "", "week",
    ),
    "similar_entities": (
        [AFFILIATIONS],
        """SELECT x.entity_name AS entity1, y.aff_name AS entity2, avg(x.match_score) AS similarity_score,
                  count(*) AS common_affiliations
           FROM a x JOIN a y ON x.aff_name = y.aff_name AND x.entity_name <> y.entity_name
             AND x.entity_name <> y.aff_name AND y.entity_name <> x.aff_name
           WHERE x.entity_type = 'ORG' GROUP BY 1, 2 HAVING count(*) > 1
           ORDER BY round(avg(x.match_score), 6) DESC, 4 DESC, 1, 2 LIMIT 20""",
        "similarity_score", "",
    ),
    "source_influence": (
        [MENTIONS],
        """SELECT source_name, count(DISTINCT entity_name) AS entities_covered, count(*) AS total_mentions,
                  avg(match_score) AS avg_match_quality
           FROM n GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""",
        "avg_match_quality", "",
    ),
    "affiliation_comparison": (
        [AFFILIATIONS],
        f"""SELECT coalesce(x.aff_name, y.aff_name) AS affiliated_entity,
                   coalesce(x.aff_type, y.aff_type) AS affiliated_type,
                   x.match_score AS entity1_match_score, y.match_score AS entity2_match_score,
                   CASE WHEN x.match_score IS NULL THEN 'Only with {BLUE}'
                        WHEN y.match_score IS NULL THEN 'Only with {RED}'
                        ELSE 'With both entities' END AS affiliation_type
            FROM (FROM a WHERE entity_name = '{RED}') x
            FULL JOIN (FROM a WHERE entity_name = '{BLUE}') y ON x.aff_name = y.aff_name""",
        "entity1_match_score entity2_match_score", "",
    ),
    "mention_context": (
        [MENTIONS],
        f"""SELECT entity_name, source_title, source_description, match_details, match_score
            FROM n WHERE entity_name = '{RED}' AND {IN_PERIOD}
            ORDER BY match_score DESC, source_title, source_description, match_details LIMIT 50""",
        "match_score", "",
    ),
    "entity_type_correlation": (
        [AFFILIATIONS],
        """SELECT x.entity_type AS type1, y.aff_type AS type2, count(*) AS correlation_strength
           FROM a x JOIN a y ON x.entity_name = y.entity_name AND x.entity_type <> y.aff_type GROUP BY 1, 2""",
        "", "",
    ),
    "sentiment_overview": (
        [MENTIONS, SENTIMENT],
        f"""SELECT entity_name, entity_type, count(*) AS total_mentions, avg(score) AS avg_sentiment_score,
                   {counts('mentions')}, {shares()}
            FROM {NS} WHERE entity_name = '{RED}' AND {IN_PERIOD} GROUP BY 1, 2""",
        "avg_sentiment_score", "",
    ),
    "sentiment_over_time": (
        [MENTIONS, SENTIMENT],
        f"""SELECT date_trunc('week', ts) AS week, entity_name, count(*) AS mention_count,
                   avg(score) AS avg_sentiment_score, {counts('mentions')}
            FROM {NS} WHERE entity_name = '{RED}' AND {IN_PERIOD} GROUP BY 1, 2""",
        "avg_sentiment_score", "week",
    ),
    "top_entities_by_positive_sentiment": (
        [MENTIONS, SENTIMENT],
        f"""SELECT entity_name, entity_type, count(*) AS total_mentions,
                   count(*) FILTER (WHERE label = 'POSITIVE') AS positive_mentions,
                   round(count(*) FILTER (WHERE label = 'POSITIVE') / count(*)::DOUBLE * 100, 2) AS positive_percentage
            FROM {NS} GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY 5 DESC, 3 DESC, 1, 2 LIMIT 20""",
        "", "",
    ),
    "top_entities_by_negative_sentiment": (
        [MENTIONS, SENTIMENT],
        f"""SELECT entity_name, entity_type, count(*) AS total_mentions,
                   count(*) FILTER (WHERE label = 'NEGATIVE') AS negative_mentions,
                   round(count(*) FILTER (WHERE label = 'NEGATIVE') / count(*)::DOUBLE * 100, 2) AS negative_percentage
            FROM {NS} WHERE entity_type = 'LOC' AND {IN_PERIOD}
            GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY 5 DESC, 3 DESC, 1, 2 LIMIT 20""",
        "", "",
    ),
    "source_sentiment": (
        [MENTIONS, SENTIMENT],
        f"""SELECT source_name, count(*) AS total_articles, avg(score) AS avg_sentiment_score,
                   {counts('articles')}, {shares()}
            FROM {NS} GROUP BY 1 HAVING count(*) >= 5""",
        "avg_sentiment_score", "",
    ),
    "sentiment_comparison": (
        [MENTIONS, SENTIMENT],
        f"""SELECT CASE entity_name WHEN '{RED}' THEN 'Entity 1' ELSE 'Entity 2' END AS entity_group,
                   entity_name, count(*) AS total_mentions, avg(score) AS avg_sentiment_score,
                   {counts('mentions')}, {shares()}
            FROM {NS} WHERE entity_name IN ('{RED}', '{BLUE}') AND {IN_PERIOD} GROUP BY 1, 2""",
        "avg_sentiment_score", "",
    ),
    "sentiment_by_source": (
        [MENTIONS, SENTIMENT],
        f"""SELECT source_name, count(*) AS total_mentions, avg(score) AS avg_sentiment_score,
                   {counts('mentions')}, {shares()}
            FROM {NS} WHERE entity_name = '{RED}' GROUP BY 1 HAVING count(*) >= 3""",
        "avg_sentiment_score", "",
    ),
    "entity_type_sentiment": (
        [MENTIONS, SENTIMENT],
        f"""SELECT entity_type, count(*) AS total_mentions, count(DISTINCT entity_name) AS unique_entities,
                   avg(score) AS avg_sentiment_score, {counts('mentions')}, {shares()}
            FROM {NS} GROUP BY 1""",
        "avg_sentiment_score", "",
    ),
    "sentiment_trend": (
        [MENTIONS, SENTIMENT],
        f"""SELECT date_trunc('month', ts) AS month, count(*) AS total_mentions,
                   avg(score) AS avg_sentiment_score, {counts('mentions')}, {shares()}
            FROM {NS} GROUP BY 1""",
        "avg_sentiment_score", "month",
    ),
    "sentiment_articles": (
        [MENTIONS, SENTIMENT],
        f"""SELECT entity_name, source_title, source_description, source_url, ts AS source_published_at,
                   score AS sentiment_score, label AS sentiment_label, match_score
            FROM {NS} WHERE entity_name = '{RED}' AND label = 'NEGATIVE' AND {IN_PERIOD}""",
        "sentiment_score match_score", "source_published_at",
    ),
    "mention_trends": (
        [MENTIONS],
        f"""SELECT day, entity_name, c AS daily_mentions,
                   avg(c) OVER (PARTITION BY entity_name ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
                     AS seven_day_moving_avg
            FROM (SELECT date_trunc('day', ts) AS day, entity_name, count(*) AS c
                  FROM n WHERE entity_name IN {top(5)} GROUP BY 1, 2)""",
        "seven_day_moving_avg", "day",
    ),
    "type_popularity_over_time": (
        [MENTIONS],
        """SELECT date_trunc('month', ts) AS month, entity_type, count(*) AS mention_count,
                  count(DISTINCT entity_name) AS unique_entities
           FROM n GROUP BY 1, 2""",
        "", "month",
    ),
    "match_score_trends": (
        [MENTIONS],
        """SELECT date_trunc('month', ts) AS month, avg(match_score) AS avg_match_score,
                  quantile_cont(match_score, 0.5) AS median_match_score,
                  min(match_score) AS min_match_score, max(match_score) AS max_match_score
           FROM n GROUP BY 1""",
        "avg_match_score median_match_score min_match_score max_match_score", "month",
    ),
    "source_activity_trends": (
        [MENTIONS],
        """SELECT date_trunc('month', ts) AS month, source_name, count(*) AS article_count,
                  count(DISTINCT entity_name) AS entity_coverage
           FROM n GROUP BY 1, 2""",
        "", "month",
    ),
    "relationship_growth": (
        [MENTIONS],
        """SELECT month, c AS new_entities, CAST(sum(c) OVER (ORDER BY month) AS BIGINT) AS cumulative_entities
           FROM (SELECT date_trunc('month', t) AS month, count(*) AS c
                 FROM (SELECT entity_name, min(ts) AS t FROM n GROUP BY 1) GROUP BY 1)""",
        "", "month",
    ),
    "pair_mention_trends": (
        [MENTIONS],
        """SELECT * FROM (
             SELECT *, rank() OVER (PARTITION BY month ORDER BY co_mention_count DESC) AS rank
             FROM (SELECT date_trunc('month', x.ts) AS month, x.entity_name AS entity1, y.entity_name AS entity2,
                          count(DISTINCT x.source_uri) AS co_mention_count
                   FROM n x JOIN n y ON x.source_uri = y.source_uri AND x.entity_name < y.entity_name
                    AND date_trunc('month', x.ts) = date_trunc('month', y.ts)
                   GROUP BY 1, 2, 3))
           WHERE rank <= 10""",
        "", "month",
    ),
    "seasonal_patterns": (
        [MENTIONS],
        f"""SELECT CAST(month(ts) AS INTEGER) AS month_number, rpad(monthname(ts), 9, ' ') AS month_name, entity_name,
                   count(*) AS mention_count, avg(match_score) AS avg_match_score
            FROM n WHERE entity_name = '{RED}' GROUP BY 1, 2, 3""",
        "avg_match_score", "",
    ),
    "mention_velocity": (
        [MENTIONS],
        f"""SELECT month, entity_name, c AS mention_count, p AS previous_month_count,
                   c - coalesce(p, 0) AS absolute_change,
                   CASE WHEN coalesce(p, 0) = 0 THEN NULL ELSE round((c - p) / p::DOUBLE * 100, 2) END
                     AS percentage_change
            FROM (SELECT *, lag(c) OVER (PARTITION BY entity_name ORDER BY month) AS p
                  FROM (SELECT date_trunc('month', ts) AS month, entity_name, count(*) AS c FROM n GROUP BY 1, 2))
            WHERE entity_name IN {top(5, 'ORG')}""",
        "", "month",
    ),
    "affiliation_strength_evolution": (
        [MENTIONS, AFFILIATIONS],
        f"""SELECT * FROM (
              SELECT *, rank() OVER (PARTITION BY quarter, entity_name ORDER BY round(avg_match_score, 6) DESC) AS rank
              FROM (SELECT date_trunc('quarter', ts) AS quarter, a.entity_name, aff_name AS affiliated_entity_name,
                           avg(a.match_score) AS avg_match_score, count(*) AS co_mention_count
                    FROM a JOIN n ON n.entity_name = a.entity_name
                    WHERE a.entity_name = '{RED}' GROUP BY 1, 2, 3))
            WHERE rank <= 5""",
        "avg_match_score", "quarter",
    ),
    "emerging_relationships": (
        [MENTIONS, AFFILIATIONS],
        """SELECT entity_name, affiliated_entity_name, r AS recent_co_mentions, h AS historical_co_mentions,
                  r - h AS absolute_growth,
                  CASE WHEN h = 0 THEN NULL ELSE round((r - h) / h::DOUBLE * 100, 2) END AS percentage_growth
           FROM (SELECT a.entity_name, aff_name AS affiliated_entity_name,
                        count(*) FILTER (WHERE ts >= DATE '2001-08-01' - INTERVAL 90 DAY) AS r,
                        count(*) FILTER (WHERE ts < DATE '2001-08-01' - INTERVAL 90 DAY
                                           AND ts >= DATE '2001-08-01' - INTERVAL 365 DAY) AS h
                 FROM a JOIN n ON n.entity_name = a.entity_name
                 WHERE a.entity_name IN (SELECT entity_name FROM a WHERE entity_type = 'PERSON') GROUP BY 1, 2)
           WHERE r > 0
           ORDER BY CASE WHEN h = 0 THEN r ELSE percentage_growth END DESC, 1, 2 LIMIT 20""",
        "", "",
    ),
    "pair_sentiment": (
        [MENTIONS, SENTIMENT, PAIR],
        f"""SELECT entity1, entity2, count(*) AS co_mentions, avg(score) AS avg_sentiment_score,
                   {counts('mentions')}, {shares()}
            FROM pair GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 3 DESC, avg(score) DESC, 1, 2 LIMIT 50""",
        "avg_sentiment_score", "",
    ),
    "relationships_by_sentiment": (
        [MENTIONS, SENTIMENT, PAIR],
        f"""SELECT *, CASE WHEN positive_mentions > greatest(neutral_mentions, negative_mentions) THEN 'Positive'
                           WHEN negative_mentions > greatest(neutral_mentions, positive_mentions) THEN 'Negative'
                           ELSE 'Neutral' END AS dominant_sentiment
            FROM (SELECT entity1, entity2, count(*) AS co_mentions, {counts('mentions')}, {shares()}
                  FROM pair WHERE 'PERSON' IN (type1, type2) GROUP BY 1, 2 HAVING count(*) >= 3)""",
        "", "",
    ),
    "sentiment_network": (
        [MENTIONS, SENTIMENT, PAIR],
        f"""SELECT entity1 AS source, type1 AS source_type, entity2 AS target, type2 AS target_type, co_mentions,
                   avg_sentiment_score,
                   CASE WHEN positive_mentions > greatest(neutral_mentions, negative_mentions) THEN 'Positive'
                        WHEN negative_mentions > greatest(neutral_mentions, positive_mentions) THEN 'Negative'
                        ELSE 'Neutral' END AS dominant_sentiment
            FROM (SELECT entity1, type1, entity2, type2, count(*) AS co_mentions, avg(score) AS avg_sentiment_score,
                         {counts('mentions')}
                  FROM pair WHERE {IN_PERIOD} GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)""",
        "avg_sentiment_score", "",
    ),
    "sentiment_correlation": (
        [MENTIONS, SENTIMENT, MEANS],
        """SELECT *, CASE WHEN sentiment_correlation >= 0.7 THEN 'Strong Positive'
                          WHEN sentiment_correlation >= 0.3 THEN 'Moderate Positive'
                          WHEN sentiment_correlation >= -0.3 THEN 'Weak/No Correlation'
                          WHEN sentiment_correlation >= -0.7 THEN 'Moderate Negative'
                          ELSE 'Strong Negative' END AS correlation_strength
           FROM (SELECT x.entity_name AS entity1, y.entity_name AS entity2, count(*) AS common_sources,
                        CASE WHEN min(x.m) = max(x.m) OR min(y.m) = max(y.m) THEN NULL
                             ELSE corr(x.m, y.m) END AS sentiment_correlation
                 FROM means x JOIN means y ON x.source_name = y.source_name AND x.entity_name < y.entity_name
                 GROUP BY 1, 2 HAVING count(*) >= 5)
           WHERE sentiment_correlation IS NOT NULL
           ORDER BY abs(sentiment_correlation) DESC, common_sources DESC, 1, 2 LIMIT 50""",
        "sentiment_correlation", "",
    ),
    "sentiment_contrast": (
        [MENTIONS, SENTIMENT, MEANS],
        """SELECT entity_name, count(DISTINCT source_name) AS source_count, avg(m) AS overall_avg_sentiment,
                  stddev_samp(m) AS sentiment_stddev, min(m) AS min_sentiment, max(m) AS max_sentiment,
                  max(m) - min(m) AS sentiment_range
           FROM means WHERE entity_type = 'LOC' GROUP BY 1 HAVING count(DISTINCT source_name) >= 3
           ORDER BY 7 DESC, 4 DESC, 1 LIMIT 20""",
        "overall_avg_sentiment sentiment_stddev min_sentiment max_sentiment sentiment_range", "",
    ),
    "pair_sentiment_change": (
        [MENTIONS, SENTIMENT, PAIR],
        """SELECT entity1, entity2, month, avg_sentiment_score, prev_sentiment_score,
                  avg_sentiment_score - prev_sentiment_score AS sentiment_change, co_mentions
           FROM (SELECT *, lag(avg_sentiment_score) OVER (PARTITION BY entity1, entity2 ORDER BY month)
                             AS prev_sentiment_score
                 FROM (SELECT entity1, entity2, date_trunc('month', ts) AS month, avg(score) AS avg_sentiment_score,
                              count(*) AS co_mentions
                       FROM pair GROUP BY 1, 2, 3 HAVING count(*) >= 2))
           WHERE prev_sentiment_score IS NOT NULL
           ORDER BY abs(avg_sentiment_score - prev_sentiment_score) DESC, month DESC, co_mentions DESC, 1, 2
           LIMIT 100""",
        "avg_sentiment_score prev_sentiment_score sentiment_change", "month",
    ),
    "sentiment_clusters": (
        [MENTIONS, SENTIMENT],
        f"""SELECT *, CASE WHEN avg_sentiment_score >= 0.5 AND positive_ratio >= 0.6 THEN 'Highly Positive'
                           WHEN avg_sentiment_score >= 0.2 AND positive_ratio >= 0.4 THEN 'Moderately Positive'
                           WHEN avg_sentiment_score <= -0.5 AND negative_ratio >= 0.6 THEN 'Highly Negative'
                           WHEN avg_sentiment_score <= -0.2 AND negative_ratio >= 0.4 THEN 'Moderately Negative'
                           WHEN neutral_ratio >= 0.6 THEN 'Predominantly Neutral'
                           ELSE 'Mixed Sentiment' END AS sentiment_cluster
            FROM (SELECT entity_name, entity_type, count(*) AS mention_count, avg(score) AS avg_sentiment_score,
                         count(*) FILTER (WHERE label = 'POSITIVE') / count(*)::DOUBLE AS positive_ratio,
                         count(*) FILTER (WHERE label = 'NEUTRAL') / count(*)::DOUBLE AS neutral_ratio,
                         count(*) FILTER (WHERE label = 'NEGATIVE') / count(*)::DOUBLE AS negative_ratio
                  FROM {NS} GROUP BY 1, 2 HAVING count(*) >= 3)""",
        "avg_sentiment_score positive_ratio neutral_ratio negative_ratio", "",
    ),
}


def statement(ctes: list[str], body: str, rounded: str = "", dates: str = "") -> str:
    """One statement: the CTEs, then ``body`` with its measures made comparable."""
    fixed = [f"round({c}, 6) AS {c}" for c in rounded.split()]
    fixed += [f"CAST({c} AS DATE) AS {c}" for c in dates.split()]
    replace = f" REPLACE ({', '.join(fixed)})" if fixed else ""
    recursive = "RECURSIVE " if any("dp(" in c for c in ctes) else ""
    return f"WITH {recursive}{','.join(ctes)}\nSELECT *{replace} FROM (\n{body}\n)"


def report_statements() -> dict[str, str]:
    return {name: statement(*parts) for name, parts in _REPORTS.items()}


def party_statements(party: str, names: tuple[str, ...]) -> dict[str, str]:
    """The statements of these reports with customers or suppliers as entities."""
    mentions = {"customer": CUSTOMER_MENTIONS, "supplier": SUPPLIER_MENTIONS}[party]
    return {
        name: statement([mentions if c == MENTIONS else c for c in _REPORTS[name][0]], *_REPORTS[name][1:])
        for name in names
    }
