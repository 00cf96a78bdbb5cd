"""DuckDB statements for the layer steps and text operators on the corpus tables."""

from __future__ import annotations

from oracle.reports import KIND, STAR_MAPPING, similar, statement

WORD = r"\p{Lu}\p{L}+"
WORD_AND_NEXT = r"\p{Lu}\p{L}+ \p{L}+"
TOKEN = r"[\p{L}\p{N}]+"

ENTITIES = """
known AS (
  SELECT sha256('item ' || item_id || 'ORG') AS uri, 'item ' || item_id AS name, 'ORG' AS kind, text AS description
  FROM benchmark
)"""

ARTICLES = """
articles AS (
  SELECT sha256(CAST(doc_id AS VARCHAR)) AS uri, source AS title, text AS content, 'doc/' || doc_id AS url
  FROM documents
)"""

# Dictionary phrases with their tokens and the final type (places folded).
DICTIONARY = f"""
phrases AS (
  SELECT DISTINCT phrase, regexp_extract_all(phrase, '{TOKEN}') AS parts,
         CASE length(phrase) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'LOC' END AS kind
  FROM (SELECT unnest(regexp_extract_all(text, '{WORD}')) AS phrase FROM benchmark
        UNION ALL SELECT unnest(regexp_extract_all(text, '{WORD_AND_NEXT}')) FROM benchmark)
)"""


def mention_ctes(name: str, texts: str) -> str:
    """CTE ``name(uri, text, kind)`` from ``texts``, a statement giving (uri, field, text)."""
    return f"""
{name}_tok AS (
  SELECT uri, field, regexp_extract_all(text, '{TOKEN}') AS toks FROM ({texts}) WHERE text IS NOT NULL
),
{name}_pos AS (
  SELECT uri, field, toks, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM {name}_tok
),
{name}_hit AS (
  SELECT DISTINCT uri, field, i, i + len(parts) AS j, phrase, kind
  FROM {name}_pos JOIN phrases ON parts[1] = tok AND toks[i : i + len(parts) - 1] = parts
),
{name} AS (
  SELECT DISTINCT uri, phrase AS text, kind FROM {name}_hit h
  WHERE NOT EXISTS (
    SELECT 1 FROM {name}_hit g
    WHERE g.uri = h.uri AND g.field = h.field AND g.i <= h.i AND g.j >= h.j AND g.j - g.i > h.j - h.i)
)"""


KNOWN_MENTIONS = mention_ctes("km", "SELECT uri, 0 AS field, description AS text FROM known")
ARTICLE_MENTIONS = mention_ctes(
    "am", "SELECT uri, 0 AS field, title AS text FROM articles UNION ALL SELECT uri, 1, content FROM articles"
)

TEXTS = "alltexts AS (SELECT DISTINCT text FROM (SELECT text FROM km UNION ALL SELECT text FROM am))"
KNOWN_TEXTS = "alltexts AS (SELECT DISTINCT text FROM km)"

SOURCE_MAPPING = [
    ENTITIES, ARTICLES, DICTIONARY, KNOWN_MENTIONS, ARTICLE_MENTIONS, TEXTS, similar("alltexts"),
    """
smap AS (
  SELECT k.uri AS known_uri, true AS match, a || ' == ' || b AS match_string, m.uri AS newsapi_uri, score
  FROM sim JOIN km k ON k.text = a JOIN am m ON m.text = b
)""",
]

ENTITY_MAPPING = [
    ENTITIES, DICTIONARY, KNOWN_MENTIONS, KNOWN_TEXTS, similar("alltexts"),
    """
emap AS (
  SELECT x.uri AS known1_uri, y.uri AS known2_uri, true AS match, a || ' == ' || b AS match_string, score
  FROM sim JOIN km x ON x.text = a JOIN km y ON y.text = b
  WHERE x.uri <> y.uri
)""",
]

FORWARD = """
fwd AS (
  SELECT x.uri AS u1, x.name AS n1, x.kind AS k1, x.description AS d1,
         y.uri AS u2, y.name AS n2, y.kind AS k2, y.description AS d2, match_string, score
  FROM emap JOIN known x ON x.uri = known1_uri JOIN known y ON y.uri = known2_uri
)"""


def affiliation_rows(one: int, two: int) -> str:
    return f"""SELECT u{one} AS entity_uri, n{one} AS entity_name, k{one} AS entity_type, d{one} AS entity_description,
       u{two} AS affiliated_entity_uri, n{two} AS affiliated_entity_name, k{two} AS affiliated_entity_type,
       d{two} AS affiliated_entity_description, match_string AS match_details, score AS match_score FROM fwd"""


def word_list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


POSITIVE = ("best", "with", "this", "les")
NEGATIVE = ("worthless", "idiot", "stupid", "disgusting", "was", "der")

KEPT = r"""
kept AS (
  SELECT doc_id, source, len(w) AS words, least(len(w), 512) AS kept_words,
         CASE WHEN len(w) > 512 THEN array_to_string(w[1:512], ' ') ELSE text END AS kept
  FROM (SELECT doc_id, source, text, regexp_extract_all(text, '\S+') AS w FROM documents)
)"""

RATED = f"""
rated AS (
  SELECT sha256(CAST(doc_id AS VARCHAR)) AS uri, source AS title, p, n,
         CASE WHEN p + n = 0 THEN 0.0 ELSE CAST(abs(p - n) / (p + n)::DOUBLE AS FLOAT)::DOUBLE END AS sentiment_score,
         CASE WHEN p > n THEN 'POSITIVE' WHEN p < n THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS sentiment_label
  FROM (SELECT doc_id, source,
               len(list_filter(toks, lambda t: t IN ({word_list(POSITIVE)}))) AS p,
               len(list_filter(toks, lambda t: t IN ({word_list(NEGATIVE)}))) AS n
        FROM (SELECT doc_id, source, regexp_extract_all(lower(text), '{TOKEN}') AS toks FROM documents))
)"""


def words_of(table: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS text FROM {table})"


PAIRS = "SELECT a AS left_text, b AS right_text, score FROM sim"

PREDICTED = [
    ARTICLES, DICTIONARY, ARTICLE_MENTIONS,
    """
predicted AS (
  SELECT uri AS uid, count(*) FILTER (WHERE kind = 'PERSON') AS "PERSON",
         count(*) FILTER (WHERE kind = 'ORG') AS "ORG", count(*) FILTER (WHERE kind = 'LOC') AS "LOC"
  FROM am GROUP BY 1
),
truth AS (
  SELECT sha256(CAST(doc_id AS VARCHAR)) AS uid, quality AS t_person, toxic AS t_org, quality + toxic AS t_loc
  FROM labels
)""",
]

KINDS = ("PERSON", "ORG", "LOC")


def metric_columns(kind: str) -> str:
    p, a = f'"{kind}"', f"t_{kind.lower()}"
    precision = f"(CASE WHEN {a} > 0 THEN {p} / greatest({p}, 1)::DOUBLE ELSE 0.0 END)"
    recall = f"(CASE WHEN {a} > 0 THEN least({p}, {a}) / greatest({a}, 1)::DOUBLE ELSE 0.0 END)"
    strict = f"(CASE WHEN {a} > 0 THEN least({p}, {a}) / greatest({p}, 1)::DOUBLE ELSE 0.0 END)"
    f1 = (
        f"(CASE WHEN {precision} + {recall} > 0 THEN 2 * {precision} * {recall} "
        f"/ greatest({precision} + {recall}, 1.0) ELSE 0.0 END)"
    )
    return ", ".join(
        f'{value}::DOUBLE AS "{kind}_{name}"'
        for name, value in (
            ("precision", precision), ("recall", recall), ("f1", f1), ("precision_strict", strict)
        )
    )


METRICS = "metrics AS (SELECT uid, " + ", ".join(map(metric_columns, KINDS)) + " FROM truth JOIN predicted USING (uid))"
MEASURES = ("precision", "recall", "f1", "precision_strict")
METRIC_NAMES = " ".join(f"{k}_{m}" for k in KINDS for m in MEASURES)


def averages() -> str:
    rows = [
        f"SELECT '{k}' AS entity_type, " + ", ".join(f'avg("{k}_{m}") AS {m}' for m in MEASURES) + " FROM metrics"
        for k in KINDS
    ]
    overall = ", ".join(
        "(" + " + ".join(f'avg("{k}_{m}")' for k in KINDS) + f") / 3 AS {m}" for m in MEASURES
    )
    return " UNION ALL ".join(rows) + f" UNION ALL SELECT 'OVERALL', {overall} FROM metrics"


def accuracy(kind: str) -> str:
    p, a = f'coalesce("{kind}", 0)', f"t_{kind.lower()}"
    return (
        f"(CASE WHEN {a} > 0 THEN greatest(0.0, 1 - abs({a} - {p}) / greatest({a}, 1)::DOUBLE) "
        f'WHEN {p} = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS "{kind}_accuracy"'
    )


INGEST = """
flat AS (
  SELECT event_id, 'user ' || user_id AS entity_name, event_type AS title, props AS description,
         'event/' || event_id AS url,
         CASE WHEN value > 5 THEN event_type ELSE '' END AS source_name,
         CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS published_at, place
  FROM events, (VALUES (0), (1)) AS twice(place)
),
windowed AS (
  SELECT *, sha256(url || title || entity_name) AS uri FROM flat
  WHERE published_at IS NULL
     OR CAST(published_at AS DATE) BETWEEN DATE '2024-01-30' - 7 AND DATE '2024-01-30'
)"""

_STATEMENTS: dict[str, tuple[list[str], str, str, str]] = {
    "composite_keys": (
        ["c AS (FROM customer)"],
        """SELECT c_custkey, sha256(c_name) AS name_key,
                  sha256(c_name || c_nationkey || CASE WHEN c_nationkey > 4 THEN c_mktsegment ELSE 'None' END) AS full_key
           FROM c""",
        "", "",
    ),
    "keyed_known_entities": (
        ["names AS (SELECT DISTINCT p_name AS name FROM part)"],
        f"""SELECT sha256(name || {KIND.format('name')}) AS uri, name AS entity_name,
                   {KIND.format('name')} AS entity_type, name AS entity_description FROM names""",
        "", "",
    ),
    "article_ingest": (
        [INGEST],
        """SELECT DISTINCT uri, sha256(entity_name) AS entity_uri, entity_name, title, description,
                  NULL::VARCHAR AS content, url, source_name, NULL::VARCHAR AS author, published_at,
                  TIMESTAMP '2024-01-31' AS ingestion_timestamp
           FROM windowed""",
        "", "published_at ingestion_timestamp",
    ),
    "known_mentions": (
        [ENTITIES, DICTIONARY, KNOWN_MENTIONS],
        "SELECT uri, text AS entity_text, kind AS entity_type FROM km",
        "", "",
    ),
    "article_mentions": (
        [ARTICLES, DICTIONARY, ARTICLE_MENTIONS],
        "SELECT uri, text AS entity_text, kind AS entity_type FROM am",
        "", "",
    ),
    "article_mentions_large_dictionary": (
        [ARTICLES, DICTIONARY, ARTICLE_MENTIONS],
        "SELECT uri, text AS entity_text, kind AS entity_type FROM am",
        "", "",
    ),
    "article_sentiment": (
        [RATED],
        "SELECT uri, title, sentiment_score, sentiment_label FROM rated",
        "sentiment_score", "",
    ),
    "active_customers": (
        ["grains AS (SELECT unnest(['month', 'quarter', 'year']) AS grain)"],
        """
SELECT o_orderpriority, grain, CAST(date_trunc(grain, o_orderdate) AS DATE) AS period, count(DISTINCT o_custkey) AS different
FROM orders CROSS JOIN grains GROUP BY ALL""",
        "", "",
    ),
    "frequent_word_pairs": (
        [f"found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{WORD}')) AS word FROM documents)"],
        """
SELECT a.word AS word1, b.word AS word2, count(*) AS documents
FROM found a JOIN found b ON a.doc_id = b.doc_id AND a.word < b.word
GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY documents DESC, word1, word2 LIMIT 50""",
        "", "",
    ),
    "word_counts": (
        [KEPT],
        "SELECT doc_id, CAST(words AS INTEGER) AS words, CAST(kept_words AS INTEGER) AS kept_words, sha256(kept) AS kept_text FROM kept",
        "", "",
    ),
    "similar_words": (
        [words_of("benchmark", "small"), words_of("documents", "large"), similar("small", "large")],
        PAIRS, "score", "",
    ),
    "similar_words_within": (
        [words_of("documents", "large"), similar("large")],
        PAIRS, "score", "",
    ),
    "similar_words_wide": (
        [words_of("benchmark", "small"), words_of("documents", "large"), similar("small", "large", 70)],
        PAIRS, "score", "",
    ),
    "similar_passages": (
        [
            "passages AS (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL)",
            "doc_lines AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS text FROM documents)",
            similar("passages", "doc_lines"),
        ],
        PAIRS, "score", "",
    ),
    "fuzzy_matches": (
        [STAR_MAPPING],
        """SELECT m.uri AS left_key, CAST(p_partkey AS VARCHAR) AS right_key, true AS match,
                  a || ' == ' || b AS match_string, score
           FROM sim JOIN ment m ON m.text = a
           JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) ON word = b""",
        "score", "",
    ),
    "passage_matches": (
        [
            """
neighbours AS (
  SELECT x.item_id, x.text AS a, y.text AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1
)""",
            """
row_dp(item_id, a, b, i, line) AS (
  SELECT item_id, a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM neighbours
  UNION ALL
  SELECT item_id, a, b, i + 1,
         list_reduce(range(1, length(b) + 1),
                     lambda acc, j: list_append(acc,
                       CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN line[j] + 1
                            ELSE greatest(line[j + 1], acc[len(acc)]) END), [0])
  FROM row_dp WHERE i < length(a)
)""",
            """
rated AS (
  SELECT item_id, a, b, (1.0::DOUBLE - (length(a) + length(b) - 2 * line[len(line)])::DOUBLE
                         / (length(a) + length(b))) * 100.0 AS score
  FROM row_dp WHERE i = length(a)
)""",
        ],
        """SELECT item_id, score >= 52 AS match, CASE WHEN score >= 52 THEN a || ' == ' || b END AS match_string, score
           FROM rated""",
        "score", "",
    ),
    "normal_labels": (
        ["l AS (FROM labels)"],
        """SELECT doc_id, CASE WHEN quality = 1 THEN 'POSITIVE' WHEN toxic = 1 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label
           FROM l""",
        "", "",
    ),
    "model_mentions": (
        [ARTICLES],
        """SELECT DISTINCT uri, w AS entity_text,
                  CASE length(w) % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'LOC' END AS entity_type
           FROM (SELECT uri, unnest(string_split(content, ' ')) AS w FROM articles)
           WHERE regexp_full_match(w, '[A-Z][a-z]{8,}') AND length(w) % 4 < 3""",
        "", "",
    ),
    "model_sentiment": (
        ["m AS (SELECT *, length(text) - length(replace(text, '!', '')) AS marks FROM documents)"],
        """SELECT sha256(CAST(doc_id AS VARCHAR)) AS uri, source AS title,
                  CASE WHEN coalesce(text, '') = '' THEN 0.0 WHEN marks = 0 THEN 0.5
                       ELSE least(1.0, marks / 8.0) END::DOUBLE AS sentiment_score,
                  CASE WHEN coalesce(text, '') = '' THEN 'NEUTRAL' WHEN marks = 0 THEN 'POSITIVE'
                       ELSE 'NEGATIVE' END AS sentiment_label
           FROM m""",
        "sentiment_score", "",
    ),
    "source_mapping": (SOURCE_MAPPING, "FROM smap", "score", ""),
    "entity_mapping": (ENTITY_MAPPING, "FROM emap", "score", ""),
    "gold_affiliations": ([*ENTITY_MAPPING, FORWARD], affiliation_rows(1, 2), "match_score", ""),
    "gold_affiliations_complete": (
        [*ENTITY_MAPPING, FORWARD],
        affiliation_rows(1, 2) + " UNION ALL " + affiliation_rows(2, 1),
        "match_score", "",
    ),
    "gold_entity_articles": (
        SOURCE_MAPPING,
        """SELECT k.uri AS entity_uri, k.name AS entity_name, k.kind AS entity_type,
                  k.description AS entity_description, d.uri AS source_uri, d.title AS source_title,
                  NULL::VARCHAR AS source_description, d.url AS source_url, d.title AS source_name,
                  NULL::DATE AS source_published_at, match_string AS match_details, score AS match_score
           FROM smap JOIN known k ON k.uri = known_uri JOIN articles d ON d.uri = newsapi_uri""",
        "match_score", "",
    ),
    "gold_article_sentiment": (
        [RATED],
        "SELECT DISTINCT uri, title, sentiment_score, sentiment_label FROM rated",
        "sentiment_score", "",
    ),
    "predicted_counts": (PREDICTED, "FROM predicted", "", ""),
    "extraction_metrics": ([*PREDICTED, METRICS], "FROM metrics", METRIC_NAMES, ""),
    "extraction_averages": ([*PREDICTED, METRICS], averages(), " ".join(MEASURES), ""),
    "extraction_accuracy": (
        PREDICTED,
        "SELECT uid, " + ", ".join(map(accuracy, KINDS)) + " FROM truth LEFT JOIN predicted USING (uid)",
        " ".join(f"{k}_accuracy" for k in KINDS), "",
    ),
    "extraction_average_counts": (
        PREDICTED,
        " UNION ALL ".join(
            f"""SELECT '{k}' AS entity_type, (SELECT avg(t_{k.lower()}) FROM truth) AS labelled,
                       (SELECT avg("{k}") FROM predicted) AS predicted"""
            for k in KINDS
        ),
        "labelled predicted", "",
    ),
}


def layer_statements() -> dict[str, str]:
    return {name: statement(*parts) for name, parts in _STATEMENTS.items()}
