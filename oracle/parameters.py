"""Parameter values the reports are registered with."""

RED, BLUE = "red plate", "blue ring"
PERIOD = {"date_from": "1996-03-01", "date_to": "2000-10-31"}

# Reports that are also run with other entities than part names.
PARTY_REPORTS: dict[str, tuple[str, ...]] = {
    "customer": ("relationship_growth", "mention_velocity", "source_influence"),
    "supplier": ("related_entities", "pair_mention_trends", "pair_sentiment", "sentiment_correlation"),
}

REPORT_PARAMETERS: dict[str, dict] = {
    "entity_information": {"entity_name": "red%"},
    "entity_affiliations": {"entity_name": RED, "entity_type": "PERSON"},
    "affiliations_by_type": {"entity_name": RED},
    "affiliations_over_time": {"entity_name": RED},
    "entity_news_sources": {"entity_name": RED, **PERIOD},
    "top_entities_by_mentions": {},
    "relationship_network": {"entity_name": BLUE},
    "news_relevance_over_time": {"entity_name": RED, **PERIOD},
    "related_entities": {},
    "entity_type_distribution": {},
    "match_quality_distribution": {},
    "news_source_timeline": {"entity_name": BLUE, **PERIOD},
    "source_distribution_by_type": {"entity_type": "ORG"},
    "affiliation_network_metrics": {"entity_type": "LOC"},
    "mention_frequency_over_time": {"entity_type": "PERSON", **PERIOD},
    "similar_entities": {"entity_type": "ORG"},
    "source_influence": {},
    "affiliation_comparison": {"entity_name_1": RED, "entity_name_2": BLUE},
    "mention_context": {"entity_name": RED, **PERIOD},
    "entity_type_correlation": {},
    "sentiment_overview": {"entity_name": RED, **PERIOD},
    "sentiment_over_time": {"entity_name": RED, **PERIOD},
    "top_entities_by_positive_sentiment": {"min_mentions": 3},
    "top_entities_by_negative_sentiment": {"min_mentions": 3, "entity_type": "LOC", **PERIOD},
    "source_sentiment": {"min_articles": 5},
    "sentiment_comparison": {"entity_name_1": RED, "entity_name_2": BLUE, **PERIOD},
    "sentiment_by_source": {"entity_name": RED, "min_mentions": 3},
    "entity_type_sentiment": {},
    "sentiment_trend": {},
    "sentiment_articles": {"entity_name": RED, "sentiment": "NEGATIVE", **PERIOD},
    "mention_trends": {"top_n_entities": 5},
    "type_popularity_over_time": {},
    "match_score_trends": {},
    "source_activity_trends": {},
    "relationship_growth": {},
    "pair_mention_trends": {},
    "seasonal_patterns": {"entity_name": RED},
    "mention_velocity": {"top_n_entities": 5, "entity_type": "ORG"},
    "affiliation_strength_evolution": {"entity_name": RED},
    "emerging_relationships": {
        "recent_period_days": 90,
        "historical_period_days": 365,
        "as_of": "2001-08-01",
        "entity_type": "PERSON",
    },
    "pair_sentiment": {"min_co_mentions": 2},
    "relationships_by_sentiment": {"min_co_mentions": 3, "entity_type": "PERSON"},
    "sentiment_network": {"min_co_mentions": 2, **PERIOD},
    "sentiment_correlation": {"min_common_sources": 5},
    "sentiment_contrast": {"min_sources": 3, "entity_type": "LOC"},
    "pair_sentiment_change": {"min_monthly_mentions": 2},
    "sentiment_clusters": {"min_mentions": 3},
}
