"""The derived survey and its companion taxonomy and dictionary.

One response per order; each answer is picked from a bank by arithmetic on the order's keys, so the survey grows with the
supplied tables and the same rule is easy to state in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatim.functions import literals
from verbatim.operators.keyword import KeywordIndex
from verbatim.sources.dictionary import TextDictionary
from verbatim.sources.survey import spread

TEXT_COLUMNS = ["Free_Text_1", "Free_Text_2", "Free_Text_3"]

BANK: list[str | None] = [
    "No",
    "n/a",
    "Yes thanks",
    "as above",
    "   ",
    None,
    "Nothing to add",
    "All good",
    "Delivery was late but the courier was friendly",
    "Checkout keeps failing on my phone",
    "Great prices and quick refunds",
    "The packaging was damaged, however support replaced it fast",
    "I would like more delivery slots",
    "Prices are too high although quality is good",
    "Staff were helpful and polite",
    "The app is slow while searching",
    "late delivery again",
    "refund took three weeks",
    "Talking to friends and yoga helped me cope",
    "I do not have time for a break",
    "Damaged box and late delivry",
    "Lorem placeholder answer with nothing to classify",
    "Café queue was long – très long",
    "good but not cheap yet reliable",
]

THEMES = {
    "themes": {
        "Delivery": {
            "parent_theme": "Operations",
            "subthemes": [
                {"name": "Late delivery", "default_polarity": "Negative",
                 "keywords_phrases": ["late delivery", "delivery was late", "arrived late", "late"]},
                {"name": "Delivery slots", "default_polarity": "Neutral",
                 "likely_columns": ["Free_Text_2", "Free_Text_3"],
                 "keywords_phrases": ["delivery slots", "more slots", "time slot"]},
            ],
        },
        "Product": {
            "subthemes": [
                {"name": "Packaging damage", "default_polarity": "Negative",
                 "keywords_phrases": ["packaging was damaged", "damaged box", "damaged"]},
                {"name": "Quality", "default_polarity": "Positive",
                 "keywords_phrases": ["quality is good", "good quality", "quality good", "reliable"]},
            ],
        },
        "Price": {
            "parent_theme": "Commercial",
            "subthemes": [
                {"name": "Too expensive", "default_polarity": "Negative",
                 "keywords_phrases": ["too high", "prices are too high", "not cheap", "expensive"]},
                {"name": "Good value", "default_polarity": "Positive",
                 "keywords_phrases": ["great prices", "good value", "value for money", "cheap"]},
            ],
        },
        "Service": {
            "parent_theme": "People",
            "subthemes": [
                {"name": "Staff attitude", "default_polarity": "Positive", "allowed_columns": ["Free_Text_1"],
                 "keywords_phrases": ["helpful and polite", "courier was friendly", "friendly", "staff were helpful"]},
                {"name": "Refunds", "default_polarity": "Either",
                 "keywords_phrases": ["quick refunds", "refund took", "refund"]},
                {"name": "Queue", "default_polarity": "Negative",
                 "keywords_phrases": ["queue was long", "café queue", "long – très long"]},
            ],
        },
        "App": {
            "parent_theme": "Digital",
            "subthemes": [
                {"name": "Checkout", "default_polarity": "Negative",
                 "keywords_phrases": ["checkout keeps failing", "failing checkout", "pay-by-phone", "checkout"]},
                {"name": "Speed", "default_polarity": "Negative",
                 "keywords_phrases": ["app is slow", "slow app", "app slow", "slow"]},
            ],
        },
        "Wellbeing": {
            "subthemes": [
                {"name": "Coping", "keywords_phrases": ["talking to friends", "talking friends", "yoga helped", "yoga"]},
                {"name": "Time pressure", "default_polarity": "Negative",
                 "keywords_phrases": ["do not have time", "not have time", "no time", "break"]},
            ],
        },
    }
}

DICTIONARY = {
    "BUSINESS_MAP": {"courier": "delivery driver", "checkout": "payment page", "support": "service team",
                     "driver": "person",
                     "of the": "from the", "und": "and", "que": "what"},
    "MERGE_TO_CANONICAL": {"delivry": "delivery", "refunds": "refund", "app": "mobile app", "le": "la", "der": "die"},
    "FORCE_PHRASES": ["late_delivery", "payment_page", "delivery_slots", "help desk", "quality is good",
                      "in_the", "de_la"],
    "UNIGRAM_WHITELIST": ["no", "too", "is"],
    "DOMAIN_WHITELIST": ["app"],
    "ACCRONYM_WHITELIST": ["UK"],
    "ALWAYS_DROP_UNIGRAMS": ["again", "the", "and"],
    "ALWAYS_BLOCK": ["keeps"],
    "MUST_BE_PHRASE": ["phone", "weeks"],
}

# Themes over the invented prose of the documents table, whose words are frequent in one of its four languages.
DOCUMENT_THEMES = {
    "themes": {
        "English": {
            "parent_theme": "Germanic",
            "subthemes": [
                {"name": "Articles", "default_polarity": "Neutral",
                 "keywords_phrases": ["of the", "to the", "in the", "the"]},
                {"name": "Conjunctions", "keywords_phrases": ["and the", "that the", "with", "by"]},
            ],
        },
        "German": {
            "parent_theme": "Germanic",
            "subthemes": [
                {"name": "Articles", "default_polarity": "Neutral",
                 "keywords_phrases": ["und der", "und die", "der die", "der"]},
                {"name": "Verbs", "keywords_phrases": ["ist ein", "ist"]},
            ],
        },
        "French": {
            "parent_theme": "Romance",
            "subthemes": [
                {"name": "Articles", "default_polarity": "Neutral",
                 "keywords_phrases": ["que le", "de la", "dans les", "les"]},
                {"name": "Conjunctions", "keywords_phrases": ["et le", "est un", "pour"]},
            ],
        },
        "Spanish": {
            "parent_theme": "Romance",
            "subthemes": [
                {"name": "Articles", "default_polarity": "Neutral",
                 "keywords_phrases": ["el la", "de los", "los de", "los"]},
                {"name": "Conjunctions", "keywords_phrases": ["que el", "y el", "para"]},
            ],
        },
    }
}

SENTIMENT_WEIGHTS = {"Free_Text_1": 0.50, "Free_Text_2": 0.30, "Free_Text_3": 0.20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bank_text(position: Column) -> Column:
    return literals.element(BANK, position.cast("int"), "string")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide survey, one row per order."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    answers = [
        bank_text((key * (2 * k + 1) + cust * k) % len(BANK)).alias(c) for k, c in enumerate(TEXT_COLUMNS, start=1)
    ]
    return orders.select(
        key.alias("ID"),
        *answers,
        F.date_format("o_orderdate", "yyyy-MM").alias("survey_period"),
        (cust % 10 + 1).alias("score"),
        cust.alias("customer"),
    )


def survey_with_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment")
    )
    return survey(spark, sf_dir).join(customers, "customer", "left")


def keyword_index() -> KeywordIndex:
    return KeywordIndex.from_themes(THEMES)


def document_index() -> KeywordIndex:
    return KeywordIndex.from_themes(DOCUMENT_THEMES)


def dictionary() -> TextDictionary:
    return TextDictionary.from_config(DICTIONARY)


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the supplied tables and every answer of the survey, whole."""
    documents = spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), "text"
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "text"
    )
    each = [F.struct(F.lit(f"-{k}").alias("k"), F.col(c).alias("text")) for k, c in enumerate(TEXT_COLUMNS, start=1)]
    answers = survey(spark, sf_dir).select("ID", F.explode(F.array(*each)).alias("a")).select(
        F.concat(F.lit("s"), F.col("ID").cast("string"), F.col("a.k")).alias("key"), F.col("a.text").alias("text")
    )
    return documents.unionByName(turns).unionByName(answers)


def documents_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, as unflagged answers; the language stands for the text column."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("ID"),
        F.col("lang").alias("TextColumn"),
        F.col("text"),
        F.lit(None).cast("boolean").alias("is_meaningful"),
        F.lit(None).cast("string").alias("response_detail"),
    )
