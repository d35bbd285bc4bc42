"""Declared schemas and the column lists the operators share."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


# The column names of the input tables and of the features.


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


ARTICLE_ATTRIBUTES = [
    "product_type_name",
    "product_group_name",
    "colour_group_name",
    "department_name",
    "index_name",
    "section_name",
    "garment_group_name",
]
CUSTOMER_ATTRIBUTES = [
    "FN",
    "Active",
    "club_member_status",
    "fashion_news_frequency",
    "age_interval",
    "postal_code",
]
# Of the customer columns those whose number of values is fixed, however many customers there are.
CUSTOMER_FEW = ["FN", "Active", "club_member_status", "fashion_news_frequency", "age_interval"]
ARTICLE_CATEG = ["article_id", *ARTICLE_ATTRIBUTES]
CUSTOMER_CATEG = ["customer_id", *CUSTOMER_ATTRIBUTES]
CUSTOMER_CONTI = ["age"]
TRANSACTION_CONTI = ["price"]
LABEL = "bought"
ROLLING_FEATURES = [
    "customer_daily_spend",
    "customer_daily_articles",
    "customer_spend_30d",
    "customer_articles_30d",
    "days_since_last_customer_trans",
]

# Facet key of a feed request -> article column.
FACETS = {
    "product_type": "product_type_name",
    "product_group": "product_group_name",
    "department": "department_name",
    "colour_group": "colour_group_name",
    "graphical_appearance": "graphical_appearance_name",
}

TRANSACTIONS = StructType(
    [
        StructField("t_dat", DateType()),
        *_strings("customer_id", "article_id"),
        StructField("price", DoubleType()),
        StructField("sales_channel_id", IntegerType()),
    ]
)
ARTICLES = StructType(
    _strings("article_id", "prod_name", *ARTICLE_ATTRIBUTES, "graphical_appearance_name", "detail_desc")
)
CUSTOMERS = StructType(
    [
        *_strings("customer_id", "FN", "Active", "club_member_status", "fashion_news_frequency"),
        StructField("age", DoubleType()),
        *_strings("postal_code"),
    ]
)
SEARCH_RESULT = StructType(
    [*_strings("article_id", "detail_desc"), StructField("similarity", DoubleType())]
)
