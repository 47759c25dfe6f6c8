"""Column -> Column functions."""


def register_functions(spark) -> None:
    """Make the Python-backed functions callable from SQL: scalar ones, and the table functions
    card_rows, link_rows and jsonld_offers for LATERAL. Functions that stay inside the JVM are
    created by `sql.create_functions`."""
    from ..sources import page_parts, page_tables
    from . import urls
    spark.udf.register("absolute_url", urls.absolute_url)
    spark.udf.register("page_cards", page_parts.cards)
    spark.udf.register("page_links", page_parts.links)
    spark.udf.register("jsonld_variants", page_parts.variants)
    spark.udf.register("page_state", page_parts.state_text)
    page_tables.register_table_functions(spark)
