import pytest

from corpusloom.llm import language


@pytest.fixture(scope="session")
def profiles(spark, sf):
    """Profiles fitted on the smallest tables."""
    return language.fit_on(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/language_codes.parquet"))
