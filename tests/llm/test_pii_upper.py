import pytest

from tubeql.llm import pii


@pytest.mark.parametrize("word", ["TOKEN = ", "PASSWORD=", "API_KEY=", "Secret: "])
def test_keywords_in_any_case(spark, word):
    value = "9233A8ECB3ED3CC8548923D6"
    row = pii.pseudonymise(spark.createDataFrame([(1, f'A {word}"{value}" B')], "doc_id long, text string"), "k1").first()
    assert value not in row.text and row.text.startswith(f'A {word}"')
