from matchloom.plans import registry

from .conftest import SMALL


def test_readability_has_the_characters_of_a_sentence(spark):
    """Every measure of the family is a column, the raw one too."""
    rows = registry.QUERIES["readability_scores"](spark, SMALL)
    assert "chars_a_sentence" in rows.columns and rows.where("chars_a_sentence > 0").count() > 0
