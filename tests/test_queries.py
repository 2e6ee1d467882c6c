"""Every registered query that SQL can state, against that SQL."""

import pytest

from loomwright.plans import catalog, dimensions, exact, models, more, networks, ordered, quality, records, registry, reports, searches, world  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(name, same):
    same(name)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_all_have_sql():
    """But for stems, which test_text_functions.py holds against plain loops."""
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"rouge_1_stemmed"}
