"""The driver's contract."""

import __spark_entry__ as contract


def test_flagship_has_rows(spark):
    assert contract.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_core_does_not_import_the_corpus_operators():
    from pathlib import Path

    for path in Path(contract.__file__).parent.glob("sparkloom/**/*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()
