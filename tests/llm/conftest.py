import pytest


@pytest.fixture(scope="session")
def tables(spark):
    return lambda name, sf="0.001": spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")


@pytest.fixture()
def arrow_maps(spark, monkeypatch):
    """(frame, function) of every ``mapInArrow`` that is asked for."""
    kind, asked = type(spark.range(1)), []
    given = kind.mapInArrow

    def spy(frame, function, *rest, **named):
        asked.append((frame, function))
        return given(frame, function, *rest, **named)

    monkeypatch.setattr(kind, "mapInArrow", spy)
    return asked
