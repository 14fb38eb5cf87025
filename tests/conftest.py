import pytest

from patchloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture
def heavy(spark):
    """Treat every group of three rows or more as heavy."""
    spark.conf.set("patchloom.heavyRows", "3")
    yield
    spark.conf.unset("patchloom.heavyRows")


@pytest.fixture
def rows():
    """Sorted tuples of a DataFrame's rows."""
    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)
    return collect
