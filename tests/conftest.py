import pytest

from tests.support import DATA, duck, session


@pytest.fixture(scope="session")
def spark():
    spark = session("4")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def con(sf_dir):
    return duck(sf_dir)
