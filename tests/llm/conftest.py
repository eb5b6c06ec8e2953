import pytest


@pytest.fixture(scope="session")
def vocabulary():
    from weftgraph.llm.tokens import default_vocabulary

    return default_vocabulary()
