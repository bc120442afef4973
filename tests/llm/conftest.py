import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest


@pytest.fixture(autouse=True)
def pseudonym_key(request):
    """The key that calls without one take from the session."""
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").conf.set("spark.manifestry.pseudonym.key", "a key of the tests")
