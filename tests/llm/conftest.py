from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def model_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json")
