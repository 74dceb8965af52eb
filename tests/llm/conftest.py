import random

import pytest


@pytest.fixture
def rng():
    return random.Random(17)


@pytest.fixture(scope="session")
def prose():
    """Word lists of four invented languages."""
    ends = {"en": ("ing", "tion", "ly", "the"), "de": ("ung", "keit", "lich", "sch"), "fr": ("eux", "ment", "ique", "ère"), "es": ("ción", "mente", "ado", "ñe")}
    heads = {"en": ("th", "wh", "st"), "de": ("ge", "ver", "ü"), "fr": ("ou", "é", "ch"), "es": ("ll", "qu", "ó")}
    return {k: [h + m + e for h in heads[k] for m in ("", "an", "or") for e in v] for k, v in ends.items()}
