import pytest

pytest.importorskip("asterweave.llm.queries")
