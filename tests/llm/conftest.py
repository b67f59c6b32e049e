import pytest

pytest.importorskip("bullgauge.llm")
