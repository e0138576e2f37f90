import pytest

from redline.llm import common


@pytest.fixture(autouse=True)
def no_wait(monkeypatch):
    """Small tests leave little on the disks: they don't wait for it to go."""
    monkeypatch.setattr(common, "WAIT", 0)
