"""What tasks keep in a reused Python worker."""

import re
import sys
from pathlib import Path

import pytest

from tarn.llm.common import cache_of


def resident():
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc and counts on glibc")
def test_dropped_tables_do_not_stay_in_memory():
    cache_of("one")["table"] = [bytes(1000) for _ in range(100_000)]
    cache_of("one")["last"] = last = bytes(1000)  # behind the table, so that the heap's end is in use
    full = resident()
    assert "table" not in cache_of("another") and last
    assert resident() < full - 70
