import os

import pytest

from strataflow.llm import common


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="needs /proc")
def test_memory_of_a_task_goes_back():
    last = []

    def run(batches):
        for batch in batches:
            parts = [os.urandom(4_000) for _ in range(50_000)]
            last.append(bytearray(4_000))  # keeps the heap's end in use
            yield len(parts)

    before = resident()
    assert list(common.giving_back(run)(iter([1]))) == [50_000]
    assert resident() - before < 100_000_000
