"""What the driver keeps of the machine's memory."""

import re
from pathlib import Path

from lodestrata.llm.common import materialize, tidy


def test_the_drivers_jvm_hands_back_what_is_free_in_its_c_heap(spark):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)

    def kept(after) -> int:
        """MB of 125 that are still the JVM's after they are freed, but for the last piece, and `after` has run."""
        pieces = [unsafe.allocateMemory(64 << 10) for _ in range(2000)]
        for p in pieces:
            unsafe.setMemory(p, 64 << 10, 1)
        full = int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1])
        for p in pieces[:-1]:
            unsafe.freeMemory(p)
        after()
        now = int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1])
        unsafe.freeMemory(pieces[-1])
        return 125 - (full - now) // 1024

    materialize(spark.range(10)).count()
    assert kept(lambda: tidy(spark)) < 60
    assert kept(lambda: materialize(spark.range(10))) < 60
