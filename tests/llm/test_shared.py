"""Intermediate tables and the filters made from them."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest

from counterfoil.llm import page_extraction, shared


@pytest.mark.parametrize("write", [shared.stored, lambda df: shared.bucketed(df, "id", 2)])
def test_no_shuffle_files_stay_behind_a_table(spark, monkeypatch, write):
    """Not even before the driver collects its garbage."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before, left = shuffled(), []

    class Collector:
        def collect(self):
            for _ in range(50):
                left[:] = shuffled() - before
                if not left:
                    break
                time.sleep(0.1)

    monkeypatch.setattr(shared, "gc", Collector())
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key)
    frame = spark.range(1000).repartition(3).join(spark.range(500, 2000).hint("merge"), "id").groupBy("id").count()
    assert write(frame).count() == 500
    assert left == []
    assert spark.conf.get(key) == held


def test_filters_hold_the_upper_bits_of_fingerprints(spark):
    prints = np.random.default_rng(5).integers(0, 2**64, 20000, dtype=np.uint64)
    cut = (prints[:5000] >> np.uint64(page_extraction.CUT)).view(np.int64)
    marks = page_extraction._marks(spark.createDataFrame(pa.table({"head": cut}).to_pandas())).value
    known = page_extraction._marked(marks, prints)
    assert known[:5000].all() and known[5000:].mean() < 0.02
    low = prints[:5000] ^ np.uint64(2**page_extraction.CUT - 1)
    assert page_extraction._marked(marks, low).all()
