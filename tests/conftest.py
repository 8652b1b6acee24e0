import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vecspark.session import tuned  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = tuned(SparkSession.builder.master("local[4]").appName("tests")
              .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
              .config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "4")
              .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


def rows(df, *order):
    out = df.toPandas()
    plain = [c for c in out.columns if not (len(out) and isinstance(out[c].iloc[0], np.ndarray))]
    return out.sort_values(list(order or plain), ignore_index=True)


def vectors(spark, mat, ids=None):
    ids = range(len(mat)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, mat)],
                                 "id bigint, vec array<double>")
