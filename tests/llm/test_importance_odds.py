import numpy as np
import pyarrow as pa
from helpers import rows, table

from lodestone.llm import importance


def test_log_weight_is_the_log_ratio_of_the_models(spark):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(24)], "doc_id long, quality int, toxic int")
    data = rows()
    docs, grams = importance._features(pa.array([r[1] for r in data], pa.string()))
    good = np.array([r[0] is not None and r[0] < 24 and r[0] % 2 == 1 for r in data])
    raw, target = np.bincount(grams, minlength=importance.BUCKETS) + 1.0, np.bincount(grams[good[docs]], minlength=importance.BUCKETS) + 1.0
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = np.bincount(docs, ratio[grams], minlength=len(data))
    got = importance.resample(table(spark, data), labels).collect()
    assert np.allclose(sorted(r.log_weight for r in got), sorted(want), atol=1e-9)
