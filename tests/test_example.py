"""The end-to-end offline build example runs on the smallest scale."""

import os
import sys

from tests.conftest import SF_SMALL


def test_offline_build_example(spark, tmpdir_path):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples"))
    import offline_build
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(offline_build)  # workers do not have examples/ on their path
    n = offline_build.main(SF_SMALL, tmpdir_path)
    assert n == 20  # the stub judge rejects the 20 aggregate statements of 40
    assert os.path.isdir(os.path.join(tmpdir_path, "vectors"))


def test_online_eval_example(spark):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples"))
    import online_eval
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(online_eval)
    s = online_eval.main(SF_SMALL)
    assert s["n"] > 0 and s["mean_em"] == 1.0 and s["mean_rougeL_f1"] == 1.0
