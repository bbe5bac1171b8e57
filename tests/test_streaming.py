"""Streaming: the file stream source scored against a static model."""

import tempfile

from latentforge.plans import evaluate as ev
from latentforge.plans import factors as fac
from latentforge.streaming import read_rating_stream, running_rmse, score_stream


def test_stream_scoring_matches_batch(spark):
    tmp = tempfile.mkdtemp(dir="/tmp", prefix="lf-stream-")
    lines = [f"{u}::{i}::{(u * i) % 5 + 1}.0::{u * 10 + i}" for u in range(1, 6)
             for i in range(1, 5)] + ["bad::line", "1::3::::11"]
    with open(f"{tmp}/part-0.dat", "w") as f:
        f.write("\n".join(lines) + "\n")
    stream = read_rating_stream(spark, tmp)
    batch = spark.createDataFrame(
        [(u, i, float((u * i) % 5 + 1)) for u in range(1, 6) for i in range(1, 5)],
        "user_id long, item_id long, rating double")
    uf, itf = fac.init_model(batch.where("user_id < 5"), fac.SgdParams(k=3))
    q = (running_rmse(score_stream(stream, uf, itf, 3.0)).writeStream
         .outputMode("complete").format("memory").queryName("lf_stream_rmse").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM lf_stream_rmse").first()
    ref = ev.rmse(ev.score(batch, uf, itf, 3.0, 3)).first()
    assert got.n == ref.n == 20
    assert abs(got.rmse - ref.rmse) < 1e-12
