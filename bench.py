"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Headline: the full training run of the reference's best configuration
(20 features, 26 epochs, decay 0.9, λ 0.1) by block-stratified SGD,
plus MLlib ALS and the relational / evaluation queries around it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    epochs = int(os.environ.get("BENCH_EPOCHS", "26"))
    from pyspark.sql import functions as F

    from latentforge import catalog
    from latentforge.operators import prep
    from latentforge.plans import als as als_plan
    from latentforge.plans import evaluate as ev
    from latentforge.plans import factors as fac
    from latentforge.plans import sgd
    from latentforge.session import build_session

    spark = build_session(f"local[{cpus}]", cpus, app="latentforge-bench")
    times: dict[str, float] = {}
    extra: dict[str, object] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    relational = ["dedupe_ratings", "dataset_summary", "split_counts", "user_items",
                  "interaction_order", "predict", "rmse", "gradient_step", "als_gram",
                  "rmse_dense", "auroc", "line_contains_count"]
    # a warm-up query first, so that JVM start-up is in no figure
    catalog.QUERIES["dataset_summary"](spark, sf_dir).collect()
    for name in relational:
        timed(name, lambda n=name: catalog.QUERIES[n](spark, sf_dir).write.format("noop")
              .mode("overwrite").save())

    train, test = catalog._stored_split(spark, sf_dir)
    extra["n_train"] = train.count()
    extra["n_test"] = test.count()
    # planted rank-4 ratings on the same pairs: the data to learn from
    from latentforge.session import new_scratch_path, write_table
    from latentforge.sources import synth
    planted = write_table(synth.synth_ratings(
        train.select("user_id", "item_id").unionByName(test.select("user_id", "item_id")),
        rank=4, seed=1), new_scratch_path(spark, "planted"))
    ptrain, ptest = prep.train_test_split(planted, 0)
    extra["planted_rating_sd"] = round(float(planted.agg(F.stddev("rating")).first()[0]), 5)

    def held_out(model, data, p):
        r = ev.rmse(ev.score(data, model.user_factors, model.item_factors, model.mu, p.k,
                             biased=p.biased)).first()
        return round(float(r["rmse"]), 5)

    # the logged configurations of the baseline; block count by the default
    best = fac.SgdParams(k=20, epochs=epochs, lr=0.1, lr_bias=0.5, lam=0.1, bias_reg=0.1,
                         decay=0.9)
    runs = {"fit_sgd_26_epochs": best,
            "fit_sgd_unbiased": fac.SgdParams(**{**best.__dict__, "biased": False}),
            "fit_sgd_planted_10_epochs": fac.SgdParams(k=8, epochs=10, lr=0.05, lr_bias=0.02,
                                                       lam=0.02, bias_reg=1.0, decay=1.0)}
    for name, p in runs.items():
        data, held = (ptrain, ptest) if "planted" in name else (train, test)
        model = timed(name, lambda d=data, q=p: sgd.fit_sgd(d, q))
        extra[name + "_blocks"] = model.blocks
        extra[name + "_epoch_seconds"] = model.epoch_seconds
        extra[name + "_test_rmse"] = held_out(model, held, p)
    extra["planted_test_rmse"] = extra["fit_sgd_planted_10_epochs_test_rmse"]

    def books_run():
        enc, _ = prep.encode_items(prep.explicit_ratings(catalog._books(spark, sf_dir)), "isbn")
        r = prep.dedupe_ratings(enc.select("user_id", "item_id",
                                           F.col("rating").cast("double")), order=["rating"])
        btrain, _ = prep.train_test_split(r, 0)
        return sgd.fit_sgd(btrain, fac.SgdParams(k=10, epochs=10, lr_bias=0.01, decay=1.0))
    timed("fit_sgd_books_parallel", books_run)

    def als_run(tr, te):
        m = als_plan.fit_als(tr, rank=10, reg=0.1, max_iter=10, blocks=cpus)
        return round(float(ev.rmse_nan_safe(als_plan.als_predict(m, te)).first()["rmse"]), 5)
    extra["als_test_rmse"] = timed("fit_als_10_iter", lambda: als_run(train, test))
    extra["als_planted_test_rmse"] = timed("fit_als_planted", lambda: als_run(ptrain, ptest))

    timed("user_permutation", lambda: prep.user_permutation(train, 0).agg(F.count(F.lit(1))).first())
    total = round(sum(times.values()), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else sf_dir,
                      "cpus": cpus, **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
