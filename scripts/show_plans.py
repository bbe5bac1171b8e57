"""Write the physical plans of the headline operators to PLANS.md."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def tree(df) -> str:
    """The operator tree of ``explain('formatted')`` (no per-node details)."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().split("\n\n\n")[0].strip()


def main():
    from pyspark.sql import functions as F

    from latentforge import catalog
    from latentforge.plans import factors as fac
    from latentforge.plans import sgd
    from latentforge.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    out = ["# Physical plans of headline operators", "",
           f"Generated by `scripts/show_plans.py` at `{sf}` (local[8], AQE on).", ""]
    for name, note in [
        ("dedupe_ratings", "pruned scans, broadcast of the smaller join side chosen by AQE, "
                           "partial + final aggregate"),
        ("predict", "prediction is a JVM expression (no Python node)"),
        ("gradient_step", "ratings joined once, a row per side, fixed-width sums with partial aggregation"),
        ("als_gram", "K² fixed-width sums per item, partial aggregation"),
        ("rmse_dense", "Gram identity: no cartesian product"),
        ("auroc", "group by score, distributed prefix sum"),
    ]:
        df = catalog.QUERIES[name](spark, sf)
        out += [f"## {name}", "", note, "", "```", tree(df), "```", ""]
    # one SGD stratum, as fit_sgd builds it
    train, _ = catalog._split(spark, sf)
    p = fac.SgdParams(k=8)
    prep = sgd.prepare(train)
    uf, itf = (f.withColumn("n_updates", F.lit(0).cast("long"))
               for f in fac.init_model(prep.base, p))
    f = sgd._expand(uf, None, "u", prep).unionByName(sgd._expand(itf, None, "i", prep))
    stage = sgd.stratum_step(f, prep.ratings, prep, 1, sgd._make_step(3.0, p, 0, prep.n))
    out += ["## fit_sgd: one stratum", "",
            "The rating side reads the files of its stratum (PartitionFilters); both sides are "
            "dealt to one group per block; the label table has B rows.", "",
            "```", tree(stage), "```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
