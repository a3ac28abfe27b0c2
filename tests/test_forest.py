"""Bootstrap counts of the tree ensembles, summed by equal inputs."""

import numpy as np
import pandas as pd

from gramlake.operators.models import forest_cells


def test_cells_hold_every_row_and_poisson_counts(spark):
    r = np.random.default_rng(3)
    rows = pd.DataFrame({"k": np.arange(20_000), "a": r.integers(0, 3, 20_000).astype(float), "b": r.integers(0, 2, 20_000).astype(float), "v": r.random(20_000)})
    df = spark.createDataFrame(rows)
    got = forest_cells(df, ["a", "b"], "v", ["k"], 4).toPandas().sort_values(["tree", "a", "b"]).reset_index(drop=True)
    want = rows.groupby(["a", "b"])["v"].agg(["size", "mean"])
    whole = got[got["tree"] == -1]
    assert (whole["n"].to_numpy() == want["size"].to_numpy()).all() and np.allclose(whole["y"], want["mean"].to_numpy())
    boot = got[got["tree"] >= 0]
    assert len(boot) == 4 * len(want)
    n, size = boot["n"].to_numpy().reshape(4, -1), want["size"].to_numpy()
    assert (np.abs(n - size) < 5 * np.sqrt(size)).all() and len({tuple(t) for t in n}) == 4  # each tree draws for itself
    one = forest_cells(df, ["k"], "v", ["k"], 1).where("tree = 0").toPandas()["n"].to_numpy()  # rows of their own: the counts themselves
    assert abs(len(one) / 20_000 - (1 - np.exp(-1))) < 0.02 and abs((one**2).sum() / 20_000 - 2) < 0.1
    again = forest_cells(df.repartition(7), ["a", "b"], "v", ["k"], 4).toPandas().sort_values(["tree", "a", "b"])
    assert (again["n"].to_numpy() == got["n"].to_numpy()).all()
