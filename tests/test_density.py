"""Log densities far from the data, against a plain log-sum-exp."""

import numpy as np
import pytest

from orbitsieve.operators import density


def plain(points, mesh, width):
    e = -((points[:, None, :] - mesh[None]) ** 2).sum(2) / (2 * width * width)
    top = e.max(0)
    norm = np.log(len(points)) + points.shape[1] * np.log(np.sqrt(2 * np.pi) * width)
    return top + np.log(np.exp(e - top).sum(0)) - norm


@pytest.mark.parametrize("width", [0.003, 0.01, 0.05, 2.0])
@pytest.mark.parametrize("block", [7, 1 << 15])
def test_log_density_is_finite_and_exact(spark, monkeypatch, width, block):
    monkeypatch.setattr(density, "BLOCK", block)
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(0.1, 0.003, (150, 2)), rng.uniform(0.0, 0.2, (50, 2)), [[0.9, 0.1]], np.full((80, 2), 0.15), [[4.0, -3.0]]])
    df = spark.createDataFrame([*map(tuple, points.tolist()), (None, 0.5), (float("nan"), 0.5)], "x double, y double").repartition(5)
    got, levels = density.kde_grid(df, ["x", "y"], width, 21)
    rows = got.toPandas().sort_values(["ix", "iy"])
    mesh = rows[["x", "y"]].to_numpy()
    assert len(rows) == 441 and np.isfinite(rows["log_density"]).all()
    assert np.allclose(rows["log_density"], plain(points, mesh, width), rtol=1e-9, atol=1e-9)
    assert levels[-1] == pytest.approx(rows["log_density"].max())


def test_one_column(spark):
    x = np.array([0.0, 0.1, 0.1, 5.0])
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x double")
    rows = density.kde_pdf(df, "x", 11, 0.05, (0.0, 5.0)).toPandas().sort_values("k")
    assert np.allclose(rows["density"], np.exp(plain(x[:, None], rows[["x"]].to_numpy(), 0.05)))


def test_no_points(spark):
    df = spark.createDataFrame([], "x double, y double")
    got, levels = density.kde_grid(df, ["x", "y"], 0.1, 5)
    assert got.collect() == [] and levels == []
