"""Layouts of more numbers than one task may hold."""

import numpy as np
import pytest

from matloom.operators import layout

from test_layout_rounds import graph, places


def test_large_layouts_are_made_by_rounds(spark, monkeypatch):
    g, start = graph(spark)
    how = {"epochs": 6, "negatives": 0, "a": 1.3, "b": 0.8}
    one = places(layout.layout(g, start, **how))
    monkeypatch.setattr(layout, "LIMIT", 100)
    assert np.allclose(places(layout.layout(g, start, **how)), one, atol=1e-9)
    with pytest.raises(ValueError):
        layout.layout(g, start, optimizer="sgd", at_once=3, **how)


@pytest.mark.parametrize("method, optimizer", [("umap", "adam"), ("largevis", "sgd")])
def test_places_on_the_driver_or_in_a_table(spark, monkeypatch, method, optimizer):
    """With edges of nodes that have no place, which both leave out."""
    g, start = graph(spark)
    g = g.union(spark.createDataFrame([(0, 99, 0.9), (98, 3, 0.9), (98, 99, 0.9)], g.schema))
    how = {"method": method, "optimizer": optimizer, "epochs": 5, "negatives": 3, "pool": 9, "seed": 4, "rounds": True, "rate": 0.3}
    held = places(layout.layout(g, start, **how))
    monkeypatch.setattr(layout, "PLACES", 0)
    assert held.shape == (25, 2) and np.allclose(held, places(layout.layout(g, start, **how)), atol=1e-9)
