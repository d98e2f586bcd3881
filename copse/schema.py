"""Schemas of the model, edge and result tables."""

from __future__ import annotations

MODEL = (
    "model_id string, round int, output int, tree_id int, node_id long, depth int, is_leaf boolean, feature int, threshold double, "
    "bin int, left_id long, right_id long, value double, samples long, weight double, class_weights array<double>, gain double, lower double, upper double"
)
EDGES = "feature int, bin int, edge double"
PROXIMITY = "i long, j long, prox double"
SHAP = "row_id long, output int, feature int, phi double"
