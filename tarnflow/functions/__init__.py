"""Column functions that the operators share, under one roof."""

from tarnflow.operators.gating import seconds
from tarnflow.operators.recovery import is_fatal
from tarnflow.operators.tensors import flatten_outputs, header_units, valid_backend, valid_inputs
from tarnflow.operators.timestamps import rescale, time_base, valid_time
from tarnflow.operators.vision import best_class, corners, letterbox, merge_detections, normalise, nv12_to_rgb, restore

__all__ = [
    "best_class", "corners", "flatten_outputs", "header_units", "is_fatal", "letterbox", "merge_detections",
    "normalise", "nv12_to_rgb", "rescale", "restore", "time_base", "valid_backend", "valid_inputs", "valid_time",
]
