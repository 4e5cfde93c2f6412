"""Diversity clusters from scalar rules, without comparing items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pose_cell, session_key, signature, visual_vector


def clustered(items: DataFrame) -> DataFrame:
    """pose, scene, appearance and session clusters and the visual vector of items with path, yaw, pitch, scene_vec and appearance_vec."""
    scene, appearance = F.concat(F.lit("scene_"), signature(F.col("scene_vec"))), F.concat(F.lit("appearance_"), signature(F.col("appearance_vec")))
    return items.withColumns({
        "pose": pose_cell(F.col("yaw"), F.col("pitch")), "scene": scene, "appearance": appearance,
        "session": session_key(F.col("path"), scene, appearance), "visual_vec": visual_vector(F.col("scene_vec"), F.col("appearance_vec"))})
