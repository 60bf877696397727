"""Station-panel analytics expressed as Spark DataFrame operators."""

KEYS = ["region", "station"]
