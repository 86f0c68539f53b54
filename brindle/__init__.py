"""Brindle: sketches, counters and expiring keyed state as Spark DataFrame operators."""
