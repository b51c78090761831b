"""Shared by the tests of the training-data operators."""

from pyspark.sql import functions as F

NAMES = "size kept copies fp key part cell bucket spans base shard salt _key _c0 tokens n_words start component_id at node g w".split()


def clashing(df):
    """The same rows with more columns whose names clash with the engine's own."""
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])
