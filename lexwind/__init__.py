"""Speech-corpus analytics on Spark: number verbalisation, text cleaning, tokens, ingest, batching and synthesis planning."""
