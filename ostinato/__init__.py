"""ostinato: analysis of performance recordings (series, notes, takes, video) on Spark."""
