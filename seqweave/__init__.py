"""Discovery of activities in sequences of discrete events, expressed as Spark plans."""
