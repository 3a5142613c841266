from corpus_spark.streaming.clean import *  # noqa: F401,F403
