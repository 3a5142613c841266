from corpus_spark.sources.readers import *  # noqa: F401,F403
from corpus_spark.sources.sinks import *  # noqa: F401,F403
