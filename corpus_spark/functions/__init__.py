from corpus_spark.functions.arrays import *  # noqa: F401,F403
from corpus_spark.functions.text import *  # noqa: F401,F403
