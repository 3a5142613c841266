from corpus_spark.plans.classify import *  # noqa: F401,F403
from corpus_spark.plans.clean import *  # noqa: F401,F403
from corpus_spark.plans.evaluate import *  # noqa: F401,F403
from corpus_spark.plans.training import *  # noqa: F401,F403
