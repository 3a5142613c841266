from corpus_spark.operators.metrics import *  # noqa: F401,F403
from corpus_spark.operators.order import *  # noqa: F401,F403
from corpus_spark.operators.packing import *  # noqa: F401,F403
from corpus_spark.operators.schema import *  # noqa: F401,F403
from corpus_spark.operators.subwords import *  # noqa: F401,F403
from corpus_spark.operators.tokens import *  # noqa: F401,F403
from corpus_spark.operators.udf import *  # noqa: F401,F403
from corpus_spark.operators.vectors import *  # noqa: F401,F403
