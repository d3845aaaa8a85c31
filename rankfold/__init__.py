"""rankfold: offline recommender evaluation on Spark DataFrames.

Interaction logs in, global-time splits, top-k lists and ranking metrics out.
Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
builds a lazy plan; nothing is collected to the driver except scalar choices
(the winning hyperparameter) and explicit report writes.
"""

from rankfold.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
