"""modelwatch: Spark-native monitoring of binary classifiers and the tables they run on.

Every operator takes DataFrames and returns DataFrames. Nothing is collected to the
driver except documented per-column scalars (fitted imputation / clip / scaler values),
whose count is bounded by the schema, never by the data.
"""

from modelwatch.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
