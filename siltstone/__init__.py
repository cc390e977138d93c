"""siltstone: Spark-native operators for retrieval and text-data pipelines.

Everything is a ``DataFrame -> DataFrame`` function built from Spark
expressions; Python runs only inside Arrow batches where no built-in exists.
The optional subpackage ``siltstone.llm`` holds the training-data operators;
nothing else imports it.
"""

from siltstone import functions, operators, sources, streaming
from siltstone.settings import Settings

__all__ = ["Settings", "functions", "operators", "sources", "streaming"]
__version__ = "0.2.0"
