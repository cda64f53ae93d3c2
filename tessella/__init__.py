"""Tessella: conversational-memory analytics and corpus preparation on Spark.

Everything is a function from DataFrame to DataFrame.  ``operators`` holds
the relational engine, ``functions`` the Column expressions it is made of,
``sources`` the readers and writers, ``plans`` the partitioning helpers,
``streaming`` the Structured Streaming twins, ``llm`` (optional, nothing else
imports it) the text and vector operators for training data.
"""

__version__ = "0.1.0"
