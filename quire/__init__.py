"""quire: a Spark-native document engine.

Files are classified and routed, turned into page text, assembled into
documents and prompts, sent through pluggable completion functions, and kept
in a versioned document/page store. Every operator is a plain
``DataFrame -> DataFrame`` function; see ``quire.plans.catalog`` for the
registered queries.
"""

__version__ = "0.1.0"
