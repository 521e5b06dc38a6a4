"""weftline: a PySpark-native analytics engine.

Composable DataFrame operators (``weftline.operators``), column functions
(``weftline.functions``), connectors (``weftline.sources`` / ``weftline.sinks``),
stateful streams (``weftline.streaming``) and a catalogue of named queries
(``weftline.plans``).  Operators for training-text pipelines live in the
optional subpackage ``weftline.llm``; nothing outside it imports it.
"""

__version__ = "0.1.0"
