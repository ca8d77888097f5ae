"""Answer-corpus analytics on Spark: build, extend, score and profile corpora
that mix human-written and model-generated answers."""

__version__ = "0.2.0"
