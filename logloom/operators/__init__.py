"""DataFrame operators: lazy, ``DataFrame -> DataFrame``."""
