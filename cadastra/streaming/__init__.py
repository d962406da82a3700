"""Stream forms of the stateful rules. Sources are file streams run with ``availableNow``."""
